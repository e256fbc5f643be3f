"""Every registered query outside the training-data subpackage: against its SQL, or that it runs."""

from __future__ import annotations

import pytest
from conftest import SF, same_rows

from lodeworks.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cosine_scan_orders_all_rows(spark, duck, monkeypatch):
    from lodeworks.operators import vectors as V

    nearest = V.nearest
    # A corpus larger than any k, seen from the query: the best by importance lie beyond the nearest.
    monkeypatch.setattr(V, "nearest", lambda corpus, queries, key, vector, k, least=None: nearest(corpus, queries, key, vector, min(k, 5), least))
    same_rows(catalogue.queries()["knw_cosine_scan"](spark, SF), duck, catalogue.oracle_sql()["knw_cosine_scan"])


def test_contradictions_split_a_text_once(spark):
    """The plan holds the pattern of sentence ends once, and none with a choice of words at every letter."""
    plan = catalogue.queries()["txt_contradiction_type"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=") == 1 and "RLIKE" not in plan
