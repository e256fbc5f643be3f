"""What the joins and graph steps move between tasks, with results against plain versions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from lodeworks.operators import graph, vector_index


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_vectors_that_no_cell_rules_out(spark, monkeypatch):
    """Long vectors in all directions: groups are dealt to pairs of blocks, not to the cells that nearly all of them meet."""
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    monkeypatch.setattr(vector_index, "STRETCH", 5)
    monkeypatch.setattr(vector_index, "_cells", lambda *a: pytest.fail("dealt to cells"))
    v = np.random.default_rng(2).normal(size=(300, 40)).astype(np.float32)
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(300)] + [(300, 0, [0.0] * 40), (301, 1, None)], "id long, g int, v array<float>")
    found = {(r["a"], r["b"]): r["sim"] for r in vector_index.similar_pairs(df, "g", "id", "v", 0.2).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    plain = {(a, b): float(u[a] @ u[b]) for a, b in itertools.combinations(range(300), 2) if a % 2 == b % 2 and u[a] @ u[b] >= 0.2}
    assert found.keys() == plain.keys() and all(abs(plain[p] - s) < 1e-9 for p, s in found.items()) and len(plain) > 500


@pytest.fixture
def small(spark):
    nodes = spark.createDataFrame([(i, i / 10) for i in range(8)], "id long, authority double")
    edges = spark.createDataFrame([(a, b, ["supports", "refines", "contradicts"][(a + b) % 3], 0.5 + a / 20) for a in range(8) for b in range(a)], "src long, dst long, relation string, strength double")
    return nodes, edges


def test_paths_over_distinct_edges(spark, small):
    """As without ``once``; only the ends of the last step are joined, and walks are no arrays."""
    nodes, edges = small
    args = (nodes, edges, nodes.where("id < 2"), nodes.where("id > 5"), 3, 0.6)
    rows = lambda df: sorted((tuple(r["nodes"]), r["hops"], round(r["score"], 9)) for r in df.collect())
    assert rows(graph.paths(*args, once=True)) == rows(graph.paths(*args)) != []


def test_distinct_edges_are_not_moved(spark, small):
    nodes, edges = small
    more = edges.union(spark.createDataFrame([(3, 3, "supports", 0.9), (9, 1, "supports", 0.9)], edges.schema))
    added = graph.add_edges(nodes, more.limit(0), more, once=True)
    assert "Exchange hashpartitioning" not in _plan(added)
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, graph.add_edges(nodes, more.limit(0), more).collect()))
    old = spark.createDataFrame([(1, 2, "supports", 0.1)], edges.schema)
    assert sorted(map(tuple, graph.add_edges(nodes, old, more, once=True).collect())) == sorted(map(tuple, graph.add_edges(nodes, old, more).collect()))


def test_names_of_any_length_are_scored(spark):
    """Thousands of capitalised words, or parts of a version, in a row: no stack frame for each."""
    from pyspark.sql import functions as F

    from lodeworks.functions import scores as S

    long = spark.createDataFrame([(0, "Ab " * 20000 + "is it."), (1, "v" + "1." * 20000 + "2 is it."), (2, "See Bob Lee in v1.2.3 now."), (3, "no names in v1x")], "k int, t string")
    got = {r["k"]: (r["d"] > 0.6, r["s"]) for r in long.select("k", S.factual_density(F.col("t")).alias("d"), S.technical_specificity(F.col("t")).alias("s")).collect()}
    assert got == {0: (True, 0.0), 1: (False, 0.4), 2: (True, 0.4), 3: (False, 0.2)}


def test_redundancy_evaluates_signatures_once(spark):
    """Repeated places, null orders and empty signatures as a plain loop has them."""
    from pyspark.sql import functions as F

    from lodeworks.operators import knowledge

    atoms = spark.createDataFrame([("d", 1, "a b c"), ("d", 2, "b c d"), ("d", 2, "b c d e"), ("d", 3, "f"), ("d", 4, ""), ("e", None, "a"), ("e", 1, "a b")], "g string, pos int, t string")
    found = knowledge.running_redundancy(atoms.withColumn("sig", F.expr("filter(split(t, ' '), x -> x <> '')")), "g", "pos", "sig")
    assert _plan(found).count("Join") == 0
    got = sorted((r["g"], r["pos"] or 0, r["own"], r["new"]) for r in found.collect())
    assert got == [("d", 1, 3, 3), ("d", 2, 3, 2), ("d", 2, 4, 2), ("d", 3, 1, 1), ("d", 4, 0, 0), ("e", 0, 1, 0), ("e", 1, 2, 1)]


def test_long_vectors_move_in_bundles(spark, monkeypatch):
    """HDBSCAN of vectors with many components: as in one task, with rows moved to bundles of blocks."""
    from lodeworks.operators import density

    monkeypatch.setattr(density, "BLOCK", 16)
    monkeypatch.setattr(density, "BUNDLES", 4)
    monkeypatch.setattr(density, "_dealt", lambda *a: pytest.fail("moved to each block"))
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 0.1 + 0.1 * (i % 3), (70, 12)) + 3 * rng.normal(size=12) for i in range(4)] + [rng.normal(0, 6, (20, 12))])
    v = np.concatenate([v, v[:5]])
    found = {r["k"]: r["cluster"] for r in density.density_clusters(spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "k long, g int, v array<double>"), "g", "k", "v", 4).collect()}
    labels = density.condensed_labels(len(v), *density.spanning_edges(v, density.core_distances(v, 4)), 4)
    low = {c: int(np.flatnonzero(labels == c)[0]) for c in set(labels.tolist()) - {-1}}
    assert found == {i: low[c] for i, c in enumerate(labels.tolist()) if c >= 0} and len(low) >= 4
