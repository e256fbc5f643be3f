"""Inverted indexes, the activation fold and versioned tables against plain versions."""

from __future__ import annotations

import datetime
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import postings, set_join
from lodeworks.sources.versioned import VersionedTables
from lodeworks.streaming import pipelines


def grams(text: str | None) -> set[str]:
    return {f"  {w} "[i : i + 3] for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w for i in range(len(w) + 1)}


@pytest.mark.parametrize(("least", "scans"), [(0.3, 1e9), (0.6, 1e9), (0.3, 0)])
def test_trigram_search(spark, monkeypatch, tmp_path, least, scans):
    monkeypatch.setattr(set_join, "LIST", 10)
    monkeypatch.setattr(postings, "SCANS", scans)
    rnd = random.Random(2)
    stock = ["thing", "think", "thin", "bring", "spring", "a", "ab", "déjà", "2024", "The"]
    rows = [(f"k{i}", " ".join(rnd.choice(stock) for _ in range(rnd.randint(1, 5)))) for i in range(150)] + [("null", None), ("empty", "?!"), ("same", "thing thing"), ("same2", "Thing")]
    df = spark.createDataFrame(rows, "key string, grams string")
    asked = spark.createDataFrame([("q1", "thing"), ("q2", "bring spring"), ("q3", None), ("q4", "zzzz"), ("q5", "the thin think"), ("q5b", "a")], "query string, key string")
    postings.gram_index(df, "key", "grams").save(f"{tmp_path}/index")
    index = postings.GramIndex.load(spark, f"{tmp_path}/index")
    found = {(r["query"], r["key"]): round(r["similarity"], 9) for r in postings.trigram_search(index, asked, "query", "key", least).collect()}
    plain = {}
    for q, t in [tuple(r) for r in asked.collect()]:
        for k, u in rows:
            a, b = grams(t), grams(u)
            if a and b and len(a & b) / len(a | b) >= least:
                plain[q, k] = round(len(a & b) / len(a | b), 9)
    assert found == plain and len({q for q, _ in plain}) >= 3
    top = {(r["query"], r["key"]) for r in postings.trigram_search(index, asked, "query", "key", least, most=3).collect()}
    best = {q: sorted((k for k in plain if k[0] == q), key=lambda k: (-plain[k], k[1]))[:3] for q, _ in plain}
    assert top == {k for ks in best.values() for k in ks}


def test_more_queries_than_a_block_are_scanned_for_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(postings, "QUERIES", 4)
    monkeypatch.setattr(postings, "SCANS", 0)
    monkeypatch.setattr(postings, "_by_lists", None)
    df = spark.createDataFrame([(i, "thing " * (i % 3) + "thin bring"[: i % 11]) for i in range(60)], "key int, text string")
    found = {(r["query"], r["key"]): round(r["similarity"], 9) for r in postings.trigram_search(postings.gram_index(df, "key", "text"), df, "key", "text").collect()}
    sets = {r["key"]: grams(r["text"]) for r in df.collect()}
    likeness = {(q, k): len(a & b) / len(a | b) for q, a in sets.items() for k, b in sets.items() if a and b}
    assert found == {k: round(v, 9) for k, v in likeness.items() if v >= 0.3}


def some_json(rnd: random.Random, depth: int = 0):
    kind = rnd.randrange(6 if depth < 3 else 4)
    if kind == 4:
        return {rnd.choice("abc."): some_json(rnd, depth + 1) for _ in range(rnd.randint(0, 2))}
    if kind == 5:
        return [some_json(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return rnd.choice([1, 1.0, 2.5, "1", "x", True, None, 10**20, 1e20])


def contains(a, b) -> bool:
    """Containment by its definition, another way round: every way to embed b's parts in a's."""
    if isinstance(b, dict):
        return isinstance(a, dict) and not [k for k in b if k not in a or not contains(a[k], b[k])]
    if isinstance(b, list):
        return isinstance(a, list) and not [y for y in b if not [x for x in a if contains(x, y)]]
    if isinstance(a, (dict, list)) or isinstance(a, bool) != isinstance(b, bool) or isinstance(a, str) != isinstance(b, str) or (a is None) != (b is None):
        return False
    return a == b


def has_leaf(v) -> bool:
    return any(map(has_leaf, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else True


def test_json_containment(spark):
    rnd = random.Random(6)
    values = [some_json(rnd) for _ in range(250)] + [[1, 2, 3], [3, 1], [{"a": 1}, {"b": 2}], [{"a": 1, "b": 2}], {"a": [1, "x"], "b": {"c": None}}]
    asked = [v for v in [some_json(rnd, 1) for _ in range(60)] if has_leaf(v)] + [[1], [3, 2], [{"a": 1, "b": 2}], {"b": {}, "a": ["x"]}, {"b": {"c": None}}, [[1]], "x"]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(1000, None), (1001, "{broken")], "leaf long, flat string")
    probes = spark.createDataFrame([(f"p{i}", json.dumps(v)) for i, v in enumerate(asked)] + [("none", None)], "n string, j string")
    found = sorted(map(tuple, postings.containing(rows, "leaf", "flat", probes, "n", "j").collect()))
    plain = sorted((f"p{i}", k) for i, b in enumerate(asked) for k, a in enumerate(values) if contains(a, b))
    assert found == plain and len(plain) > 100
    with pytest.raises(Exception, match="needs a leaf"):
        postings.containing(rows, "leaf", "flat", spark.createDataFrame([("e", "[]")], "n string, j string"), "n", "j").collect()


@pytest.mark.parametrize("partitions", [1, 6])
def test_activation_over_ranges(spark, partitions):
    rnd = random.Random(partitions)
    rows, begin = [], datetime.datetime(2024, 1, 1)
    for key in ("hot", "cold", "capped", None):
        at = begin
        for _ in range({"hot": 400, "capped": 200}.get(key, 12)):
            at += datetime.timedelta(hours=rnd.choice([0, 0.01, 1, 40, 167.9, 168, 169, 400]) if key != "capped" else 0.1)
            rows.append((key, at))
    rows.append(("cold", None))
    found = {r["k"]: r["activation"] for r in pipelines.activation_batch(spark.createDataFrame(rows, "k string, t timestamp"), "k", "t", partitions).collect()}
    for key in ("hot", "cold", "capped", None):
        plain, _ = pipelines.activation_fold(sorted(t.timestamp() for k, t in rows if k == key and t))
        assert math.isclose(found[key], plain, rel_tol=1e-9)
    assert found["capped"] > 9.9 and len(found) == 4


def test_maps_fold_anywhere():
    """However the uses are cut into stretches, the folded map is the same."""
    rnd = random.Random(1)
    times = sorted(rnd.uniform(0, 5e6) for _ in range(60))
    uses = [(t, t, 1.0, pipelines.AMOUNT, pipelines.CAP) for t in times]
    whole = pipelines.fold_maps(uses)
    for _ in range(30):
        cuts = sorted(rnd.sample(range(1, 60), 4))
        parts = [pipelines.fold_maps(uses[a:b]) for a, b in zip([0, *cuts], [*cuts, 60], strict=True)]
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(pipelines.fold_maps(parts), whole, strict=True))
    assert pipelines.fold_maps([]) is None


def state(store: VersionedTables) -> dict:
    return {n: sorted(map(tuple, store.read(n).collect()), key=repr) for n in ("parents", "children")}


@pytest.fixture
def store(spark, tmp_path):
    s = VersionedTables(spark, f"file://{tmp_path}/store")
    s.create("parents", "id long, seq long, name string", ["id"], ["seq"], buckets=4)
    s.create("children", "id long, n int, seq long", ["id", "n"], ["seq"], buckets=4)
    return s


def test_replayed_and_late_batches(spark, store):
    change = lambda rows: {"parents": spark.createDataFrame(rows, "id long, seq long, name string"), "children": spark.createDataFrame([(r[0], 1, r[1]) for r in rows], "id long, n int, seq long")}
    store.upsert("w", 0, change([(1, 5, "a"), (1, 7, "b"), (2, 1, None), (3, None, "n")]))
    first = state(store)
    assert first["parents"] == [(1, 7, "b"), (2, 1, None), (3, None, "n")]
    assert store.upsert("w", 0, change([(9, 9, "replayed")])) == store.versions()[-1] and state(store) == first
    # Another writer's batch of that number counts; what is older than the table stays out; a null sequence loses.
    store.upsert("v", 0, change([(1, 6, "late"), (3, 0, "m"), (4, 1, "new")]))
    assert state(store)["parents"] == [(1, 7, "b"), (2, 1, None), (3, 0, "m"), (4, 1, "new")]
    assert sorted(map(tuple, store.read("parents", 3).collect()), key=repr) == first["parents"]
    before = store.versions()[-1]
    store.upsert("w", 1, change([]))
    assert state(store)["parents"][-1] == (4, 1, "new") and store.versions()[-1] == before + 1
    held = state(store)
    assert store.vacuum() > 0 and state(store) == held and len(store.versions()) == 1


def test_failed_batch_changes_neither_table(spark, store):
    good = spark.createDataFrame([(1, 1, "a")], "id long, seq long, name string")
    bad = spark.range(1).select("id", F.raise_error(F.lit("lost")).cast("int").alias("n"), F.lit(1).alias("seq"))
    with pytest.raises(Exception, match="lost"):
        store.upsert("w", 0, {"parents": good, "children": bad})
    assert state(store) == {"parents": [], "children": []} and store.manifest()["batches"] == {}
    store.upsert("w", 0, {"parents": good, "children": spark.createDataFrame([(1, 2, 3)], "id long, n int, seq long")})
    assert state(store) == {"parents": [(1, 1, "a")], "children": [(1, 2, 3)]}


def test_of_two_writers_one_succeeds(spark, store):
    now = store.manifest()
    store._commit({**now, "version": now["version"] + 1})
    with pytest.raises(RuntimeError, match="was first"):
        store._commit({**now, "version": now["version"] + 1})


def test_stream_fails_between_batches_and_goes_on(spark, store, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, i, f"n{i}"), (7, i, f"x{i}")], "id long, seq long, name string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def changes(batch):
        seen.append(1)
        if len(seen) == 2:
            raise ValueError("driver lost")
        return {"parents": batch}

    run = lambda: pipelines.table_stream(spark, f"file://{tmp_path}/in", 1).writeStream.trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/at").foreachBatch(store.sink("s", changes)).start().awaitTermination()
    with pytest.raises(Exception, match="driver lost"):
        run()
    assert len(state(store)["parents"]) == 2
    run()
    assert [r[0] for r in state(store)["parents"]] == [0, 1, 2, 7] and len(seen) == 4
    assert dict((r[0], r[1]) for r in state(store)["parents"])[7] == 2


def test_json_postings_of_plain_lists_need_no_python(spark, monkeypatch):
    texts = ["[1,2,2]", "[3, 4]", "[null]", "[1,null]", "[-0]", "[7,-8]", "[1.0,2]", "[]", "{}", '{"a":[1,{"b":2}]}', "5", "bad", "[01]", "[1,2", "[99999999999999999999]", '["1"]', "[true]", "[[1]]", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, v string")
    got = sorted(tuple(r[c] for c in ("key", "leaf", "flat", "n")) for r in postings.json_postings(rows, "k", "v").collect())
    assert got == sorted((k, *r) for k, t in enumerate(texts) if t is not None for r in postings._leaf_rows(t))

    def none(text):
        raise AssertionError(text)

    monkeypatch.setattr(postings, "_leaf_rows", none)
    plain = rows.where("v IN ('[1,2,2]', '[7,-8]')")
    assert sorted(r["leaf"] for r in postings.json_postings(plain, "k", "v").collect()) == ["[]=-8", "[]=1", "[]=2", "[]=7"]
