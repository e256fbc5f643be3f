"""Similarity joins, nearest neighbours, parallel greedy grouping and components against plain versions."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import cognition, graph, greedy, set_join, vector_index, vectors


def unit(v) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


def blobs(n: int, seed: int, size: int = 8, wide: float = 0.15) -> list[tuple]:
    """Noisy directions, copies of some vectors, zero and null vectors, and a null group."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    rows = [(i, "xyz"[i % 3], (centres[rng.integers(12)] + rng.normal(size=size) * wide).tolist()) for i in range(n)]
    rows += [(n + i, "x", rows[i % 4][2]) for i in range(30)]
    return rows + [(n + 40, "x", [0.0] * size), (n + 41, "x", [0.0] * size), (n + 42, "y", None), (n + 43, None, rows[0][2])]


SCHEMA = "id long, g string, v array<double>"


@pytest.fixture(params=[(16, 4096), (16, 3), (2048, 4096)])
def sized(request, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", request.param[0])
    monkeypatch.setattr(vector_index, "PIVOTS", request.param[1])


@pytest.mark.parametrize("least", [0.9, 0.2])
def test_similar_pairs(spark, sized, least):
    rows = blobs(200, 5)
    found = vector_index.similar_pairs(spark.createDataFrame(rows, SCHEMA), "g", "id", "v", least).collect()
    good = [(i, g, unit(np.array(v))) for i, g, v in rows if v and any(v) and g]
    plain = {(g, a, b): float(u @ w) for (a, g, u), (b, h, w) in itertools.combinations(good, 2) if g == h and u @ w >= least}
    assert len(found) == len(plain) and all(abs(plain[r["g"], r["a"], r["b"]] - r["sim"]) < 1e-9 for r in found)


def test_pairs_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_index.similar_pairs(empty, "g", "id", "v", 0.5).count() == 0
    assert vector_index.similar_pairs(spark.createDataFrame([(1, "g", None), (2, "g", [0.0])], SCHEMA), None, "id", "v", 0.5).count() == 0
    assert vector_index.nearest_by_cells(empty, empty, "id", "v", 3).count() == 0
    assert vectors.greedy_clusters(empty, "g", "id", "v", ["id"], 0.5).count() == 0
    assert vectors.greedy_clusters(empty, "g", "id", "v", ["id"], 0.5, moving=True).count() == 0


def test_bounds_prune_most_pairs(spark, monkeypatch):
    """Tight blobs: the bounds leave less than a quarter of all pairs to compare."""
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    rows = blobs(600, 7, wide=0.02)
    compared, every = vector_index.compared_share(spark.createDataFrame(rows, SCHEMA), "v", "id", 0.95)
    assert every == 631 * 630 // 2 and compared < every / 4


@pytest.mark.parametrize("least", [None, 0.8])
def test_nearest_by_cells(spark, sized, least):
    rows = blobs(150, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.where("id % 4 = 0")
    found = vector_index.nearest_by_cells(df, asked, "id", "v", 5, least).collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["query"], set()).add((round(-r["sim"], 9), r["id"]))
    good = [(i, unit(np.array(v))) for i, _, v in rows if v]
    for i, u in good:
        if i % 4 == 0:
            best = sorted((round(-float(u @ w), 9), j) for j, w in good if j != i)[:5]
            assert [x for x in best if least is None or -x[0] >= least] == [x for x in sorted(got.get(i, ()))[:5] if least is None or -x[0] >= least]


def test_nearest_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(blobs(80, 4), SCHEMA)
    small = sorted(map(tuple, vectors.nearest(df, df, "id", "v", 3).withColumn("sim", F.round("sim", 9)).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 10)
    assert sorted(map(tuple, vectors.nearest(df, df, "id", "v", 3).withColumn("sim", F.round("sim", 9)).collect())) == small
    cents = df.where("id < 40").select("id", F.col("v").alias("centroid"))
    many = sorted(map(tuple, vectors.nearest_centroid(df.where("v IS NOT NULL").drop("g"), cents.withColumnRenamed("id", "c"), "id", "v", "c").withColumn("sim", F.round("sim", 9)).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 1000)
    assert many == sorted(map(tuple, vectors.nearest_centroid(df.where("v IS NOT NULL").drop("g"), cents.withColumnRenamed("id", "c"), "id", "v", "c").withColumn("sim", F.round("sim", 9)).collect()))


def sequential(rows: list[tuple], least: float, order, moving: bool = False) -> dict:
    out, groups = {}, {}
    for i, g, v in sorted(rows, key=order):
        kept = groups.setdefault(g, [])
        u = unit(np.array(v or [0.0] * 8))
        sims = [float(unit(k[1]) @ u) for k in kept]
        fits = [j for j, s in enumerate(sims) if (s > least if moving else s >= least)]
        if not fits:
            kept.append([i, np.array(v or [0.0] * 8), 1])
            out[i] = i
            continue
        j = max(fits, key=lambda j: (sims[j], -j)) if moving else fits[0]
        if moving:
            kept[j][1] = (kept[j][1] * kept[j][2] + u * np.linalg.norm(v)) / (kept[j][2] + 1)
            kept[j][2] += 1
        out[i] = kept[j][0]
    return out


@pytest.mark.parametrize("finish", [0, 200, 1 << 16])
def test_greedy_clusters_of_one_large_group(spark, monkeypatch, finish):
    """2,000 vectors of one group and more, in an order with ties, equal to taking rows one by one."""
    monkeypatch.setattr(greedy, "FINISH", finish)
    monkeypatch.setattr(vector_index, "BLOCK", 256)
    rows = [(i, "one" if i < 2000 else g, v) for i, g, v in blobs(2100, 11, wide=0.4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.col("id") % 7)
    found = {r["id"]: r["leader"] for r in vectors.greedy_clusters(df, "g", "id", "v", ["-score", "id"], 0.8).collect()}
    plain = sequential(rows, 0.8, lambda r: (-(r[0] % 7), r[0]))
    assert found == plain and 12 < len(set(found.values())) < 1500


def test_centroid_clusters_stream(spark):
    rows = blobs(300, 2, wide=0.5)
    found = {r["id"]: r["leader"] for r in vectors.greedy_clusters(spark.createDataFrame(rows, SCHEMA), "g", "id", "v", ["id"], 0.7, moving=True).collect()}
    assert found == sequential(rows, 0.7, lambda r: r[0], True)


def test_greedy_rounds_on_a_chain(spark, monkeypatch):
    """The order in which rows depend on each other as long as can be: every second one of a path is kept."""
    monkeypatch.setattr(greedy, "FINISH", 0)
    links = spark.createDataFrame([("g", i, i + 1) for i in range(7)] + [("h", 0, i) for i in range(1, 9)], "g string, a long, b long")
    rows = spark.createDataFrame([("g", i) for i in range(8)] + [("h", i) for i in range(9)], "g string, k long")
    found = {(r["g"], r["k"]): r["leader"] for r in greedy.first_leaders(rows, links).collect()}
    assert found == {**{("g", i): i - i % 2 for i in range(8)}, **{("h", i): 0 for i in range(9)}}


def sets(seed: int, n: int = 150) -> list[tuple]:
    """A token in every second set, copies, sets of one token, empty and null ones."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        own = {f"t{min(int(rnd.expovariate(0.15)), 60)}" for _ in range(rnd.randint(1, 12))} | ({"common"} if i % 2 else set())
        rows.append((i, "ab"[i % 2] if i < 100 else "c", sorted(own)))
    rows += [(n + i, "c", rows[120][2] + rows[120][2]) for i in range(5)] + [(n + 10, "c", ["common"]), (n + 11, "c", ["common"])]
    return rows + [(n + 20, "c", []), (n + 21, "c", None), (n + 22, None, ["common"])]


@pytest.mark.parametrize(("measure", "least", "strict"), [("jaccard", 0.5, False), ("jaccard", 0.5, True), ("jaccard", 0.15, False), ("overlap", 0.5, True), ("overlap", 0.8, False)])
def test_set_join(spark, monkeypatch, measure, least, strict):
    monkeypatch.setattr(set_join, "LIST", 8)
    rows = sets(int(least * 100))
    found = set_join.set_join(spark.createDataFrame(rows, "id long, g string, t array<string>"), "g", "id", "t", least, measure, strict)
    plain = {}
    for (a, g, x), (b, h, y) in itertools.combinations([r for r in rows if r[1] and r[2]], 2):
        x, y = set(x), set(y)
        whole = len(x | y) if measure == "jaccard" else min(len(x), len(y))
        if g == h and (len(x & y) / whole > least if strict else len(x & y) / whole >= least):
            plain[g, a, b] = (len(x & y), len(x), len(y))
    assert {(r["g"], r["a"], r["b"]): (r["shared"], r["size_a"], r["size_b"]) for r in found.expanded().collect()} == plain
    partners: dict = {}
    for g, a, b in plain:
        for k in (a, b):
            partners[g, k] = partners.get((g, k), 0) + 1
    assert {(r["g"], r["key"]): r["partners"] for r in found.partners().collect()} == partners
    counts = {r["g"]: r["pairs"] for r in found.pair_counts().collect()}
    assert counts == {g: sum(k[0] == g for k in plain) for g in {k[0] for k in plain}}


def test_set_join_compares_few_pairs(spark):
    """A token in half of all sets makes no candidates where rarer ones tell the sets apart."""
    rows = [(i, [f"w{i % 500}", f"x{i % 250}", f"y{i}", "z" if i % 2 else "q"]) for i in range(1000)]
    found = set_join.set_join(spark.createDataFrame(rows, "id long, t array<string>"), None, "id", "t", 0.6)
    assert found.candidates.count() < 1500 and found.pairs.count() == 500


@pytest.mark.parametrize(("measure", "least", "few"), [("jaccard", 0.3, 3), ("jaccard", 0.3, 100), ("overlap", 0.6, 3), ("overlap", 0.6, 100)])
def test_set_join_of_small_groups(spark, monkeypatch, measure, least, few):
    """Groups below and above the size at which sets meet each other directly; with all of them below, nothing is joined by token."""
    monkeypatch.setattr(set_join, "FEW", few)
    rnd = random.Random(6)
    rows = [(i, f"g{int(i**0.5)}", [f"t{rnd.randrange(8)}" for _ in range(rnd.randint(0, 6))]) for i in range(80)]
    found = set_join.set_join(spark.createDataFrame(rows, "id long, g string, t array<string>"), "g", "id", "t", least, measure).expanded()
    plain = set()
    for (a, g, x), (b, h, y) in itertools.combinations(rows, 2):
        x, y = set(x), set(y)
        if g == h and x and y and len(x & y) / (len(x | y) if measure == "jaccard" else min(len(x), len(y))) >= least:
            plain.add((g, a, b, len(x & y)))
    assert {(r["g"], r["a"], r["b"], r["shared"]) for r in found.collect()} == plain


def test_merge_claims_brute(spark):
    rnd = random.Random(4)
    stock = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(rnd.choice("tu"), i // 2, " ".join(rnd.choice(stock) for _ in range(rnd.randint(3, 6))), rnd.random()) for i in range(160)]
    rows += [("t", 500, "alpha beta gamma", 0.25)] * 3 + [("v", 1, None, 0.5), ("v", 1, None, 0.5), ("v", 2, "", 0.1), (None, 1, "alone", 0.9)]
    found = cognition.merge_claims(spark.createDataFrame(rows, "g string, o long, c string, f double"), "g", "o", "c", "f").collect()
    plain = []
    for g in {r[0] for r in rows}:
        kept: list = []
        for _, _, c, f in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3])):
            w = set((c or "").lower().split())
            twin = next((k for k in kept if w and len(w & k[0]) / len(w | k[0]) > 0.6), None)
            if twin is None:
                kept.append([w, c, f, 1])
            else:
                twin[2:] = [(twin[2] + f) / 2, twin[3] + 1]
        plain += [(g, c, n, round(f, 9), n) for _, c, f, n in kept]
    assert sorted(((*r[:3], round(r[3], 9), r[4]) for r in found), key=repr) == sorted(plain, key=repr)


def test_components_of_paths_and_hubs(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    rnd.shuffle(edges)
    edges = [e[::-1] if i % 2 else e for i, e in enumerate(edges)]
    found = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long"), spark.range(410).withColumnRenamed("id", "id")).collect()}
    parent = list(range(410))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert found == {i: find(i) for i in range(410)}
