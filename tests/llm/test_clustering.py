"""Centroid clustering against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from lodeworks.llm import kdtree


def brute(rows: list[tuple], k: int, rounds: int, size: int) -> list[tuple]:
    """Plain Lloyd rounds on Python integers."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]
    far = lambda v, z: sum((a - b) ** 2 for a, b in zip(v, z, strict=True))
    assign = lambda: [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        labels = assign()
        for c in range(len(centres)):
            own = [v for (_, v), x in zip(kept, labels, strict=True) if x == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    labels = assign()
    distances = [far(v, centres[c]) for (_, v), c in zip(kept, labels, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centres]
    return sorted(((i, c, d, sum(e for e, x in zip(distances, labels, strict=True) if x == c), sum(distances), digest[c]) for (i, _), c, d in zip(kept, labels, distances, strict=True)), key=repr)


def made(size: int, n: int, seed: int) -> list[tuple]:
    """Blobs, copies of one vector, repeated and null ids, and rows that are left out."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=size) * 0.05 + i % 5).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.5] * size) for i in range(n)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    return rows + [(2000, None), (2001, []), (2002, [1.0] * (size - 1)), (2003, [1.0] * (size + 1)), (2004, [None] + [1.0] * (size - 1)), (2005, [float("nan")] * size), (2006, [float("-inf")] * size)]


@pytest.mark.parametrize(("size", "k", "rounds"), [(2, 4, 3), (64, 8, 10), (3, 500, 2)])
def test_equals_plain_rounds(spark, monkeypatch, size, k, rounds):
    monkeypatch.setattr(kdtree, "BLOCK", 50)
    monkeypatch.setattr(kdtree, "LEAF", 4)
    rows = made(size, 120, size)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS id", "'y' AS v", "0 AS cluster")
    found = sorted((tuple(r) for r in kdtree.cluster_vectors(df, k=k, rounds=rounds, size=size).collect()), key=repr)
    assert found == brute(rows, k, rounds, size)


def test_filter_prunes_and_equals_distances(monkeypatch):
    """Well apart blobs are assigned by whole nodes; every count, sum and label equals the plain ones, ties included."""
    monkeypatch.setattr(kdtree, "LEAF", 8)
    rng = np.random.default_rng(1)
    points = (rng.integers(-20, 20, (3000, 4)) + rng.choice([-5000, 0, 5000], (3000, 1))).astype(np.int64)
    centres = np.array([[-5000] * 4, [0] * 4, [0] * 4, [5000] * 4, [5001] * 4])
    order, tree = kdtree.build_tree(points)
    counts, sums, labels = kdtree.filter_tree(tree, centres)
    plain = ((points[order][:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert (labels == plain).all() and (counts == np.bincount(plain, minlength=5)).all()
    assert all((sums[c] == points[order][plain == c].sum(axis=0)).all() for c in range(5))


def test_large_components(spark):
    most = kdtree.largest_component(64) / 1024
    good = spark.createDataFrame([(1, [most - 1] * 64), (2, [1 - most] * 64)], "vec_id long, embedding array<double>")
    assert {r["distance"] for r in kdtree.cluster_vectors(good, k=1).collect()} == {64 * ((int(most) - 1) * 1024) ** 2}
    with pytest.raises(Exception, match="not supported"):
        kdtree.cluster_vectors(spark.createDataFrame([(1, [most] * 64)], "vec_id long, embedding array<double>")).collect()
