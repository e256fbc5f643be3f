"""Centroid clustering of integer vectors: Lloyd rounds by kd-tree filtering, exact to the last unit.

Every scan partition is cut into blocks of at most ``BLOCK`` vectors, and each block becomes one kd-tree, written once to
the shared folder. A node holds the count, the integer sums and the box of its vectors. A round walks all trees with the
centroids of the round before: a centroid that is strictly farther than another one from every point of a node's box is
pruned, a node with one centroid left is assigned as a whole from its count and sums, and what is left at a leaf is
resolved point by point. A task returns one row a centroid, so a round brings ``k`` rows to the driver at any size of the
table, and copies of a vector, however many, are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, named, scratch_path, scratch_scope

#: Vectors of one tree at most, and of a leaf that is not split further.
BLOCK = 8192
LEAF = 32
#: Numbers that one step of the walk holds at a time.
_AT_ONCE = 1 << 22

TREE = "points binary, bounds binary, child binary, box binary, sums binary"


def largest_component(size: int) -> int:
    """The largest absolute component with which every squared distance of the walk fits a long."""
    return isqrt(2**62 // size) // 4


def integer_vectors(vectors: DataFrame, key: str, vector: str, size: int = 64, scale: int = 1024) -> DataFrame:
    """``id, v``: floor(scale * x) of every vector with exactly ``size`` components, none null, NaN or infinite.

    Other rows are left out, null vectors among them. Keys may be null or repeated; every row counts. A component beyond
    ``largest_component`` is an error, since distances need not fit a long then.
    """
    x = named(vectors, id=key, v=vector)
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = largest_component(size)
    whole = lambda c: F.floor(c.cast("double") * scale)
    cell = lambda c: F.when(F.abs(c.cast("double") * scale) < most, whole(c)).otherwise(F.raise_error(F.lit(f"components of {most / scale} or more are not supported")).cast("long"))
    return x.where((F.size("v") == size) & finite).select("id", F.transform("v", cell).alias("v"))


def build_tree(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points in the tree, and its arrays by node: slice of the order, first child (-1: leaf), box, sums."""
    order = np.arange(len(points))
    bounds, child, box, sums = [(0, len(points))], [], [], []
    for a, b in bounds:  # grows while it is walked
        part = points[order[a:b]]
        low, high = part.min(axis=0), part.max(axis=0)
        box.append((low, high))
        sums.append(part.sum(axis=0, dtype=np.int64))
        widths = high - low
        axis = int(widths.argmax())
        if b - a <= LEAF or not widths[axis]:
            child.append(-1)
            continue
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], half)]
        child.append(len(bounds))
        bounds += [(a, a + half), (a + half, b)]
    return order, {"points": points[order].astype(np.int32), "bounds": np.array(bounds, np.int32), "child": np.array(child, np.int32), "box": np.array(box, np.int32), "sums": np.array(sums)}


def filter_tree(tree: dict[str, np.ndarray], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count and sums by centroid, and the centroid of every point in the tree's order; the smaller number wins ties."""
    k, size = centres.shape
    counts, sums, labels = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.empty(len(tree["points"]), np.int32)
    squares = (centres * centres).sum(axis=1)
    step = max(1, _AT_ONCE // (k * size))
    todo = [(np.zeros(1, np.int64), np.ones((1, k), bool))]
    while todo:
        nodes, alive = todo.pop()
        if len(nodes) > step:
            todo += [(nodes[i : i + step], alive[i : i + step]) for i in range(0, len(nodes), step)]
            continue
        low, high = tree["box"][nodes, 0].astype(np.int64), tree["box"][nodes, 1].astype(np.int64)
        middle = ((low + high)[:, None] - 2 * centres) ** 2
        best = np.where(alive, middle.sum(axis=2), np.iinfo(np.int64).max).argmin(axis=1)
        # The corner of the box where another centroid does best against the one nearest to the middle.
        apart = centres - centres[best][:, None]
        corner = np.where(apart > 0, high[:, None], low[:, None])
        alive &= squares - squares[best][:, None] <= 2 * (corner * apart).sum(axis=2)
        first = alive.argmax(axis=1)
        whole = (alive.sum(axis=1) == 1) | (low == high).all(axis=1)
        a, b = tree["bounds"][nodes].T
        np.add.at(counts, first[whole], (b - a)[whole])
        np.add.at(sums, first[whole], tree["sums"][nodes[whole]])
        for x, y, c in zip(a[whole], b[whole], first[whole], strict=True):
            labels[x:y] = c
        child = tree["child"][nodes]
        inner, leaf = ~whole & (child >= 0), ~whole & (child < 0)
        if inner.any():
            todo.append((np.concatenate([child[inner], child[inner] + 1]), np.concatenate([alive[inner]] * 2)))
        if leaf.any():
            at = np.concatenate([np.arange(x, y) for x, y in zip(a[leaf], b[leaf], strict=True)])
            open_ = np.repeat(alive[leaf], (b - a)[leaf], axis=0)
            points = tree["points"][at].astype(np.int64)
            nearest, distance = np.zeros(len(at), np.int32), np.full(len(at), np.iinfo(np.int64).max)
            for c in range(k):
                rows = np.flatnonzero(open_[:, c])
                d = ((points[rows] - centres[c]) ** 2).sum(axis=1)
                closer = d < distance[rows]
                nearest[rows[closer]], distance[rows[closer]] = c, d[closer]
            labels[at] = nearest
            counts += np.bincount(nearest, minlength=k)
            np.add.at(sums, nearest, points)
    return counts, sums, labels


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _planter(size: int, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def plant(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            order, arrays = build_tree(np.concatenate([_rows(c, size) for c in table.column("v").chunks]))
            ids = table.column("id").take(pa.array(order)).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids).cast(schema.field("ids").type), *[pa.array([arrays[n].tobytes()], pa.binary()) for n in schema.names[1:]]], schema=schema)

        for batch in batches:
            while batch.num_rows:
                free = BLOCK - sum(b.num_rows for b in held)
                held.append(batch.slice(0, free))
                batch = batch.slice(min(free, batch.num_rows))
                if sum(b.num_rows for b in held) == BLOCK:
                    yield tree()
                    held.clear()
        if held:
            yield tree()

    return plant


def _trees(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    shapes = {"points": (np.int32, (-1, size)), "bounds": (np.int32, (-1, 2)), "child": (np.int32, (-1,)), "box": (np.int32, (-1, 2, size)), "sums": (np.int64, (-1, size))}
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("ids").slice(i, 1).flatten(), {n: np.frombuffer(batch.column(n)[i].as_buffer(), t).reshape(s) for n, (t, s) in shapes.items()}


def plant_trees(vectors: DataFrame, size: int) -> DataFrame:
    """The kd-trees of ``vectors(id, v)``, one row for each; they are written once and read in every round."""
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, {TREE}"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(vectors.sparkSession.createDataFrame([], schema).schema)
    return materialise(vectors.mapInArrow(_planter(size, arrow), schema), "kdtrees")


def lloyd_round(trees: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of sums over counts; a centroid without a vector stays."""
    k, size = centres.shape

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, tree in _trees(batches, size):
            n, s, _ = filter_tree(tree, centres)
            counts += n
            sums += s
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["centre", "n", "s"])

    parts = trees.mapInArrow(step, "centre int, n long, s array<long>")
    found = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s")).collect()
    after = centres.copy()
    for r in found:
        after[r["centre"]] = [x // r["n"] for x in r["s"]]
    return after


def first_centres(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors whose id, after ``salt``, has the smallest hash; equal ids by their vectors, null ids last."""
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return [r["v"] for r in vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Fewer vectors than ``k`` make as many centroids; none, or an empty table, give an empty result. Repeated rows count
    as often as they occur, and repeated vectors make equal centroids, of which the smaller number takes all. Rounds end
    early once no centroid moves, which changes nothing. Broadcast and collected are ``k`` rows at most.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, key, vector, size, scale)
    kind = kept.schema["id"].dataType.simpleString()
    path = scratch_path(spark, "clusters")
    with scratch_scope(spark):
        trees = plant_trees(kept, size)
        centres = np.array(first_centres(kept, k, salt), np.int64).reshape(-1, size)
        for _ in range(rounds if len(centres) else 0):
            before, centres = centres, lloyd_round(trees, centres)
            if (before == centres).all():
                break

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, tree in _trees(batches, size):
                labels = filter_tree(tree, centres)[2]
                distance = ((tree["points"] - centres[labels]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(labels), pa.array(distance)], names=["id", "cluster", "distance"])

        found = materialise(trees.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters", path)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(c, s, sum(inertia.values()), digest(c)) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
