"""Vectors: similarity, nearest neighbours, clustering and consolidation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled
from .greedy import first_leaders, order_key
from .vector_index import best_of, nearest_by_cells, similar_pairs

#: Queries that are broadcast at most.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or zero vectors; the longer of two vectors is cut."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def similarity_from_distance(distance: Column, kind: str = "cosine") -> Column:
    return F.greatest(F.least(1 - distance, F.lit(1.0)), F.lit(0.0)) if kind == "cosine" else F.exp(-distance)


def nearest(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float | None = None) -> DataFrame:
    """Exact top-k by cosine of every query against all rows: ``query, id, sim, rank``; ties by id, a row never finds itself.

    At most ``BLOCK`` queries are broadcast and each task keeps the k best of its rows for them; a larger query set goes
    through the pivot cells of ``vector_index``, and never through the driver. Rows without a vector are left out.
    """
    spark = corpus.sparkSession
    few = queries.where(F.size(vector) > 0).select(F.col(key).cast("long"), vector).limit(BLOCK + 1).collect()
    if len(few) > BLOCK:
        found = nearest_by_cells(corpus, queries, key, vector, k, least)
    elif not few:
        found = spark.createDataFrame([], "query long, id long, sim double")
    else:
        names, matrix = np.array([r[0] for r in few]), np.array([r[1] for r in few], np.float64)
        shared = spark.sparkContext.broadcast((names, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best: list[list[tuple[float, int]]] = [[] for _ in names]
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                if not len(own):
                    continue
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                sims = q @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T
                sims[names[:, None] == own[None, :]] = -np.inf
                best = [sorted(old + new, key=lambda x: (-x[0], x[1]))[:k] for old, new in zip(best, best_of(sims, own, k), strict=True)]
            rows = [(n, i, s) for n, found in zip(names.tolist(), best, strict=True) for s, i in found]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query", "id", "sim"])

        found = corpus.where(F.size(vector) > 0).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(search, "query long, id long, sim double")
    if least is not None:
        found = found.where(F.col("sim") >= least)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= k)


def group_pairs(vectors: DataFrame, group: str, key: str, vector: str, least: float) -> DataFrame:
    """Pairs within a group at or above a cosine: ``group, a, b, sim``, over pivot cells."""
    return similar_pairs(vectors, group, key, vector, least).select(F.col("g").alias(group), "a", "b", "sim")


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Element-wise means per group; sums are combined before the shuffle."""
    means = vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def pooled(vectors: DataFrame, group: str, vector: str, method: str = "mean") -> DataFrame:
    agg = F.max if method == "max" else F.avg
    values = vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(agg(F.col("x").cast("double")).alias("x"))
    return values.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("pooled"))


def mean_similarities(vectors: DataFrame, anchor: str, group: str, vector: str) -> DataFrame:
    """``x, y, pairs, mean``: the mean cosine of two groups, ``x`` the lesser, over the pairs of their rows that share an anchor.

    Dot products of unit vectors add up to that of the sums of the unit vectors, so no pair of rows is made: a row goes
    into its group's sum, and sums meet under their anchors. Vectors without a direction have cosine 0 to all.
    """
    rows = vectors.where(F.col(anchor).isNotNull() & F.col(group).isNotNull()).select(F.col(anchor).alias("anchor"), F.col(group).alias("g"), F.col(vector).alias("v"), norm(F.col(vector)).alias("length"))
    long = rows.where(F.isnan("length") | (F.col("length") > 0))
    sums = long.select("anchor", "g", "length", F.posexplode("v").alias("pos", "e")).groupBy("anchor", "g", "pos").agg(F.sum(F.col("e").cast("double") / F.col("length")).alias("e"))
    totals = sums.groupBy("anchor", "g").agg(F.map_from_entries(F.collect_list(F.struct("pos", "e"))).alias("total"))
    each = rows.groupBy("anchor", "g").agg(F.count(F.lit(1)).alias("n")).join(totals, ["anchor", "g"], "left")
    side = lambda name: each.select("anchor", F.col("g").alias(name), F.col("n").alias(f"n{name}"), F.col("total").alias(f"t{name}"))
    both = side("x").join(side("y"), "anchor").where("x < y")
    product = F.aggregate(F.map_entries("tx"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at("ty", e["key"]), F.lit(0.0)))
    met = both.select("x", "y", (F.col("nx") * F.col("ny")).alias("pairs"), F.coalesce(product, F.lit(0.0)).alias("product"))
    return met.groupBy("x", "y").agg(F.sum("pairs").alias("pairs"), (F.sum("product") / F.sum("pairs")).alias("mean"))


def nearest_centroid(vectors: DataFrame, cents: DataFrame, key: str, vector: str, group: str, least: float = 0.5) -> DataFrame:
    """Each vector's best centroid above a cosine, else null. More than ``BLOCK`` centroids go through the pivot cells."""
    if cents.limit(BLOCK + 1).count() > BLOCK:
        corpus = cents.select(F.col(group).alias(key), F.col("centroid").alias(vector))
        near = nearest_by_cells(corpus, vectors, key, vector, 1, others=False).groupBy("query").agg(F.max(F.struct("sim", (-F.col("id")).alias("neg"))).alias("m"))
        return near.select(F.col("query").alias(key), F.when(F.col("m.sim") > least, -F.col("m.neg")).alias(group), F.col("m.sim").alias("sim"))
    pair = vectors.select(key, vector).join(F.broadcast(cents.select(F.col(group).alias("__g"), "centroid")))
    best = pair.withColumn("sim", cosine(F.col(vector), F.col("centroid"))).groupBy(key).agg(F.max(F.struct("sim", (-F.col("__g")).alias("neg"))).alias("m"))
    return best.select(key, F.when(F.col("m.sim") > least, -F.col("m.neg")).alias(group), F.col("m.sim").alias("sim"))


def greedy_clusters(vectors: DataFrame, group: str, key: str, vector: str, order: list[str], least: float, moving: bool = False) -> DataFrame:
    """Leader clustering of each group in a given order: ``group, key, leader``.

    A row joins the first leader at or above a cosine, else it becomes one. Leaders are found in parallel, as the first
    maximal independent set of the pairs (``greedy``); copies of a vector are one row there. With ``moving`` a row joins
    the most similar centroid above the cosine and moves it, which depends on every row before: rows of a group then
    stream in order through one task that holds the centroids only. Null vectors and those of length 0 are like nothing
    and lead themselves; groups may be null.
    """
    if moving:
        return _moving(vectors, group, key, vector, order, least)
    x = vectors.select(F.struct(group).alias("g"), order_key(order, key).alias("k"), F.col(vector).alias("v"))
    some = F.size("v") > 0
    x = settled(x.withColumn("alike", F.when(some & F.exists("v", lambda e: e != 0), F.struct("v", F.lit(None).cast(x.schema["k"].dataType).alias("k"))).otherwise(F.struct(F.lit(None).cast(x.schema["v"].dataType).alias("v"), "k"))))
    distinct = settled(x.groupBy("g", "alike").agg(F.min("k").alias("k")))
    links = settled(similar_pairs(distinct.select("g", "k", F.col("alike.v").alias("v")), "g", "k", "v", least).select("g", "a", "b"))
    led = distinct.join(first_leaders(distinct.select("g", "k"), links), ["g", "k"]).select("g", "alike", "leader")
    same = (x["g"] == led["g"]) & x["alike"].eqNullSafe(led["alike"])
    return x.join(led, same).select(x[f"g.{group}"].alias(group), F.col("k.key").alias(key), F.col("leader.key").alias("leader"))


def _moving(vectors: DataFrame, group: str, key: str, vector: str, order: list[str], least: float) -> DataFrame:
    g, k = (vectors.schema[c].dataType.simpleString() for c in (group, key))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names = object(), []
        units = sums = counts = None
        for batch in batches:
            out = []
            for own, name, v in zip(*(batch.column(c).to_pylist() for c in ("g", "key", "v")), strict=True):
                if own != now:
                    now, names, units, sums, counts = own, [], np.empty((0, len(v or []))), np.empty((0, len(v or []))), []
                v = np.asarray(v or np.zeros(units.shape[1]), np.float64)
                if units.shape[1] == 0 and len(v):
                    units, sums = np.zeros((len(names), len(v))), np.zeros((len(names), len(v)))
                n = np.linalg.norm(v)
                sims = units[: len(names)] @ (v / n) if n else np.zeros(len(names))
                best = int(sims.argmax()) if len(sims) and sims.max() > least else -1
                if best < 0:
                    if len(names) == len(units):
                        units, sums = (np.concatenate([m, np.zeros((max(16, len(m)), m.shape[1]))]) for m in (units, sums))
                    best = len(names)
                    names.append(name)
                    counts.append(0)
                counts[best] += 1
                sums[best] += v
                length = np.linalg.norm(sums[best])
                units[best] = sums[best] / length if length else 0.0
                out.append(names[best])
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("key"), pa.array(out, batch.column("key").type)], names=[group, key, "leader"])

    x = vectors.select(F.col(group).alias("g"), order_key(order, key).alias("o"), F.col(key).alias("key"), F.col(vector).alias("v"))
    return x.repartition("g").sortWithinPartitions("g", "o").select("g", "key", "v").mapInArrow(run, f"{group} {g}, {key} {k}, leader {k}")


def consolidate(clusters: DataFrame, group: str, key: str) -> DataFrame:
    """Golden rows of clusters: the leader stands for its members."""
    return clusters.groupBy(group, F.col("leader").alias("golden")).agg(F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_list(key)).alias("member_ids"))


def kmeans(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """k-means labels; k is at most the number of vectors, and below two there is one cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    k = min(k, x.count())
    if k < 2:
        return x.select(key, F.lit(0).alias("cluster"))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(x).transform(x).select(key, "cluster")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Deterministic bag of words: counts of hashed tokens. Stands in for an injected embedding model."""
    toks = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    slots = F.transform(toks, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    return F.element_at(F.transform(F.array(slots), lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))), 1)
