"""Retrieval lanes, merging, re-ranking, diversification and packing; all queries of a batch at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T


def query_words(query: str, most: int = 5, least: int = 3) -> list[str]:
    return [w for w in query.lower().split() if len(w) >= least][:most]


def keyword_lane(items: DataFrame, text: str, query: str) -> DataFrame:
    """Items that contain any usable word of the query, with the number of words hit; no usable word finds nothing.

    ``%`` and ``_`` in a word are wildcards, as in LIKE.
    """
    terms = query_words(query)
    if not terms:
        return items.withColumn("hits", F.lit(0)).where(F.lit(False))
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, [low.like(f"%{w}%").cast("int") for w in terms])
    return items.withColumn("hits", hits).where(F.col("hits") > 0)


def merge_lanes(lanes: list[DataFrame], key: str, position: str) -> DataFrame:
    """Union of lanes, first lane first; of items with the same key the earliest stays.

    Items without a key are kept from the first lane and dropped from the others.
    """
    tagged = [lane.withColumn("lane", F.lit(i)) for i, lane in enumerate(lanes)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = Window.partitionBy(key).orderBy("lane", position)
    keyed = every.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return keyed.unionByName(every.where(F.col(key).isNull() & (F.col("lane") == 0)))


def ranked(items: DataFrame, query: str, score: Column, tie: str, limit: int) -> DataFrame:
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(score.desc(), F.asc(tie)))).where(F.col("rank") <= limit)


def age_band(days: Column, faithful: bool = False) -> Column:
    d = F.when(days == 0, 9999).otherwise(days) if faithful else days
    d = F.coalesce(d, F.lit(9999))
    return F.when(d <= 30, 0).when(d <= 365, 1).otherwise(2)


def diversify(items: DataFrame, query: str, rank: str, days: str, limit: int, faithful: bool = False) -> DataFrame:
    """Quotas of 30, 40 and the remaining per cent for recent, middle and old items, at least one each; gaps are filled in rank order."""
    recent, middle = max(1, round(limit * 0.30)), max(1, round(limit * 0.40))
    quota = F.element_at(F.array(F.lit(recent), F.lit(middle), F.lit(max(1, limit - recent - middle))), F.col("band") + 1)
    banded = items.withColumn("band", age_band(F.col(days), faithful))
    banded = banded.withColumn("__k", F.row_number().over(Window.partitionBy(query, "band").orderBy(rank)))
    banded = banded.withColumn("__in", F.col("__k") <= quota)
    order = Window.partitionBy(query).orderBy(F.desc("__in"), F.when(F.col("__in"), F.col("band")).otherwise(0), rank)
    return banded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("__k", "__in")


def cluster_cap(items: DataFrame, query: str, cluster: str, score: str, tie: str, most: int = 2) -> DataFrame:
    w = Window.partitionBy(query, cluster).orderBy(F.desc(score), tie)
    return items.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def compress_clusters(items: DataFrame, query: str, cluster: str, score: str, tie: str, clusters: int = 3, most: int = 2) -> DataFrame:
    """The best clusters of each query by their best item, and the best items of those."""
    best = items.groupBy(query, cluster).agg(F.max(score).alias("best"))
    top = best.withColumn("c", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("best"), cluster))).where(F.col("c") <= clusters).select(query, cluster, "c")
    return cluster_cap(items.join(top, [query, cluster]), query, cluster, score, tie, most)


PACK_CLUSTERS = {
    "mechanism": "because|causes|mechanism|works|root cause", "tradeoffs": "tradeoff|versus|compare|better|worse", "constraints": "constraint|limit|bound|cannot|must",
    "implementation": "implement|deploy|config|code|runtime",
}


def pack_cluster(text: Column, kind: Column) -> Column:
    """Number of the evidence cluster, in packing order; contradictions first, others last."""
    out = F.lit(len(PACK_CLUSTERS) + 1)
    for i, pattern in reversed(list(enumerate(PACK_CLUSTERS.values(), 1))):
        out = F.when(F.lower(text).rlike(pattern), i).otherwise(out)
    return F.when(F.lower(kind).contains("contradiction"), 0).otherwise(out)


def pack_evidence(items: DataFrame, query: str, text: str, kind: str, position: str, budget: int = 12_000) -> DataFrame:
    """Round robin over the clusters until the word budget is first exceeded; the first item always stays."""
    x = items.withColumn("cluster", pack_cluster(F.col(text), F.col(kind))).withColumn("words", F.greatest(T.word_count(F.col(text)), F.lit(1)))
    x = x.withColumn("__turn", F.row_number().over(Window.partitionBy(query, "cluster").orderBy(position)))
    order = Window.partitionBy(query).orderBy("__turn", "cluster")
    x = x.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when((F.col("used") > budget) & (F.col("place") > 1), F.col("place"))).over(Window.partitionBy(query))
    return x.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("place") < F.col("__stop"))).drop("__stop", "__turn")


def tiered(items: DataFrame, query: str, score: str, tie: str, high: float = 0.75, support: float = 0.5, each: int = 6, total: int = 12) -> DataFrame:
    """HIGH and SUPPORT items up to a cap each; LOW ones fill to the total."""
    x = items.withColumn("tier", F.when(F.col(score) >= high, 0).when(F.col(score) >= support, 1).otherwise(2))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy(query, "tier").orderBy(F.desc(score), tie))).where((F.col("tier") == 2) | (F.col("k") <= each))
    return x.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("tier", "k"))).where(F.col("place") <= total).drop("k")


def multi_query_merge(found: DataFrame, key: str, query: str, position: str) -> DataFrame:
    """Results of several queries merged by key, the first query first."""
    w = Window.partitionBy(key).orderBy(query, position)
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def context_block(items: DataFrame, query: str, role: str, order: str, content: str) -> DataFrame:
    """One text per query: a heading per role and a line per item."""
    line = F.concat(F.lit("- "), F.col(content))
    roles = items.groupBy(query, role).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    block = F.concat(F.lit("### "), F.col(role), F.lit("\n"), F.col("body"))
    return roles.groupBy(query).agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("context"))
