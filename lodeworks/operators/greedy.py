"""Greedy, order-dependent grouping in parallel: the first rows of an order that no earlier kept row is like.

Taking rows in order and keeping each that is like no kept one gives the lexicographically first maximal independent set
of the graph of likeness. Rounds find it without an order of execution: a row that no undecided earlier row is like is
kept, and all later rows like it are not. The number of rounds is the longest chain of such decisions, about the
logarithm of the rows where the order has little to do with the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled

#: Undecided links that are few enough to be settled in order on the driver, in place of further rounds.
FINISH = 1 << 16


def covered_rows(links: DataFrame) -> DataFrame:
    """``g, b`` of all rows that are not kept; ``links(g, a, b)`` lead from the earlier to the later of two like rows."""
    open_, found = links.select("g", "a", "b"), []
    schema = links.select("g", "b").schema
    while True:
        few = open_.limit(FINISH + 1).collect() if FINISH else []
        if len(few) <= FINISH if FINISH else open_.isEmpty():
            break
        later = open_.select("g", F.col("b").alias("a")).distinct()
        kept = open_.select("g", "a").distinct().join(later, ["g", "a"], "left_anti")
        gone = settled(open_.join(kept, ["g", "a"], "left_semi").select("g", "b").distinct())
        found.append(gone)
        open_ = settled(open_.join(gone, ["g", "b"], "left_anti").join(gone.withColumnRenamed("b", "a"), ["g", "a"], "left_anti").select("g", "a", "b"))
    gone_here: set[tuple] = set()
    for r in sorted(few, key=lambda r: r["b"]):
        if (r["g"], r["a"]) not in gone_here:
            gone_here.add((r["g"], r["b"]))
    out = links.sparkSession.createDataFrame(list(gone_here), schema)
    for part in found:
        out = out.unionByName(part)
    return out


def first_leaders(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``g, k, leader`` of ``rows(g, k)``: itself for a kept row, else the first kept row that is earlier and like it."""
    gone = settled(covered_rows(links))
    led = links.join(gone.withColumnRenamed("b", "a"), ["g", "a"], "left_anti").groupBy("g", F.col("b").alias("k")).agg(F.min("a").alias("leader"))
    return rows.join(led, ["g", "k"], "left").select("g", "k", F.coalesce("leader", "k").alias("leader"))


def order_key(order: list[str], key: str) -> Column:
    """A struct that sorts as the columns do (``-`` before one that falls), the key last."""
    return F.struct(*[(-F.col(c[1:]) if c.startswith("-") else F.col(c)).alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("key"))
