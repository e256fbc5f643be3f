"""Scans and keyed writes: relational access as set operations on DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(df: DataFrame, where: dict[str, Any]) -> DataFrame:
    """Rows equal to all given values; a null value matches nothing."""
    for name, value in where.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def fetch_one(df: DataFrame, where: dict[str, Any]) -> DataFrame:
    return matching(df, where).limit(1)


def fetch_many(df: DataFrame, where: dict[str, Any], order_by: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Filtered scan; a limit of 0 or none means all rows."""
    found = matching(df, where)
    found = found.orderBy(*order_by) if order_by else found
    return found.limit(limit) if limit else found


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert; columns that rows lack are null."""
    return table.unionByName(rows.select(*[c for c in rows.columns if c in table.columns]), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Keyed upsert: of several rows for a key that with the highest sequence wins; columns not supplied are kept."""
    last = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", sequence)
    given = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"__{c}") for c in given], F.lit(True).alias("__hit"))
    joined = table.join(new, keys, "full_outer")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns])


def update(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Updates existing rows by key; keys that the table lacks are ignored."""
    given = [c for c in rows.columns if c != key]
    new = rows.select(key, *[F.col(c).alias(f"__{c}") for c in given], F.lit(True).alias("__hit"))
    return table.join(new, key, "left").select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, where: dict[str, Any]) -> DataFrame:
    if not where:
        raise ValueError("a delete needs a predicate")
    hit = F.lit(True)
    for name, value in where.items():
        hit = hit & (F.col(name) == F.lit(value))
    return table.filter(~F.coalesce(hit, F.lit(False)))


def replace_children(table: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``rows`` are replaced by those rows."""
    return table.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows, allowMissingColumns=True).select(*table.columns)


def enforce_parent(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with at least one child; the others are what a caller must reject."""
    return parents.join(children.select(key).distinct(), key, "left_semi")


def ingest(existing: DataFrame, arrivals: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """Arrivals that are new by identity, one of each, the first in the given order."""
    first = Window.partitionBy(*identity).orderBy(*order)
    one = arrivals.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return one.join(existing.select(*identity).distinct(), identity, "left_anti")


def stale_embeddings(sources: DataFrame, registry: DataFrame, key: str, model: str) -> DataFrame:
    """Sources whose embedding is missing or of another model."""
    return sources.join(registry.select(key, F.col("model").alias("__m")), key, "left").where(F.coalesce(F.col("__m") != model, F.lit(True))).drop("__m")
