"""The knowledge schema as views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import text as T

ATOM_STRIDE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a small table, which may be a single row group, over all cores before costly expressions.

    It moves at most 32 MB a core; larger tables have row groups enough and stay where they are.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(width) if 1 < width and size < width << 25 else df


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence of ``documents``: an atom; its topic is the source, its mission the language."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    one = docs.select("doc_id", "lang", "source", F.posexplode(T.split_sentences(F.coalesce("text", F.lit("")))).alias("pos", "statement"))
    return one.select(
        (F.col("doc_id") * ATOM_STRIDE + F.col("pos")).alias("atom_id"), F.col("source").alias("topic_id"), F.col("lang").alias("mission_id"),
        F.col("doc_id").alias("source_id"), "pos", "statement",
    )


WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"

#: The same view in SQL: sentence ends are marked first, since the regular expressions there have no look-behind.
ATOMS_SQL = f"""
sents AS (
  SELECT doc_id, lang, source, list_filter(list_transform(
    string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {WS})), lambda x: x <> '') AS ss
  FROM documents
), atoms AS (
  SELECT doc_id * {ATOM_STRIDE} + i - 1 AS atom_id, source AS topic_id, lang AS mission_id, doc_id AS source_id, CAST(i - 1 AS INTEGER) AS pos, ss[i] AS statement
  FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM sents)
)"""


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(map(sql_quote, words)) + "]"


def sql_any(text: str, words: list[str]) -> str:
    return f"list_bool_or(list_transform({sql_list(words)}, lambda n: contains({text}, n)))"


def sql_count(text: str, words: list[str]) -> str:
    return f"len(list_filter({sql_list(words)}, lambda n: contains({text}, n)))"
