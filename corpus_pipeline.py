"""Corpus pipeline: language ID, exact dedup, near-dedup by shingles, PII, best-fit packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import materialise, remove_path, scratch_path, scratch_scope
from lodeworks.llm.exact_dedup import exact_duplicates
from lodeworks.llm.langid import UNDETERMINED, identify, learn, vocabulary
from lodeworks.llm.packing import pack_documents
from lodeworks.llm.pii import find_identifiers, redact
from lodeworks.llm.simhash import similar_documents

#: The near-dedup stage: words of a shingle, and the similarity of near duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under column names that clash with none of the operators', and what each column is called there."""
    names = {c: f"col_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the language predicted from the text; documents without a determinable language go.

    The model learns from a bounded sample of the labelled documents. Null texts and texts without a letter are
    undetermined. An empty table, or one without labels, has no language to predict and keeps nothing.
    """
    plain, names = _plain(docs)
    model = learn(plain, vocabulary(public_tokenizers.path("piece_bpe_32k.model")), names["text"], names["lang"])
    found = identify(plain, model, names["text"], tuple(plain.columns)).where(F.col("lang_pred") != UNDETERMINED)
    return found.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in names.items()])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts stays: that with the largest doc_id."""
    plain, names = _plain(docs)
    kept = exact_duplicates(plain, names["doc_id"], names["text"], carry=tuple(plain.columns)).where("kept")
    return kept.select(*[F.col(f"{n}__").alias(c) for c, n in names.items()])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the first of the table.

    Row numbers are written before they are used, since a scan may be split otherwise the next time.
    """
    plain, names = _plain(docs)
    numbered = materialise(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = similar_documents(numbered, "row", names["text"], SHINGLE_WORDS, SIMILARITY)
    dropped = found.where("id <> component_id").select("id")
    return numbered.join(dropped, F.col("row") == F.col("id"), "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data in the texts; ``n_chars`` follows. No document goes."""
    plain, names = _plain(docs)
    text = names["text"]
    found = find_identifiers(plain, text, tuple(plain.columns)).withColumn(text, redact(F.col(text), F.col("spans")))
    return found.select(*[F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(n).alias(c) for c, n in names.items()])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2048 tokens; one row per piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the language model, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to the written result of the one before.

    What a stage writes on its way, and the result before the last, are removed once its own result is written.
    """
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, path)
        if held:
            remove_path(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
