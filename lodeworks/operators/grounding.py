"""Checks that cited text is grounded in its sources, and limits on responses."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T

from .derivation import STOPWORDS

NOT_WORD = r"[^\p{L}\p{N}_]+"
# Opposite words.
ANTONYMS = [
    ("not", "is"), ("never", "always"), ("true", "false"), ("increases", "decreases"), ("supports", "opposes"), ("enables", "prevents"), ("causes", "prevents"),
    ("correct", "incorrect"), ("valid", "invalid"), ("possible", "impossible"), ("required", "optional"), ("safe", "unsafe"), ("works", "fails"), ("better", "worse"),
]


def tokenise(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(tokenise(text), lambda t: ~t.isin(STOPWORDS)))


def stated_numbers(text: Column) -> Column:
    """Numbers as written, without a closing full stop."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*\.?[0-9]*"), F.lit(0)), lambda n: F.regexp_replace(n, r"\.+$", ""))


def entities(text: Column) -> Column:
    """Words with a capital, of at least two characters, but for the first word."""
    w = F.filter(F.split(text, NOT_WORD), lambda t: t != "")
    return F.filter(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda t: (F.length(t) > 1) & (F.lower(t) != t))


def citation_segments(text: Column) -> Column:
    """The text before each citation ``[A12]`` with that citation; text after the last has none."""
    marks = F.regexp_extract_all(text, F.lit(r"\[[A-Za-z0-9]+\]"), F.lit(0))
    parts = F.split(text, r"\[[A-Za-z0-9]+\]", -1)
    cut = F.zip_with(parts, marks, lambda p, m: F.struct(F.trim(p).alias("text"), F.regexp_replace(m, r"[\[\]]", "").alias("citation")))
    return F.filter(cut, lambda s: (s["text"] != "") | s["citation"].isNotNull())


def grounded(claims: DataFrame, items: DataFrame, claim: str, citation: str, key: str, content: str, least: int = 2) -> DataFrame:
    """Claims joined to the items they cite: lexical overlap, unsupported numbers and entities, and whether all agree."""
    joined = claims.join(items.select(F.col(key).alias(citation), F.col(content).alias("__item")), citation, "left")
    overlap = F.size(F.array_intersect(content_words(F.col(claim)), content_words(F.coalesce("__item", F.lit("")))))
    numbers = F.size(F.array_except(stated_numbers(F.col(claim)), stated_numbers(F.coalesce("__item", F.lit("")))))
    names = F.size(F.array_except(entities(F.col(claim)), F.filter(F.split(F.coalesce("__item", F.lit("")), NOT_WORD), lambda t: t != "")))
    out = joined.withColumn("overlap", overlap).withColumn("lost_numbers", numbers).withColumn("lost_entities", names).withColumn("known", F.col("__item").isNotNull())
    return out.withColumn("valid", F.col("known") & (F.col("overlap") >= least) & (F.col("lost_numbers") == 0) & (F.col("lost_entities") == 0)).drop("__item")


def section_report(sections: DataFrame, key: str, text: str) -> DataFrame:
    """Per section: sentences, those with a citation, words, and whether every sentence is cited."""
    s = sections.select(key, F.explode(T.split_sentences(F.col(text))).alias("s"))
    cited = F.col("s").rlike(r"\[[A-Za-z]?[0-9]+\]")
    return s.groupBy(key).agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if(cited).alias("cited"), F.sum(T.word_count(F.col("s"))).alias("words"), F.bool_and(cited).alias("all_cited")
    )


def repetitions(text: Column, threshold: float = 0.5) -> Column:
    """Places of sentences whose words overlap an earlier sentence that is no repetition by more than the threshold."""
    bags = F.transform(T.split_sentences(text), lambda s: F.array_distinct(tokenise(s)))

    def again(bags: list[list[str]]) -> list[int]:
        holders, sizes, out = {}, [], []
        for at, bag in enumerate(bags):
            shared = Counter(k for w in bag for k in holders.get(w, ()))
            if any(n / min(len(bag), sizes[k]) > threshold for k, n in shared.items()):
                out.append(at)
                continue
            for w in bag:
                holders.setdefault(w, []).append(len(sizes))
            sizes.append(len(bag))
        return out

    def run(column: pa.Array) -> pa.Array:
        found = (None if bags is None else again(bags) for at in range(0, len(column), 128) for bags in column.slice(at, 128).to_pylist())
        return pa.array(found, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(bags)


def hard_stop(text: Column, sentences: int = 6) -> Column:
    return F.array_join(F.slice(T.split_sentences(text), 1, sentences), " ")


def polarity_conflict(a: Column, b: Column) -> Column:
    """One text has a word and the other its opposite, as substrings."""
    x, y = F.lower(a), F.lower(b)
    out = F.lit(False)
    for p, n in ANTONYMS:
        out = out | (x.contains(p) & y.contains(n)) | (x.contains(n) & y.contains(p))
    return out


def loops(turns: DataFrame, session: str, order: str, text: str, least: float = 0.85) -> DataFrame:
    """Turns whose words all but repeat the turn before."""
    before = F.lag(text).over(Window.partitionBy(session).orderBy(order))
    x = turns.withColumn("__before", before)
    return x.withColumn("similarity", T.jaccard(F.array_distinct(tokenise(F.col(text))), F.array_distinct(tokenise(F.coalesce("__before", F.lit("")))))).withColumn("loop", F.col("similarity") > least).drop("__before")
