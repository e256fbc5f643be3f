"""Deterministic derivation over numeric atoms, and analytical bundles; every operator works on all groups at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T

RULES_VERSION = "12-A-v1"
# Word lists of the analytical operators.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "of", "at", "by", "for", "with", "in", "on", "to", "from", "is", "are", "was", "were", "be",
    "been", "it", "its", "this", "that", "as", "also", "has", "have", "had", "not", "all", "any", "so", "do", "does", "did", "will", "can",
    "may", "more", "most", "into", "out", "up", "than", "then", "their", "there", "over", "our", "we", "they", "he", "she", "which", "who", "what",
]
PRO = "advantage|benefit|strength|pro|upside|positive|gain|improvement|efficient|fast|simple|easy|flexible|scalable"
CON = "disadvantage|drawback|weakness|con|downside|limitation|risk|slow|complex|difficult|expensive|poor|lack|issue|problem|concern"


@dataclass(frozen=True)
class DerivationConfig:
    """Tolerance of verification, version of the rules, and whether a stored number goes before one in the text."""

    tolerance: float = 1e-9
    version: str = RULES_VERSION
    from_metadata: bool = True


def numbers(text: Column) -> Column:
    """All numbers in a text, without thousands separators; no sign."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9,]+\.?[0-9]*"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda v: v.isNotNull())


def numeric_value(stored: Column, text: Column, config: DerivationConfig = DerivationConfig()) -> Column:  # noqa: B008
    first = F.get(numbers(text), 0)
    return F.coalesce(stored, first) if config.from_metadata else F.coalesce(first, stored)


def claim_id(rule: Column, ids: Column, version: str = RULES_VERSION) -> Column:
    """16 hexadecimal digits of the hash of rule, sorted ids and version."""
    return F.substring(F.sha2(F.concat_ws(":", rule, F.array_join(F.array_sort(ids), ","), F.lit(version)), 256), 1, 16)


def consecutive_pairs(atoms: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """All pairs of a group's atoms in key order, by an equi-join within the (bounded) group."""
    a = atoms.select(group, F.col(key).alias("a"), F.col(value).alias("va"))
    b = atoms.select(group, F.col(key).alias("b"), F.col(value).alias("vb"))
    return a.join(b, group).where("a < b")


def delta(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("delta", F.col("va") - F.col("vb"))


def percent_change(pairs: DataFrame) -> DataFrame:
    """Change from a to b in per cent; pairs with a zero base have none."""
    return pairs.where("va <> 0").withColumn("percent", (F.col("vb") - F.col("va")) / F.col("va") * 100)


def ratio(pairs: DataFrame) -> DataFrame:
    return pairs.where("vb <> 0").withColumn("ratio", F.col("va") / F.col("vb"))


def numeric_rank(atoms: DataFrame, group: str, key: str, value: str) -> DataFrame:
    return atoms.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), F.asc(key))))


def chronology(atoms: DataFrame, group: str, key: str, time: str) -> DataFrame:
    """Earliest and latest atom of each group with at least two, ties by key."""
    ends = atoms.groupBy(group).agg(F.min(F.struct(time, key)).alias("lo"), F.max(F.struct(F.col(time), F.col(key))).alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return ends.select(group, F.col(f"lo.{key}").alias("earliest"), F.col(f"hi.{key}").alias("latest"), (F.unix_timestamp(f"hi.{time}") - F.unix_timestamp(f"lo.{time}")).alias("seconds"), "n")


def support_rollup(atoms: DataFrame, key: str, entity: str, least: int = 2) -> DataFrame:
    """Distinct atoms per entity, for entities with at least ``least``; an atom under several counts for the smallest."""
    return atoms.groupBy(key).agg(F.min(entity).alias(entity)).groupBy(entity).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)


def conflict_rollup(atoms: DataFrame, flag: str, concept: str) -> DataFrame:
    return atoms.where(F.col(flag)).groupBy(F.coalesce(concept, F.lit("unknown")).alias("concept")).agg(F.count(F.lit(1)).alias("conflicts"))


def verify(pairs: DataFrame, rule: str, claimed: str, config: DerivationConfig = DerivationConfig()) -> DataFrame:  # noqa: B008
    """``computed`` where a claimed value differs from the recomputed one; null where it agrees or the rule is unknown."""
    value = {"delta": F.col("va") - F.col("vb"), "percent": F.try_divide(F.col("vb") - F.col("va"), F.col("va")) * 100}.get(rule, F.lit(None).cast("double"))
    return pairs.withColumn("computed", F.when(F.abs(value - F.col(claimed)) > config.tolerance, value))


def derive_all(atoms: DataFrame, group: str, key: str, value: str, time: str, entity: str) -> DataFrame:
    """All rules as one table of (rule, group, ids, value)."""
    pairs = consecutive_pairs(atoms, group, key, value)
    both = F.array(F.col("a").cast("string"), F.col("b").cast("string"))
    row = lambda rule, ids, val: (F.lit(rule).alias("rule"), F.col(group).cast("string").alias("grp"), ids.alias("ids"), val.cast("double").alias("value"))
    parts = [
        delta(pairs).select(*row("delta", both, F.col("delta"))), percent_change(pairs).select(*row("percent_change", both, F.col("percent"))), ratio(pairs).select(*row("ratio", both, F.col("ratio"))),
        numeric_rank(atoms, group, key, value).select(*row("rank", F.array(F.col(key).cast("string")), F.col("rank"))),
        chronology(atoms, group, key, time).select(*row("chronology", F.array(F.col("earliest").cast("string"), F.col("latest").cast("string")), F.col("seconds"))),
        support_rollup(atoms, key, entity).withColumn(group, F.col(entity)).select(*row("support_rollup", F.array(F.col(entity).cast("string")), F.col("support"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("claim_id", claim_id(F.col("rule"), F.col("ids")))


def content_tokens(text: Column) -> Column:
    """Distinct lower-case words of at least two characters that are no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS)))


def compare_contrast(atoms: DataFrame, entity: str, key: str, text: str) -> DataFrame:
    """Per entity with at least two atoms: the tokens that all share, and each atom's own."""
    toks = atoms.select(entity, key, content_tokens(F.col(text)).alias("toks"))
    n = toks.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    each = toks.join(n, entity).select(entity, key, "n", F.explode("toks").alias("tok"))
    common = each.groupBy(entity, "tok").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where("k = n").groupBy(entity).agg(F.array_sort(F.collect_list("tok")).alias("shared"))
    return toks.join(n, entity).join(common, entity, "left").select(
        entity, key, F.coalesce("shared", F.array().cast("array<string>")).alias("shared"), F.array_sort(F.array_except("toks", F.coalesce("shared", F.array().cast("array<string>")))).alias("own")
    )


def tradeoff(text: Column) -> Column:
    """pro, con or null: the side with more words, pro on a tie."""
    count = lambda p: F.size(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike(f"^({p})$")))
    pro, con = count(PRO), count(CON)
    return F.when((pro == 0) & (con == 0), None).when(pro >= con, "pro").otherwise("con")


def pair_methods(atoms: DataFrame, group: str, key: str, kind: str, methods: list[str], results: list[str]) -> DataFrame:
    """The i-th method of a group with its (i modulo n)-th result."""
    order = Window.partitionBy(group).orderBy(key)
    m = atoms.where(F.col(kind).isin(methods)).select(group, F.col(key).alias("method"), (F.row_number().over(order) - 1).alias("i"))
    r = atoms.where(F.col(kind).isin(results)).select(group, F.col(key).alias("result"), (F.row_number().over(order) - 1).alias("j"))
    n = r.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return m.join(n, group).withColumn("j", F.pmod("i", "n").cast("int")).join(r, [group, "j"]).select(group, "method", "result")


def consensus(atoms: DataFrame, group: str, key: str, text: str, threshold: float = 0.25) -> DataFrame:
    """Per group of at least three atoms: how many others each overlaps with, and whether it is consensus or divergent.

    Overlaps come from a similarity join of the token sets; atoms with equal tokens are counted, not paired.
    """
    from .set_join import set_join

    toks = atoms.select(group, key, content_tokens(F.col(text)).alias("toks"))
    hits = set_join(toks, group, key, "toks", threshold).partners().select(F.col("g").alias(group), F.col("key").alias("k"), F.col("partners").alias("overlaps"))
    n = toks.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    out = toks.select(group, F.col(key).alias("k")).join(n, group).join(hits, [group, "k"], "left").select(group, F.col("k").alias(key), "n", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))
    return out.withColumn("stance", F.when(F.col("overlaps") >= (F.col("n") - 1) / 2, "consensus").when(F.col("overlaps") == 0, "divergent"))


def authority_weight(trust: Column, level: Column, days: Column) -> Column:
    grade = F.when(level == "A", 1.0).when(level == "B", 0.8).when(level == "C", 0.6).when(level == "D", 0.4).otherwise(0.5)
    return F.round(trust * grade * F.greatest(1 - days / 3650, F.lit(0.1)), 6)


def change_detection(atoms: DataFrame, group: str, key: str, time: str, value: str) -> DataFrame:
    """Oldest against newest value of a group; none where both have the same time; 0 per cent from a zero base."""
    ends = atoms.where(F.col(value).isNotNull()).groupBy(group).agg(F.min(F.struct(time, key, value)).alias("old"), F.max(F.struct(time, key, value)).alias("new")).where(f"old.{time} <> new.{time}")
    d = F.col(f"new.{value}") - F.col(f"old.{value}")
    return ends.select(group, F.col(f"old.{key}").alias("old_key"), F.col(f"new.{key}").alias("new_key"), d.alias("delta"), F.when(F.col(f"old.{value}") == 0, 0.0).otherwise(F.try_divide(d, F.col(f"old.{value}")) * 100).alias("percent"))


def token_overlap(a: Column, b: Column) -> Column:
    return T.jaccard(content_tokens(a), content_tokens(b))
