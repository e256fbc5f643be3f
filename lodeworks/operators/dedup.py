"""Deduplication of texts and entities by exact, lexical and greedy rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T


def content_hash(text: Column, head: int = 2000) -> Column:
    return F.sha2(F.substring(text, 1, head), 256)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


# Determiners, abstract endings, and words too generic to stand alone.
DETERMINERS = "the|a|an|this|that|these|those|its|our|their|his|her|my|your"
ENDINGS = "ing|tion|sion|ment|ence|ance|ity|ness|ology|graphy|metry"
GENERIC = [
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "can", "could", "may", "might", "shall", "should", "must", "need", "dare", "ought",
    "used", "about", "above", "across", "after", "against", "along", "among", "around", "before", "behind", "below", "beneath", "beside",
    "between", "beyond", "by", "down", "during", "except", "from", "into", "like", "near", "off", "onto", "out", "outside", "over", "past",
    "since", "through", "till", "toward", "under", "until", "up", "upon", "with", "within", "without", "thing", "things", "stuff", "way",
    "ways", "one", "ones", "part", "parts",
]


def canonical_entity(entity: Column) -> Column:
    """Without leading determiners, the last word naively in the singular."""
    bare = F.regexp_replace(F.trim(entity), rf"(?i)^(({DETERMINERS})\s+)+", "")
    low = F.lower(bare)
    cut = lambda n: F.substring(bare, F.lit(1), F.length(bare) - n)
    return (
        F.when(low.rlike(r"\S{2,}ies$"), F.concat(cut(3), F.lit("y"))).when(low.rlike(r"\S[^s\s]ses$"), cut(1)).when(low.rlike(r"\S{2,}ches$"), cut(2))
        .when(low.rlike(r"\S{2,}[^s\s]s$"), cut(1)).otherwise(bare)
    )


def structural_stability(entity: Column) -> Column:
    """Bonuses and penalties for number of words, length, casing, hyphens, abstract endings and repetition."""
    w = F.filter(F.split(entity, r"\s+"), lambda x: x != "")
    n = F.size(w)
    upper = (F.upper(entity) == entity) & (F.lower(entity) != entity)
    capitals = F.length(F.regexp_replace(entity, "[^A-Z]", ""))
    abstract = F.size(F.filter(w, lambda x: F.lower(x).rlike(f".{{2,}}({ENDINGS})$"))) * 0.5
    repeated = F.size(F.array_distinct(F.transform(w, lambda x: F.lower(x)))) / n < 0.7
    bonus = lambda t, v: F.when(t, v).otherwise(0.0)
    return (
        bonus(n >= 2, 2.0) + bonus(n >= 3, 1.0) + bonus(n > 6, -2.0) + bonus(F.length(entity) < 4, -2.0) + bonus(F.length(entity) > 100, -1.0)
        + bonus(entity.rlike("^[A-Z]") & ~upper, 0.5) + bonus(upper, -2.0) + bonus((F.length(entity) >= 3) & (capitals >= 2) & entity.rlike("[a-z]"), 1.5)
        + bonus(F.size(F.filter(w, lambda x: ~x.rlike("^[A-Z]"))) == 0, 1.0) + bonus(entity.contains("-") & (n == 1), 1.0) + abstract + bonus((n > 1) & repeated, -1.0)
    )


def is_generic(entity: Column) -> Column:
    return (F.size(F.split(F.trim(entity), r"\s+")) == 1) & ((F.length(F.trim(entity)) <= 3) | F.lower(F.trim(entity)).isin(GENERIC))


def tier(entity: Column, frequency: Column, stability: Column) -> Column:
    """expandable, contextual or noise; how often the canonical form occurs counts most."""
    noise = T.is_artifact(entity) | is_generic(entity) | T.is_language_list(entity) | (F.length(entity) <= 2)
    return (
        F.when(noise, "noise").when(frequency >= 3, "expandable").when((frequency == 2) & (stability >= 2.0), "expandable").when(frequency == 2, "contextual")
        .when(stability >= 3.0, "contextual").otherwise("noise")
    )


def tiered_entities(entities: DataFrame, entity: str, position: str) -> DataFrame:
    """Per canonical form with an expandable spelling: frequency and the most stable such spelling, the earliest of equals."""
    x = entities.select(F.col(entity).alias("form"), canonical_entity(F.col(entity)).alias("canonical"), F.col(position).alias("pos"))
    # Spellings are counted before they are compared, so a frequent entity is one row per spelling.
    forms = x.groupBy("canonical", "form").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    totals = forms.groupBy("canonical").agg(F.sum("n").alias("frequency"))
    scored = forms.join(totals, "canonical").withColumn("stability", structural_stability(F.col("form")))
    good = scored.where(tier(F.col("form"), F.col("frequency"), F.col("stability")) == "expandable")
    best = good.groupBy("canonical", "frequency").agg(F.max(F.struct("stability", (-F.col("pos")).alias("early"), "form")).alias("best"))
    return best.select("canonical", "frequency", F.col("best.form").alias("form"), F.lit("expandable").alias("tier"))


def representative(forms: DataFrame, cluster: str, form: str) -> DataFrame:
    """The longest form of a cluster, capitals preferred."""
    score = F.length(form) + F.when(F.col(form).rlike(r"^([A-Z][^ ]* ?)+$"), 10).otherwise(0) + F.when(F.col(form).rlike("^[A-Z]"), 5).otherwise(0)
    return forms.withColumn("__s", score).groupBy(cluster).agg(F.max(F.struct("__s", form))[form].alias(form))


def _anchors(df: DataFrame, text: str) -> DataFrame:
    """``df`` of distinct texts with ``anchor``, the rarest letter trigram of each, or the text itself if it is shorter."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))
    each = df.select(text, F.explode(grams).alias("g"))
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return each.join(often, "g").groupBy(text).agg(F.min(F.struct("n", "g"))["g"].alias("anchor"))


def contained(inner: DataFrame, inner_text: str, outer: DataFrame, outer_text: str) -> DataFrame:
    """``inner, outer``: the distinct pairs of texts of which the first is part of the second, without comparing all.

    A part's rarest trigram occurs in what holds it, so texts meet only under it; texts of under three letters meet under
    all pieces of their length. Null texts are part of nothing; an empty text is part of all, and is left to the caller.
    """
    a = _anchors(inner.select(F.col(inner_text).alias("inner")).where("inner <> ''").distinct(), "inner")
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("outer") - (n - 1), F.lit(1))), lambda i: F.substring("outer", i, F.lit(n)))
    b = outer.select(F.col(outer_text).alias("outer")).where("outer <> ''").distinct().select("outer", F.explode(F.array_distinct(F.concat(pieces(3), pieces(2), pieces(1)))).alias("anchor"))
    return a.join(b, "anchor").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def emergent_topics(counts: DataFrame, concept: str, n: str, known: DataFrame, title: str, least: int = 5, most: int = 10) -> DataFrame:
    """Frequent concepts, but for noise, that are no part of a known title nor contain one; the top ones.

    Letter case does not count. With an empty title among the known ones nothing is new.
    """
    frequent = counts.where((F.col(n) >= least) & ~T.is_noise_concept(F.col(concept))).withColumn("__c", F.lower(concept))
    titles = known.select(F.lower(title).alias("__t")).where("__t IS NOT NULL").distinct()
    related = contained(frequent, "__c", titles, "__t").select(F.col("inner").alias("__c")).union(contained(titles, "__t", frequent, "__c").select(F.col("outer").alias("__c")))
    blank = titles.where("__t = ''").limit(1)
    apart = frequent.join(related.distinct(), "__c", "left_anti").join(F.broadcast(blank), F.lit(True), "left_anti")
    return apart.drop("__c").orderBy(F.desc(n), concept).limit(most)


def merge_topics(known: DataFrame, new: DataFrame, concept: str, n: str) -> DataFrame:
    """Recorded topics and new ones, the greater count of each."""
    return known.select(concept, n).unionByName(new.select(concept, n)).groupBy(concept).agg(F.max(n).alias(n))
