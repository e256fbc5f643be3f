"""Knowledge-base operators: evidence, concepts, contradictions, signals, planning and frontier decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T

from .derivation import content_tokens

# Legal moves of a source, and preference wording.
TRANSITIONS = {"discovered": ["fetched", "failed"], "fetched": ["filtered_out", "condensing", "failed"], "condensing": ["condensed", "failed"], "condensed": [], "filtered_out": [], "failed": ["fetched"]}
LEAKAGE = ["you are an ai", "system prompt", "as an assistant", "ignore previous", "instructions:", "output json", "respond with"]
PREFERENCE = r"(?i)\bi (?:really )?(prefer|like|love|want|hate|dislike) ([^.!?,]{3,60})"


def trigrams(text: Column) -> Column:
    """Distinct letter trigrams of each word, padded by two blanks before and one after."""
    w = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")
    grams = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.substring(F.concat(F.lit("  "), x, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(w, grams)))


def trigram_similarity(text: Column, query: str) -> Column:
    return T.jaccard(trigrams(text), trigrams(F.lit(query)))


def legal_move(current: Column, target: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    return F.coalesce(F.array_contains(F.element_at(table, current), target), F.lit(False))


def normalise_atom(text: Column, kind: Column, confidence: Column) -> Column:
    """Struct of text, type and confidence, or null for fragments, bare urls and leaked prompts."""
    body = T.strip(text)
    ok = (F.length(body) >= 15) & ~body.rlike(r"^https?://\S+$") & ~T.contains_any(F.lower(body), LEAKAGE)
    words = F.when(F.lower(confidence) == "low", 0.2).when(F.lower(confidence) == "medium", 0.5).when(F.lower(confidence) == "high", 0.85)
    score = F.coalesce(words, F.least(F.greatest(confidence.try_cast("double"), F.lit(0.0)), F.lit(1.0)), F.when(confidence.isNull(), 0.6).otherwise(0.5))
    known = F.when(F.lower(kind).isin("claim", "definition", "fact", "mechanism", "comparison", "metric"), F.lower(kind)).otherwise("claim")
    return F.when(ok, F.struct(body.alias("text"), known.alias("kind"), score.alias("confidence")))


def knowledge_unit(text: Column, kind: Column) -> Column:
    """Id and terminated text of a unit."""
    body = F.when(T.strip(text).rlike("[.!?]$"), T.strip(text)).otherwise(F.concat(T.strip(text), F.lit(".")))
    return F.struct(F.concat(F.lit("ku_"), F.substring(F.sha2(F.concat(kind, F.lit(":"), body), 256), 1, 12)).alias("id"), body.alias("text"))


def document_of(*parts: Column) -> Column:
    """Non-empty parts, a line each: what the vector index stores of a record."""
    return F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def preserved(original: Column, repaired: Column) -> Column:
    """Drift of a repair: one less the share of the original's longer tokens that stay; three places."""
    long = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^a-z0-9]+"), lambda w: F.length(w) > 3))
    a, b = long(original), long(repaired)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.bround(1 - F.size(F.array_intersect(a, b)) / F.size(a), 3))


def negated(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(not|no|never|without)\b|n't")


def entity_phrases(text: Column) -> Column:
    """Runs of at least two capitalised words, and words with inner capitals."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0))
    camel = F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+[A-Z][A-Za-z]*"), F.lit(0))
    return F.concat(runs, camel)


def preferences(text: Column) -> Column:
    verbs, objects = (F.regexp_extract_all(text, F.lit(PREFERENCE), F.lit(i)) for i in (1, 2))
    return F.zip_with(verbs, objects, lambda v, o: F.struct(F.lower(v).alias("verb"), F.trim(o).alias("object")))


def govern_queries(queries: DataFrame, group: str, text: str, order: str, anchor: str) -> DataFrame:
    """White space collapsed, one of each wording (the first), at least one token in common with the anchor."""
    q = queries.withColumn("clean", F.trim(F.regexp_replace(text, r"\s+", " "))).where("clean <> ''")
    q = q.withColumn("__n", F.row_number().over(Window.partitionBy(group, F.lower("clean")).orderBy(order))).where("__n = 1").drop("__n")
    return q.where(F.arrays_overlap(T.tokens(F.col("clean")), T.tokens(F.col(anchor))))


def chunk_evidence(atoms: DataFrame, chunks: DataFrame, source: str, atom: str, statement: str, chunk: str, body: str, least: float = 0.15) -> DataFrame:
    """Each atom's chunk within its source: one that contains it, else the most alike in words, else the first."""
    a = atoms.select(source, F.col(atom).alias("a"), F.col(statement).alias("s"), content_tokens(F.col(statement)).alias("sw"))
    c = chunks.select(source, F.col(chunk).alias("c"), F.col(body).alias("b"), content_tokens(F.col(body)).alias("bw"))
    scored = a.join(c, source).withColumn("score", F.when(F.col("b").contains(F.col("s")) | F.col("s").contains(F.col("b")), 1.0).otherwise(T.jaccard(F.col("sw"), F.col("bw"))))
    # The maximum needs no sort of a source's pairs and is combined before the shuffle.
    best = scored.groupBy(source, "a").agg(F.max(F.struct("score", (-F.col("c")).alias("neg"))).alias("m"), F.min("c").alias("first"))
    return best.select(source, F.col("a").alias(atom), F.when(F.col("m.score") >= least, -F.col("m.neg")).otherwise(F.col("first")).alias(chunk), F.when(F.col("m.score") >= least, F.col("m.score")).alias("score"))


def link_signals(items: DataFrame, key: str, authority: DataFrame, contradictions: DataFrame, other: str) -> DataFrame:
    """Flags of items that an authority lists or a contradiction binds."""
    a = authority.select(F.col(other).alias(key)).distinct().withColumn("__a", F.lit(True))
    c = contradictions.select(F.col(other).alias(key)).distinct().withColumn("__c", F.lit(True))
    return items.join(a, key, "left").join(c, key, "left").select(*items.columns, F.col("__a").isNotNull().alias("authority_aligned"), F.col("__c").isNotNull().alias("contradiction_bound"))


def build_concepts(atoms: DataFrame, cluster: str, text: str, reliability: str, kind: str, contradicts: str, least: int = 5, most_rate: float = 0.2, limit: int = 1200) -> DataFrame:
    """Stable clusters as concepts: size, mean reliability, name of their types, a summary of the best atoms within a length."""
    g = atoms.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg(reliability).alias("reliability"), F.array_join(F.array_sort(F.collect_set(kind)), ", ").alias("name"),
        (F.count_if(F.col(contradicts)) / (F.count(F.lit(1)) * 2)).alias("contradiction_rate"),
    ).where((F.col("n") >= least) & (F.col("contradiction_rate") <= most_rate))
    top = Window.partitionBy(cluster).orderBy(F.desc(reliability), text)
    t = atoms.withColumn("k", F.row_number().over(top)).where("k <= 5").withColumn("used", F.sum(F.length(text) + 1).over(top.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= limit)
    s = t.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text))), lambda x: x[text]), " ").alias("summary"))
    return g.join(s, cluster, "left")


def anchors(beliefs: DataFrame, concept: str, belief: str, domain: str) -> DataFrame:
    from lodeworks.functions import scores as S

    g = beliefs.groupBy(concept).agg(F.countDistinct(domain).alias("domains"), F.countDistinct(belief).alias("beliefs"))
    return g.withColumn("authority", F.least(F.lit(1.0), S.anchor_authority(F.col("domains"), F.col("beliefs"), F.col("domains") >= 2)))


def adjudicate(pairs: DataFrame, conf_a: str, conf_b: str) -> DataFrame:
    """The surer side of a contradiction wins at four fifths of its confidence; ties go to the first."""
    a, b = F.col(conf_a), F.col(conf_b)
    return pairs.withColumn("winner", F.when(a >= b, "a").otherwise("b")).withColumn("confidence", F.greatest(a, b) * 0.8)


def section_plan(atoms: DataFrame, packet: str, entity: str, atom: str, kind: str) -> DataFrame:
    """Sections of a packet: one per entity with at least two atoms, largest first, and the mode of each."""
    g = atoms.groupBy(packet, entity).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(kind) == "contradiction").alias("c"), F.max(F.col(kind) == "method").alias("m"))
    mode = F.when(F.col("c"), "adjudicative").when(F.col("m"), "implementation").when(F.col("n") >= 4, "comparative").otherwise("descriptive")
    return g.where("n >= 2").select(packet, entity, "n", mode.alias("mode"), F.row_number().over(Window.partitionBy(packet).orderBy(F.desc("n"), entity)).alias("section"))


def novelty(vectors: DataFrame, best_similarity: str) -> Column:
    """Novelty from the distance to the nearest neighbour; .8 where there is none."""
    return F.coalesce(F.least(F.lit(1.0), (1 - F.col(best_similarity)) / 1.5), F.lit(0.8))


def running_redundancy(atoms: DataFrame, group: str, order: str, signature: str) -> DataFrame:
    """Redundancy of each atom against all grams of the group's atoms before it, by counts of first appearances.

    ``seen`` before an atom is the number of grams whose first appearance is earlier; so no set is carried along.
    """
    # A signature is evaluated once: each atom adds a row of its own, without a gram, that keeps its place and size.
    # Nulls come first in the order. Minima are combined before the shuffle and need no sort of the grams.
    none = F.lit(None).cast(atoms.schema[order].dataType)
    gram = atoms.schema[signature].dataType.elementType
    entry = lambda g, at, own: F.struct(g.alias("gram"), at.alias("at"), own.alias("own"))
    own = entry(F.lit(None).cast(gram), F.col(order), F.size(signature))
    entries = F.concat(F.array(own), F.transform(F.coalesce(signature, F.array().cast(atoms.schema[signature].dataType)), lambda g: entry(g, none, F.lit(None).cast("int"))))
    rows = atoms.select(group, order, F.inline(entries))
    firsts = rows.groupBy(group, "gram", "at", "own").agg(F.when(F.bool_and(F.col(order).isNotNull()), F.min(order)).alias(order), F.count(F.lit(1)).alias("times"))
    atom = F.col("own").isNotNull()
    sizes = firsts.groupBy(group, order).agg(F.count_if(~atom).alias("new"), F.flatten(F.collect_list(F.when(atom, F.array_repeat("own", F.col("times").cast("int"))))).alias("owns"))
    sizes = sizes.select(group, order, F.explode("owns").alias("own"), F.when(F.col(order).isNull() | F.col(group).isNull(), 0).otherwise(F.col("new")).alias("new"))
    before = F.coalesce(F.sum("new").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = sizes.withColumn("seen", before)
    similarity = (F.col("own") - F.col("new")) / (F.col("seen") + F.col("new"))
    return x.withColumn("redundancy", F.when(F.col("seen") == 0, 1.0).otherwise(F.pow(1 - similarity, F.lit(2.0))))
