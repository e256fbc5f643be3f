"""Query scoring by intent, distillation, novelty, claim merging and the decisions of a research loop."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import scores as S
from lodeworks.functions import text as T

from .graph import settled
from .greedy import first_leaders
from .set_join import set_join
from .vectors import cosine

# Weights by intent and the evidence that an intent asks for.
INTENT_WEIGHTS = {
    "factual": {"reliability": 0.45, "query_relevance": 0.25, "specificity": 0.15, "centrality": 0.10, "recency": 0.05},
    "comparative": {"reliability": 0.30, "query_relevance": 0.30, "specificity": 0.20, "centrality": 0.10, "recency": 0.10},
    "procedural": {"reliability": 0.40, "query_relevance": 0.25, "specificity": 0.15, "centrality": 0.15, "recency": 0.05},
    "conceptual": {"reliability": 0.25, "query_relevance": 0.20, "specificity": 0.25, "centrality": 0.20, "recency": 0.10},
    "exploratory": {"reliability": 0.20, "query_relevance": 0.20, "specificity": 0.20, "centrality": 0.20, "recency": 0.20},
}
MODES = ["grounding", "verification", "dialectic", "expansion"]
#: Reference vectors of the density gate at most.
REFERENCES = 1024
RELIABLE_HOSTS = [(r"\.edu$|\.gov$", 0.9), (r"wikipedia\.org$", 0.7), (r"github\.com$", 0.7), (r"\.org$", 0.6)]


def intent_score(intent: Column, parts: dict[str, Column], boosted: Column, excluded: Column) -> Column:
    """Weighted parts by intent, three tenths more for boosted types, 0 for excluded ones."""
    total = F.lit(0.0)
    for name, value in parts.items():
        weight = F.element_at(F.create_map(*[x for k, w in INTENT_WEIGHTS.items() for x in (F.lit(k), F.lit(w[name]))]), intent)
        total = total + weight * S.clamp(value)
    return F.when(excluded, 0.0).otherwise(S.clamp(total * F.when(boosted, 1.3).otherwise(1.0)))


def distil(text: Column, most_tokens: int = 800, most_chars: int = 3000) -> Column:
    """Embedding-safe chunks of a text: cleaned, split, filtered; one chunk if small, else windows of ten sentences by seven.

    Without an informative sentence: up to five of the most fact-like sentences.
    """
    cut = lambda c: F.when(F.length(c) <= most_chars, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most_chars), r"(?s)\. (?!.*\. ).*$", ""), F.lit(".")))

    def of_atoms(atoms: Column) -> Column:
        joined = F.array_join(atoms, " ")
        windows = F.transform(T.sliding_windows(atoms, 10, 7), lambda w: cut(F.array_join(w, " ")))
        return F.when(T.rough_token_count(joined) <= most_tokens, F.array(cut(joined))).otherwise(windows)

    def of_sentences(sentences: Column) -> Column:
        facts = F.filter(sentences, lambda s: (F.length(s) >= 20) & (T.fact_score(s) >= 2))
        best = F.slice(F.transform(F.array_sort(F.transform(facts, lambda s, i: F.struct((-T.fact_score(s)).alias("k"), i.alias("i"), s.alias("s")))), lambda x: x["s"]), 1, 5)
        return T.let(F.filter(sentences, T.is_informational), lambda a: F.when(F.size(a) > 0, of_atoms(a)).otherwise(best))

    return T.let(T.split_sentences(T.clean_boilerplate(text)), of_sentences)


def density_gate(vectors: DataFrame, references: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """Greatest cosine to low-value and to high-value reference vectors; skipped if close to the former only.

    References are a set of fixed texts; their number is checked before they are broadcast.
    """
    if references.limit(REFERENCES + 1).count() > REFERENCES:
        raise ValueError(f"at most {REFERENCES} references; for more, use nearest_centroid per kind")
    r = references.select(F.col(kind).alias("__k"), F.col(vector).alias("__v"))
    s = vectors.select(key, vector).join(F.broadcast(r)).withColumn("s", cosine(F.col(vector), F.col("__v")))
    g = s.groupBy(key).agg(F.max(F.when(F.col("__k") == "low", F.col("s"))).alias("low"), F.max(F.when(F.col("__k") == "high", F.col("s"))).alias("high"))
    return g.withColumn("skip", (F.coalesce("low", F.lit(0.0)) > 0.85) & (F.coalesce("high", F.lit(0.0)) < 0.60))


def text_similarity(a: Column, b: Column, stop: list[str]) -> Column:
    """The greater of word Jaccard and overlap of content words; 0 if either has no word."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    own = lambda w: F.filter(w, lambda x: ~x.isin(stop))
    x, y = words(a), words(b)
    least = F.least(F.size(own(x)), F.size(own(y)))
    overlap = F.when(least > 0, F.size(F.array_intersect(own(x), own(y))) / least).otherwise(0.0)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.greatest(T.jaccard(x, y), overlap))


def phrase_novelty(atoms: DataFrame, group: str, key: str, text: str, n: int = 4) -> DataFrame:
    """Per group: pairs whose 4-grams overlap by over half of the smaller set, their share of all pairs, and the risk."""
    grams = F.filter(T.ngrams(T.words(F.lower(text)), n), lambda x: F.size(F.split(x, " ")) == n)
    hits = set_join(atoms, group, key, grams, 0.5, "overlap", strict=True).pair_counts().withColumnRenamed("pairs", "overlapping")
    sizes = atoms.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    out = sizes.join(hits, "g", "left").withColumn("overlapping", F.coalesce("overlapping", F.lit(0))).withColumn("ratio", F.col("overlapping") / F.greatest("pairs", F.lit(1)))
    return out.select(F.col("g").alias(group), "pairs", "overlapping", "ratio", F.when(F.col("ratio") > 0.5, "high").when(F.col("ratio") > 0.25, "medium").otherwise("low").alias("risk"))


def merge_claims(claims: DataFrame, topic: str, order: str, claim: str, confidence: str, least: float = 0.6) -> DataFrame:
    """Claims of a topic folded in order: one like an earlier kept claim raises its version and halves towards its confidence.

    Likeness is a Jaccard similarity of words above ``least``; a claim joins the first kept one that it is like. Kept
    claims are found in parallel (``greedy``), and equal sets of words are one claim there. A member's weight is a half
    to the power of its place from the end, so the confidence is a sum and no list of a claim's members is held. Null and
    empty claims are like nothing. Claims of one place in the order are taken as their texts and confidences go, and of
    those that are equal each counts.
    """
    x = claims.select(F.struct(topic).alias("g"), F.col(order).alias("o"), F.col(claim).alias("claim"), F.col(confidence).cast("double").alias("confidence"))
    x = x.groupBy("g", "o", "claim", "confidence").agg(F.count(F.lit(1)).alias("times"))
    # Claims are named by their place, so that joins do not carry their texts.
    named = F.row_number().over(Window.partitionBy("g", "o").orderBy("claim", "confidence"))
    x = settled(x.withColumn("k", F.struct("o", named.alias("n"))))
    words = F.filter(F.split(F.lower("claim"), r"\s+"), lambda w: w != "")
    joined = set_join(x, "g", "k", words, least, strict=True)
    classes = joined.classes.select("g", F.col("c").alias("k"))
    led = first_leaders(classes, settled(joined.pairs.select("g", "a", "b"))).withColumnRenamed("k", "c")
    member = joined.members.join(led, ["g", "c"]).select("g", F.col("key").alias("k"), "leader")
    # Repeats of a row with words join its own first occurrence's leader; of one without words, each is a claim of its own.
    every = x.join(member, ["g", "k"], "left").withColumn("copy", F.explode(F.expr("sequence(1L, if(leader IS NULL, times, 1L))")))
    every = every.select("g", F.coalesce("leader", "k").alias("leader"), F.when(F.col("leader").isNull(), F.col("copy")).alias("copy"), "k", "confidence", F.when(F.col("leader").isNull(), 1).otherwise(F.col("times")).alias("times"))
    w = Window.partitionBy("g", "leader", "copy").orderBy(F.desc("k"))
    after = F.coalesce(F.sum("times").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.lead("k").over(w).isNull()
    half = lambda n: F.pow(F.lit(0.5), n)
    # A run of t equal confidences with n claims after it weighs 2^-n - 2^-(n+t); the first of all keeps the rest.
    weight = F.when(first, half("n")).otherwise(half("n") - half(F.col("n") + F.col("times")))
    parts = every.withColumn("n", after).withColumn("share", weight * F.col("confidence"))
    folded = parts.groupBy("g", "leader", "copy").agg(F.sum("share").alias("confidence"), F.sum("times").cast("int").alias("members"))
    folded = folded.join(x.select("g", F.col("k").alias("leader"), "claim"), ["g", "leader"])
    return folded.select(F.col(f"g.{topic}").alias(topic), "claim", F.col("members").alias("version"), "confidence", "members")


def convergence(cycles: DataFrame, mission: str, order: str, found: str, window: int = 5) -> DataFrame:
    """Novelty rate and yield entropy over the last cycles, and whether a mission should stop."""
    w = Window.partitionBy(mission).orderBy(order).rowsBetween(-(window - 1), 0)
    x = cycles.withColumn("__y", F.collect_list(found).over(w)).withColumn("cycle", F.row_number().over(Window.partitionBy(mission).orderBy(order)))
    n, total = F.size("__y"), F.aggregate("__y", F.lit(0.0), lambda a, y: a + y)
    rate = F.size(F.filter("__y", lambda y: y > 0)) / n
    h = -F.aggregate("__y", F.lit(0.0), lambda a, y: a + F.when(y > 0, y / F.col("__t") * F.log2(y / F.col("__t"))).otherwise(0.0))
    x = x.withColumn("__t", total).withColumn("novelty_rate", rate)
    x = x.withColumn("entropy", F.when(n < 3, 1.0).when(F.col("__t") == 0, 0.0).otherwise(h / F.log2(n.cast("double"))))
    return x.withColumn("stop", (F.col("cycle") >= window) & ((F.col("novelty_rate") < 0.05) | (F.col("entropy") < 0.3))).drop("__y", "__t")


def approval_reason(usage: Column, respawns: Column) -> Column:
    return F.when(usage >= 0.92, "BUDGET_PRESSURE").when(respawns >= 4, "SCOPE_EXPANSION").when((respawns >= 2) & (usage >= 0.85), "BUDGET_AND_SCOPE")


def next_action(nodes: DataFrame, node: str, exhausted: str, order: str) -> DataFrame:
    """The node with the fewest exhausted modes that has one left, and its first open mode."""
    open_ = F.array_except(F.array(*map(F.lit, MODES)), F.col(exhausted))
    return nodes.withColumn("mode", F.get(open_, 0)).where("mode IS NOT NULL").orderBy(F.size(exhausted), order).limit(1).select(node, "mode")


def active_concepts(items: DataFrame, session: str, label: str, salience: str, most: int = 6) -> DataFrame:
    best = items.groupBy(session, F.lower(label).alias("label")).agg(F.max(salience).alias("salience"))
    return best.withColumn("k", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("salience"), "label"))).where(F.col("k") <= most)


def agenda(parts: list[tuple[DataFrame, str, float]], title: str, most: int) -> DataFrame:
    """Prioritised sources as one list, the best first."""
    out = None
    for df, kind, priority in parts:
        p = df.select(F.col(title).alias("title"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))
        out = p if out is None else out.unionByName(p)
    return out.orderBy(F.desc("priority"), "kind", "title").limit(most)


def expand_concepts(top: DataFrame, members: DataFrame, rank: str, concept: str, atom: str, position: str) -> DataFrame:
    """Members of ranked concepts, each atom at its first appearance."""
    x = top.select(concept, rank).join(members, concept)
    return x.withColumn("__n", F.row_number().over(Window.partitionBy(atom).orderBy(rank, position))).where("__n = 1").drop("__n")


def blind_spots(outcomes: DataFrame, domain: str, predicted: str, actual: str, authority: str, least: int = 3) -> DataFrame:
    """Domains with enough outcomes that err too often, are poorly calibrated or lack authority."""
    g = outcomes.groupBy(domain).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(actual), 0.0).otherwise(1.0)).alias("error_rate"),
        F.abs(F.avg(predicted) - F.avg(F.col(actual).cast("double"))).alias("calibration_error"), F.avg(authority).alias("authority"),
    ).where(F.col("n") >= least)
    return g.withColumn("blind", (F.col("calibration_error") >= 0.15) | (F.col("error_rate") > 0.4) | (F.col("authority") < 0.4))


def abstraction_gate(atoms: DataFrame, group: str, concept: str, source: str) -> DataFrame:
    g = atoms.groupBy(group).agg(F.count(F.lit(1)).alias("atoms"), F.countDistinct(concept).alias("concepts"), F.countDistinct(source).alias("sources"))
    return g.withColumn("eligible", (F.col("atoms") >= 3) & ((F.col("concepts") >= 2) | (F.col("sources") >= 2)))


def url_reliability(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    out = F.lit(0.5)
    for pattern, score in reversed(RELIABLE_HOSTS):
        out = F.when(host.rlike(pattern), score).otherwise(out)
    return F.when(host == "", 0.3).otherwise(out)


def character_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the sets of characters."""
    chars = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), ""), lambda c: c != ""))
    return T.jaccard(chars(a), chars(b))


def merge_unique(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def role_rows(bundles: DataFrame, key: str, roles: str) -> DataFrame:
    """A map of role to atoms as rows with their position."""
    return bundles.select(key, F.explode(roles).alias("role", "atoms")).select(key, "role", F.posexplode("atoms").alias("position", "atom"))


def maturation(atoms: DataFrame, record: str) -> DataFrame:
    """Confidence of an authority record by its number of atoms, .92 at most."""
    n = atoms.groupBy(record).agg(F.count(F.lit(1)).alias("atoms"))
    return n.withColumn("confidence", F.least(F.lit(0.92), F.bround(F.col("atoms") * 0.02 + 0.6, 2)))


def weak_dimensions(dimensions: DataFrame, text: DataFrame, key: str, dimension: str, body: str, most: int = 3) -> DataFrame:
    """Dimensions of a problem that its evidence never names, a few at most."""
    joined = text.groupBy(key).agg(F.lower(F.array_join(F.collect_list(body), " ")).alias("__t"))
    x = dimensions.join(joined, key, "left").where(~F.coalesce(F.col("__t"), F.lit("")).contains(F.lower(dimension)))
    return x.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(dimension))).where(F.col("k") <= most).drop("__t", "k")


def repair_json(text: str) -> str | None:
    """The first balanced JSON value in a model's output, with unclosed brackets closed; lists are wrapped as atoms."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    stack, quoted, escaped, end = [], False, False, len(text)
    for i, c in enumerate(text[start:], start):
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                end = i + 1
                break
    body = text[start:end] + ('"' if quoted else "") + "".join(reversed(stack))
    for candidate in (body, body.replace(",}", "}").replace(",]", "]")):
        try:
            value = json.loads(candidate)
            return json.dumps({"atoms": value} if isinstance(value, list) else value)
        except ValueError:
            continue
    return None


def repair_driver(content: Column, topic: Column) -> Column:
    """Local repairs in turn: fragments, meta statements, vague subjects; null where none applies."""
    tags = T.diagnose(content)
    return F.coalesce(
        F.when(F.array_contains(tags, "meta"), T.repair_meta(content)), F.when(F.array_contains(tags, "vague"), T.repair_vague(content)), F.when(F.array_contains(tags, "fragment"), T.repair_fragment(content))
    )


def repaired_json(outputs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, value``: the JSON that ``repair_json`` finds in each output of a model, null where there is none."""
    from lodeworks.sources.readers import map_texts

    return map_texts(outputs, key, text, "value string", lambda t: [(repair_json(t),)])
