"""Personal data by bootstrapped contextual extraction; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, named, running

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive and anchored forms of the contract's: the same matches without recursion or rescanning.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Shapes of identifiers that the base patterns do not cover, by kind.
SHAPE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,64}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{1,64}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([ ._/-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![0-9])",
}
#: A cheap test that a text can hold the kind at all.
HINT = {"email": r"@|[(\[{]at[)\]}]", "ip": r"[0-9]\.[0-9]|:", "card": r"[0-9][ ._/-]?[0-9]", "phone": r"\+[0-9]|[0-9][ .-][0-9]"}

ROUNDS = 6
LEAST_SEEDS = 3
LEAST_PATTERN_SCORE = 0.6
LEAST_INSTANCE_SCORE = 0.4
#: Of the score of its best pattern, what an instance that is no seed keeps: a pattern cannot vouch for itself in full.
DAMPING = 0.8
CONTEXT = 48
#: Characters of a text's blocks, from which pieces are taken.
BLOCK = 1024


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Digits from the right, every second doubled, less nine if over nine; the sum must divide by ten."""
    digits = F.transform(F.filter(F.split(F.reverse(_digits(text)), ""), lambda d: d != ""), lambda d: d.cast("int"))
    return _sum(F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        return text.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return (n >= 14) & (n <= 19) & F.when((n >= 14) & (n <= 19), _luhn(text)).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _valid_match(kind: str):
    return lambda m: _valid(kind, m["body"])


_FOUND = "array<struct<kind:int,start:int,end:int,body:string,left:string,right:string>>"


def _matches(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """All leftmost non-overlapping matches with their place in code points and the text on both sides.

    The pieces between the matches (a split by the same pattern) and the matches themselves give the places by
    running sums.
    """

    def located(found: Column) -> Column:
        steps = F.zip_with(F.slice(found["gaps"], 1, F.size(found["hits"])), found["hits"], lambda g, h: F.length(g) + F.length(h))
        return let(running(steps, lambda a, x: a + x), lambda ends: F.transform(found["hits"], lambda h, i: item(h, i, F.get(ends, i), found["gaps"])))

    def item(hit: Column, i: Column, end: Column, gaps: Column) -> Column:
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("body"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right"),
        )

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(hint), let(found, located)).otherwise(F.array().cast(_FOUND)).cast(_FOUND)


def replace_spans(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with its spans (sorted by start) replaced by ``by(span, before)``; before is where the spans so far end.

    Pieces of the text are taken from blocks of it, so that each costs its own length and not its distance from the start.
    """

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        within = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(within, a - first * BLOCK + 1, b - a)).otherwise("")

    def one(blocks: Column, s: Column, before: Column) -> Column:
        return F.concat(piece(blocks, before, s["start"]), by(s, before))

    def whole(blocks: Column, tops: Column) -> Column:
        replaced = F.transform(spans, lambda s, i: let(F.coalesce(F.get(tops, i - 1), F.lit(0)), lambda before: one(blocks, s, before)))
        return F.concat(F.array_join(replaced, ""), piece(blocks, F.get(tops, F.size(tops) - 1), F.length(text)))

    tops = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    bound = let(F.struct(blocks.alias("blocks"), tops.alias("tops")), lambda x: whole(x["blocks"], x["tops"]))
    return F.when(F.size(spans) == 0, text).otherwise(bound)


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (valid base matches, by start and kind) and ``shaped`` (identifier-like strings outside them)."""
    found = docs
    for kind in KINDS:
        found = found.withColumn(f"_b_{kind}", _matches(F.col(text), kind, BASE[kind], HINT[kind]))
    for kind in KINDS:
        found = found.withColumn(f"_b_{kind}", F.filter(f"_b_{kind}", _valid_match(kind)))
    order = lambda c: F.array_sort(F.transform(c, lambda m: F.struct(m["start"], m["kind"], m["end"], m["body"], m["left"], m["right"])))
    found = found.withColumn("base", order(F.concat(*[f"_b_{k}" for k in KINDS]))).drop(*[f"_b_{k}" for k in KINDS])
    # Shapes are looked for where base matches have been blanked out, character by character.
    blank = lambda s, before: F.repeat(F.lit("\x01"), F.greatest(s["end"], before) - F.greatest(s["start"], before))
    found = found.withColumn("_blanked", replace_spans(F.col(text), F.col("base"), blank))
    for kind in KINDS:
        found = found.withColumn(f"_s_{kind}", _matches(F.col("_blanked"), kind, SHAPE[kind], HINT[kind]))
    return found.withColumn("shaped", order(F.concat(*[f"_s_{k}" for k in KINDS]))).drop("_blanked", *[f"_s_{k}" for k in KINDS])


def _patterns(m: Column) -> Column:
    """Lexical patterns around an identifier: two words before it; one word before and one after it."""
    words = F.regexp_extract_all(F.lower(m["left"]), F.lit(r"\p{L}+"), F.lit(0))
    after = F.regexp_extract(F.lower(m["right"]), r"^\P{L}*(\p{L}+)", 1)
    two = F.when(F.size(words) >= 2, F.concat(F.lit("before:"), F.array_join(F.slice(words, -2, 2), " ")))
    around = F.when((F.size(words) >= 1) & (after != ""), F.concat(F.lit("around:"), F.element_at(words, -1), F.lit(" _ "), after))
    return F.filter(F.array(two, around), lambda p: p.isNotNull())


def _edges(found: DataFrame, column: str, seed: bool) -> DataFrame:
    """Distinct (kind, pattern, instance); combined within tasks first, so a common line counts once a task."""
    one = found.where(F.size(column) > 0).select(F.explode(column).alias("m"))
    return one.select(F.col("m.kind").alias("kind"), F.explode(_patterns(F.col("m"))).alias("pattern"), F.lower("m.body").alias("instance")).distinct().withColumns({"seed": F.lit(seed), "base": F.lit(seed)})


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Mutual scores on the graph of patterns and instances, and the bootstrapping between rounds.

    A pattern's score is the summed score of its instances over their number plus one. Seeds score 1, other instances
    ``DAMPING`` times the score of their best pattern, starting at 0; with s seeds and m others a pattern alone comes to
    s / (s + m (1 - DAMPING) + 1). After each round the instances that a trusted pattern extracts and whose score
    suffices are seeds of the next, under all their patterns: so a pattern that occurs with discovered identifiers only
    can come to be trusted as well. Returns ``(kind, pattern, score, seeds)`` and ``(kind, instance, score)``.
    """
    state = edges.withColumn("score", F.col("seed").cast("double"))
    patterns = None
    for _ in range(rounds):
        patterns = state.groupBy("kind", "pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("weight"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        trusted = (F.col("weight") >= LEAST_PATTERN_SCORE) & (F.col("seeds") >= LEAST_SEEDS)
        rated = state.where("NOT seed").join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg((F.max("weight") * DAMPING).alias("own"), F.max(trusted).alias("vouched"))
        found = F.coalesce(F.col("vouched") & (F.col("own") >= LEAST_INSTANCE_SCORE), F.lit(False))
        next_ = state.join(rated, ["kind", "instance"], "left").withColumn("seed", F.col("seed") | found)
        state = next_.select("kind", "pattern", "instance", "seed", "base", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("own", F.lit(0.0))).alias("score"))
        state = materialise(state, "pii-round")
    scores = state.where("NOT base").groupBy("kind", "instance").agg(F.max("score").alias("score"))
    return patterns.withColumnRenamed("weight", "score"), scores


def find_identifiers(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    """All spans of every row: the ``keep`` columns, ``base`` and ``spans``.

    Both are arrays of (start, kind, end) in code points, end exclusive, kind an index into ``KINDS``, sorted. Base
    matches are seeds. The contexts of seeds give lexical patterns; a string shaped like an identifier of the same
    kind that no base match touches is added if a pattern of at least ``LEAST_SEEDS`` distinct seeds, those found in
    earlier rounds included, and score ``LEAST_PATTERN_SCORE`` extracts it and its own score reaches
    ``LEAST_INSTANCE_SCORE``.

    A null text counts as empty and has no spans; repeated rows stay repeated; an empty table gives no rows. A kept
    column named like one of the results has ``__`` behind its name.
    """
    source = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    names = [f"{c}__" if c.lower() in ("base", "spans") else c for c in keep]
    found = _find(source, [f"_k{i}" for i in range(len(keep))], rounds)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)], "base", "spans")


def _find(source: DataFrame, keep: list[str], rounds: int) -> DataFrame:
    """``find_identifiers`` of ``__text``, with kept columns under names that clash with none of ours."""
    found = find_base(source, "__text").drop("__text").withColumn("__row", F.monotonically_increasing_id())
    found = materialise(found, "pii-found")
    plain = lambda c: F.transform(c, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    slim = found.select(*keep, "__row", plain(F.col("base")).alias("base"))
    shaped = found.where(F.size("shaped") > 0)
    if shaped.isEmpty():
        return slim.select(*keep, "base", F.col("base").alias("spans"))
    edges = materialise(_edges(found, "base", True).unionByName(_edges(shaped, "shaped", False)), "pii-edges")
    patterns, instances = score_patterns(edges, rounds)
    trusted = patterns.where((F.col("score") >= LEAST_PATTERN_SCORE) & (F.col("seeds") >= LEAST_SEEDS)).select("kind", "pattern")
    likely = instances.where(F.col("score") >= LEAST_INSTANCE_SCORE).select("kind", "instance")
    each = shaped.select("__row", F.explode("shaped").alias("m")).select(
        "__row", F.col("m.kind").alias("kind"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.lower("m.body").alias("instance"), F.explode(_patterns(F.col("m"))).alias("pattern")
    )
    new = each.join(trusted, ["kind", "pattern"]).join(likely, ["kind", "instance"]).groupBy(F.col("__row").alias("__at")).agg(F.collect_set(F.struct("start", "kind", "end")).alias("new"))
    new = materialise(new, "pii-new")
    if new.isEmpty():
        return slim.select(*keep, "base", F.col("base").alias("spans"))
    return slim.join(new, F.col("__row") == F.col("__at"), "left").select(*keep, "base", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(slim.schema["base"].dataType)))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """Replaces spans by ``<KIND>``; spans that overlap become one, of the kind that starts first."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    return replace_spans(text, spans, lambda s, before: F.when(s["start"] >= before, F.get(names, s["kind"])).otherwise(""))


def identifier_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, base counts by kind, the SHA-256 of the base spans and all spans as text, one row per input row."""
    source = named(docs, id=id_col, text=text_col)
    found = find_identifiers(source, "text", ("id",))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("id", *map(count, KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
