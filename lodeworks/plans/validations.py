"""Grounding and validation queries over ``conversations``: a turn is a claim about the turn before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.operators import grounding as V
from lodeworks.operators.derivation import STOPWORDS

from .views import spread, sql_list, table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


_C = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"
_SPLIT = "list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
_WORDS = f"list_distinct(list_filter({_SPLIT.format('lower({})')}, lambda t: NOT list_contains({sql_list(STOPWORDS)}, t)))".replace("lower({})", "lower({0})")
_NUM = "list_transform(regexp_extract_all({}, '[0-9][0-9,]*\\.?[0-9]*'), lambda n: regexp_replace(n, '\\.+$', ''))"
_ENT = f"list_filter({_SPLIT.format('{0}')}[2:], lambda t: length(t) > 1 AND lower(t) <> t)".replace("{{0}}", "{0}")


def _fill(template: str, value: str) -> str:
    return template.replace("{0}", value).replace("{}", value)


@query(
    f"""WITH {_C}, p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS item FROM c), g AS (SELECT conv_id, turn, item IS NOT NULL AS known,
      len(list_intersect({_fill(_WORDS, 'text')}, {_fill(_WORDS, "coalesce(item, '')")})) AS overlap, len(list_filter(list_distinct({_fill(_NUM, 'text')}), lambda x: NOT list_contains({_fill(_NUM, "coalesce(item, '')")}, x))) AS lost_numbers,
      len(list_filter(list_distinct({_fill(_ENT, 'text')}), lambda x: NOT list_contains({_fill(_SPLIT.format('{0}').replace('{{', '{').replace('}}', '}'), "coalesce(item, '')")}, x))) AS lost_entities FROM p)
    SELECT *, known AND overlap >= 2 AND lost_numbers = 0 AND lost_entities = 0 AS valid FROM g"""
)
def val_grounding(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    claims = t.withColumn("cites", F.concat_ws("-", "conv_id", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))))
    items = t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    g = V.grounded(claims, items, "text", "cites", "id", "text")
    return g.select("conv_id", "turn", "known", *[F.col(c).cast("long").alias(c) for c in ("overlap", "lost_numbers", "lost_entities")], "valid")


@query(f"WITH {_C} SELECT conv_id, turn, array_to_string({_fill(_NUM, 'text')}, ' ') AS numbers, len({_fill(_ENT, 'text')}) AS entities FROM c")
def val_numbers_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(V.stated_numbers(F.col("text")), " ").alias("numbers"), F.size(V.entities(F.col("text"))).cast("long").alias("entities"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12))), lambda x: x <> '')"


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), e AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, {_SENT} AS ss FROM d)),
    b AS MATERIALIZED (SELECT doc_id, i, list_distinct({_SPLIT.format('lower(s)')}) AS bag FROM e),
    t(doc_id, i, kept, again) AS (
      SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[][]), 0 FROM d
      UNION ALL
      SELECT doc_id, i, CASE WHEN hit THEN kept ELSE list_append(kept, bag) END, again + CAST(hit AS INTEGER) FROM (
        SELECT b.doc_id, b.i, kept, again, bag, len(list_filter(kept, lambda k: len(k) > 0 AND len(bag) > 0 AND len(list_intersect(k, bag)) > 0.5 * least(len(k), len(bag)))) > 0 AS hit FROM t JOIN b ON b.doc_id = t.doc_id AND b.i = t.i + 1)
    ) SELECT doc_id, max(again) AS repeated FROM t GROUP BY 1"""
)
def val_repetition(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.size(V.repetitions(F.col("text"))).alias("repeated"))




@query(f"WITH {_C}, s AS (SELECT conv_id, unnest({_SENT}) AS s FROM c) SELECT conv_id, count(*) AS sentences, count(*) FILTER (regexp_matches(s, '\\[[A-Za-z]?[0-9]+\\]')) AS cited, CAST(sum(len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words, bool_and(regexp_matches(s, '\\[[A-Za-z]?[0-9]+\\]')) AS all_cited FROM s GROUP BY 1")
def val_longform(spark: SparkSession, sf: str) -> DataFrame:
    return V.section_report(_turns(spark, sf), "conv_id", "text")


@query(f"WITH {_C} SELECT conv_id, turn, array_to_string({_SENT}[1:2], ' ') AS cut FROM c")
def val_hard_stop(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", V.hard_stop(F.col("text"), 2).alias("cut"))


_POLAR = " OR ".join(f"(contains(x, '{p}') AND contains(y, '{n}')) OR (contains(x, '{n}') AND contains(y, '{p}'))" for p, n in V.ANTONYMS)


@query(f"WITH {_C}, p AS (SELECT conv_id, turn, lower(text) AS x, lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS y FROM c) SELECT conv_id, turn, {_POLAR} AS conflict FROM p WHERE y IS NOT NULL")
def val_polarity(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf).withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return t.select("conv_id", "turn", V.polarity_conflict(F.col("text"), F.col("before")).alias("conflict"))


_BAG = f"list_distinct({_SPLIT.format('lower({0})')})".replace("{{", "{").replace("}}", "}")


@query(
    f"""WITH {_C}, p AS (SELECT conv_id, turn, {_fill(_BAG, 'text')} AS a, {_fill(_BAG, "coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS b FROM c),
    j AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS i, len(a) + len(b) - len(list_intersect(a, b)) AS u FROM p) SELECT conv_id, turn, round(CASE WHEN u = 0 THEN 0.0 ELSE i / u END, 6) AS similarity, CASE WHEN u = 0 THEN false ELSE i / u > 0.85 END AS loop FROM j"""
)
def val_loops(spark: SparkSession, sf: str) -> DataFrame:
    return V.loops(_turns(spark, sf), "conv_id", "turn", "text").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"), "loop")


@query(
    f"""WITH {_C}, m AS (SELECT conv_id, turn, regexp_replace(text, '([.!?]) ', '\\1 [A1] ', 'g') AS t FROM c),
    p AS (SELECT conv_id, turn, regexp_split_to_array(t, '\\[[A-Za-z0-9]+\\]') AS parts, regexp_extract_all(t, '\\[([A-Za-z0-9]+)\\]', 1) AS marks FROM m),
    i AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)
    SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, trim(parts[i]) AS text, marks[i] AS citation FROM i WHERE trim(parts[i]) <> '' OR marks[i] IS NOT NULL"""
)
def val_citation_segments(spark: SparkSession, sf: str) -> DataFrame:
    marked = _turns(spark, sf).select("conv_id", "turn", F.regexp_replace("text", r"([.!?]) ", "$1 [A1] ").alias("text"))
    return marked.select("conv_id", "turn", F.posexplode(V.citation_segments(F.col("text"))).alias("pos", "s")).select("conv_id", "turn", "pos", "s.text", "s.citation")
