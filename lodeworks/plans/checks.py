"""Validators over the driver tables: ``pages`` are sources, ``documents`` contents, ``events`` preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import validators as C

from .views import WS, spread, sql_list, sql_words, table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(body, '{pattern}'))"


def _found(pattern: str) -> str:
    return f"regexp_matches(body, '(?m){pattern}')"


_HOST = " ".join(f"WHEN regexp_matches(host, '{p}') THEN {v}" for p, v in C.HOSTS)
_H, _C, _M, _I, _LEAST = C.LEVELS["normal"]


@query(
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host FROM pages),
    q AS (SELECT page_id, body, CASE {_HOST} ELSE 0.5 END AS reliability, len({sql_words('body')}) AS n, length(regexp_replace(body, '\\s+', '', 'g')) AS letters,
      {' + '.join(map(_count, C.FACTS))} AS facts, ({' + '.join(f'CAST({_found(p)} AS INTEGER)' for p in C.SOURCE_MARKDOWN)}) / {C.MARKDOWN_FIELDS} AS marked,
      CAST(regexp_matches(body, '(?i){'|'.join(C.INDICATORS)}') AS INTEGER) AS shown, list_transform(regexp_extract_all(body, '(?m){C.HEADER}', 1), lambda m: length(m)) AS levels FROM p),
    r AS (SELECT *, least(length(body) / 1000, 1.0) + least(len(string_split(body, chr(10) || chr(10))) / 10, 1.0) + CASE WHEN n > 0 THEN 1 - least(greatest(letters / n - 4, 0) / 8, 1.0) + least(facts / (n / 100), 1.0) ELSE 0 END AS parts FROM q),
    s AS (SELECT *, round(CAST(reliability * {_H} + parts / 4 * {_C} + marked * {_M} + shown * {_I} AS DOUBLE) + {C.NUDGE}, 2) AS score FROM r)
    SELECT page_id, score >= {_LEAST} AS valid, score, CASE WHEN len(levels) = 0 THEN 0.0 ELSE round(len(list_filter(range(1, len(levels) + 1), lambda i: i = 1 OR levels[i] <= levels[i - 1] + 1)) / len(levels), 6) END AS hierarchy FROM s"""
)
def val_source(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", C.validate_source(F.col("html"), F.col("url")).alias("v")).select("page_id", "v.valid", "v.score", F.round("v.hierarchy", 6).alias("hierarchy"))


_MARKED = " + ".join(f"CASE WHEN {_found('|'.join(ps))} THEN 0.1 ELSE 0 END" for ps in C.CONTENT_MARKDOWN)
_COUNTED = " + ".join(f"least({_count(p)} / {n}, 1.0) * {w}" for p, n, w in C.CONTENT_COUNTS)


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), s AS (SELECT doc_id, round(CAST(least(least(length(body) / 1000, 1.0) * 0.2 + {_MARKED} + {_COUNTED}, 1.0) AS DOUBLE) + {C.NUDGE}, 2) AS score,
      CASE WHEN length(body) < {C.SHORTEST} THEN 'Content too short' WHEN length(body) > {C.LONGEST} THEN 'Content too long' WHEN trim(body, {WS}) = '' THEN 'Empty content' END AS early FROM d),
    e AS (SELECT doc_id, CASE WHEN early IS NULL THEN score ELSE 0.0 END AS score, coalesce(early, CASE WHEN score < {C.LEVELS['lenient'][-1]} THEN 'Content quality below threshold' END) AS error FROM s)
    SELECT doc_id, error IS NULL AS valid, error, score FROM e"""
)
def val_content(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", C.validate_content(F.col("text"), "lenient").alias("v")).select("doc_id", "v.valid", "v.error", "v.score")


#: Preferences made of events: a kind by the id, values of which some are of another type or beyond their limits.
_KINDS = ["string", "boolean", "integer", "float", "enum", "list", "dict", "other"]


@query(
    f"""WITH e AS (SELECT event_id, event_type, value, ({sql_list(_KINDS)})[event_id % 8 + 1] AS kind FROM events),
    v AS (SELECT *, CASE kind WHEN 'string' THEN CASE WHEN event_id % 3 = 0 THEN 'a string beyond its length' WHEN event_id % 3 = 1 THEN '' ELSE 'short' END
        WHEN 'boolean' THEN CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'TRUE' END WHEN 'integer' THEN CASE WHEN event_id % 3 = 0 THEN '1.5' ELSE CAST(event_id AS VARCHAR) END
        WHEN 'float' THEN CASE WHEN event_id % 3 = 0 THEN 'one' ELSE CAST(event_id AS VARCHAR) || '.5' END WHEN 'enum' THEN event_type END AS text FROM e),
    x AS (SELECT event_id, event_type, value, CASE kind
        WHEN 'string' THEN CASE WHEN length(text) > 10 THEN 'String too long' WHEN length(text) < 1 THEN 'String too short' END
        WHEN 'boolean' THEN CASE WHEN lower(text) NOT IN ('true', 'false') THEN 'Value must be a boolean' END
        WHEN 'integer' THEN CASE WHEN event_id % 3 = 0 THEN 'Value must be an integer' WHEN event_id < 20 THEN 'Value below the minimum' WHEN event_id > 500 THEN 'Value above the maximum' END
        WHEN 'float' THEN CASE WHEN event_id % 3 = 0 THEN 'Value must be a number' WHEN event_id + 0.5 < 20 THEN 'Value below the minimum' WHEN event_id + 0.5 > 500 THEN 'Value above the maximum' END
        WHEN 'enum' THEN CASE WHEN event_type NOT IN ('view', 'click') THEN 'Value must be one of the options' END
        WHEN 'list' THEN CASE WHEN event_id % 3 = 0 THEN 'Value must be a list' WHEN event_id % 3 = 1 THEN 'List too long' END
        WHEN 'dict' THEN CASE WHEN event_id % 3 = 0 THEN 'Value must be a dictionary' WHEN event_id % 3 = 1 THEN 'Missing required key' END ELSE 'Invalid value type' END AS failed FROM v)
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Invalid category' WHEN failed IS NOT NULL THEN failed WHEN value IS NULL OR value / 100 NOT BETWEEN 0 AND 1 THEN 'Confidence score must be between 0 and 1' END AS error FROM x"""
)
def val_preferences(spark: SparkSession, sf: str) -> DataFrame:
    n, text = F.col("event_id") % 3, F.col("event_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 8 + 1).cast("int"))
    value = (
        F.when(F.col("kind") == "string", F.when(n == 0, "a string beyond its length").when(n == 1, "").otherwise("short"))
        .when(F.col("kind") == "boolean", F.when(n == 0, "yes").otherwise("TRUE")).when(F.col("kind") == "integer", F.when(n == 0, "1.5").otherwise(text))
        .when(F.col("kind") == "float", F.when(n == 0, "one").otherwise(F.concat(text, F.lit(".5")))).when(F.col("kind") == "enum", F.col("event_type"))
        .when(F.col("kind") == "list", F.when(n == 0, "none").when(n == 1, '["a", "b", 3]').otherwise('["a"]'))
        .when(F.col("kind") == "dict", F.when(n == 0, "none").when(n == 1, '{"b": 1}').otherwise('{"a": 1}'))
    )
    limits = {
        "min": F.lit(20.0), "max": F.lit(500.0), "max_length": F.lit(10), "max_items": F.lit(2),
        "options": F.array(F.lit("view"), F.lit("click")), "required_keys": F.array(F.lit("a")),
    }
    e = table(spark, sf, "events").withColumn("kind", kind).withColumn("text", value)
    category = F.when(F.col("event_id") % 11 == 0, "unknown").otherwise("content")
    return e.select("event_id", C.validate_preference(F.col("event_type"), category, F.col("kind"), F.col("text"), F.lit("events"), F.col("value") / 100, F.col("ts").cast("string"), limits).alias("error"))


#: Pieces of markdown that a turn's key puts together around its text.
_PIECES = ["# One\n", "### Three\n", "- item\n* item\n", "|a|b|\n|-|-|\n|1|2|\n\n", "```py\nx\n```\n", "Set\n===\n", "> said *so*\n", "[in](http://x) [to][ref] \n", "[ref]: http://y\n", "---\n", "**strong** `code`\n", "## Two\n"]


def _sql_text(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


_MD = " || ".join(f"CASE WHEN (key // {2**i if i < 6 else 3 * 2 ** (i - 6) + 1}) % {2 + i % 2} = 0 THEN {_sql_text(x)} ELSE '' END" for i, x in enumerate(_PIECES))
_LINE = lambda p: f"CAST(regexp_matches(body, '(?m){p}') AS INTEGER)"


@query(
    f"""WITH k AS (SELECT conv_id, turn, conv_id * 7 + turn AS key, coalesce(text, '') AS text FROM conversations), b AS (SELECT conv_id, turn, {_MD} || replace(text, chr(10), ' ') AS body FROM k),
    m AS (SELECT *, regexp_extract_all(body, '(?m)^(#+)', 1) AS marks, regexp_extract_all(body, '(?m){C.MARKDOWN_LINKS["reference"]}', 1) AS refs, regexp_extract_all(body, '(?m){C.MARKDOWN_LINKS["definition"]}', 1) AS names FROM b),
    f AS (SELECT conv_id, turn, {_LINE(C.MARKDOWN_STRUCTURE["headers"])} AS h, {_LINE(C.MARKDOWN_STRUCTURE["lists"])} AS l, CAST(contains(body, '|1|2|' || chr(10)) AS INTEGER) AS t, CAST(regexp_matches(body, '{C.MARKDOWN_CODE}') AS INTEGER) AS c,
      {" + ".join(map(_LINE, C.MARKDOWN_FORMATTING))} AS formats, len(list_filter(refs, lambda r: NOT list_contains(names, r))) = 0 AS linked, least(len(regexp_extract_all(body, '{C.MARKDOWN_LINKS["inline"]}')) + len(refs), 5) AS links,
      len(list_filter(range(1, len(marks) + 1), lambda i: CASE WHEN i = 1 THEN length(marks[1]) <> 1 ELSE length(marks[i]) > length(marks[i - 1]) + 1 END)) = 0 AS hierarchy FROM m),
    s AS (SELECT *, ((h + l + t + c) * 10 + formats * 4 + CASE WHEN linked THEN links * 4 ELSE 0 END + CASE WHEN hierarchy THEN 20 ELSE 0 END) / 100 AS score FROM f)
    SELECT conv_id, turn, score >= 0.6 AND h = 1 AS valid, score, h = 1 AS has_headers, hierarchy, linked AS links_valid FROM s"""
)
def val_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Turns set as markdown; which pieces come before the text depends on the key."""
    key = F.col("conv_id") * 7 + F.col("turn")
    pieces = [F.when(F.floor(key / (2**i if i < 6 else 3 * 2 ** (i - 6) + 1)) % (2 + i % 2) == 0, x).otherwise("") for i, x in enumerate(_PIECES)]
    turns = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    body = F.concat(*pieces, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    return turns.select("conv_id", "turn", C.validate_markdown(body).alias("v")).select("conv_id", "turn", "v.*")


_REFERENCES = ["(Smith et al., 2020, pp. 3-4)", "[12]", "see [3] and vol. 4", "3. Author of a book; another", "(Lee, 1999)", "(Knuth 84-90)", "no citation 1234", "doi 10.1234/abc.d (Ng, 2001) volume 2", " "]


@query(
    f"""WITH r AS (SELECT item_id, ({sql_list(_REFERENCES)})[item_id % 9 + 1] || CASE WHEN item_id % 2 = 0 THEN '' ELSE ' ' || split_part(text, ' ', 1) END AS body, CASE item_id % 5 WHEN 0 THEN 'apa' WHEN 1 THEN 'ieee' END AS expected FROM benchmark),
    e AS (SELECT *, 6 + {' + '.join(f"CAST(regexp_matches(body, '{p}') AS INTEGER)" for p in C.CITATION_EXTRAS)} AS extra FROM r),
    t AS (SELECT *, [{', '.join("CASE WHEN regexp_matches(body, '" + p + "') THEN least(10, extra + " + ' + '.join(f"CASE WHEN regexp_matches(body, '{q}') THEN {n} ELSE 0 END" for q, n in more) + ") ELSE 0 END" for p, more in C.CITATIONS.values())}] AS tenths FROM e),
    b AS (SELECT *, list_max(tenths) AS best, CASE WHEN list_max(tenths) > 0 THEN ({sql_list(list(C.CITATIONS))})[list_position(tenths, list_max(tenths))] END AS format FROM t),
    x AS (SELECT *, CASE WHEN trim(body) = '' THEN 'Empty reference' WHEN expected IS NOT NULL AND format IS DISTINCT FROM expected THEN 'Reference format mismatch' WHEN best < 7 THEN 'Invalid reference format' END AS error FROM b)
    SELECT item_id, error IS NULL AS valid, error, format, best / 10 AS confidence, regexp_matches(body, '{C.DOI}') AS has_doi, regexp_matches(body, '\\d{{4}}') AS has_year, regexp_matches(body, '[A-Za-z]') AS has_authors FROM x"""
)
def val_references(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of all formats, by the item's id, every second one with a word of the item behind it."""
    b = table(spark, sf, "benchmark")
    body = F.concat(F.element_at(F.array(*map(F.lit, _REFERENCES)), (F.col("item_id") % 9 + 1).cast("int")), F.when(F.col("item_id") % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.split_part("text", F.lit(" "), F.lit(1)))))
    expected = F.when(F.col("item_id") % 5 == 0, "apa").when(F.col("item_id") % 5 == 1, "ieee")
    return b.select("item_id", C.validate_reference(body, expected).alias("v")).select("item_id", "v.*")


@query(
    """WITH d AS (SELECT event_id, event_id % 6 AS n, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events),
    f AS (SELECT event_id, CASE WHEN n = 0 THEN 'name' WHEN n = 1 THEN 'k' END AS missing, n <> 1 AND (n = 2 OR k < 10 OR k > 80) AS bad_k, n <> 0 AND (event_type NOT IN ('view', 'click') OR length(event_type) <> 4) AS bad_name, n = 3 AS bad_tags FROM d)
    SELECT event_id, missing IS NULL AND NOT bad_k AND NOT bad_tags AS valid, coalesce(missing, '') AS missing, array_to_string(list_filter([CASE WHEN bad_k THEN 'k' END, CASE WHEN bad_name THEN 'name' END, CASE WHEN bad_tags THEN 'tags' END], lambda x: x IS NOT NULL), ',') AS invalid FROM f"""
)
def val_data(spark: SparkSession, sf: str) -> DataFrame:
    """Objects made of events, some without a field or of another type, against a schema."""
    n = F.col("event_id") % 6
    k = F.get_json_object("props", "$.k")
    parts = [F.when(n != 1, F.concat(F.lit('"k": '), F.when(n == 2, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k))), F.when(n != 0, F.concat(F.lit('"name": "'), "event_type", F.lit('"'))), F.when(n == 3, '"tags": "none"').otherwise('"tags": ["a", 1]')]
    schema = {"k": {"type": "numeric", "minimum": 10, "maximum": 80}, "name": {"type": "string", "constraints": {"enum": ["view", "click"], "regex": "[a-z]", "length": 4}}, "tags": {"type": "list", "constraints": {"min_length": 1, "max_length": 2}}}
    v = C.validate_data(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), ["k", "name"], schema)
    found = spread(table(spark, sf, "events")).select("event_id", v.alias("v"))
    return found.select("event_id", "v.valid", F.array_join("v.missing", ",").alias("missing"), F.array_join("v.invalid", ",").alias("invalid"))
