"""Text gates, cleaning, chunking and scores over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import scores as S
from lodeworks.functions import text as T

from .views import ATOMS_SQL, WS, atoms, spread, sql_any, sql_count, sql_list, sql_words, table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")))


DOCS = "docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents)"


def sql_word(text: str, alternatives: str) -> str:
    """A whole word among alternatives, letters of any script counting as word characters."""
    return f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({alternatives})([^\\p{{L}}\\p{{N}}_]|$)')"


def bare(pattern: str) -> str:
    """The alternatives inside a word pattern."""
    return pattern.removeprefix("(?i)").removeprefix(r"\b(").removesuffix(r")\b")


_GATE = f"""
w AS (SELECT doc_id, text, {sql_words('text')} AS ws, {sql_count('lower(text)', T.JUNK)} AS junk FROM docs),
g AS (SELECT doc_id, CASE WHEN trim(text, {WS}) = '' THEN 'empty' WHEN len(ws) < 50 THEN 'too_short' WHEN junk >= 3 THEN 'junk_patterns'
  WHEN len(ws) > 200 AND contains(lower(array_to_string(ws[101:], ' ')), lower(array_to_string(ws[1:100], ' '))) THEN 'repetition' ELSE '' END AS reason FROM w)"""


@query(f"WITH {DOCS}, {_GATE} SELECT doc_id, CASE WHEN reason = '' THEN 'PASS' ELSE 'SKIP' END AS verdict, reason FROM g")
def txt_gate0a(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.gate_0a(F.col("text")).alias("g")).select("doc_id", "g.verdict", "g.reason")


@query(
    f"""WITH {DOCS}, {_GATE} SELECT doc_id, CASE WHEN reason IN ('empty', 'too_short') THEN 'too_short' WHEN reason = 'repetition' THEN 'duplicate' WHEN reason = '' THEN NULL ELSE 'low_quality' END AS canonical FROM g"""
)
def txt_gate_reason(spark: SparkSession, sf: str) -> DataFrame:
    g = _docs(spark, sf).select("doc_id", T.gate_0a(F.col("text"))["reason"].alias("r"))
    return g.select("doc_id", F.when(F.col("r") != "", T.normalise_reason(F.col("r"))).alias("canonical"))


_CLEAN = "text"
for _p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>", r"\n{3,}"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', ' ', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?im)^({'|'.join(T.LINE_BOILERPLATE)}).*$', ' ', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?im)^({'|'.join(T.LINE_HEADINGS)})\\s*$', ' ', 'g')"
_CLEAN = f"trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g'), {WS})"


@query(f"WITH docs AS (SELECT page_id, coalesce(html, '') AS text FROM pages) SELECT page_id, {_CLEAN} AS cleaned FROM docs")
def txt_clean_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.clean_boilerplate(F.coalesce("html", F.lit(""))).alias("cleaned"))


@query(
    f"""WITH {DOCS}, t AS (SELECT doc_id, CAST(floor(len({sql_words(_CLEAN)}) * 1.3) AS INTEGER) AS tokens FROM docs)
    SELECT doc_id, tokens, CASE WHEN tokens > 8000 THEN 'DROP' WHEN tokens > 2400 THEN 'DISTILL' ELSE 'OK' END AS gate FROM t"""
)
def txt_gate_size(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.rough_token_count(T.clean_boilerplate(F.col("text"))).alias("tokens")).withColumn("gate", T.gate_by_size(F.col("tokens")))


@query(f"WITH {ATOMS_SQL} SELECT atom_id, statement FROM atoms")
def txt_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("atom_id", "statement")


_INFO = f"""length(statement) >= 20 AND NOT {sql_any('lower(statement)', T.NOISE_MARKERS)}
  AND (length(lower(statement)) - length(replace(lower(statement), 'http', ''))) / 4 + (length(lower(statement)) - length(replace(lower(statement), 'www', ''))) / 3 <= 2
  AND NOT (upper(statement) = statement AND lower(statement) <> statement AND length(statement) > 30)
  AND NOT (ends_with(statement, '?') AND length(statement) - length(replace(statement, '?', '')) = 1)"""


@query(f"WITH {ATOMS_SQL} SELECT atom_id, {_INFO} AS informational FROM atoms")
def txt_informational(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("atom_id", T.is_informational(F.col("statement")).alias("informational"))


_ACADEMIC = sql_any("lower(url)", T.ACADEMIC_URLS)


@query(
    f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, lower(coalesce(html, '')) AS c FROM pages)
    SELECT page_id, CASE WHEN {sql_any('lower(url)', [*T.HARD_SKIP_DOMAINS, *T.LOW_VALUE_URLS])} THEN 'skip' WHEN {sql_any('substr(c, 1, 1000)', T.HTTP_ERRORS)} THEN 'skip'
      WHEN url <> '' AND NOT {_ACADEMIC} AND {sql_count('substr(c, 1, 500)', T.DICTIONARY_PHRASES)} >= 2 THEN 'skip' WHEN {_ACADEMIC} THEN 'academic' ELSE 'standard' END AS quality FROM p"""
)
def txt_source_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.classify_source(F.col("url"), F.col("html")).alias("quality"))


@query("SELECT page_id, CASE WHEN ends_with(split_part(split_part(lower(url), '?', 1), '#', 1), '.pdf') OR contains(lower(url), 'example.org') THEN 'slow' ELSE 'fast' END AS lane FROM pages")
def txt_lane_route(spark: SparkSession, sf: str) -> DataFrame:
    u = F.lower("url")
    return table(spark, sf, "pages").select("page_id", F.when(F.regexp_replace(u, "[?#].*$", "").endswith(".pdf") | u.contains("example.org"), "slow").otherwise("fast").alias("lane"))


@query("SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) = '' THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE regexp_extract(url, '://([^/?#]*)', 1) || '/' || regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) END AS citation_key FROM pages")
def txt_citation_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), T.citation_key(F.col("url")).alias("citation_key"))


@query(f"WITH {ATOMS_SQL}, s AS (SELECT source_id, list(statement ORDER BY pos) AS ss FROM atoms GROUP BY 1), i AS (SELECT source_id, ss, unnest(range(0, greatest(len(ss) - 10, 0) + 1, 7)) AS k FROM s) SELECT source_id, CAST(k AS INTEGER) AS start, array_to_string(ss[k + 1:k + 10], ' ') AS window_text FROM i")
def txt_windows(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select(F.col("doc_id").alias("source_id"), T.split_sentences(F.col("text")).alias("ss")).where(F.size("ss") > 0)
    w = docs.select("source_id", F.posexplode(T.sliding_windows(F.col("ss"), 10, 7)).alias("k", "w"))
    return w.select("source_id", (F.col("k") * 7).alias("start"), F.array_join("w", " ").alias("window_text"))


_SIG = "regexp_replace(lower(statement), '[^a-z0-9_\\s]', '', 'g')"


@query(
    f"""WITH {ATOMS_SQL}, w AS (SELECT atom_id, {sql_words(_SIG)} AS ws FROM atoms), g AS (SELECT atom_id, ws, unnest(range(0, greatest(len(ws) - 4, 0) + 1)) AS i FROM w)
    SELECT atom_id, count(DISTINCT array_to_string(ws[i + 1:i + 4], ' ')) AS grams, min(array_to_string(ws[i + 1:i + 4], ' ')) AS first_gram FROM g GROUP BY 1"""
)
def txt_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("atom_id", T.signature(F.col("statement")).alias("g")).select("atom_id", F.size("g").cast("long").alias("grams"), F.array_min("g").alias("first_gram"))


def _verb(verbs: list[str]) -> str:
    return f"regexp_matches(lower(statement), ' ({'|'.join(verbs)}) ')"


@query(
    f"""WITH {ATOMS_SQL} SELECT atom_id, CASE WHEN length(statement) < 20 OR NOT regexp_matches(statement, '[.!?)\\]]$') OR NOT {_verb(T.VERBS)} THEN 'FRAGMENT'
      WHEN len({sql_words('statement')}) >= 8 THEN 'VALID' ELSE 'WEAK' END AS quality FROM atoms"""
)
def txt_quality(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("atom_id", T.atom_quality(F.col("statement")).alias("quality"))


@query(SQL["txt_quality"].replace("SELECT atom_id, CASE", "SELECT quality, count(*) AS n FROM (SELECT CASE", 1) + ") GROUP BY 1")
def txt_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return txt_quality(spark, sf).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


_META = T.META_PATTERN.removeprefix(r"\b(").removesuffix(r")\b")


@query(
    f"""WITH {ATOMS_SQL} SELECT atom_id, CASE WHEN length(statement) < 10 THEN 'fragment' ELSE concat_ws(',', CASE WHEN NOT {_verb(T.SCORING_VERBS)} THEN 'fragment' END,
      CASE WHEN length(statement) > 200 THEN 'overlong' END, CASE WHEN regexp_matches(lower(statement), '^({'|'.join(T.VAGUE_STARTS)}) ') THEN 'vague' END,
      CASE WHEN {sql_word('statement', _META)} THEN 'meta' END,
      CASE WHEN len(regexp_extract_all(statement, 'https?://')) > 0 AND len(regexp_extract_all(statement, 'https?://')) * 3 > len({sql_words('statement')}) THEN 'url_heavy' END,
      CASE WHEN regexp_matches(statement, '^([*•-]|[a-z]\\))\\s+') THEN 'list_item' END) END AS tags FROM atoms"""
)
def txt_diagnose(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("atom_id", F.array_join(T.diagnose(F.col("statement")), ",").alias("tags"))


_REPAIR = "CASE " + " ".join(f"WHEN starts_with(lower(statement), '{k}') THEN '{v}' || substr(statement, {len(k) + 1})" for k, v in T.VAGUE_REPAIRS.items()) + " END"


@query(f"WITH {ATOMS_SQL} SELECT atom_id, {_REPAIR} AS repaired FROM atoms WHERE {_REPAIR} IS NOT NULL")
def txt_repair_vague(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("atom_id", T.repair_vague(F.col("statement")).alias("repaired")).where("repaired IS NOT NULL")


@query()
def txt_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Local repairs of every atom: fragment and meta, null where none applies."""
    s = F.col("statement")
    return atoms(spark, sf).select("atom_id", T.repair_fragment(s).alias("fragment"), T.repair_meta(s).alias("meta")).where("fragment IS NOT NULL OR meta IS NOT NULL")


_SENTS_OF = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {WS})), lambda x: x <> '')"


@query(
    f"""WITH {DOCS}, p AS (SELECT doc_id, text, {_SENTS_OF} AS ss FROM docs WHERE length(text) > 0), e AS (SELECT doc_id, unnest(ss) AS statement, generate_subscripts(ss, 1) AS i FROM p),
    g AS (SELECT doc_id, list(CASE WHEN regexp_matches(statement, '[.!?]$') THEN statement ELSE statement || '.' END ORDER BY i) AS good FROM e WHERE length(statement) >= 15 AND {_verb(T.SCORING_VERBS)} AND len({sql_words('statement')}) >= 5 GROUP BY 1),
    c AS (SELECT p.doc_id, CASE WHEN length(text) <= 200 THEN [text] WHEN good IS NOT NULL THEN good ELSE [substr(text, 1, 200)] END AS claims FROM p LEFT JOIN g ON g.doc_id = p.doc_id)
    SELECT doc_id, CAST(generate_subscripts(claims, 1) - 1 AS INTEGER) AS pos, unnest(claims) AS claim FROM c"""
)
def txt_split_overlong(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(F.length("text") > 0).select("doc_id", F.posexplode(T.split_overlong(F.col("text"))).alias("pos", "claim"))


@query(
    f"""WITH RECURSIVE {DOCS}, p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM docs WHERE length(text) > 3000),
    s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM p),
    r AS (SELECT doc_id, 0::BIGINT AS i, NULL::VARCHAR AS chunk, '' AS cur FROM p
      UNION ALL SELECT s.doc_id, s.i, CASE WHEN length(cur) + length(s) > 3000 AND cur <> '' THEN trim(cur, {WS}) END,
        CASE WHEN length(cur) + length(s) > 3000 AND cur <> '' THEN s ELSE trim(cur || ' ' || s, {WS}) END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
    e AS (SELECT doc_id, i, chunk FROM r WHERE chunk IS NOT NULL UNION ALL SELECT r.doc_id, r.i + 1, trim(cur, {WS}) FROM r JOIN p ON p.doc_id = r.doc_id AND r.i = len(ss) WHERE trim(cur, {WS}) <> ''),
    l AS (SELECT doc_id, list(chunk ORDER BY i) AS packed FROM e GROUP BY 1),
    c AS (SELECT d.doc_id, CASE WHEN length(text) <= 3000 THEN [text] WHEN packed IS NULL OR len(list_filter(packed, lambda x: length(x) > 6000)) > 0
      THEN list_transform(range((length(text) - 1) // 3000 + 1), lambda j: substr(text, j * 3000 + 1, 3000)) ELSE packed END AS chunks FROM docs d LEFT JOIN l ON l.doc_id = d.doc_id)
    SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS pos, unnest(chunks) AS chunk FROM c"""
)
def txt_safe_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(T.safe_chunks(F.col("text"))).alias("pos", "chunk"))


_WORDS = "list_filter(regexp_split_to_array(statement, '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')"
_CAPS = f"len(list_filter({_WORDS}, lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}')))"
_FACT = f"""CASE WHEN regexp_matches(statement, '[0-9]') THEN 2 ELSE 0 END + {_CAPS} + CASE WHEN regexp_matches(statement, '(?i)(use|provid|achiev|implement|requir|support|enabl)') THEN 1 ELSE 0 END
  + CASE WHEN {sql_word('statement', 'is|are|was|were|has|have|can|will|use|provide|achieve')} THEN 1 ELSE 0 END"""


@query(
    f"""WITH {ATOMS_SQL}, f AS (SELECT atom_id, source_id, {_FACT} AS score FROM atoms WHERE length(statement) >= 20),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, atom_id) AS rank FROM f WHERE score >= 2)
    SELECT atom_id, source_id, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def txt_fact_summary(spark: SparkSession, sf: str) -> DataFrame:
    from lodeworks.operators.relational import top_per_group

    f = atoms(spark, sf).where(F.length("statement") >= 20).select("atom_id", "source_id", T.fact_score(F.col("statement")).alias("score")).where("score >= 2")
    return top_per_group(f, "source_id", [F.desc("score"), F.asc("atom_id")], 10)


@query(
    f"""WITH {DOCS}, w AS (SELECT doc_id, {sql_words('text')} AS ws, len(regexp_split_to_array(text, '[.!?]+')) AS n FROM docs)
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(1 - (least(greatest((len(ws) / n - 10) / 20, 0), 1) * 0.5
      + least(greatest((list_sum(list_transform(ws, lambda x: length(x))) / len(ws) - 4) / 4, 0), 1) * 0.5), 2) END AS readability FROM w"""
)
def txt_readability(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.readability(F.col("text")).alias("readability"))


@query("SELECT page_id, len(regexp_extract_all(coalesce(html, ''), 'https?://[^\\s<>\"'']*[^\\s<>\"''.,;:!?)]')) AS urls FROM pages")
def txt_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.size(T.extract_urls(F.coalesce("html", F.lit("")))).cast("long").alias("urls"))


@query(
    f"""WITH {DOCS} SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\\s<>"'']+')) AS url, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS email,
      len(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}')) AS date, len(regexp_extract_all(text, '\\+?[0-9][0-9 ().-]{{7,}}[0-9]')) AS phone FROM docs"""
)
def txt_patterns(spark: SparkSession, sf: str) -> DataFrame:
    found = _docs(spark, sf).select("doc_id", T.pattern_matches(F.col("text")).alias("m"))
    return found.select("doc_id", *[F.coalesce(F.size(F.col("m").getItem(k)), F.lit(0)).cast("long").alias(k) for k in ("url", "email", "date", "phone")])


_MEM = "CASE WHEN regexp_matches(lower(text), 'favorite|prefer|like|love|hate') THEN 'preference' WHEN regexp_matches(lower(text), 'always|never|must|should|rule') THEN 'rule' WHEN regexp_matches(lower(text), 'remember|recall|note|important') THEN 'important' ELSE 'general' END"


@query(f"SELECT conv_id, turn, {_MEM} AS kind FROM conversations")
def txt_memory_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.memory_type(F.col("text")).alias("kind"))


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{k}'" for k, p in T.INTENTS.items()) + " ELSE 'exploratory' END"


@query(f"SELECT conv_id, turn, {_INTENT} AS intent FROM (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS low FROM conversations WHERE role = 'user')")
def txt_intent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.query_intent(F.coalesce("text", F.lit(""))).alias("intent"))


@query(
    """SELECT page_id, CASE WHEN starts_with(t, '<!DOCTYPE html>') OR regexp_matches(t, '<html\\b') THEN 'text/html' WHEN regexp_matches(t, '^[{\\[]') AND json_valid(t) THEN 'application/json'
    WHEN contains(t, ',') AND contains(t, chr(10)) THEN 'text/csv' WHEN starts_with(t, '<?xml') OR regexp_matches(t, '^<\\w+[^>]*>') THEN 'application/xml'
    WHEN regexp_matches(t, '(?m)^#{1,6}\\s') OR contains(t, '```') THEN 'text/markdown' ELSE 'text/plain' END AS kind FROM (SELECT page_id, trim(coalesce(html, ''), """
    + WS
    + ") AS t FROM pages)"
)
def txt_content_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.content_type(F.coalesce("html", F.lit(""))).alias("kind"))


_ENTITY = "list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))"


@query(f"WITH {DOCS}, e AS (SELECT DISTINCT unnest({_ENTITY}) AS concept FROM docs) SELECT concept, list_contains({sql_list(T.NOISE_CONCEPTS)}, lower(concept)) OR length(concept) <= 2 AS noise FROM e")
def txt_noise_concepts(spark: SparkSession, sf: str) -> DataFrame:
    found = _docs(spark, sf).select(F.explode(T.capitalised(F.col("text"))).alias("concept")).distinct()
    return found.select("concept", T.is_noise_concept(F.col("concept")).alias("noise"))


@query(
    f"""WITH {ATOMS_SQL}, p AS (SELECT a.atom_id AS a, b.atom_id AS b, lower(a.statement) || ' ' || lower(b.statement) AS t FROM atoms a JOIN atoms b ON a.source_id = b.source_id AND b.pos = a.pos + 1)
    SELECT a, b, CASE WHEN regexp_matches(t, 'version|release|before|after|current|previous') THEN 'temporal_mismatch' WHEN regexp_matches(t, 'environment|linux|windows|staging|production') THEN 'scope_mismatch'
      WHEN regexp_matches(t, 'usually|sometimes|often|rarely|always|never') THEN 'qualified' WHEN regexp_matches(t, 'more|less|higher|lower|faster|slower') THEN 'degree_mismatch'
      WHEN regexp_matches(t, 'called|term|definition|means') THEN 'terminology_mismatch' ELSE 'direct' END AS kind FROM p"""
)
def txt_contradiction_type(spark: SparkSession, sf: str) -> DataFrame:
    # Sentences are split once a text: an alias would be split again wherever it is used.
    neighbours = lambda s: F.arrays_zip(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))).alias("x"), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))).alias("y"))
    pairs = _docs(spark, sf).select("doc_id", F.posexplode(T.bound(T.split_sentences(F.col("text")), neighbours)).alias("pos", "p"))
    a = F.col("doc_id") * 1_000_000 + F.col("pos")
    return pairs.select(a.alias("a"), (a + 1).alias("b"), T.contradiction_type(F.col("p.x"), F.col("p.y")).alias("kind"))


# Scores


_N = f"len({sql_words('statement')})"
_LETTERS = "length(regexp_replace(statement, '[^A-Za-zÀ-ÖØ-öø-ÿŒœ]', '', 'g'))"
_UPPER = "length(regexp_replace(statement, '[^A-ZÀ-ÖØ-ÞŒ]', '', 'g'))"
_SHARE = f"({_UPPER}::DOUBLE / nullif({_LETTERS}, 0))"
_CLARITY = f"""CASE WHEN length(statement) < 5 THEN 0.0 ELSE least(CASE WHEN regexp_matches(statement, '[.!?]$') OR (regexp_matches(statement, '[^ \\t\\n][)\\]">°%]$') AND length(statement) > 2) THEN 0.35 ELSE 0 END
  + CASE WHEN {_verb(T.SCORING_VERBS)} THEN 0.35 ELSE 0 END + CASE WHEN {_N} BETWEEN 8 AND 50 THEN 0.15 WHEN {_N} BETWEEN 5 AND 7 THEN 0.08 WHEN {_N} > 50 THEN 0.03 ELSE 0 END
  + CASE WHEN {_SHARE} BETWEEN 0.03 AND 0.25 THEN 0.15 WHEN {_SHARE} BETWEEN 0.01 AND 0.40 THEN 0.08 ELSE 0 END, 1.0) END"""
_STRIPPED = f"list_transform({sql_words('statement')}, lambda x: trim(lower(x), '.,;:!?()\"'''))"
_OWN = f"len(list_filter({_STRIPPED}, lambda x: x <> '' AND NOT list_contains({sql_list(S.FUNCTION_WORDS)}, x)))"
_DENSITY = f"""CASE WHEN length(statement) < 10 OR {_N} = 0 THEN 0.0 ELSE least({_OWN}::DOUBLE / {_N} * 0.6 + CASE WHEN regexp_matches(statement, '{S.MEASURE}') THEN 0.2 ELSE 0 END
  + CASE WHEN regexp_matches(statement, '[A-Z][a-z]+(\\s+[A-Z][a-z]+)+') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(statement, '[a-z]+[A-Z]|[a-z]+-[a-z]+') THEN 0.1 ELSE 0 END
  + CASE WHEN length(statement) - length(replace(statement, '"', '')) >= 2 OR length(statement) - length(replace(statement, '''', '')) >= 2 THEN 0.05 ELSE 0 END, 1.0) END"""
_TECH = "[A-Z][A-Za-z]*(Net|Model|Layer|Method|Algorithm|System|Framework)|Accuracy|Precision|Recall|F1|Loss|Error|Throughput|Latency|Params|Transformer|CNN|RNN|LSTM|GRU|GAN|BERT|GPT|ResNet|VGG|Attention|PyTorch|TensorFlow|JAX|NumPy|SciPy|Pandas"
_CITE = f"""CASE WHEN length(statement) < 10 THEN 0.0 ELSE least(least(len(regexp_extract_all(statement, '[0-9]+\\.?[0-9]*')) * 0.1, 0.3)
  + CASE WHEN {sql_word('statement', _TECH).replace('(?i)', '')} THEN 0.15 ELSE 0 END
  + CASE WHEN regexp_matches(statement, 'v?[0-9]+\\.[0-9]+') OR {sql_word('statement', '20[0-9]{2}|19[0-9]{2}')} THEN 0.1 ELSE 0 END
  + CASE WHEN {_CAPS} >= 2 THEN 0.15 WHEN {_CAPS} = 1 THEN 0.08 ELSE 0 END + CASE WHEN {sql_word('statement', bare(S.COMPARATIVE))} THEN 0.1 ELSE 0 END, 1.0) END"""
_SPECIFIC = f"""least(CASE WHEN {sql_word('statement', 'v[0-9]+([.][0-9]+)*')} THEN 0.2 ELSE 0 END + CASE WHEN {sql_word('statement', bare(S.TECH_NOUN))} THEN 0.35 ELSE 0 END
  + CASE WHEN {sql_word('statement', bare(S.TECH_NAME))} THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(statement, '[0-9]') THEN 0.2 ELSE 0 END, 1.0)"""
_QUALIFIERS = f"len(list_filter({_WORDS}, lambda w: list_contains({sql_list(bare(S.QUALIFIER).split('|'))}, lower(w))))"
_QUALITY = f"CASE WHEN {_QUALIFIERS} = 0 THEN 0.4 ELSE least({_QUALIFIERS} * 0.08 + 0.5, 1.0) END"
_SCOPE = f"""least(CASE WHEN {sql_word('statement', bare(S.SCOPE_WORD))} THEN 0.35 ELSE 0 END + CASE WHEN {sql_word('statement', bare(S.SCOPE_PLACE))} THEN 0.35 ELSE 0 END
  + CASE WHEN {sql_word('statement', bare(S.SCOPE_TIME))} THEN 0.30 ELSE 0 END, 1.0)"""
_TRACE = f"least(greatest({_CITE}, CASE WHEN {sql_word('statement', bare(S.CAUSE))} THEN 0.35 ELSE 0 END), 1.0)"
SCORED = f"""scored AS (SELECT *, clarity * 0.22 + density * 0.18 + specific * 0.20 + qualifiers * 0.15 + scope * 0.15 + trace * 0.10 AS total FROM
  (SELECT atom_id, source_id, topic_id, mission_id, pos, statement, CAST({_CLARITY} AS DOUBLE) AS clarity, CAST({_DENSITY} AS DOUBLE) AS density, CAST({_SPECIFIC} AS DOUBLE) AS specific,
    CAST({_QUALITY} AS DOUBLE) AS qualifiers, CAST({_SCOPE} AS DOUBLE) AS scope, CAST({_TRACE} AS DOUBLE) AS trace FROM atoms))"""


@query(
    f"""WITH {ATOMS_SQL}, {SCORED} SELECT atom_id, round(total + 1e-9, 3) AS score, round(clarity, 3) AS clarity, round(density, 3) AS factual_density, round(trace, 3) AS evidence_traceability,
      CASE WHEN {_N} < 5 OR NOT regexp_matches(statement, '[A-Za-z]') OR ({sql_word('statement', 'great|amazing|interesting|important')} AND density < 0.3) OR NOT {_verb(T.SCORING_VERBS)} THEN 'reject'
        WHEN total >= 0.5 THEN 'accept' WHEN total >= 0.25 THEN 'repair' ELSE 'reject' END AS verdict FROM scored"""
)
def score_atom(spark: SparkSession, sf: str) -> DataFrame:
    a = atoms(spark, sf).select("atom_id", S.atom_score(F.col("statement")).alias("s"))
    return a.select("atom_id", "s.score", "s.clarity", "s.factual_density", "s.evidence_traceability", "s.verdict")


_IMPORTANCE = f"""CASE WHEN length(statement) < 10 THEN 0.1 ELSE least(greatest(least(len(regexp_extract_all(statement, '[0-9]+\\.?[0-9]*')) * 0.05, 0.15)
  + least(len(regexp_extract_all(statement, '{S.METRIC}')) * 0.08, 0.20)
  + least(len(list_filter({_WORDS}, lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}(Net|Model|Layer|Method|Algorithm|System|Framework|Transformer|CNN|RNN|LSTM|GAN|BERT|GPT|ResNet|VGG)'))) * 0.10, 0.25)
  + CASE WHEN regexp_matches(lower(statement), '{'|'.join(S.CAUSAL_TERMS)}') THEN 0.20 ELSE 0 END + CASE WHEN regexp_matches(lower(statement), '{'|'.join(S.COMPARATIVE_TERMS)}') THEN 0.15 ELSE 0 END, 0.1), 1.0) END"""


@query(f"WITH {ATOMS_SQL} SELECT atom_id, round(CAST({_IMPORTANCE} AS DOUBLE), 4) AS importance FROM atoms")
def score_importance(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("atom_id", F.round(S.importance(F.col("statement")), 4).alias("importance"))


@query(
    """SELECT page_id, round(CASE WHEN (page_id % 10) / 10.0 < 0.3 THEN 0.0 ELSE (page_id % 10) / 10.0 * 0.35 + CASE WHEN regexp_matches(lower(url), 'arxiv|nature\\.com|science\\.org|ncbi\\.nlm\\.nih\\.gov|ieeexplore') THEN 1.0
      WHEN regexp_matches(lower(url), 'github\\.com|wikipedia\\.org|docs\\.|\\.edu') THEN 0.8 ELSE 0.5 END * 0.25 + least(length(html) / 5000.0, 1.0) * 0.20 + (page_id % 4) / 4.0 * 0.20 END, 6) AS priority FROM pages"""
)
def score_priority(spark: SparkSession, sf: str) -> DataFrame:
    p = S.document_priority((F.col("page_id") % 10) / 10.0, S.url_authority(F.col("url")), F.length("html"), (F.col("page_id") % 4) / 4.0)
    return table(spark, sf, "pages").select("page_id", F.round(p, 6).alias("priority"))


_V = "least(greatest(value / 500.0, 0.0), 1.0)"


@query(
    f"""WITH e AS (SELECT event_id, event_type, {_V} AS v, (event_id % 5) / 5.0 AS c, (event_id % 3) / 3.0 AS s, (event_id % 4) / 4.0 AS r, (event_id % 7) / 7.0 AS q FROM events), b AS (SELECT *,
      (v * 0.6 + c * 0.4) * 0.30 + s * 0.20 + CASE WHEN r = 0 THEN 0.5 ELSE r END * 0.20 + ln(1 + c) / ln(3) * 0.15 + q * 0.15 AS base FROM e)
    SELECT event_id, round(least(greatest(CASE WHEN event_type = 'error' THEN base * 0.7 ELSE base END, 0), 1), 6) AS weight FROM b"""
)
def score_cmk(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda n: (F.col("event_id") % n) / float(n)
    v = S.clamp(F.col("value") / 500.0)
    return table(spark, sf, "events").select("event_id", F.round(S.evidence_weight(v, part(5), part(3), part(4), part(7), F.col("event_type") == "error"), 6).alias("weight"))


_SUPPORT = """s AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS support, count(*) FILTER (event_type = 'error') AS contra, avg(least(greatest(value / 500.0, 0), 1)) AS conf,
  CAST(floor((epoch(TIMESTAMP '2024-02-15') - epoch(max(ts))) / 86400) AS BIGINT) AS days FROM events GROUP BY 1)"""
_AUTH = "least(0.4 * ln(1 + support) + 0.3 * conf + 0.1 * exp(-days / 45.0) + 0.2 * CASE WHEN contra = 0 THEN 1.0 WHEN contra <= support THEN 0.5 ELSE 0.2 END, 1.0)"


@query(f"WITH {_SUPPORT} SELECT user_id, round({_AUTH}, 6) AS authority, round(least(greatest({_AUTH} - 0.3 * contra + 0.2 * ln(1 + support) - (1 - exp(-days / 90.0)), 0), 1), 6) AS stability FROM s")
def score_authority(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("support"), F.count_if(F.col("event_type") == "error").alias("contra"), F.avg(S.clamp(F.col("value") / 500.0)).alias("conf"),
        F.floor((F.unix_timestamp(F.lit("2024-02-15").cast("timestamp")) - F.unix_timestamp(F.max("ts"))) / 86400).alias("days"),
    )
    a = S.authority_score(F.col("support"), F.col("conf"), F.col("days"), F.col("contra"))
    return e.select("user_id", F.round(a, 6).alias("authority"), F.round(S.stability_score(a, F.col("contra"), F.col("support"), F.col("days")), 6).alias("stability"))


@query("SELECT doc_id, round(0.6 * coalesce(quality, 0) + 0.3 * greatest(1 - (d.doc_id % 60) * 0.02, 0) + 0.1 * least((d.doc_id % 15) / 10.0, 1.0), 6) AS retention FROM documents d LEFT JOIN labels USING (doc_id)")
def score_retention(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    r = S.retention(F.coalesce("quality", F.lit(0)), F.col("doc_id") % 60, 0.02, F.col("doc_id") % 15)
    return d.select("doc_id", F.round(r, 6).alias("retention"))


@query("SELECT event_id, round(least(greatest(0.40 * (event_id % 11) / 11.0 + 0.35 * (event_id % 5) / 5.0 + 0.15 * least((event_id % 17) / 10.0, 1.0) + 0.10 * (event_id % 3) / 3.0, 0), 1), 6) AS fused, round((event_id % 17) * exp(-0.01 * (event_id % 100)), 6) AS decayed FROM events")
def score_fusion(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda n: (F.col("event_id") % n) / float(n)
    fused = S.retrieval_fusion(part(11), part(5), F.col("event_id") % 17, part(3))
    return table(spark, sf, "events").select("event_id", F.round(fused, 6).alias("fused"), F.round(S.activation_decay(F.col("event_id") % 17, F.col("event_id") % 100), 6).alias("decayed"))


@query(
    """WITH d AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p, count(*) OVER (PARTITION BY user_id) AS k FROM d)
    SELECT user_id, round(CASE WHEN max(k) < 2 THEN 0.0 ELSE -sum(p * log2(p)) / log2(max(k)) END, 6) AS entropy FROM t GROUP BY 1"""
)
def score_entropy(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = n.groupBy("user_id").agg(F.collect_list("n").alias("ns"), F.sum("n").alias("t"))
    h = -F.aggregate("ns", F.lit(0.0), lambda a, x: a + x / F.col("t") * F.log2(x / F.col("t")))
    return one.select("user_id", F.round(F.when(F.size("ns") < 2, 0.0).otherwise(h / F.log2(F.size("ns").cast("double"))), 6).alias("entropy"))


@query(
    f"""WITH {ATOMS_SQL} SELECT atom_id, round(len(list_filter(['that', 'the', 'from', 'with'], lambda t: contains(lower(statement), t))) / 4.0, 4) AS relevance FROM atoms"""
)
def score_query_relevance(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array(*map(F.lit, ["that", "the", "from", "with"]))
    return atoms(spark, sf).select("atom_id", F.round(S.query_relevance(F.col("statement"), terms), 4).alias("relevance"))
