"""Queries of intent scoring, novelty, merging and loop decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import cognition as C
from lodeworks.operators.derivation import STOPWORDS
from lodeworks.sources import sinks

from .views import sql_list, table

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


def _weight(part: str) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{e}' THEN {C.INTENT_WEIGHTS[i][part]}" for e, i in INTENTS.items()) + f" ELSE {C.INTENT_WEIGHTS['exploratory'][part]} END"


INTENTS = {"view": "factual", "click": "comparative", "purchase": "procedural", "signup": "conceptual"}
_PARTS = {"reliability": 11, "specificity": 3, "centrality": 5, "recency": 4, "query_relevance": 7}
_TOTAL = " + ".join(f"{_weight(p)} * (event_id % {n}) / {n}.0" for p, n in _PARTS.items())


@query(f"SELECT event_id, round(CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE least(1.0, ({_TOTAL}) * CASE WHEN event_id % 2 = 0 THEN 1.3 ELSE 1.0 END) END, 6) AS score FROM events")
def cog_intent_score(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    intent = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv]), F.col("event_type")), F.lit("exploratory"))
    parts = {p: (i % n) / float(n) for p, n in _PARTS.items()}
    return table(spark, sf, "events").select("event_id", F.round(C.intent_score(intent, parts, i % 2 == 0, i % 13 == 0), 6).alias("score"))


@query()
def cog_distil(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.posexplode(C.distil(F.col("text"))).alias("pos", "chunk"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS (SELECT CASE WHEN vec_id < 7 THEN 'low' ELSE 'high' END AS k, e FROM v WHERE vec_id < 11)
    SELECT vec_id, round(max(list_cosine_similarity(v.e, r.e)) FILTER (k = 'low'), 5) AS low, round(max(list_cosine_similarity(v.e, r.e)) FILTER (k = 'high'), 5) AS high,
      coalesce(max(list_cosine_similarity(v.e, r.e)) FILTER (k = 'low') > 0.85 AND max(list_cosine_similarity(v.e, r.e)) FILTER (k = 'high') < 0.60, false) AS skip FROM v, r GROUP BY 1"""
)
def cog_density_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Seven low-value and four high-value references, here the first vectors of the table."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    refs = v.where("vec_id < 11").select(F.when(F.col("vec_id") < 7, "low").otherwise("high").alias("kind"), "embedding")
    g = C.density_gate(v, refs, "vec_id", "embedding", "kind")
    return g.select("vec_id", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "skip")


_W = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> ''))"
_OWN = f"list_filter({{}}, lambda t: NOT list_contains({sql_list(STOPWORDS)}, t))"


@query(
    f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), p AS (SELECT conv_id, turn, {_W.format('text')} AS x, {_W.format("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS y FROM c),
    o AS (SELECT *, {_OWN.format('x')} AS a, {_OWN.format('y')} AS b FROM p) SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE greatest(len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))),
      CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) ELSE 0 END) END, 6) AS similarity FROM o"""
)
def cog_output_novelty(spark: SparkSession, sf: str) -> DataFrame:
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return _turns(spark, sf).withColumn("before", before).select("conv_id", "turn", F.round(C.text_similarity(F.col("text"), F.col("before"), STOPWORDS), 6).alias("similarity"))


@query(
    """WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM conversations),
    g AS (SELECT conv_id, turn, list_distinct(list_transform(range(0, greatest(len(ws) - 3, 0)), lambda i: array_to_string(ws[i + 1:i + 4], ' '))) AS grams FROM w),
    p AS (SELECT a.conv_id, len(a.grams) > 0 AND len(b.grams) > 0 AND len(list_intersect(a.grams, b.grams))::DOUBLE / least(len(a.grams), len(b.grams)) > 0.5 AS hit FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn < b.turn),
    n AS (SELECT conv_id, count(*) AS n FROM g GROUP BY 1), h AS (SELECT conv_id, count(*) FILTER (hit) AS overlapping FROM p GROUP BY 1)
    SELECT n.conv_id, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs, coalesce(overlapping, 0) AS overlapping, CASE WHEN coalesce(overlapping, 0) / greatest(n * (n - 1) / 2, 1) > 0.5 THEN 'high' WHEN coalesce(overlapping, 0) / greatest(n * (n - 1) / 2, 1) > 0.25 THEN 'medium' ELSE 'low' END AS risk
    FROM n LEFT JOIN h ON h.conv_id = n.conv_id"""
)
def cog_phrase_novelty(spark: SparkSession, sf: str) -> DataFrame:
    return C.phrase_novelty(_turns(spark, sf), "conv_id", "turn", "text").select("conv_id", "pairs", "overlapping", "risk")


@query(
    """WITH RECURSIVE c AS (SELECT conv_id, turn, text AS claim, (turn % 10) / 10.0 AS f, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS w FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM c),
    t(conv_id, i, kept) AS (
      SELECT conv_id, i, [{'claim': claim, 'w': w, 'confidence': f::DOUBLE, 'members': 1}] FROM o WHERE i = 1
      UNION ALL
      SELECT conv_id, i, CASE WHEN hit IS NULL THEN list_append(kept, {'claim': claim, 'w': w, 'confidence': f::DOUBLE, 'members': 1})
        ELSE list_transform(kept, lambda k, j: CASE WHEN j = hit THEN {'claim': k.claim, 'w': k.w, 'confidence': (k.confidence + f) / 2, 'members': k.members + 1} ELSE k END) END
      FROM (SELECT o.*, kept, list_position(list_transform(kept, lambda k: len(w) > 0 AND len(list_intersect(k.w, w))::DOUBLE / (len(k.w) + len(w) - len(list_intersect(k.w, w))) > 0.6), true) AS hit FROM t JOIN o ON o.conv_id = t.conv_id AND o.i = t.i + 1)
    ), last AS (SELECT conv_id, unnest(kept) AS k FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS n FROM t) WHERE i = n)
    SELECT conv_id, k.claim AS claim, k.members AS version, round(k.confidence, 6) AS confidence, k.members AS members FROM last"""
)
def cog_merge_claims(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf).withColumn("confidence", (F.col("turn") % 10) / 10.0)
    return C.merge_claims(t, "conv_id", "turn", "text", "confidence").withColumn("confidence", F.round("confidence", 6))


@query(
    """WITH d AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) FILTER (event_type = 'purchase')::DOUBLE AS found FROM events GROUP BY 1, 2),
    w AS (SELECT *, list(found) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y, row_number() OVER (PARTITION BY user_id ORDER BY day) AS cycle FROM d),
    r AS (SELECT *, len(list_filter(y, lambda v: v > 0))::DOUBLE / len(y) AS rate, CASE WHEN len(y) < 3 THEN 1.0 WHEN list_sum(y) = 0 THEN 0.0 ELSE 0.0 - list_sum(list_transform(y, lambda v: CASE WHEN v > 0 THEN v / list_sum(y) * log2(v / list_sum(y)) ELSE 0 END)) / log2(len(y)) END AS entropy FROM w)
    SELECT user_id, CAST(cycle AS INTEGER) AS cycle, round(rate, 6) AS novelty_rate, round(entropy, 6) AS entropy, cycle >= 5 AND (rate < 0.05 OR entropy < 0.3) AS stop FROM r"""
)
def cog_convergence(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").cast("double").alias("found"))
    c = C.convergence(d, "user_id", "day", "found")
    return c.select("user_id", "cycle", F.round("novelty_rate", 6).alias("novelty_rate"), F.round("entropy", 6).alias("entropy"), "stop")


@query("SELECT event_id, CASE WHEN (event_id % 100) / 100.0 >= 0.92 THEN 'BUDGET_PRESSURE' WHEN event_id % 6 >= 4 THEN 'SCOPE_EXPANSION' WHEN event_id % 6 >= 2 AND (event_id % 100) / 100.0 >= 0.85 THEN 'BUDGET_AND_SCOPE' END AS reason FROM events")
def cog_approval(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", C.approval_reason((F.col("event_id") % 100) / 100.0, F.col("event_id") % 6).alias("reason"))


@query("WITH b AS (SELECT user_id, lower(event_type) AS label, max(value) AS salience FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY salience DESC, label) AS k FROM b) SELECT user_id, label, salience, CAST(k AS INTEGER) AS k FROM k WHERE k <= 3")
def cog_active_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return C.active_concepts(table(spark, sf, "events"), "user_id", "event_type", "value", 3)


@query(
    """WITH g AS (SELECT p_brand, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE 1.0 END), 6) AS error_rate, round(abs(avg(l_discount * 10) - avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END)), 6) AS calibration_error, round(avg(l_tax * 10), 6) AS authority
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT *, calibration_error >= 0.15 OR error_rate > 0.4 OR authority < 0.4 AS blind FROM g WHERE n >= 3"""
)
def cog_blind_spots(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    x = x.select("p_brand", (F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "N").alias("a"), (F.col("l_tax") * 10).alias("w"))
    b = C.blind_spots(x, "p_brand", "p", "a", "w")
    return b.select("p_brand", "n", *[F.round(c, 6).alias(c) for c in ("error_rate", "calibration_error", "authority")], "blind")


@query("SELECT l_orderkey AS packet, count(*) AS atoms, count(DISTINCT l_partkey) AS concepts, count(DISTINCT l_suppkey) AS sources, count(*) >= 3 AND (count(DISTINCT l_partkey) >= 2 OR count(DISTINCT l_suppkey) >= 2) AS eligible FROM lineitem GROUP BY 1")
def cog_abstraction_gate(spark: SparkSession, sf: str) -> DataFrame:
    return C.abstraction_gate(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "packet"), "packet", "l_partkey", "l_suppkey")


@query("SELECT page_id, CASE WHEN h = '' THEN 0.3 WHEN regexp_matches(h, '\\.edu$|\\.gov$') THEN 0.9 WHEN regexp_matches(h, 'wikipedia\\.org$') THEN 0.7 WHEN regexp_matches(h, 'github\\.com$') THEN 0.7 WHEN regexp_matches(h, '\\.org$') THEN 0.6 ELSE 0.5 END AS reliability FROM (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS h FROM pages)")
def cog_url_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.url_reliability(F.coalesce("url", F.lit(""))).alias("reliability"))


@query("SELECT c_custkey, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM (SELECT c_custkey, list_distinct(string_split(lower(c_name), '')) AS a, list_distinct(string_split(lower(c_mktsegment), '')) AS b FROM customer)")
def cog_string_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.round(C.character_similarity(F.col("c_name"), F.col("c_mktsegment")), 6).alias("similarity"))


@query("SELECT l_orderkey, count(*) AS atoms, least(0.92, round_even(0.6 + 0.02 * count(*), 2)) AS confidence FROM lineitem GROUP BY 1")
def cog_maturation(spark: SparkSession, sf: str) -> DataFrame:
    return C.maturation(table(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT conv_id, dimension FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY dimension) AS k FROM (SELECT conv_id, unnest(['the', 'cost', 'risk', 'zebra']) AS dimension, t FROM (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS t FROM conversations GROUP BY 1)) WHERE NOT contains(coalesce(t, ''), dimension)) WHERE k <= 2")
def cog_weak_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    dims = t.select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, ["the", "cost", "risk", "zebra"]))).alias("dimension"))
    return C.weak_dimensions(dims, t, "conv_id", "dimension", "text", 2).select("conv_id", "dimension")


@query("SELECT page_id, md5(html) AS checksum, CAST(octet_length(encode(html)) AS INTEGER) AS bytes, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages")
def cog_scraped(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.scraped(table(spark, sf, "pages"), "url", "html").select("page_id", "checksum", "bytes", "host")


@query("SELECT doc_id AS key, role, CAST(p - 1 AS INTEGER) AS position, atoms[p] AS atom FROM (SELECT doc_id, role, atoms, unnest(range(1, len(atoms) + 1)) AS p FROM (SELECT doc_id, 'evidence' AS role, [source, lang] AS atoms FROM documents UNION ALL SELECT doc_id, 'definition', [lang] FROM documents))")
def cog_role_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.create_map(F.lit("evidence"), F.array("source", "lang"), F.lit("definition"), F.array("lang")).alias("roles"))
    return C.role_rows(d, "key", "roles")


@query("SELECT title, kind, CAST(priority AS DOUBLE) AS priority FROM (SELECT n_name AS title, 'gap' AS kind, 0.9 AS priority FROM nation UNION ALL SELECT r_name, 'blind_spot', 0.7 FROM region) ORDER BY priority DESC, kind, title LIMIT 27")
def cog_agenda(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation").select(F.col("n_name").alias("t")), table(spark, sf, "region").select(F.col("r_name").alias("t"))
    return C.agenda([(n, "gap", 0.9), (r, "blind_spot", 0.7)], "t", 27)


@query(
    """WITH c AS (SELECT label, row_number() OVER (ORDER BY label DESC) AS rank FROM (SELECT DISTINCT label FROM embeddings)), x AS (SELECT vec_id % 50 AS atom, c.rank, vec_id, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY c.rank, vec_id) AS k FROM embeddings e JOIN c ON c.label = e.label WHERE c.rank <= 3)
    SELECT atom, CAST(rank AS INTEGER) AS rank, vec_id FROM x WHERE k = 1"""
)
def cog_expand_concepts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", "vec_id", (F.col("vec_id") % 50).alias("atom"))
    # Concepts are the few labels of a mission, ranked here by name.
    top = e.select("label").distinct().orderBy(F.desc("label")).limit(3).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("label"))))
    return C.expand_concepts(top, e, "rank", "label", "atom", "vec_id").select("atom", "rank", "vec_id")


@query()
def cog_repair_driver(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_sentences(F.coalesce("text", F.lit("")))).alias("pos", "s"))
    return docs.select("doc_id", "pos", C.repair_driver(F.col("s"), F.lit("")).alias("repaired")).where("repaired IS NOT NULL")
