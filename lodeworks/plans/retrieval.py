"""Retrieval, ranking and deduplication queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import scores as S
from lodeworks.functions import text as T
from lodeworks.operators import dedup as G
from lodeworks.operators import retrieval as R

from .views import ATOMS_SQL, atoms, sql_any, sql_list, sql_words, table

QUERIES, SQL = {}, {}
QUERY = "what is the thing that they have"


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HITS = " + ".join(f"CAST(contains(lower(statement), '{w}') AS INTEGER)" for w in R.query_words(QUERY))
_LANE = f"lane AS (SELECT *, {_HITS} AS hits FROM atoms WHERE {_HITS} > 0)"


@query(
    f"""WITH {ATOMS_SQL}, {_LANE}, s AS (SELECT atom_id, mission_id, round(0.54 * hits / 5.0 + 0.22 * (atom_id % 10) / 10.0 + 0.06 / (1 + (atom_id % 700) / 365.0), 6) AS score FROM lane),
    r AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY score DESC, atom_id) AS rank FROM s) SELECT atom_id, mission_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12"""
)
def ret_keyword(spark: SparkSession, sf: str) -> DataFrame:
    """Top twelve atoms of every mission for a query text."""
    lane = R.keyword_lane(atoms(spark, sf), "statement", QUERY)
    score = S.rerank_score(F.col("hits") / 5.0, (F.col("atom_id") % 10) / 10.0, F.col("atom_id") % 700, {}, F.lit(0.0), F.lit(0.0), F.lit("forming"))
    return R.ranked(lane.withColumn("score", F.round(score, 6)), "mission_id", F.col("score"), "atom_id", 12).select("atom_id", "mission_id", "score", "rank")


@query(
    """WITH l AS (SELECT user_id AS id, event_id AS pos, 0 AS lane FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, 1 FROM events WHERE event_type = 'click'
      UNION ALL SELECT c_custkey, c_custkey, 2 FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lane, pos) AS k FROM l)
    SELECT id, pos, CAST(lane AS INTEGER) AS lane FROM r WHERE k = 1"""
)
def ret_merge_lanes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), "event_type")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"))
    return R.merge_lanes([e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'click'").drop("event_type"), c], "id", "pos").select("id", "pos", "lane")


_DELTA = "CASE WHEN event_id % 5 = 0 THEN 0.08 WHEN event_id % 5 = 1 THEN 0.04 WHEN event_id % 5 = 2 THEN 0.0 WHEN event_id % 5 = 3 THEN -0.08 ELSE -0.12 END"


def _rerank_sql(zero: str) -> str:
    return f"""WITH e AS (SELECT event_id, user_id, (event_id % 11) / 10.0 AS rel, (event_id % 7) / 7.0 AS tr, event_id % 900 AS days FROM events), s AS (SELECT *, round(
      least({zero.format('rel')}, 1) * 0.54 + least({zero.format('tr')}, 1) * 0.22 + 0.14 / (1 + days / 365.0) + CASE WHEN event_id % 3 = 0 THEN 0.10 ELSE 0 END + CASE WHEN event_id % 4 = 0 THEN 0.08 ELSE 0 END
      + least((event_id % 13) / 50.0, 0.15) + least((event_id % 17) / 17.0 * 0.12, 0.08) + {_DELTA} + CASE WHEN days > 365 THEN -0.08 ELSE 0 END, 6) AS score FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM s) SELECT event_id, user_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def _rerank(spark: SparkSession, sf: str, faithful: bool) -> DataFrame:
    i = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ["reusable", "synthesized", "forming", "contested", "stale"])), (i % 5 + 1).cast("int"))
    flags = {"is_core_atom": i % 3 == 0, "exact_match": i % 4 == 0}
    score = S.rerank_score((i % 11) / 10.0, (i % 7) / 7.0, i % 900, flags, (i % 17) / 17.0, (i % 13) / 50.0, state, "temporal", faithful)
    x = table(spark, sf, "events").select("event_id", "user_id", F.round(score, 6).alias("score"))
    return R.ranked(x, "user_id", F.col("score"), "event_id", 10)


@query(_rerank_sql("{}"))
def ret_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _rerank(spark, sf, False)


@query(_rerank_sql("CASE WHEN {0} = 0 THEN 0.5 ELSE {0} END"))
def ret_rerank_faithful(spark: SparkSession, sf: str) -> DataFrame:
    return _rerank(spark, sf, True)


@query(
    """WITH e AS (SELECT event_id, user_id, event_id % 900 AS days, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
    b AS (SELECT *, CASE WHEN days <= 30 THEN 0 WHEN days <= 365 THEN 1 ELSE 2 END AS band FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, band ORDER BY rank) <= CASE band WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 3 END AS inq FROM b),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY inq DESC, CASE WHEN inq THEN band ELSE 0 END, rank) AS place FROM k) SELECT event_id, user_id, CAST(band AS INTEGER) AS band, CAST(place AS INTEGER) AS place FROM p WHERE place <= 12"""
)
def ret_diversify(spark: SparkSession, sf: str) -> DataFrame:
    x = R.ranked(table(spark, sf, "events"), "user_id", F.col("value"), "event_id", 1 << 30).withColumn("days", F.col("event_id") % 900)
    return R.diversify(x, "user_id", "rank", "days", 12).select("event_id", "user_id", "band", "place")


_PACK = "CASE WHEN regexp_matches(lower(text), 'because|causes|mechanism|works|root cause') THEN 1 WHEN regexp_matches(lower(text), 'tradeoff|versus|compare|better|worse') THEN 2 WHEN regexp_matches(lower(text), 'constraint|limit|bound|cannot|must') THEN 3 WHEN regexp_matches(lower(text), 'implement|deploy|config|code|runtime') THEN 4 ELSE 5 END"


@query(
    f"""WITH c AS (SELECT conv_id, turn, {_PACK} AS cluster, greatest(len({sql_words('text')}), 1) AS words FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, cluster ORDER BY turn) AS k FROM c), p AS (SELECT *, row_number() OVER w AS place, sum(words) OVER w AS used FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY k, cluster ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, min(CASE WHEN used > 150 AND place > 1 THEN place END) OVER (PARTITION BY conv_id) AS stop FROM p) SELECT conv_id, turn, CAST(place AS INTEGER) AS place, CAST(used AS BIGINT) AS used FROM s WHERE stop IS NULL OR place < stop"""
)
def ret_pack(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("kind"))
    return R.pack_evidence(x, "conv_id", "text", "kind", "turn", 150).select("conv_id", "turn", "place", "used")


@query("WITH k AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) SELECT event_id, user_id, event_type, CAST(k AS INTEGER) AS k FROM k WHERE k <= 2")
def ret_cluster_cap(spark: SparkSession, sf: str) -> DataFrame:
    return R.cluster_cap(table(spark, sf, "events"), "user_id", "event_type", "value", "event_id").select("event_id", "user_id", "event_type", "k")


@query(
    """WITH b AS (SELECT user_id, event_type, max(value) AS best FROM events GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY best DESC, event_type) AS c FROM b),
    k AS (SELECT e.*, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY value DESC, event_id) AS k FROM events e JOIN c ON c.user_id = e.user_id AND c.event_type = e.event_type AND c.c <= 3)
    SELECT event_id, user_id, event_type FROM k WHERE k <= 2"""
)
def ret_compress(spark: SparkSession, sf: str) -> DataFrame:
    return R.compress_clusters(table(spark, sf, "events"), "user_id", "event_type", "value", "event_id").select("event_id", "user_id", "event_type")


@query(
    """WITH t AS (SELECT event_id, user_id, (event_id % 101) / 100.0 AS score, CASE WHEN (event_id % 101) / 100.0 >= 0.75 THEN 0 WHEN (event_id % 101) / 100.0 >= 0.5 THEN 1 ELSE 2 END AS tier FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, tier ORDER BY score DESC, event_id) AS k FROM t), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, k) AS place FROM k WHERE tier = 2 OR k <= 6)
    SELECT event_id, user_id, CAST(tier AS INTEGER) AS tier, CAST(place AS INTEGER) AS place FROM p WHERE place <= 12"""
)
def ret_tiers(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select("event_id", "user_id", ((F.col("event_id") % 101) / 100.0).alias("score"))
    return R.tiered(x, "user_id", "score", "event_id").select("event_id", "user_id", "tier", "place")


@query(
    """WITH c AS (SELECT p_partkey, p_brand, round(0.35 * (p_partkey % 10) / 10.0 + 0.20 * (p_size / 50.0) + 0.06 * greatest(0.2, 1 - (p_partkey % 800) / 365.0) + 0.15 * (p_partkey % 3) / 3.0 + 0.19 * (p_partkey % 4) / 4.0 + 0.05 * (p_partkey % 3) / 3.0, 6) AS score FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM c) SELECT p_partkey, p_brand, score, CAST(rank AS INTEGER) AS rank FROM r"""
)
def ret_composite(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("p_partkey")
    score = S.composite((i % 10) / 10.0, F.col("p_size") / 50.0, i % 800, (i % 3) / 3.0, (i % 4) / 4.0)
    x = table(spark, sf, "part").select("p_partkey", "p_brand", F.round(score, 6).alias("score"))
    return R.ranked(x, "p_brand", F.col("score"), "p_partkey", 1 << 30)


@query(
    """WITH q AS (SELECT user_id AS key, 0 AS q, event_id AS pos FROM events WHERE value > 100 UNION ALL SELECT user_id, 1, event_id FROM events WHERE event_type = 'view'), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY q, pos) AS k FROM q)
    SELECT key, CAST(q AS INTEGER) AS q, pos FROM r WHERE k = 1"""
)
def ret_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", "value", "event_type")
    a = e.where("value > 100").select("key", F.lit(0).alias("q"), F.col("event_id").alias("pos"))
    b = e.where("event_type = 'view'").select("key", F.lit(1).alias("q"), F.col("event_id").alias("pos"))
    return R.multi_query_merge(a.unionByName(b), "key", "q", "pos")


@query(
    """WITH r AS (SELECT conv_id, role, string_agg('- ' || text, chr(10) ORDER BY turn) AS body FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2)
    SELECT conv_id, string_agg('### ' || role || chr(10) || body, chr(10) ORDER BY '### ' || role || chr(10) || body) AS context FROM r GROUP BY 1"""
)
def ret_context(spark: SparkSession, sf: str) -> DataFrame:
    return R.context_block(table(spark, sf, "conversations").where("text IS NOT NULL"), "conv_id", "role", "turn", "text")


@query("WITH h AS (SELECT doc_id, source, sha256(substr(coalesce(text, ''), 1, 2000)) AS content_hash FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS k FROM h) SELECT doc_id, content_hash FROM r WHERE k = 1")
def dup_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select("doc_id", G.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return G.first_by(x, ["content_hash"], [F.asc("doc_id")])


_CANON = """CASE WHEN regexp_matches(b, '\\S{2,}ies$') THEN substr(form, 1, length(form) - 3) || 'y' WHEN regexp_matches(b, '\\S[^s\\s]ses$') THEN substr(form, 1, length(form) - 1)
  WHEN regexp_matches(b, '\\S{2,}ches$') THEN substr(form, 1, length(form) - 2) WHEN regexp_matches(b, '\\S{2,}[^s\\s]s$') THEN substr(form, 1, length(form) - 1) ELSE form END"""


@query(
    f"""WITH e AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{3,}}'))) AS form FROM documents),
    x AS (SELECT form, {_CANON} AS canonical FROM (SELECT *, lower(form) AS b FROM e)), f AS (SELECT *, count(*) OVER (PARTITION BY canonical) AS frequency FROM x),
    t AS (SELECT *, NOT {sql_any('lower(form)', T.ARTIFACTS)} AND NOT list_contains({sql_list(G.GENERIC)}, lower(form)) AND (frequency >= 3 OR (frequency = 2 AND regexp_matches(lower(form), '.{{2,}}({G.ENDINGS})$'))) AS ok FROM f)
    SELECT DISTINCT canonical, frequency, 'expandable' AS tier FROM t WHERE ok"""
)
def dup_entity_tiers(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.explode(T.capitalised(F.coalesce("text", F.lit("")))).alias("form"))
    return G.tiered_entities(docs, "form", "doc_id").select("canonical", "frequency", "tier")


@query("SELECT turn_key, text FROM (SELECT conv_id * 1000 + turn AS turn_key, trim(text) AS text, row_number() OVER (PARTITION BY conv_id, lower(trim(text)) ORDER BY turn) AS k FROM conversations WHERE trim(text) <> '') WHERE k = 1")
def dup_query_list(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_key"), F.trim("text").alias("text"), "conv_id").where("text <> ''")
    return G.first_by(x.withColumn("low", F.lower("text")), ["conv_id", "low"], [F.asc("turn_key")]).select("turn_key", "text")
