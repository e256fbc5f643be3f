"""Relational queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import scores as S
from lodeworks.functions import text as T
from lodeworks.operators import relational as R
from lodeworks.sources import tables as A

from .texts import _IMPORTANCE
from .views import ATOMS_SQL, atoms, sql_any, sql_list, table

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 17")
def rel_fetch_one(spark: SparkSession, sf: str) -> DataFrame:
    return A.fetch_one(table(spark, sf, "events"), {"event_id": 17}).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY value DESC NULLS LAST, event_id LIMIT 50")
def rel_fetch_many(spark: SparkSession, sf: str) -> DataFrame:
    return A.fetch_many(table(spark, sf, "events"), {"event_type": "purchase"}, [F.desc_nulls_last("value"), F.asc("event_id")], 50).select("event_id", "user_id", "value")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 1000, r_name, NULL FROM region")
def rel_bulk_insert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return A.append_rows(table(spark, sf, "nation"), rows)


@query(
    """
    WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
    t AS (SELECT c_custkey AS user_id, c_name AS name, c_acctbal AS value FROM customer)
    SELECT coalesce(t.user_id, e.user_id) AS user_id, t.name, CASE WHEN e.user_id IS NOT NULL THEN e.value ELSE t.value END AS value
    FROM t FULL JOIN (SELECT * FROM e WHERE k = 1) e ON t.user_id = e.user_id
    """
)
def rel_upsert_lww(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    rows = table(spark, sf, "events").select("user_id", "value", F.struct("ts", "event_id").alias("seq"))
    return A.upsert(base, rows, ["user_id"], "seq")


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 1000 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def rel_update_rows(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return A.update(base, base.where("s_acctbal < 1000").select("s_suppkey", F.lit(0.0).alias("s_acctbal")), "s_suppkey")


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type = 'error' AND user_id = 3)")
def rel_delete_where(spark: SparkSession, sf: str) -> DataFrame:
    return A.delete_where(table(spark, sf, "events").select("event_id", "event_type", "user_id"), {"event_type": "error", "user_id": 3}).drop("user_id")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT o_orderkey, 1, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    """
)
def rel_replace_children(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parents = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return A.replace_children(lines, parents.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity")), "l_orderkey")


@query(
    """
    WITH a AS (SELECT doc_id, lang, md5(text) AS content_hash, octet_length(encode(text)) AS bytes,
      row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, lang, content_hash, bytes FROM a WHERE k = 1 AND content_hash NOT IN (SELECT md5(text) FROM documents WHERE lang = 'de' AND text IS NOT NULL)
    """
)
def rel_ingest_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.md5("text").alias("content_hash"), F.octet_length("text").cast("long").alias("bytes"))
    old = docs.where("lang = 'de'").select("content_hash").distinct()
    fresh = A.ingest(docs.limit(0), docs, ["lang", "content_hash"], [F.asc("doc_id")])
    return fresh.join(old, "content_hash", "left_anti").select("doc_id", "lang", "content_hash", "bytes")


@query(
    """
    SELECT source AS topic_id, w AS entity, count(*) AS cnt FROM
      (SELECT source, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))) AS w FROM documents) GROUP BY 1, 2
    """
)
def rel_concept_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.concept_counts(_entities(spark, sf), "topic_id", "entity")


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(F.col("source").alias("topic_id"), "doc_id", F.explode(T.capitalised(F.coalesce("text", F.lit("")))).alias("entity"))


_ENT = "ent AS (SELECT source AS topic_id, doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))) AS entity FROM documents)"


@query(f"WITH {_ENT} SELECT entity, count(*) AS cnt FROM ent GROUP BY 1 ORDER BY cnt DESC, entity LIMIT 25")
def rel_concept_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _entities(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "entity").limit(25)


@query(
    f"""
    WITH {_ENT}, links AS (SELECT entity, topic_id, count(*) AS cnt FROM ent GROUP BY 1, 2 ORDER BY cnt DESC, entity, topic_id LIMIT 150)
    SELECT entity, sum(cnt) AS weight, count(*) AS topics FROM links GROUP BY 1
    """
)
def rel_graph_weights(spark: SparkSession, sf: str) -> DataFrame:
    links = R.concept_counts(_entities(spark, sf), "topic_id", "entity").orderBy(F.desc("cnt"), "entity", "topic_id").limit(150)
    return links.groupBy("entity").agg(F.sum("cnt").alias("weight"), F.count(F.lit(1)).alias("topics"))


@query(
    """
    SELECT m.lang AS mission_id, count(*) AS sources, sum(octet_length(encode(m.text))) AS bytes, count(l.doc_id) AS judged, count(*) FILTER (l.quality = 1) AS good
    FROM documents m LEFT JOIN labels l ON l.doc_id = m.doc_id GROUP BY 1
    """
)
def rel_mission_rollup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("mission_id"), F.octet_length("text").cast("long").alias("bytes"))
    labels = table(spark, sf, "labels").select("doc_id", "quality", F.lit(1).alias("hit"))
    return docs.join(labels, "doc_id", "left").groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("bytes").alias("bytes"), F.count("hit").alias("judged"), F.count_if(F.col("quality") == 1).alias("good")
    )


@query(
    """
    WITH o AS (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total FROM orders GROUP BY 1), e AS (SELECT user_id, count(*) AS events FROM events GROUP BY 1)
    SELECT c_custkey, coalesce(orders, 0) AS orders, round(coalesce(total, 0), 2) AS total, coalesce(events, 0) AS events
    FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey
    """
)
def rel_left_merge_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey")
    sides = {
        "orders": (table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), [F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total")]),
        "events": (table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey"), [F.count(F.lit(1)).alias("events")]),
    }
    return R.left_counts(c, "c_custkey", sides).withColumn("total", F.round(F.col("total").cast("double"), 2))


@query(
    """
    SELECT a.l_orderkey AS set_id, a.l_linenumber AS a, b.l_linenumber AS b, pa.p_brand AS brand_a, pb.p_brand AS brand_b
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
    JOIN part pa ON pa.p_partkey = a.l_partkey JOIN part pb ON pb.p_partkey = b.l_partkey WHERE pa.p_brand = pb.p_brand
    """
)
def rel_pair_selfjoin(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("set_id"), "l_linenumber", "l_partkey")
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    members = lines.join(brands, "l_partkey").select("set_id", F.struct("l_linenumber", "brand").alias("m"))
    pairs = R.member_pairs(members, "set_id", "m").where("a.brand = b.brand AND a.l_linenumber < b.l_linenumber")
    return pairs.select("set_id", F.col("a.l_linenumber").alias("a"), F.col("b.l_linenumber").alias("b"), F.col("a.brand").alias("brand_a"), F.col("b.brand").alias("brand_b"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rel_not_in_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return R.null_aware_gaps(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id"), "doc_id", "doc_id")


@query("SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages v WHERE starts_with(v.url, 'https') AND v.url = p.url) AND url <> ''")
def rel_anti_visited(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pages.where("url <> ''").join(pages.where(F.col("url").startswith("https")).select("url").distinct(), "url", "left_anti").select("page_id", "url")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS chunks FROM conversations GROUP BY 1")
def rel_text_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    return R.reassemble(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query(
    """
    WITH RECURSIVE edge AS (
      SELECT 'r' || r_regionkey AS a, 'n' || n_nationkey AS b FROM region JOIN nation ON n_regionkey = r_regionkey
      UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    ), walk(node, depth) AS (SELECT 'r1', 0 UNION ALL SELECT e.b, w.depth + 1 FROM walk w JOIN edge e ON e.a = w.node WHERE w.depth < 3)
    SELECT node, CAST(depth AS INTEGER) AS depth FROM walk
    """
)
def rel_recursive_walk(spark: SparkSession, sf: str) -> DataFrame:
    for name in ("region", "nation", "customer"):
        table(spark, sf, name).createOrReplaceTempView(f"__walk_{name}")
    return spark.sql(
        """
        WITH RECURSIVE edge AS (
          SELECT concat('r', r_regionkey) AS a, concat('n', n_nationkey) AS b FROM __walk_region JOIN __walk_nation ON n_regionkey = r_regionkey
          UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM __walk_customer
        ), walk(node, depth) AS (SELECT 'r1', 0 UNION ALL SELECT e.b, w.depth + 1 FROM walk w JOIN edge e ON e.a = w.node WHERE w.depth < 3)
        SELECT node, depth FROM walk
        """
    )


_END = "(statement LIKE '%.' OR statement LIKE '%!' OR statement LIKE '%?' OR statement LIKE '%)' OR statement LIKE '%.]')"
_BROWSE = f"{_IMPORTANCE} >= 0.11 AND NOT {sql_any('lower(statement)', T.BROWSE_NOISE)} AND length(statement) >= 40"


@query(f"WITH {ATOMS_SQL} SELECT atom_id, topic_id FROM atoms WHERE {_BROWSE} AND {_END}")
def rel_atom_browse_intended(spark: SparkSession, sf: str) -> DataFrame:
    return browse(atoms(spark, sf), S.importance(F.col("statement")) >= 0.11).select("atom_id", "topic_id")


@query(f"WITH {ATOMS_SQL} SELECT atom_id, topic_id FROM atoms WHERE {_BROWSE} AND {_END.strip('()').replace(chr(39) + '%)', chr(39) + '%)')} AND topic_id = 'src1'")
def rel_atom_browse_faithful(spark: SparkSession, sf: str) -> DataFrame:
    return browse(atoms(spark, sf), S.importance(F.col("statement")) >= 0.11, F.col("topic_id") == "src1", faithful=True).select("atom_id", "topic_id")


def browse(found: DataFrame, *tests, faithful: bool = False) -> DataFrame:
    """Atoms worth showing. ``faithful``: the alternatives of the ending bind looser than the other tests, and the topic test only to the last."""
    s = F.col("statement")
    first, *topic = tests
    base = first & ~T.contains_any(F.lower(s), T.BROWSE_NOISE) & (F.length(s) >= 40)
    ends = [s.endswith("."), s.endswith("!"), s.endswith("?"), s.endswith(")"), s.endswith(".]")]
    last = ends[-1] & topic[0] if topic else ends[-1]
    if faithful:
        return found.where((base & ends[0]) | ends[1] | ends[2] | ends[3] | last)
    every = base & (ends[0] | ends[1] | ends[2] | ends[3] | ends[4])
    return found.where(every & topic[0] if topic else every)


@query(
    """
    SELECT (SELECT count(*) FROM documents) AS sources, (SELECT count(DISTINCT source) FROM documents WHERE n_chars > 100) AS topics,
      (SELECT count(*) FROM labels) AS judged, (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic, (SELECT count(*) FROM conversations) AS turns, (SELECT count(*) FROM pages) AS pages
    """
)
def rel_knowledge_stats(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, *aggs: table(spark, sf, name).agg(*aggs)
    # One-row tables side by side.
    out = one("documents", F.count(F.lit(1)).alias("sources"), F.countDistinct(F.when(F.col("n_chars") > 100, F.col("source"))).alias("topics"))
    out = out.crossJoin(one("labels", F.count(F.lit(1)).alias("judged"), F.count_if(F.col("toxic") == 1).alias("toxic")))
    return out.crossJoin(one("conversations", F.count(F.lit(1)).alias("turns"))).crossJoin(one("pages", F.count(F.lit(1)).alias("pages")))


_STATE = """CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'stale' WHEN event_type = 'error' THEN 'contested' WHEN event_type = 'purchase' THEN 'reusable' WHEN event_type = 'signup' THEN 'synthesized' ELSE 'forming' END"""


def event_states(events: DataFrame) -> DataFrame:
    """Trust states of events: age decides freshness and the type the rest."""
    old = F.when(F.col("ts") < F.lit("2024-01-08").cast("timestamp"), "stale").otherwise("fresh")
    none = F.lit(None).cast("string")
    state = S.trust_state(
        none, old, F.when(F.col("event_type") == "signup", "matured").otherwise(""), F.when(F.col("event_type") == "error", 1).otherwise(0),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0), F.lit(False), F.lit(False),
    )
    return events.withColumn("state", state)


@query(f"SELECT event_id, {_STATE} AS state FROM events")
def score_trust_state(spark: SparkSession, sf: str) -> DataFrame:
    return event_states(table(spark, sf, "events")).select("event_id", "state")


@query(f"SELECT s AS state, coalesce(n, 0) AS n FROM (SELECT unnest({sql_list(S.TRUST_STATES)}) AS s) LEFT JOIN (SELECT {_STATE} AS state, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) ON state = s")
def rel_trust_histogram(spark: SparkSession, sf: str) -> DataFrame:
    counts = event_states(table(spark, sf, "events").where("event_type <> 'error'")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return R.zero_filled(counts, "state", S.TRUST_STATES, "n")


@query(
    f"""
    SELECT user_id, CASE WHEN list_contains(st, 'contested') THEN 'contested' WHEN list_contains(st, 'stale') THEN 'stale' WHEN list_contains(st, 'reusable') THEN 'reusable'
      WHEN list_contains(st, 'synthesized') THEN 'synthesized' ELSE 'forming' END AS state FROM (SELECT user_id, list(DISTINCT {_STATE}) AS st FROM events GROUP BY 1)
    """
)
def score_trust_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    states = event_states(table(spark, sf, "events"))
    return states.groupBy("user_id").agg(S.aggregate_trust_state(F.collect_set("state")).alias("state"))


@query("SELECT lang AS mission_id, count(*) AS pending FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1 ORDER BY pending DESC, mission_id LIMIT 1")
def rel_backlog(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("mission_id"))
    return docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("mission_id").agg(F.count(F.lit(1)).alias("pending")).orderBy(F.desc("pending"), "mission_id").limit(1)


@query("SELECT event_type AS state, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def rel_state_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@query(
    """
    SELECT user_id, round(avg(value), 6) AS mean, list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * 0.5) AS BIGINT)) + 1] AS p50,
      list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1
    """
)
def rel_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value IS NOT NULL").groupBy("user_id").agg(
        F.round(F.avg("value"), 6).alias("mean"), R.index_percentile(F.col("value"), 0.5).alias("p50"), R.index_percentile(F.col("value"), 0.95).alias("p95")
    )


@query(
    """
    SELECT source AS topic_id, count(DISTINCT d.doc_id) AS atoms, count(DISTINCT l.doc_id) AS toxic, round(count(DISTINCT l.doc_id)::DOUBLE / nullif(count(DISTINCT d.doc_id), 0), 6) AS ratio
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 GROUP BY 1
    """
)
def rel_topic_health(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("source").alias("topic_id"), "doc_id").distinct()
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("hit")).distinct()
    return docs.join(bad, "doc_id", "left").groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("atoms"), F.count("hit").alias("toxic"), F.round(F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("ratio")
    )


@query("SELECT vec_id FROM embeddings WHERE NOT (label < 6 AND label % 2 = 0)")
def rel_embedding_stale(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "label")
    registry = vectors.where("label < 6").select("vec_id", F.when(F.col("label") % 2 == 0, "m2").otherwise("m1").alias("model"))
    return A.stale_embeddings(vectors.select("vec_id"), registry, "vec_id", "m2")


@query("SELECT event_type AS metric, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def rel_metric_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events")
def rel_json_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("")).alias("missing"))


@query("SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days FROM orders")
def rel_days_since(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.unix_timestamp(F.lit("2000-01-01").cast("timestamp"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.floor((as_of - F.unix_timestamp("o_orderdate")) / 86400), F.lit(9999)).cast("long").alias("days"))
