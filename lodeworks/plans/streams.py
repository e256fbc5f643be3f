"""Streaming queries over ``events`` and their batch equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions import scores as S
from lodeworks.streaming import pipelines as P

from .views import table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return P.table_stream(spark, f"{sf}/events.parquet")


@query("SELECT DISTINCT user_id, event_type FROM events")
def str_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The events span less than the window here, so each key stays once."""
    s = _stream(spark, sf).select("user_id", "event_type", "ts")
    return P.run_available(P.distinct_within(s, ["user_id", "event_type"], "ts", "2000 hours")).select("user_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return P.run_available(P.hourly_counts(_stream(spark, sf), "ts"), "complete").select(F.col("w.start").alias("hour"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS events FROM s GROUP BY 1"""
)
def str_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = P.run_available(P.sessions(_stream(spark, sf).select("user_id", "ts"), "user_id", "ts"), "complete")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


@query("SELECT DISTINCT user_id, true AS agrees FROM events")
def str_activation(spark: SparkSession, sf: str) -> DataFrame:
    """Arbitrary state of a stream against the fold over the table."""
    events = table(spark, sf, "events")
    live: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        live.append(P.fresh_path(spark, "activation"))
        batch.withColumn("batch", F.lit(number)).write.parquet(live[-1])

    P.run_available(P.activation_stream(_stream(spark, sf), "user_id", "ts"), "update", keep)
    last = Window.partitionBy("user_id").orderBy(F.desc("batch"))
    streamed = spark.read.parquet(*live).withColumn("k", F.row_number().over(last)).where("k = 1").select("user_id", F.col("activation").alias("streamed"))
    batch = P.activation_batch(events, "user_id", "ts")
    return batch.join(streamed, "user_id").select("user_id", (F.abs(F.col("activation") - F.col("streamed")) < 1e-6).alias("agrees"))


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 168 * 3600, false) AS fresh FROM e),
    r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY t DESC ROWS UNBOUNDED PRECEDING) - fresh::INT AS newer, max(t) OVER (PARTITION BY user_id) AS last FROM g),
    w AS (SELECT user_id, t, exp(-0.01 * (last - t) / 3600) AS w FROM r WHERE newer = 0),
    s AS (SELECT user_id, w, coalesce(sum(w) OVER (PARTITION BY user_id ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM w)
    SELECT user_id, round(least(0.5 * sum(w), min(10.0 * w + 0.5 * after)), 6) AS activation FROM s GROUP BY 1"""
)
def str_activation_fold(spark: SparkSession, sf: str) -> DataFrame:
    return P.activation_batch(table(spark, sf, "events"), "user_id", "ts").withColumn("activation", F.round("activation", 6))


@query(
    """SELECT e.user_id, e.event_type, e.event_id, e.value, u.n_types FROM (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) e
    JOIN (SELECT user_id, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1) u ON u.user_id = e.user_id"""
)
def str_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Users and their last event of each type, kept as two tables by a stream in several batches; the stream runs twice, the second time from its start, which changes nothing."""
    from lodeworks.sources.versioned import VersionedTables

    store = VersionedTables(spark, P.fresh_path(spark, "upsert"))
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    store.create("users", "user_id long, seen timestamp", ["user_id"], ["seen"])
    store.create("last_events", "user_id long, event_type string, ts timestamp, event_id long, value double", ["user_id", "event_type"], ["ts", "event_id"])
    arrivals = f"{P.fresh_path(spark, 'arrivals')}"
    events.repartition(3, "event_id").write.parquet(arrivals)
    changes = lambda b: {"users": b.select("user_id", F.col("ts").alias("seen")), "last_events": b}
    for _ in range(2):
        P.run_available(P.table_stream(spark, arrivals, 1), "append", store.sink("events", changes))
    last = store.read("last_events").join(store.read("users").select("user_id"), "user_id", "left_semi")
    types = last.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_types"))
    return last.join(types, "user_id").select("user_id", "event_type", "event_id", "value", "n_types")


@query(
    """SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS uses, round(pow(0.7, count(*) OVER w - 1), 6) AS weight FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"""
)
def str_usage_decay(spark: SparkSession, sf: str) -> DataFrame:
    return P.usage_decay(table(spark, sf, "events"), "user_id", "ts").select("event_id", "uses", F.round("weight", 6).alias("weight"))


@query(
    """WITH r AS (SELECT event_id, event_type, ts, sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 5000000.0 AS ratio FROM events),
    l AS (SELECT *, CASE WHEN ratio >= 0.10 THEN 'CRITICAL' WHEN ratio >= 0.05 THEN 'HIGH' WHEN ratio >= 0.01 THEN 'LOW' ELSE 'OK' END AS level FROM r)
    SELECT event_id, level, level <> 'OK' AND level <> coalesce(lag(level) OVER (PARTITION BY event_type ORDER BY ts, event_id), 'OK') AS fires FROM l"""
)
def str_budget(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("bytes", F.round(F.col("value") * 100).cast("long"))
    return P.budget_pressure(e, "event_type", ["ts", "event_id"], "bytes", 5_000_000.0).select("event_id", "level", "fires")


@query(
    """SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN 'abandoned' WHEN event_type = 'click' THEN 'requeued' ELSE 'abandoned' END AS outcome FROM events WHERE event_type <> 'view'"""
)
def str_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    jobs = e.select("event_id", F.when(F.col("event_type") == "view", "done").otherwise("pending").alias("status"), (F.col("event_id") % 5).alias("attempts"), F.when(F.col("event_type") == "click", "extraction").otherwise("condensation").alias("kind"))
    return P.replay_dead_letters(jobs, "status", "attempts", "kind").select("event_id", "outcome")


@query("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id DESC LIMIT 64")
def str_pop_batch(spark: SparkSession, sf: str) -> DataFrame:
    return P.pop_batch(table(spark, sf, "events").select("event_id", "value"), "value", "event_id", 64)


@query("SELECT event_id, true AS due FROM events WHERE ts <= TIMESTAMP '2024-01-10' UNION ALL SELECT event_id, false FROM events WHERE ts > TIMESTAMP '2024-01-10'")
def str_retries(spark: SparkSession, sf: str) -> DataFrame:
    due, waiting = P.due_retries(table(spark, sf, "events"), "ts", F.lit("2024-01-10").cast("timestamp"))
    return due.select("event_id", F.lit(True).alias("due")).unionByName(waiting.select("event_id", F.lit(False).alias("due")))


@query(
    """WITH p AS (SELECT doc_id, sha256(substr(coalesce(text, ''), 1, 2000)) AS content_hash, CASE WHEN (doc_id % 10) / 10.0 < 0.3 THEN 0.0 ELSE 0.35 * (doc_id % 10) / 10.0 + 0.25 * 0.5 + 0.20 * least(length(coalesce(text, '')) / 5000.0, 1.0) + 0.20 * (doc_id % 3) / 3.0 END AS priority FROM documents)
    SELECT doc_id, content_hash, round(priority, 6) AS priority, CASE WHEN priority >= 0.2 THEN 1 ELSE 0 END AS tier FROM p"""
)
def str_tiers(spark: SparkSession, sf: str) -> DataFrame:
    docs = P.table_stream(spark, f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = P.tier_zero(docs, "text", (F.col("doc_id") % 10) / 10.0, F.lit(0.5), (F.col("doc_id") % 3) / 3.0).select("doc_id", "content_hash", F.round("priority", 6).alias("priority"), "tier")
    return P.run_available(t)


@query(
    """SELECT user_id, round(sum(CASE WHEN q >= 0.7 THEN 0.02 * q WHEN q < 0.4 THEN -0.05 * (1 - q) ELSE 0 END), 6) AS delta, count(*) AS uses FROM (SELECT user_id, least(greatest(value / 500.0, 0), 1) AS q FROM events) GROUP BY 1"""
)
def str_feedback(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", S.clamp(F.col("value") / 500.0).alias("q"))
    return P.reliability_feedback(e, "user_id", "q").withColumn("delta", F.round("delta", 6))


@query(
    """WITH t AS (SELECT conv_id, turn, least(1.0, least(length(text) % 5, 3) * 0.35) + CASE WHEN turn % 2 = 0 THEN 0.2 ELSE 0 END AS c, least(1.0, (length(text) % 3) * 0.25) AS u FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, round(least(1.0, sum(c) OVER w), 4) AS confidence_pressure, round(least(1.0, sum(u) OVER w), 4) AS insufficiency_pressure FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""
)
def str_session_pressure(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").where("text IS NOT NULL")
    t = t.select("conv_id", "turn", (F.length("text") % 5).alias("c"), (F.length("text") % 3).alias("u"), F.when(F.col("turn") % 2 == 0, "forming").otherwise("reusable").alias("s"))
    p = P.session_pressure(t, "conv_id", "turn", "c", "u", "s")
    return p.select("conv_id", "turn", F.round("confidence_pressure", 4).alias("confidence_pressure"), F.round("insufficiency_pressure", 4).alias("insufficiency_pressure"))


def _commands(events: DataFrame) -> DataFrame:
    """Purchases take two jobs, every eleventh event fails one, all others push one; a lane is a seventh of the users."""
    command = F.when(F.col("event_type") == "purchase", "take").when(F.col("event_id") % 11 == 0, "fail").otherwise("push")
    return events.select(
        (F.col("user_id") % 7).alias("lane"), "ts", command.alias("command"), F.col("event_id").alias("job"), (F.col("event_id") % 3).cast("int").alias("tier"),
        F.when(command == "fail", F.col("event_id") % 4).otherwise(0).cast("int").alias("attempts"), F.lit(2).alias("amount"),
    )


@query(
    """WITH RECURSIVE c AS (SELECT user_id % 7 AS lane, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms, CASE WHEN event_type = 'purchase' THEN 'take' WHEN event_id % 11 = 0 THEN 'fail' ELSE 'push' END AS command, event_id AS job, CAST(event_id % 3 AS INTEGER) AS tier, event_id % 4 AS a FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    o AS MATERIALIZED (SELECT *, CAST(CASE WHEN command = 'fail' THEN a ELSE 0 END AS INTEGER) AS attempts, row_number() OVER (PARTITION BY lane ORDER BY ms, command, job) AS i FROM c WHERE ms <= (SELECT max(ms) FROM c) - 3600000),
    t(lane, i, held, done) AS (
      SELECT DISTINCT lane, CAST(0 AS BIGINT), CAST([] AS STRUCT(tier INTEGER, due BIGINT, job BIGINT, attempts INTEGER)[]), CAST([] AS STRUCT("at" BIGINT, job BIGINT, outcome VARCHAR, attempts INTEGER)[]) FROM o
      UNION ALL
      SELECT lane, i,
        CASE WHEN command = 'take' THEN list_filter(held, lambda j: NOT list_contains(taken, j)) WHEN command = 'push' AND len(held) < 20 THEN list_append(held, {'tier': tier, 'due': ms, 'job': job, 'attempts': 0})
             WHEN command = 'fail' AND attempts < 2 THEN list_append(held, {'tier': tier, 'due': ms + 600000 * (1 << attempts), 'job': job, 'attempts': attempts + 1}) ELSE held END,
        CASE command WHEN 'take' THEN list_transform(taken, lambda j: {'at': ms, 'job': j.job, 'outcome': 'taken', 'attempts': j.attempts})
             WHEN 'push' THEN [{'at': ms, 'job': job, 'outcome': CASE WHEN len(held) < 20 THEN 'accepted' ELSE 'rejected' END, 'attempts': 0}]
             ELSE [{'at': ms, 'job': job, 'outcome': CASE WHEN attempts < 2 THEN 'retry' ELSE 'dead' END, 'attempts': attempts + 1}] END
      FROM (SELECT o.*, held, list_sort(list_filter(held, lambda j: j.due <= o.ms))[1:2] AS taken FROM t JOIN o ON o.lane = t.lane AND o.i = t.i + 1)
    ) SELECT lane, d."at" AS "at", d.job AS job, d.outcome AS outcome, d.attempts AS attempts FROM (SELECT lane, unnest(done) AS d FROM t)"""
)
def str_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of a bounded queue with tiers, retries and dead letters, as a stream with list state and timers."""
    from lodeworks.streaming import queues as Q

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return P.run_available(Q.queue_stream(_commands(_stream(spark, sf)), "ts", rules=Q.QueueRules(20, 3, 600_000)))
    finally:
        spark.conf.set(provider, before)
