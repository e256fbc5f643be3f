"""Structured Streaming ingestion: stateful deduplication, tiers, activation, budgets, retries and dead letters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.sources.shared import fresh_path

CAP, RATE, AMOUNT = 10.0, 0.01, 0.5
IDLE_HOURS = 168


def table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a Parquet table, a folder or a single file; a limit of files per trigger is the back-pressure.

    Time stamps without a zone are read in the session's, since event time needs one.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    rows = reader.parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_available(stream: DataFrame, mode: str = "append", step: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over all that is there, then returns what it wrote; files and state are in the shared folder.

    With ``step`` each micro-batch goes to that function and nothing is returned.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, "sink")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    if step is not None:
        writer.foreachBatch(step).start().awaitTermination()
        return None
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def write(batch: DataFrame, number: int) -> None:
        # Each batch holds the full result so far, so writing it again replaces it and a replay is harmless.
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out")

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("__batch")


def distinct_within(stream: DataFrame, keys: list[str], time: str, window: str = "72 hours") -> DataFrame:
    """The first row of a key within the window; a key is forgotten once the watermark has passed it."""
    return stream.withWatermark(time, window).dropDuplicatesWithinWatermark(keys)


def hourly_counts(stream: DataFrame, time: str, late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, key: str, time: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def activation_fold(times: Iterable[float], amount: float = AMOUNT, state: tuple[float, float] | None = None) -> tuple[float, float]:
    """(score, last time) of uses in seconds: each use decays the score by its age and adds an amount, up to a cap.

    After more than ``IDLE_HOURS`` without a use the score starts anew.
    """
    score, last = state or (0.0, None)
    for now in times:
        if last is not None:
            idle = max(0.0, now - last) / 3600
            score = score * math.exp(-RATE * idle) if idle <= IDLE_HOURS else 0.0
        score = min(CAP, score + amount)
        last = now if last is None else max(last, now)
    return score, last


def activation_stream(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Activation per key as arbitrary state; the watermark's timer evicts the state of a key idle for ``IDLE_HOURS``.

    Rows later than ``late`` behind the newest are dropped. An evicted key that comes back starts anew, as in the fold.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = pd.concat([f["__seconds"] for f in frames]).sort_values()
        score, last = activation_fold(times, state=state.get if state.exists else None)
        state.update((score, last))
        # One millisecond later, since a key is still active at the limit itself.
        state.setTimeoutTimestamp(max(int((last + IDLE_HOURS * 3600) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [name[0]], "activation": [score]})

    uses = stream.where(F.col(time).isNotNull()).withWatermark(time, late).select(key, time, (F.unix_micros(time) / 1e6).alias("__seconds"))
    return uses.groupBy(key).applyInPandasWithState(step, f"{key} long, activation double", "score double, last double", "update", GroupStateTimeout.EventTimeTimeout)


def fold_maps(maps: Iterable[tuple[float, float, float, float, float]]) -> tuple[float, float, float, float, float] | None:
    """Joins stretches of uses in order: ``(first, last, a, b, c)`` turns a score x at the first use into min(c, a x + b) at the last.

    Such maps are closed under composition, and the decay of a gap is one of them, so stretches may be folded anywhere.
    """
    whole = None
    for first, last, a, b, c in maps:
        if whole is None:
            whole = first, last, a, b, c
            continue
        start, end, a0, b0, c0 = whole
        idle = max(0.0, first - end) / 3600
        held = math.exp(-RATE * idle) if idle <= IDLE_HOURS else 0.0
        whole = start, max(last, end), a * held * a0, a * held * b0 + b, min(c, a * held * c0 + b)
    return whole


def activation_batch(events: DataFrame, key: str, time: str, partitions: int | None = None) -> DataFrame:
    """The same fold over a table: ``key, activation``.

    Uses are dealt by ranges of key and time, so that a key's uses may lie over any number of tasks; each folds its
    stretch of a key to one map, and the maps of a key, at most one a task, are folded in turn. Null times are no uses.
    """
    kind = events.schema[key].dataType.simpleString()
    x = events.select(F.col(key).alias("key"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("at")).where("at IS NOT NULL")
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def folded(batches: Iterable[pa.RecordBatch], maps_of: Callable[[pa.RecordBatch], Iterable[tuple]]) -> Iterator[pa.RecordBatch]:
        """Rows by key and time: one map for each key. What a batch of rows ends goes out together."""
        now, whole, kind = object(), None, None
        rows = lambda done: pa.RecordBatch.from_arrays([pa.array(v, kind if i == 0 else pa.float64()) for i, v in enumerate(zip(*done, strict=True))], names=["key", "first", "last", "a", "b", "c"])
        for batch in batches:
            kind, done = batch.schema.field("key").type, []
            for name, use in zip(batch.column("key").to_pylist(), maps_of(batch), strict=True):
                if name != now:
                    if whole:
                        done.append((now, *whole))
                    now, whole = name, None
                whole = fold_maps((whole, use)) if whole else use
            if done:
                yield rows(done)
        if whole:
            yield rows([(now, *whole)])

    def stretch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded(batches, lambda batch: [(at, at, 1.0, AMOUNT, CAP) for at in batch.column("at").to_pylist()])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded(batches, lambda batch: zip(*[batch.column(c).to_pylist() for c in ("first", "last", "a", "b", "c")], strict=True))

    row = f"key {kind}, first double, last double, a double, b double, c double"
    maps = x.repartitionByRange(n, "key", "at").sortWithinPartitions("key", "at").mapInArrow(stretch, row)
    whole = maps.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(join, row)
    return whole.select(F.col("key").alias(key), F.least("b", "c").alias("activation"))


def usage_decay(events: DataFrame, key: str, time: str, hours: int = 24, base: float = 0.7) -> DataFrame:
    """Weight of a use: .7 to the number of earlier uses within the sliding window."""
    w = Window.partitionBy(key).orderBy(F.unix_timestamp(time)).rangeBetween(-hours * 3600, 0)
    return events.withColumn("uses", F.count(F.lit(1)).over(w)).withColumn("weight", F.pow(F.lit(base), F.col("uses") - 1))


def budget_pressure(events: DataFrame, key: str, order: list[str], size: str, ceiling: float, thresholds: tuple[float, float, float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Running share of a ceiling and the level it reaches; ``fires`` where a level is first reached."""
    w = Window.partitionBy(key).orderBy(*order)
    ratio = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) / ceiling
    low, high, critical = thresholds
    level = F.when(F.col("ratio") >= critical, "CRITICAL").when(F.col("ratio") >= high, "HIGH").when(F.col("ratio") >= low, "LOW").otherwise("OK")
    x = events.withColumn("ratio", ratio).withColumn("level", level)
    return x.withColumn("fires", (F.col("level") != "OK") & (F.col("level") != F.coalesce(F.lag("level").over(w), F.lit("OK"))))


def due_retries(jobs: DataFrame, due: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs to queue again, and those still waiting."""
    return jobs.where(F.col(due) <= now), jobs.where(F.coalesce(F.col(due) > now, F.lit(True)))


def replay_dead_letters(jobs: DataFrame, status: str, attempts: str, kind: str, most: int = 3) -> DataFrame:
    """Pending extraction jobs are queued again, other kinds and exhausted jobs are abandoned."""
    return jobs.where(F.col(status) == "pending").withColumn("outcome", F.when(F.col(attempts) >= most, "abandoned").when(F.col(kind) == "extraction", "requeued").otherwise("abandoned"))


def pop_batch(queue: DataFrame, priority: str, member: str, n: int) -> DataFrame:
    """The n highest priorities; equal ones in reverse order of the member."""
    return queue.orderBy(F.desc(priority), F.desc(member)).limit(n)


def admit(queue: DataFrame, order: str, capacity: int, depth: int) -> DataFrame:
    """Back-pressure over a batch: arrivals beyond the free places of a queue, in order, are marked as rejected.

    Only the first arrivals are sorted out, at most as many as the queue holds; equal ones by their other columns. The
    queue as a stream is ``queues``.
    """
    first = queue.orderBy(order, *[c for c in queue.columns if c != order]).limit(max(0, capacity - depth))
    return first.withColumn("accepted", F.lit(True)).unionByName(queue.exceptAll(first).withColumn("accepted", F.lit(False)))


def tier_zero(batch: DataFrame, text: str, novelty: Column, authority: Column, gap: Column, least: float = 0.2) -> DataFrame:
    """Hash and novelty gates, priority, and the tier that a document goes to next."""
    from lodeworks.functions import scores as S
    from lodeworks.operators.dedup import content_hash

    x = batch.withColumn("content_hash", content_hash(F.col(text))).withColumn("priority", S.document_priority(novelty, authority, F.length(text), gap))
    return x.withColumn("tier", F.when(F.col("priority") >= least, 1).otherwise(0))


def reliability_feedback(uses: DataFrame, atom: str, quality: str) -> DataFrame:
    """Summed reliability changes per atom: +.02 q for good responses, -.05 (1 - q) for bad ones."""
    q = F.col(quality)
    delta = F.when(q >= 0.7, q * 0.02).when(q < 0.4, (1 - q) * -0.05).otherwise(0.0)
    return uses.groupBy(atom).agg(F.sum(delta).alias("delta"), F.count(F.lit(1)).alias("uses"))


def session_pressure(turns: DataFrame, session: str, order: str, contradictions: str, unresolved: str, state: str) -> DataFrame:
    """Pressures of a session after each turn: .35 per contradiction (at most three), .25 per unresolved point, .2 for an unsettled state, capped at 1."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.least(F.lit(1.0), F.least(F.col(contradictions), F.lit(3)) * 0.35) + F.when(F.col(state).isin("contested", "forming"), 0.2).otherwise(0.0)
    # Capped sums of non-negative steps equal the cap of the sum.
    return turns.withColumn("confidence_pressure", F.least(F.lit(1.0), F.sum(step).over(w))).withColumn("insufficiency_pressure", F.least(F.lit(1.0), F.sum(F.least(F.lit(1.0), F.col(unresolved) * 0.25)).over(w)))


def escalation(confidence: Column, insufficiency: Column, depth: Column) -> Column:
    return F.when((confidence >= 0.8) | (insufficiency >= 0.8), "deep").when((confidence >= 0.5) | (depth == "deep"), "standard").otherwise("none")


def approval_needed(similarity: Column, respawns: Column) -> Column:
    return (similarity >= 0.92) | (respawns >= 4) | ((respawns >= 2) & (similarity >= 0.85))
