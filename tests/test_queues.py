"""The stateful queue: stream and table agree, over batches and restarts; rules against hand-made cases."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.streaming import pipelines, queues

SCHEMA = "lane long, ts timestamp, command string, job long, tier int, attempts int, amount int"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def made(n: int) -> list[tuple]:
    """One lane holds half of all commands; instants with several of them; nulls."""
    rnd, rows = random.Random(n), []
    for i in range(n):
        command = rnd.choice(["push", "push", "push", "take", "fail"])
        lane = 0 if i % 2 else rnd.randrange(5)
        rows.append((lane, START + datetime.timedelta(minutes=i // 3 * 2), command, i, rnd.randrange(3), rnd.randrange(4) if command == "fail" else 0, rnd.randrange(1, 4)))
    return [*rows, (None, START, "push", 1, 0, 0, 0), (1, None, "push", 1, 0, 0, 0), (1, START, None, 1, 0, 0, 0), (1, START, "other", 1, 0, 0, 0), (2, START, "push", -5, None, None, None)]


def test_stream_equals_table_over_restarts(spark, rocksdb, tmp_path):
    """Five files in batches of one, each file's rows out of order, with a stop between: the same outcomes as the table's."""
    rules = queues.QueueRules(6, 3, 5 * 60_000)
    rows = made(600)
    random.Random(1).shuffle(rows)
    key = lambda r: (r[1] or START).timestamp() + random.Random(r[3]).uniform(-1200, 1200)
    rows.sort(key=key)
    begin = lambda a, b: spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = queues.queue_stream(pipelines.table_stream(spark, f"file://{tmp_path}/in", 1), "ts", "1 hour", rules)
        stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/at").format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()

    for a, b in ((0, 120), (120, 240), (240, 360)):
        begin(a, b)
    run()
    for a, b in ((360, 480), (480, len(rows))):
        begin(a, b)
    run()
    found = sorted(map(tuple, spark.read.schema(queues.OUTCOMES).parquet(f"{tmp_path}/out").collect()))
    until = int(max(r[1] for r in rows if r[1]).timestamp() * 1000) - 3600_000
    table = queues.queue_table(spark.createDataFrame(rows, SCHEMA), "ts", until, rules)
    assert found == sorted(map(tuple, table.collect()))
    assert {"accepted", "rejected", "taken", "retry", "dead"} == {r[3] for r in found}


def test_rules():
    rules, held = queues.QueueRules(2, 3, 10), []
    run = lambda *c: list(queues.apply_commands(held, queues.in_order(c), rules))
    push, take, fail = (lambda at, job, tier=0: (at, "push", job, tier, 0, 0)), (lambda at, n=1: (at, "take", 0, 0, 0, n)), (lambda at, job, k: (at, "fail", job, 0, k, 0))
    # What comes at the instant of a take is there before it; the third push finds the lane full.
    assert run(take(1, 5), push(1, 7, 2), push(1, 8, 1), push(1, 9)) == [(1, 7, "accepted", 0), (1, 8, "accepted", 0), (1, 9, "rejected", 0), (1, 8, "taken", 0), (1, 7, "taken", 0)]
    # Retries wait 10, 20 and so on; the third failure is the last.
    assert run(fail(2, 7, 0), fail(2, 8, 1), fail(2, 9, 2), take(11, 9), take(12, 9), take(22, 9)) == [(2, 7, "retry", 1), (2, 8, "retry", 2), (2, 9, "dead", 3), (12, 7, "taken", 1), (22, 8, "taken", 2)]
    assert held == []


def test_empty_table(spark):
    assert queues.queue_table(spark.createDataFrame([], SCHEMA), "ts").count() == 0


def test_one_hot_lane_streams(spark):
    rows = [(1, START + datetime.timedelta(seconds=i), "push" if i % 2 else "take", i, 0, 0, 1) for i in range(2000)]
    found = queues.queue_table(spark.createDataFrame(rows, SCHEMA).repartition(4), "ts").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["outcome"]: r["n"] for r in found} == {"accepted": 1000, "taken": 999}


def test_a_lane_orders_one_stretch_of_its_commands_at_a_time(monkeypatch):
    """A lane that meets all its commands at once, as from one file, keeps them in its state by stretches of time."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    from lodeworks.streaming import queues as Q

    class Held:
        def __init__(self):
            self.rows = []

        get, put, clear = (lambda self: iter(self.rows)), (lambda self, rows: setattr(self, "rows", list(rows))), (lambda self: self.rows.clear())

    class Kept(dict):
        getValue, containsKey, updateValue, removeKey = dict.get, dict.__contains__, dict.__setitem__, dict.__delitem__

    timers, sizes, rng = [], [], random.Random(5)
    handle = SimpleNamespace(getListState=lambda *a: Held(), getMapState=lambda *a: Kept(), registerTimer=timers.append)
    commands = [(rng.randrange(200 * 3_600_000), rng.choice(["push", "push", "take", "fail"]), job, job % 3, job % 4, 2) for job in range(4000)]
    frame = pd.DataFrame(commands, columns=["at", "command", "job", "tier", "attempts", "amount"])
    ordered = Q.in_order
    monkeypatch.setattr(Q, "in_order", lambda c: sizes.append(len(x := list(c))) or ordered(x))
    monkeypatch.setattr(Q, "TOGETHER", 700, raising=False)
    rules = Q.QueueRules(20, 3, 600_000)
    lane, got = Q._Lane(rules), []
    lane.init(handle)
    for watermark, frames in ((0, [frame[at : at + 300] for at in range(0, 4000, 300)]), (90 * 3_600_000 + 1234, None), (200 * 3_600_000, None)):
        time = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w)
        for out in lane.handleInputRows((3,), iter(frames), time) if frames else lane.handleExpiredTimer((3,), time, None):
            got += [tuple(r) for r in out.itertuples(index=False)]
    assert got == [(3, *o) for o in Q.apply_commands([], ordered(commands), rules)]
    assert max(sizes) < 60
    assert timers[0] == min(c[0] for c in commands) and timers[1] == min(c[0] for c in commands if c[0] > 90 * 3_600_000 + 1234)
