"""A queue as a stateful stream: bounded depth with rejects, tiers, delayed retries and dead letters.

Commands of a lane are taken in order of event time once the watermark has passed them, so that the result does not
depend on how they arrive in micro-batches or on restarts:

* ``push`` adds a job, or rejects it where the lane holds ``capacity`` jobs already (back-pressure);
* ``take`` hands out up to ``amount`` jobs that are due, lower tiers first, then the longest due, then by job;
* ``fail`` brings a job back after a delay that doubles with its attempts, or gives it up as a dead letter after the last.

What a lane holds is its state: the jobs, and the commands that are still ahead of the watermark, by stretches of time. A
task has one such stretch in memory, or the commands that it is about to put there, however many are ahead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "lane bigint, at bigint, job bigint, outcome string, attempts int"
_JOBS = "tier int, due bigint, job bigint, attempts int"
#: Commands of one instant: what fails or comes is there before something is taken.
_ORDER = {"fail": 0, "push": 1, "take": 2}
#: A command as it is kept: its place in the order of commands in place of its name.
_KEPT = np.dtype([("at", "<i8"), ("command", "<i4"), ("job", "<i8"), ("tier", "<i4"), ("attempts", "<i4"), ("amount", "<i4")])
#: Milliseconds of a stretch of commands, and commands that are put to their stretches together.
STRETCH, TOGETHER = 3_600_000, 100_000


@dataclass(frozen=True)
class QueueRules:
    """Jobs that a lane holds at most, attempts before a job is a dead letter, and the first delay in milliseconds."""

    capacity: int = 100
    attempts: int = 3
    delay: int = 60_000


Job = tuple[int, int, int, int]
Command = tuple[int, str, int, int, int, int]


def in_order(commands: Iterable[Command]) -> list[Command]:
    return sorted(commands, key=lambda c: (c[0], _ORDER[c[1]], c[2]))


def apply_commands(held: list[Job], commands: Iterable[Command], rules: QueueRules) -> Iterator[tuple[int, int, str, int]]:
    """Changes what a lane holds by commands in order, and gives ``at, job, outcome, attempts`` of what happens."""
    for at, command, job, tier, attempts, amount in commands:
        if command == "push":
            fits = len(held) < rules.capacity
            if fits:
                held.append((tier, at, job, attempts))
            yield at, job, "accepted" if fits else "rejected", attempts
        elif command == "fail":
            again = attempts + 1 < rules.attempts
            if again:
                held.append((tier, at + rules.delay * 2**attempts, job, attempts + 1))
            yield at, job, "retry" if again else "dead", attempts + 1
        else:
            for taken in sorted(j for j in held if j[1] <= at)[:amount]:
                held.remove(taken)
                yield at, taken[2], "taken", taken[3]


class _Lane(StatefulProcessor):
    """The queue of one lane; a timer fires at the first command ahead of the watermark."""

    def __init__(self, rules: QueueRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _JOBS)
        self.stretches = handle.getMapState("stretches", "stretch bigint", "pieces int, first bigint")
        self.ahead = handle.getMapState("ahead", "stretch bigint, piece int", "commands binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, size = [], 0
        for frame in rows:
            part = np.empty(len(frame), _KEPT)
            for name in _KEPT.names:
                part[name] = frame[name].map(_ORDER) if name == "command" else frame[name]
            new.append(part)
            size += len(part)
            if size >= TOGETHER:
                self._keep(np.concatenate(new))
                new, size = [], 0
        if size:
            self._keep(np.concatenate(new))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _keep(self, commands: np.ndarray) -> None:
        """Each stretch gets its commands as one more piece."""
        commands = commands[np.argsort(commands["at"], kind="stable")]
        stretch = commands["at"] // STRETCH
        for part in np.split(commands, np.flatnonzero(np.diff(stretch)) + 1):
            at, first = int(part["at"][0]) // STRETCH, int(part["at"][0])
            pieces, least = self.stretches.getValue((at,)) if self.stretches.containsKey((at,)) else (0, first)
            self.ahead.updateValue((at, pieces), (part.tobytes(),))
            self.stretches.updateValue((at,), (pieces + 1, min(first, least)))

    def _advance(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        """The stretches that the watermark has reached, one at a time; what is left of the last one stays."""
        ahead = sorted(int(s[0]) for s in self.stretches.keys())
        due = [s for s in ahead if s * STRETCH <= watermark]
        if due:
            held = [tuple(j) for j in self.held.get()]
            names = list(_ORDER)
            for stretch in due:
                pieces = int(self.stretches.getValue((stretch,))[0])
                commands = np.concatenate([np.frombuffer(bytes(self.ahead.getValue((stretch, p))[0]), _KEPT) for p in range(pieces)])
                for p in range(pieces):
                    self.ahead.removeKey((stretch, p))
                self.stretches.removeKey((stretch,))
                left = commands[commands["at"] > watermark]
                if len(left):
                    self._keep(left)
                now = in_order((at, names[command], *rest) for at, command, *rest in commands[commands["at"] <= watermark].tolist())
                done = [(key[0], *o) for o in apply_commands(held, now, self.rules)]
                if done:
                    yield pd.DataFrame(done, columns=["lane", "at", "job", "outcome", "attempts"])
            self.held.put(held) if held else self.held.clear()
        for stretch in ahead:
            if self.stretches.containsKey((stretch,)):
                self.handle.registerTimer(int(self.stretches.getValue((stretch,))[1]))
                break

    def close(self) -> None:
        pass


def queue_stream(commands: DataFrame, time: str, late: str = "1 hour", rules: QueueRules = QueueRules()) -> DataFrame:  # noqa: B008
    """The outcomes of a stream of ``lane, command, job, tier, attempts, amount`` with an event time; nulls there are no commands.

    The session must keep state in RocksDB: ``spark.sql.streaming.stateStore.providerClass``. Commands later than
    ``late`` behind the newest are dropped; the last stretch before the watermark waits for later rows.
    """
    some = F.col(time).isNotNull() & F.col("command").isin(*_ORDER) & F.col("lane").isNotNull()
    x = commands.where(some).withWatermark(time, late).select("lane", time, F.unix_millis(time).alias("at"), "command", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("job", "long"), ("tier", "int"), ("attempts", "int"), ("amount", "int"))])
    return x.groupBy("lane").transformWithStateInPandas(_Lane(rules), OUTCOMES, "append", "eventTime")


def queue_table(commands: DataFrame, time: str, until: int | None = None, rules: QueueRules = QueueRules()) -> DataFrame:  # noqa: B008
    """The same outcomes over a table, of the commands up to a time in milliseconds. A lane's rows stream in order through a task that holds its jobs only."""
    at = F.unix_millis(F.col(time).cast("timestamp"))
    some = F.col(time).isNotNull() & F.col("command").isin(*_ORDER) & F.col("lane").isNotNull()
    x = commands.where(some).select("lane", at.alias("at"), "command", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("job", "long"), ("tier", "int"), ("attempts", "int"), ("amount", "int"))])
    x = x.where(F.col("at") <= until) if until is not None else x
    order = F.element_at(F.create_map(*[F.lit(v) for pair in _ORDER.items() for v in pair]), F.col("command"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, held = None, []
        for frame in frames:
            out = []
            for now, *command in frame.itertuples(index=False):
                if now != lane:
                    lane, held = now, []
                out += [(lane, *o) for o in apply_commands(held, [tuple(command)], rules)]
            yield pd.DataFrame(out, columns=["lane", "at", "job", "outcome", "attempts"])

    return x.repartition("lane").withColumn("o", order).sortWithinPartitions("lane", "at", "o", "job").drop("o").mapInPandas(run, OUTCOMES)
