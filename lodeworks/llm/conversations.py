"""Repair of conversation structure at least cost, by a weighted automaton that is determinised lazily.

A conversation's rows, in order of turn, become symbols: the role's initial and the row's fault. What it costs to repair
the rest of a conversation from each of four grammar states is a vector; with its minimum taken off it is a state of the
determinised automaton, and a table remembers the next state and the weight for each symbol as they are first met. A
scan from the last row to the first by that table gives the costs; the trace goes the other way along tight arcs and
takes the least edit each time, which gives the least audit of all cheapest ones.

Rows are dealt by ranges of conversation and turn, so one conversation may lie over any number of tasks. Each task's part
of a conversation is a segment. Where a conversation has several, segments are (min, +) matrices, of which only the
product of those to the right enters a segment's scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, named, shuffle_width

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
_NONE = 1 << 40

#: Grammar states: nothing yet, after system, after user, after assistant; what may come next, and after what it is.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
#: Cost and edits of ending in a state: a conversation is empty or ends with an assistant.
_FINAL = (0, 6, 3, 0)
_TAIL = ("", "II", "I", "")

#: A symbol is an initial in the case or sign of its fault; x is any other initial.
_INITIALS, _FAULTS = "suax", ("none", "truncated", "blank", "duplicate")
_SYMBOLS = "suaxSUAX0123456789"
_LEGAL = {"su", "ua", "au"}

_WHITE = " \t\n\x0b\x0c\r"


def _initial(symbol: int) -> str:
    return _INITIALS[symbol % 4]


class Repairs:
    """The determinised automaton, as far as it has been needed."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int, int]] = {}

    def state(self, vector: Iterable[int]) -> tuple[int, int]:
        """The state of a cost vector, and its minimum."""
        vector = tuple(vector)
        least = min(vector)
        vector = tuple(x - least if x < _NONE else _NONE for x in vector)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def _before(self, after: tuple[int, ...], symbol: int) -> list[int]:
        """Costs before a row, from those after it; insertions before the row are included."""
        fault, cost = symbol // 4, [min(_NONE, DELETE + x) for x in after]
        if fault < 2:
            extra = TRUNCATED if fault else 0
            for q in range(4):
                cost[q] = min(cost[q], REROLE + extra + after[_NEXT[q]])
                if (q, _initial(symbol)) in _KEPT:
                    cost[q] = min(cost[q], extra + after[_KEPT[q, _initial(symbol)]])
        user, assistant = cost[_USER], cost[_ASSISTANT]
        cost[_USER], cost[_ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
        return [min(c, INSERT + cost[_NEXT[q]], _NONE) for q, c in enumerate(cost)]

    def step(self, after: int, symbol: int) -> tuple[int, int]:
        """The state before a row and the weight of the transition."""
        key = (after, symbol)
        if key not in self.table:
            self.table[key] = self.state(self._before(self.vectors[after], symbol))
        return self.table[key]

    def arc(self, after: int, symbol: int, q: int) -> tuple[str, int, int]:
        """The edits of a row and of what is inserted before it on the least of the cheapest ways, the state then, the cost."""
        key = (after, symbol, q)
        if key not in self.arcs:
            right = self.vectors[after]
            left, edits, paid = self._before(right, symbol), "", 0
            fault, extra = symbol // 4, TRUNCATED if symbol // 4 else 0
            while True:
                kept = _KEPT.get((q, _initial(symbol)))
                if left[q] == DELETE + right[q]:
                    edits, paid = edits + "D", paid + DELETE
                elif left[q] == INSERT + left[_NEXT[q]]:
                    edits, paid, q = edits + "I", paid + INSERT, _NEXT[q]
                    continue
                elif fault < 2 and kept is not None and left[q] == extra + right[kept]:
                    edits, paid, q = edits + "K", paid + extra, kept
                else:
                    edits, paid, q = edits + "R", paid + REROLE + extra, _NEXT[q]
                break
            self.arcs[key] = edits, q, paid
        return self.arcs[key]

    def scan(self, symbols: list[int], right: Iterable[int]) -> tuple[list[int], list[int]]:
        """The state after each row, and the costs before the first one."""
        (now, total), after = self.state(right), []
        for s in reversed(symbols):
            after.append(now)
            now, weight = self.step(now, s)
            total += weight
        return after[::-1], [min(_NONE, x + total) for x in self.vectors[now]]

    def matrix(self, symbols: list[int]) -> list[int]:
        """Costs from each state before the rows to each state after them, row by row."""
        columns = [self.scan(symbols, [0 if p == q else _NONE for p in range(4)])[1] for q in range(4)]
        return [columns[q][p] for p in range(4) for q in range(4)]

    def trace(self, symbols: list[int], after: list[int], q: int) -> tuple[str, int, int]:
        edits, paid = [], 0
        for s, state in zip(symbols, after, strict=True):
            piece, q, cost = self.arc(state, s, q)
            edits.append(piece)
            paid += cost
        return "".join(edits), q, paid


def _codes(symbols: str) -> list[int]:
    return [ord(c) - 65 for c in symbols]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` after damage by a hash of conversation and turn; null roles and texts become one space."""
    x = named(rows, conv=conv, turn=turn, role=role, text=text)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = x.select("conv", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv"), F.lit(":"), part("turn"))) % 20).alias("act")).where("act <> 0")
    x = x.withColumn("text", F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("act") == 4, "user").otherwise(F.col("role")))
    return x.withColumn("copy", F.explode(F.when(F.col("act") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv", "turn", "role", "text")


def _ordered(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows in order of conversation and turn over ranges, numbered in that order, with a digest of conversation, role and text."""
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    body = F.unhex(F.sha2(F.concat(F.coalesce(sized(F.col("conv").cast("string")), F.lit("-")), sized(F.col("role")), F.col("text")), 256))
    x = rows.withColumn("body", body).repartitionByRange(partitions, "conv", "turn", "role", "body").sortWithinPartitions("conv", "turn", "role", "body")
    return materialise(x.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "*"), "turns")


def _segments(turns: DataFrame) -> DataFrame:
    """``part, conv``, the symbols of a segment and its turns. The repeats of a text are found by groups of digests, combined before they are shuffled."""
    repeats = turns.groupBy("body").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = turns.select("at", "body").join(repeats, "body").where("at > first").select(F.col("at").alias("again"))
    end = F.right(F.rtrim(F.col("text"), F.lit(_WHITE)), F.lit(1))
    initial = F.position(F.substring("role", 1, 1), F.lit(_INITIALS[:3]))
    flagged = turns.select("part", "at", "conv", "turn", F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1).alias("initial"), end.alias("end")).join(later, F.col("at") == F.col("again"), "left")
    fault = F.when(F.col("end") == "", 2).when(F.col("again").isNotNull(), 3).when(~F.col("end").isin(".", "!", "?"), 1).otherwise(0)
    symbol = F.chr(F.lit(65) + fault * 4 + F.col("initial"))
    one = F.struct("at", symbol.alias("s"))
    return flagged.groupBy("part", "conv").agg(
        F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), "").alias("symbols"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
    )


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv"].eqNullSafe(b["conv__"]) & (a["part"] == b["part__"])


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"conv": "conv__", "part": "part__"})


def _borders(segments: DataFrame) -> DataFrame:
    """``conv__, part__, costs, starts`` of the segments of conversations with several: at most two a task, so few enough to broadcast.

    ``costs`` are those after the segment.
    """
    kind = _kind(segments, "conv")
    split = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("conv__"))
    own = segments.join(F.broadcast(split), segments["conv"].eqNullSafe(split["conv__"]), "left_semi").select("conv", "part", "symbols")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs = Repairs()
        for b in batches:
            found = [repairs.matrix(_codes(s)) for s in b.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "part", "matrix"])

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part", ascending=False)
        costs, out = list(_FINAL), []
        for m in frame["matrix"]:
            out.append(costs)
            costs = [min(_NONE, *(int(m[4 * p + q]) + costs[q] for q in range(4))) for p in range(4)]
            costs = [c - min(costs) for c in costs]
        return pd.DataFrame({"conv": frame["conv"], "part": frame["part"], "costs": out})

    return _keyed(own.mapInArrow(weigh, f"conv {kind}, part int, matrix array<bigint>").groupBy("conv").applyInPandas(compose, f"conv {kind}, part int, costs array<bigint>"))


def _traced(segments: DataFrame) -> DataFrame:
    """Each segment's edits, end state and cost for the states it may start in: all four where its conversation has several segments, else the first."""
    borders, columns = materialise(_borders(segments), "borders"), segments.columns
    joined = segments.join(F.broadcast(borders), _same(segments, borders), "left").drop("conv__", "part__")
    last = joined.withColumn("last", F.col("costs").isNull() | (F.col("costs") == F.array(*[F.lit(x).cast("long") for x in _FINAL])))
    schema = ", ".join(f"{c} {_kind(segments, c)}" for c in columns) + ", edits array<string>, ends array<int>, paid array<bigint>, blank bigint, duplicate bigint, truncated bigint, inside bigint"

    def trace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs = Repairs()
        for b in batches:
            rows = []
            for symbols, costs in zip(b.column("symbols").to_pylist(), b.column("costs").to_pylist(), strict=True):
                codes = _codes(symbols)
                after, _ = repairs.scan(codes, costs or _FINAL)
                ways = [repairs.trace(codes, after, q) for q in (range(4) if costs else (_START,))]
                faults = [c // 4 for c in codes]
                inside = sum(_initial(a) + _initial(b) not in _LEGAL for a, b in zip(codes, codes[1:], strict=False))
                rows.append(([w[0] for w in ways], [w[1] for w in ways], [w[2] for w in ways], faults.count(2), faults.count(3), faults.count(1), inside))
            found = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *[pa.array(list(x), k) for x, k in zip(found, kinds, strict=True)]], names=[*columns, "edits", "ends", "paid", "blank", "duplicate", "truncated", "inside"])

    traced = materialise(last.drop("last").mapInArrow(trace, schema), "traced")

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame, q, out = frame.sort_values("part"), _START, []
        for ends in frame["ends"]:
            out.append(q)
            q = int(ends[q])
        return pd.DataFrame({"conv": frame["conv"], "part": frame["part"], "start": out, "final": frame["part"] == frame["part"].max()})

    kind = _kind(segments, "conv")
    starts = _keyed(traced.where(F.size("ends") > 1).select("conv", "part", "ends").groupBy("conv").applyInPandas(chain, f"conv {kind}, part int, start int, final boolean"))
    x = traced.join(F.broadcast(starts), _same(traced, starts), "left").drop("conv__", "part__")
    start, final = F.coalesce("start", F.lit(_START)), F.coalesce("final", F.lit(True))
    pick = lambda c: F.get(c, F.col("start"))
    x = x.withColumn("start", start).withColumn("final", final)
    tail = lambda values: F.when(F.col("final"), F.element_at(F.array(*[F.lit(v) for v in values]), pick("ends") + 1)).otherwise(F.lit("" if isinstance(values[0], str) else 0))
    return x.select("conv", "part", "at", "symbols", "low", "high", "turns", "start", F.concat(pick("edits"), tail(_TAIL)).alias("edits"), (pick("paid") + tail(_FINAL)).alias("paid"), "blank", "duplicate", "truncated", "inside")


def _edits(pieces: DataFrame) -> DataFrame:
    """``conv, part, pos, at, edit, role`` of what stays: role null where it is kept, at null where the row is inserted."""

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, q, codes, edits = (b.column(c)[i].as_py() for c in ("at", "start", "symbols", "edits"))
                codes, k, rows = _codes(codes), 0, []
                for pos, e in enumerate(edits):
                    if e == "K":
                        q = _KEPT[q, _initial(codes[k])]
                        rows.append((pos, at + k, e, None))
                    elif e in "IR":
                        q = _NEXT[q]
                        rows.append((pos, None if e == "I" else at + k, e, _ROLE[q]))
                    k += e != "I"
                n = len(rows)
                pos, own, edit, role = zip(*rows, strict=True) if rows else ((),) * 4
                same = lambda c, b=b, i=i, n=n: b.column(c).take(pa.array([i] * n, pa.int64()))
                yield pa.RecordBatch.from_arrays([same("conv"), same("part"), pa.array(pos, pa.int64()), pa.array(own, pa.int64()), pa.array(edit, pa.string()), pa.array(role, pa.string())], names=["conv", "part", "pos", "at", "edit", "role"])

    return pieces.mapInArrow(expand, f"conv {_kind(pieces, 'conv')}, part int, pos bigint, at bigint, edit string, role string")


def repair_conversations(rows: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The repair of ``rows(conv, turn, role, text)``: a summary by conversation, and the repaired rows.

    The summary has ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``. Repaired rows are
    ``conv, part, pos, role, text, edit``, in order of ``part`` and ``pos`` within a conversation; deleted rows are not
    among them. Rows are taken by turn, nulls first; rows of one turn by role, then by a digest, so that equal ones are
    neighbours. A null conversation is one of its own; null roles and texts count as one space, and a role with another
    initial than s, u or a fits nowhere. An empty table gives two empty ones.
    """
    rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    turns = _ordered(rows, partitions or shuffle_width(rows.sparkSession))
    pieces = materialise(_traced(materialise(_segments(turns), "segments")), "pieces")
    # Only the first and last symbols and turns of a segment matter to its neighbours.
    ends = F.array_sort(F.collect_list(F.struct("part", F.substring("symbols", 1, 1).alias("a"), F.substring("symbols", -1, 1).alias("b"), "low", "high", "edits")))
    initial = lambda s: F.substring(F.lit(_INITIALS), (F.ascii(s) - 65) % 4 + 1, F.lit(1))
    by = pieces.groupBy("conv").agg(ends.alias("p"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "inside", "turns", "paid")], F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    count = lambda test: F.size(F.filter(pairs, test)).cast("long")
    across = count(lambda e: ~F.concat(initial(e["x"]["b"]), initial(e["y"]["a"])).isin(*_LEGAL))
    shared = count(lambda e: e["x"]["high"] == e["y"]["low"])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - shared), F.lit(0)).cast("long")
    audit = F.array_join(F.transform("p", lambda x: x["edits"]), "")
    summary = by.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("inside") + across).alias("illegal"), F.col("paid").alias("cost"), audit.alias("audit"))
    edits = _edits(pieces)
    texts = turns.select(F.col("at").alias("own"), F.col("role").alias("had"), "text")
    repaired = edits.join(texts, edits["at"] == texts["own"], "left").select("conv", "part", "pos", F.coalesce("role", "had").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
    return summary, repaired


def _digests(repaired: DataFrame) -> DataFrame:
    """``conv__, sha`` over ``role:text`` by line; rows stream in order, so that no conversation is held."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, kind = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([now.hexdigest()])], names=["conv__", "sha"])
        for b in batches:
            kind = b.schema.field("conv").type
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        yield done()
                    now, key = hashlib.sha256(), conv
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
        if now is not None:
            yield done()

    x = repaired.repartition("conv").sortWithinPartitions("conv", "part", "pos").select("conv", "role", "text")
    return x.mapInArrow(digest, f"conv__ {_kind(repaired, 'conv')}, sha string")


def repair_digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Damages the table and repairs it: one row for every original conversation, also where no row is left."""
    summary, repaired = repair_conversations(damaged(rows, conv, turn, role, text), partitions)
    every = named(rows, id=conv).distinct()
    summary, digests = materialise(summary, "summary"), _digests(repaired)
    joined = every.join(summary, F.col("id").eqNullSafe(summary["conv"]), "left").join(digests, F.col("id").eqNullSafe(digests["conv__"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
