"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import forget_kept, materialise, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST_DIGIT = 64
WIDEN = 4
MOST_BYTES = 32 << 20
LEAST_BYTES = 64 << 10

_CLASS = "rep_key long, keep_id long, keep_key long, group_size long"


def radix_classes(texts: list[bytes], start: int = 0) -> list[int]:
    """For each text the index of the first text equal to it.

    Splits by successive byte digits until a group is a singleton or its texts have ended. Digits widen as the
    recursion goes deeper, which changes the number of passes only.
    """
    first = list(range(len(texts)))
    todo = [(first[:], start, 8)]
    while todo:
        members, at, width = todo.pop()
        buckets: dict[bytes, list[int]] = {}
        for i in members:
            buckets.setdefault(texts[i][at : at + width], []).append(i)
        for digit, group in buckets.items():
            if len(group) == 1:
                continue
            if len(digit) < width:
                for i in group:
                    first[i] = group[0]
            else:
                todo.append((group, at + width, min(width * 2, 4096)))
    return first


def _rank(doc: int | None, key: int) -> tuple:
    return (doc is not None, doc or 0, key)


def _combine(batches: Iterable[pa.RecordBatch], with_body: bool) -> Iterator[pa.RecordBatch]:
    """Map-side combine: of each class of equal texts of a batch the best row stands for the others.

    Columns in: id, text and whatever is carried. Only representatives keep their text and carried columns; the
    normalised text is left out where the text is carried anyway.
    """
    forget_kept()
    base = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
        keys = [base + i for i in range(len(ids))]
        base += len(ids)
        members: dict[int, list[int]] = {}
        for i, f in enumerate(radix_classes(texts)):
            members.setdefault(f, []).append(i)
        rep, size, digest = [0] * len(ids), [None] * len(ids), [""] * len(ids)
        for group in members.values():
            best = max(group, key=lambda i: _rank(ids[i], keys[i]))
            size[best] = len(group)
            name = hashlib.sha256(texts[best]).hexdigest()
            for i in group:
                rep[i], digest[i] = keys[best], name
        stands = pa.array([n is not None for n in size])
        kept = [pc.if_else(stands, c, pa.scalar(None, c.type)) for c in batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()), pa.array(rep, pa.int64()), pa.array(ids, pa.int64()), pa.array(size, pa.int64()),
                pa.array([t if with_body and n is not None else None for t, n in zip(texts, size, strict=True)], pa.binary()), pa.array(digest, pa.string()), *kept,
            ],
            names=["row_key", "rep_key", "id", "n", "body", "sha", *batch.schema.names[2:]],
        )


def _finisher(start: int):
    """Finishes groups that share ``start`` bytes; rows arrive sorted by prefix, one group is held at a time."""

    def close(rows: list[tuple]) -> pa.RecordBatch:
        first = radix_classes([r[4] for r in rows], start) if len(rows) > 1 else [0]
        best: dict[int, tuple] = {}
        size: dict[int, int] = {}
        for (_, top_id, top_key, n, _), f in zip(rows, first, strict=True):
            mine = _rank(top_id, top_key)
            best[f] = max(best.get(f, mine), mine)
            size[f] = size.get(f, 0) + n
        return [(r[0], best[f][1] if best[f][0] else None, best[f][2], size[f]) for r, f in zip(rows, first, strict=True)]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep_key", "keep_id", "keep_key", "group_size"])

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        out: list[tuple] = []
        for batch in batches:
            for prefix, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if prefix != at and held:
                    out += close(held)
                    held = []
                at = prefix
                held.append(tuple(row))
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if held:
            out += close(held)
        if out:
            yield batch_of(out)

    return finish


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), first_digit: int = FIRST_DIGIT, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Classes of texts that are identical once A-Z are lower-cased.

    Returns one row per input row: ``id, keep_id, group_size, kept, sha`` and each ``carry`` column as ``<name>__``,
    null on some rows that are not kept. A null text counts as empty; empty texts are one class. Of a class the row with the
    largest id stays; a null id ranks below all others, and between rows with the same id exactly one is kept. An
    empty input gives an empty result. Columns not named are not read.

    Method: equal texts of one batch are combined first, so a hot group shrinks to one row per batch. Representatives
    are then dealt by their leading digit of ``first_digit`` bytes. Groups over a fair share of the data (at most
    ``most_bytes``) are not gathered but split again by the following bytes, until small or ended; small groups are
    finished by byte recursion within one task. No digest takes part in a comparison.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    carried = {c: f"__carry{i}" for i, c in enumerate(carry)}
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(a) for c, a in carried.items()])
    kinds = [StructField(n, k) for n, k in (("row_key", LongType()), ("rep_key", LongType()), ("id", LongType()), ("n", LongType()), ("body", BinaryType()), ("sha", StringType()))]
    schema = StructType([*kinds, *[StructField(f.name, f.dataType) for f in source.schema.fields[2:]]])
    with_body = text_col not in carry
    rows = materialise(source.mapInArrow(lambda batches: _combine(batches, with_body), schema), "radix")
    # Lower-casing A-Z changes no length, so sizes come from the text as it is, and leading digits from its beginning.
    raw = F.col("body") if with_body else F.coalesce(F.col(carried[text_col]).cast("string"), F.lit(""))
    normal = (lambda c: c) if with_body else lambda c: F.encode(F.translate(c, UPPER, LOWER), "UTF-8")
    reps = rows.where("n IS NOT NULL").select("rep_key", F.col("id").alias("top_id"), F.col("row_key").alias("top_key"), "n", raw.alias("raw"))
    done: list[DataFrame] = []
    digit = first_digit
    total = None
    while True:
        level = reps.withColumn("prefix", F.substring(normal(F.substring("raw", 1, digit)), 1, digit))
        sizes = level.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("raw").cast("long")).alias("bytes"))
        if total is None:
            total = reps.agg(F.sum(F.octet_length("raw").cast("long"))).first()[0] or 0
            bound = max(LEAST_BYTES, min(most_bytes, total // (2 * width)))
        # Groups of more than ``bound`` bytes: at most total / bound of them. The planner sees the size of this table
        # and broadcasts it if small; otherwise the join is by key, and a common prefix is a skewed side that it splits.
        big = materialise(sizes.where((F.col("rows") > 1) & (F.col("bytes") > bound)).select("prefix"), "radix-big")
        none_big = big.isEmpty()
        small = level if none_big else level.join(big, "prefix", "left_anti")
        done.append(
            small.select("prefix", "rep_key", "top_id", "top_key", "n", normal(F.col("raw")).alias("body"))
            .repartition(width, "prefix")
            .sortWithinPartitions("prefix")
            .mapInArrow(_finisher(0), _CLASS)
        )
        if none_big:
            break
        large = level.join(big, "prefix", "left_semi")
        ended = large.where(F.octet_length("raw") <= digit).withColumn("body", normal(F.col("raw")))
        best = ended.groupBy("body").agg(F.max(F.struct("top_id", "top_key")).alias("top"), F.sum("n").alias("group_size"))
        done.append(
            ended.select("rep_key", "body").join(best, "body")
            .select("rep_key", F.col("top.top_id").alias("keep_id"), F.col("top.top_key").alias("keep_key"), "group_size")
        )
        reps = large.where(F.octet_length("raw") > digit).select("rep_key", "top_id", "top_key", "n", "raw")
        digit *= WIDEN
    classes = done[0]
    for more in done[1:]:
        classes = classes.unionByName(more)
    found = rows.drop("n", "body").join(classes, "rep_key").withColumn("kept", F.col("row_key") == F.col("keep_key"))
    return found.select("id", "keep_id", "group_size", "kept", "sha", *[F.col(a).alias(f"{c}__") for c, a in carried.items()])
