"""Shared folder, materialised tables and small helpers of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that has none gets a temporary folder; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folder of the innermost open ``scratch_scope``.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, within the open scope if there is one."""
    return f"{_SCOPE.get() or shared_dir(spark) + '/scratch'}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are removed at the end; what is read from them must be done by then."""
    path = scratch_path(spark, "scope")
    outer = _SCOPE.set(path)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        remove_path(spark, path)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts lineage, survives lost executors.

    The files stay until the scope ends or ``remove_scratch`` is called, since a returned DataFrame may be evaluated
    at any later time.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver look for shuffles that nothing refers to any longer, so that executors delete their files now."""
    spark._jvm.System.gc()


def remove_scratch(spark: SparkSession) -> None:
    """Delete every table that ``materialise`` has left; results not yet evaluated become unreadable."""
    remove_path(spark, f"{shared_dir(spark)}/scratch")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns under internal names, so that further columns of the input cannot clash with ours."""
    return df.select(*[F.col(f"`{source}`").alias(alias) for alias, source in columns.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """Running values of an associative operation with neutral element 0 over an array of ints.

    Arrays grow by copying, so blocks are folded on their own and then moved by what the blocks before them come to.
    """
    fold = lambda part: F.aggregate(part, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(combine(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)), x))))

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: fold(F.slice(v, b * block + 1, block)))
        moved = lambda bs: let(fold(F.transform(bs, lambda x: F.get(x, F.size(x) - 1))), lambda upto: F.flatten(F.transform(bs, lambda x, i: F.transform(x, lambda y: combine(F.coalesce(F.get(upto, i - 1), F.lit(0)), y)))))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(let(blocks, moved))

    return let(values, of)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: What a Python worker keeps between tasks, under the key it was asked for with.
_KEPT: dict[tuple, object] = {}


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps between tasks, so that a table of words filled by one task serves the next.

    A worker keeps one such object, the last one asked for; a new worker starts with none. Results never depend on it.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    """Frees what ``kept_in_worker`` holds; called by operators that need the memory for other things."""
    _KEPT.clear()
