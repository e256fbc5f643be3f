"""Tables in versions: several are changed together by one commit, and a batch that comes again changes nothing.

A table lies in buckets by the hash of its key; a change rewrites the buckets that it touches, and a version is the list
of bucket folders of every table. The version's manifest is put in place by a rename that never replaces, after all data
is written: readers see all of a commit or none, of two writers one succeeds, and a lost executor or driver leaves only
files that no manifest names. The manifest also holds the last batch of each writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionedTables:
    """The tables below a folder of a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        folder = self._at("versions")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds, by default the last; before the first there is nothing."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "batches": {}}
        text = self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        held, final = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{manifest['version']}")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(held, final, none)
        except Exception as e:
            self._fs.delete(held, False)
            raise RuntimeError(f"version {manifest['version']} is there already; another writer was first") from e

    def create(self, name: str, schema: StructType | str, keys: list[str], sequence: list[str], buckets: int = 16) -> None:
        """An empty table; of several rows of a key the one with the greatest ``sequence`` stays, also across commits."""
        now = self.manifest()
        if name in now["tables"]:
            raise ValueError(f"there is a table {name!r} already")
        ddl = self.spark.createDataFrame([], schema).schema.json()
        now["tables"][name] = {"schema": ddl, "keys": keys, "sequence": sequence, "buckets": buckets, "folders": {}}
        self._commit({**now, "version": now["version"] + 1})

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["tables"][name])

    def _rows(self, table: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(table["schema"]))
        folders = sorted({f for b, f in table["folders"].items() if only is None or b in only})
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, writer: str, batch: int, changes: dict[str, DataFrame]) -> int:
        """Applies the changes of all tables in one commit, and returns the version then current.

        A batch that the writer has committed already, or one before it, changes nothing. Null sequences go before all
        others; rows of equal sequence are taken as their columns go. Columns that the changes lack are null.
        """
        now = self.manifest()
        if now["batches"].get(writer, -1) >= batch:
            return now["version"]
        for name, rows in changes.items():
            now["tables"][name] = self._merged(now["tables"][name], name, rows)
        self._commit({**now, "version": now["version"] + 1, "batches": {**now["batches"], writer: batch}})
        return now["version"] + 1

    def _merged(self, table: dict, name: str, rows: DataFrame) -> dict:
        schema = StructType.fromJson(json.loads(table["schema"]))
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        bucket = F.pmod(F.xxhash64(*table["keys"]), F.lit(table["buckets"])).cast("int")
        others = [f.name for f in schema if f.name not in table["keys"] + table["sequence"]]
        order = F.struct(*table["sequence"], *others)
        # The changes are combined before they meet the table, and written first, so that they are made once.
        folder = f"data/{name}-{uuid.uuid4().hex}"
        best = lambda df: df.groupBy(*table["keys"]).agg(F.max(order).alias("__best")).select(*[F.col(c) if c in table["keys"] else F.col(f"__best.{c}") for c in schema.names])
        best(rows).withColumn("__bucket", bucket).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}-new")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(f"{folder}-new"))]
        touched = {n.removeprefix("__bucket=") for n in names if n.startswith("__bucket=")}
        if not touched:
            return table
        new = self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}-new/__bucket={b}" for b in sorted(touched)])
        best(self._rows(table, touched).unionByName(new)).withColumn("__bucket", bucket).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        self._fs.delete(self._at(f"{folder}-new"), True)
        return {**table, "folders": {**table["folders"], **{b: f"{folder}/__bucket={b}" for b in touched}}}

    def sink(self, writer: str, changes: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: a micro-batch's changes of all tables as one commit under its number."""
        return lambda batch, number: self.upsert(writer, number, changes(batch)) and None

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the last versions names, and older manifests; returns how many folders went."""
        known = self.versions()
        live = {f.split("/")[1] for v in known[-keep:] for t in self.manifest(v)["tables"].values() for f in t["folders"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._at(f"versions/{v}"), False)
        folder = self._at("data")
        gone = [f.getPath() for f in self._fs.listStatus(folder) if f.getPath().getName() not in live] if self._fs.exists(folder) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
