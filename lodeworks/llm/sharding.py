"""Sharding by size-tiered compaction under a versioned manifest."""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUNS_PER_JOB = 64


class ShardStore:
    """Immutable Parquet shards in tiers by size, listed by versioned manifests.

    ``append`` writes arrivals as small shards of their own; ``compact`` merges runs of similarly sized shards until
    they reach the target size. Both write new files first and then commit the next manifest by renaming it to a
    name that must not exist yet, so readers see one version or the next and a writer that lost a race fails and may
    try again. Shards are never changed; files that no manifest lists (of failed attempts) are ignored.

    All access goes through Spark and the Hadoop file system of the path. A manifest holds one entry per shard; its
    size is the number of shards, not of rows.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, text_col: str = "text"):
        self.spark, self.path, self.target, self.fan_in, self.text_col = spark, path.rstrip("/"), target_bytes, fan_in, text_col
        self.jvm = spark._jvm
        self.fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, path: str) -> list[tuple[str, int]]:
        if not self.fs.exists(self._hadoop(path)):
            return []
        return [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._hadoop(path))]

    def versions(self) -> list[int]:
        return sorted(int(name[1:-5]) for name, _ in self._list(f"{self.path}/manifests") if name.startswith("v") and name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The entries of a version, the latest by default; version 0 is the empty store."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._hadoop(f"{self.path}/manifests/v{version:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], schema: str | None) -> int:
        version = base["version"] + 1
        final, held = self._hadoop(f"{self.path}/manifests/v{version:08d}.json"), self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(held, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": shards}).encode()))
        out.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        option = getattr(hadoop, "Options$Rename")
        try:
            # Unlike FileSystem.rename this never replaces a file that is there.
            hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(held, final, self.spark.sparkContext._gateway.new_array(option, 0))
        except Exception as e:
            self.fs.delete(held, False)
            raise RuntimeError(f"version {version} could not be committed; another writer may have been first") from e
        return version

    def _written(self, folder: str) -> list[dict]:
        return [{"file": f"{folder}/{name}", "bytes": size} for name, size in self._list(f"{self.path}/{folder}") if name.startswith("part-")]

    def _write(self, df: DataFrame) -> list[dict]:
        """Writes new shards below a folder of their own and lists them; the first task's may be empty and is left out then."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        first = f"{folder}/part-00000-"
        return [s for s in self._written(folder) if not (s["file"].startswith(first) and self.read_files([s], df.schema.json()).isEmpty())]

    def read_files(self, shards: list[dict], schema: str | None, spark: SparkSession | None = None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        spark = spark or self.spark
        if not shards:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).parquet(*[f"{self.path}/{s['file']}" for s in shards])

    def append(self, arrivals: DataFrame) -> int:
        """Commits arrivals as small shards, one per task that reads them. No rows: a version without new shards."""
        base = self.manifest()
        schema = base["schema"] or arrivals.schema.json()
        return self._commit(base, base["shards"] + self._write(arrivals), schema)

    def append_parts(self, rows: DataFrame, part: Column, parts: int) -> int:
        """Appends ``parts`` arrivals, told apart by a number from 0, in one pass over the rows; a version for each."""
        mark, folder = f"_part_{uuid.uuid4().hex}", f"data/{uuid.uuid4().hex}"
        rows.withColumn(mark, part).write.option("compression", "zstd").partitionBy(mark).parquet(f"{self.path}/{folder}")
        version = self.manifest()["version"]
        for k in range(parts):
            base = self.manifest()
            version = self._commit(base, base["shards"] + self._written(f"{folder}/{mark}={k}"), base["schema"] or rows.schema.json())
        return version

    def tier(self, size: int) -> int:
        """0 for shards of the target size; one more for each factor of ``fan_in`` below it."""
        return max(0, math.ceil(math.log(self.target / max(size, 1), self.fan_in) - 0.5))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs of similarly sized shards, each of one tier: smallest first, until they add up to about the target."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs = []
        for tier, members in sorted(tiers.items(), reverse=True):
            if tier == 0 or len(members) < self.fan_in:
                continue
            run: list[dict] = []
            for s in sorted(members, key=lambda x: (x["bytes"], x["file"])):
                run.append(s)
                if len(run) > 1 and sum(x["bytes"] for x in run) >= self.target:
                    runs.append(run)
                    run = []
            if len(run) >= self.fan_in:
                runs.append(run)
        return runs

    def compact(self) -> int:
        """Merges runs until no tier holds one, committing a version per round.

        Every run becomes one new shard, written by one task that reads the run's shards alone; nothing is shuffled.
        ``RUNS_PER_JOB`` runs make one Spark job. Each round leaves fewer shards.
        """
        # Runs must stay partitions of their own; their union would otherwise be taken for one single partition.
        session = self.spark.newSession()
        session.conf.set("spark.sql.unionOutputPartitioning", "false")
        while True:
            base = self.manifest()
            runs = self.plan(base["shards"])
            if not runs:
                return base["version"]
            gone = {s["file"] for run in runs for s in run}
            new = []
            for at in range(0, len(runs), RUNS_PER_JOB):
                merged = [self.read_files(run, base["schema"], session).coalesce(1) for run in runs[at : at + RUNS_PER_JOB]]
                new += self._write(reduce(DataFrame.union, merged))
            self._commit(base, [s for s in base["shards"] if s["file"] not in gone] + new, base["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("the store is empty and has no schema yet")
        return self.read_files(found["shards"], found["schema"])

    def read_with_shards(self, version: int | None = None) -> DataFrame:
        """All rows of a version with ``_shard``, the file that holds them."""
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        return self.read(version).withColumn("_shard", name)


def shard_documents(docs: DataFrame, path: str, arrivals: int = 8, target_bytes: int = 128 << 20, fan_in: int = 4) -> ShardStore:
    """Shards a table that arrives in ``arrivals`` parts: the parts are appended and the store compacted at the end.

    With at least twice ``fan_in`` arrivals there are runs of one tier at any size of the table, so compaction merges.
    Every row goes to one part by a hash of all its columns; nulls and repeated rows are kept as they are. An empty
    table gives a store with a schema and no rows.
    """
    store = ShardStore(docs.sparkSession, path, target_bytes, fan_in)
    store.append_parts(docs, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(arrivals)), arrivals)
    store.compact()
    return store
