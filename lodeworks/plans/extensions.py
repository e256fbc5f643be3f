"""Extension surface: a registry of named functions, and injectable models with deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import derivation as D
from lodeworks.operators.vectors import hashed_embedding

from .views import table


@dataclass
class Registry:
    """Named column functions; ``install`` makes Python ones callable from SQL."""

    columns: dict[str, Callable[..., Column]] = field(default_factory=dict)
    python: dict[str, tuple[Callable, str]] = field(default_factory=dict)

    def column(self, name: str):
        def add(f: Callable[..., Column]) -> Callable[..., Column]:
            if name in self.columns or name in self.python:
                raise ValueError(f"{name} is registered already")
            self.columns[name] = f
            return f

        return add

    def function(self, name: str, returns: str):
        def add(f: Callable) -> Callable:
            if name in self.columns or name in self.python:
                raise ValueError(f"{name} is registered already")
            self.python[name] = (f, returns)
            return f

        return add

    def call(self, name: str, *args: Column) -> Column:
        return self.columns[name](*args)

    def install(self, spark: SparkSession) -> None:
        for name, (f, returns) in self.python.items():
            spark.udf.register(name, f, returns)


@dataclass(frozen=True)
class Models:
    """What the reference asks of external models, as functions that callers may replace."""

    embed: Callable[[Column], Column] = hashed_embedding
    complete: Callable[[str, str], str] = lambda task, prompt: f"{task}: {len(prompt)}"
    judge_contradiction: Callable[[str, str], bool] = lambda a, b: False


def completed(rows: DataFrame, key: str, task: str, prompt: str, models: Models, retries: int = 2, accepts: Callable[[str], bool] = bool) -> DataFrame:
    """``key, answer``: the injected model's answer to each prompt under its task, asked again where a guard refuses it.

    Batches go to the tasks' Python workers; what no attempt brings to acceptance is null, as is a null prompt's answer.
    """

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for name, text in zip(frame["task"], frame["prompt"], strict=True):
                tries = (models.complete(name, text) for _ in range(1 + retries)) if text is not None else ()
                answers.append(next((a for a in tries if accepts(a)), None))
            yield pd.DataFrame({key: frame[key], "answer": answers})

    x = rows.select(key, F.col(task).alias("task"), F.col(prompt).alias("prompt"))
    return x.mapInPandas(answer, f"{key} {rows.schema[key].dataType.simpleString()}, answer string")


def run_workers(pages: DataFrame, key: str, fetch: Callable[[DataFrame], DataFrame], distil: Callable[[DataFrame], DataFrame], extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ingestion workers as functions of tables that callers plug in: fetch, distil, extract; rows without a key go."""
    return extract(distil(fetch(pages.where(F.col(key).isNotNull()))))


QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT event_id, event_id * 2 AS doubled, length(event_type) AS size FROM events")
def ext_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A tool registered as a function of SQL, and one as a column function."""
    tools = Registry()
    tools.function("lodeworks_doubled", "long")(lambda x: 2 * x)
    tools.column("size")(F.length)
    tools.install(spark)
    return table(spark, sf, "events").select("event_id", F.expr("lodeworks_doubled(event_id)").alias("doubled"), tools.call("size", F.col("event_type")).alias("size"))


@query("SELECT conv_id * 1000 + turn AS key, CASE WHEN length(text) % 3 <> 0 THEN role || ': ' || length(text) END AS answer FROM conversations")
def ext_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of an injected model, routed by task and guarded: those whose length is a multiple of three are refused."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "role", "text")
    return completed(turns, "key", "role", "text", Models(), accepts=lambda a: int(a.rsplit(" ", 1)[1]) % 3 != 0)


@query("SELECT doc_id, length(text) AS size, len(string_split(text, ' ')) AS words FROM documents WHERE text IS NOT NULL AND length(text) > 100")
def ext_workers(spark: SparkSession, sf: str) -> DataFrame:
    fetch = lambda x: x.where("text IS NOT NULL")
    distil = lambda x: x.withColumn("size", F.length("text")).where("size > 100")
    extract = lambda x: x.select("doc_id", "size", F.size(F.split("text", " ")).alias("words"))
    return run_workers(table(spark, sf, "documents"), "doc_id", fetch, distil, extract)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS mass FROM embeddings WHERE embedding IS NOT NULL")
def ext_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """An injected embedding in place of the default: that of the table."""
    models = Models(embed=lambda c: c.cast("array<double>"))
    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", models.embed(F.col("embedding")).alias("e"))
    return e.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("mass"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 3.5 ELSE value END AS value FROM events WHERE event_id % 2 = 0 OR value IS NOT NULL")
def ext_derivation_config(spark: SparkSession, sf: str) -> DataFrame:
    """A configuration in which a number in the text goes before a stored one."""
    config = D.DerivationConfig(from_metadata=False)
    text = F.when(F.col("event_id") % 2 == 0, "about 3.5 of it").otherwise("no number")
    return table(spark, sf, "events").select("event_id", D.numeric_value(F.col("value"), text, config).alias("value")).where("value IS NOT NULL")
