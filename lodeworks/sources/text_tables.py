"""Tables within texts, as a table function: ``SELECT ... FROM docs, LATERAL tables_in(text, format)``."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import DROP_TAGS, TEXTS, walked

FORMATS = ("markdown", "html", "csv")
SCHEMA = "table_no int, row_no int, headers array<string>, cells array<string>"

_BAR_LINE = re.compile(r"\|.*\|")
_RULE_LINE = re.compile(r"\|[-\s|]*-[-\s|]*\|")


def markdown_tables(text: str) -> Iterator[list[list[str]]]:
    """Runs of lines between bars whose second one is a rule; the rule is left out."""
    run: list[str] = []
    for line in [*text.split("\n"), ""]:
        if _BAR_LINE.match(line):
            run.append(line)
            continue
        # A run may open with lines that head no table.
        for i in range(1, len(run)):
            if _RULE_LINE.match(run[i]):
                yield [[c.strip() for c in x.strip().strip("|").split("|")] for x in (run[i - 1], *run[i + 1 :])]
                break
        run = []


def html_tables(text: str) -> Iterator[list[list[str]]]:
    """Rows of cells of every table element, header cells among them."""
    w = walked(text, DROP_TAGS)
    tables: dict[int, dict[int, dict[int, str]]] = {}
    for e, (tag, _) in w.info.items():
        if tag in ("td", "th"):
            above = {w.info[x][0]: x for x in w.around[e]}
            if "table" in above and "tr" in above:
                tables.setdefault(above["table"], {}).setdefault(above["tr"], {})[e] = ""
    for run, around in w.runs:
        kinds = {w.info[e][0]: e for e in around}
        cell = max(kinds.get("td", 0), kinds.get("th", 0))
        if cell and cell in tables.get(kinds.get("table"), {}).get(kinds.get("tr"), {}):
            tables[kinds["table"]][kinds["tr"]][cell] += run.strip()
    for rows in tables.values():
        yield [list(cells.values()) for cells in rows.values()]


def csv_tables(text: str) -> Iterator[list[list[str]]]:
    """Blocks between blank lines with a comma; cells are split at commas without quoting."""
    for block in re.split(r"\n\s*\n", text):
        lines = [x.strip() for x in block.split("\n") if x.strip()]
        if "," in block and len(lines) > 1:
            yield [[c.strip() for c in x.split(",")] for x in lines]


class TablesIn:
    """Rows of a text's tables that are as wide as their header; null texts and unknown formats have none."""

    KINDS = {"markdown": markdown_tables, "html": html_tables, "csv": csv_tables}

    def eval(self, text: str, format: str) -> Iterator[tuple]:
        number = 0
        for head, *rows in self.KINDS[format](text) if text and format in self.KINDS else ():
            fits = [(i, r) for i, r in enumerate(rows) if len(r) == len(head)]
            yield from ((number, i, head, r) for i, r in fits)
            number += bool(fits)


def register(spark: SparkSession) -> None:
    """Makes ``tables_in(text, format)`` known to SQL."""
    spark.udtf.register("tables_in", F.udtf(TablesIn, returnType=SCHEMA))


def extract_tables(df: DataFrame, key: str, text: str, format: str) -> DataFrame:
    """``key, table_no, row_no, headers, cells``, as a lateral join with ``tables_in`` gives them; ``format`` is a column.

    The texts go to Python by Arrow batches rather than one call of the table function a row.
    """
    x = df.select(F.col(key).alias("key"), F.col(text).alias("body"), F.col(format).alias("kind"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = TablesIn()
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field(0).type), ("table_no", pa.int32()), ("row_no", pa.int32()), ("headers", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [list(tables.eval(body, kind)) for body, kind in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), list(map(len, found)))))
                columns = list(zip(*(row for rows in found for row in rows), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, schema.field(i + 1).type) for i, c in enumerate(columns)]], schema=schema)

    return x.mapInArrow(run, f"key {x.schema['key'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("key", key)
