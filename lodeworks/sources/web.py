"""Search and scrape of web pages as data sources, offline: a folder of saved pages stands in for the network.

``spark.read.format("page_scrape")`` gives the pages with what a scrape derives, ``"page_search"`` those that hold words
of a query. Both read a Parquet table of ``page_id, url, html`` by row groups, one input partition each, take filters on
``page_id``, ``url`` and ``host`` into the scan, and read only the columns that they need.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from lodeworks.functions import text as T

SCRAPED = "page_id bigint, url string, host string, checksum string, bytes bigint, academic boolean"
FOUND = "page_id bigint, url string, host string, hits int"
_HOST = re.compile(r"://([^/?#]*)")


def host_of(url: str | None) -> str | None:
    """The host of a url, empty where it has none."""
    return None if url is None else m[1] if (m := _HOST.search(url)) else ""


@dataclass
class RowGroup(D.InputPartition):
    path: str
    group: int


def _dataset(path: str) -> ds.Dataset:
    at = urlparse(path)
    if len(at.scheme) > 1 and at.scheme != "file":
        from pyarrow.fs import FileSystem

        system, inner = FileSystem.from_uri(path)
        return ds.dataset(inner, filesystem=system, format="parquet", exclude_invalid_files=False)
    return ds.dataset(at.path if at.scheme else path, format="parquet")


def _pushed(filter: D.Filter) -> tuple[Callable[[], pc.Expression] | None, Callable[[dict], bool] | None]:
    """A filter as an expression of the scan, or on the derived host; neither if it stays with Spark."""
    name = filter.attribute[0] if len(getattr(filter, "attribute", ())) == 1 else None
    if name in ("page_id", "url"):
        field = pc.field(name)
        plain = {
            D.EqualTo: lambda: field == filter.value, D.GreaterThan: lambda: field > filter.value, D.GreaterThanOrEqual: lambda: field >= filter.value, D.LessThan: lambda: field < filter.value,
            D.LessThanOrEqual: lambda: field <= filter.value, D.In: lambda: field.isin(list(filter.value)), D.IsNotNull: lambda: ~field.is_null(), D.StringStartsWith: lambda: pc.starts_with(field, filter.value),
            D.StringContains: lambda: pc.match_substring(field, filter.value),
        }
        return plain.get(type(filter)), None
    if name == "host":
        return None, {D.EqualTo: lambda row: row["host"] == filter.value, D.In: lambda row: row["host"] in filter.value, D.IsNotNull: lambda row: row["host"] is not None}.get(type(filter))
    return None, None


class _PageReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.options = options["path"], dict(options)
        self.scan_filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if any(_pushed(f)):
                self.scan_filters.append(f)
            else:
                yield f

    def partitions(self) -> list[RowGroup]:
        return [RowGroup(f.path, g.id) for f in _dataset(self.path).get_fragments() for g in f.row_groups]

    def _pages(self, part: RowGroup) -> Iterator[dict[str, Any]]:
        """The pages of a row group that pass the filters of the scan."""
        wanted, tests = None, []
        for expression, test in map(_pushed, self.scan_filters):
            if expression is not None:
                wanted = expression() if wanted is None else wanted & expression()
            else:
                tests.append(test)
        whole = _dataset(self.path)
        fragment = next(f for f in whole.get_fragments() if f.path == part.path).subset(row_group_ids=[part.group])
        for batch in fragment.to_batches(columns=["page_id", "url", "html"], filter=wanted, batch_size=512):
            for row in batch.to_pylist():
                row["host"] = host_of(row["url"])
                if all(t(row) for t in tests):
                    yield row

    def read(self, part: RowGroup | None) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        if part is not None:
            rows = [self.row(p) for p in self._pages(part) if self.keeps(p)]
        yield pa.RecordBatch.from_pylist([dict(zip(self.schema.names, r, strict=True)) for r in rows], schema=self.schema)


class _ScrapeReader(_PageReader):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("checksum", pa.string()), ("bytes", pa.int64()), ("academic", pa.bool_())])

    def keeps(self, page: dict) -> bool:
        return True

    def row(self, page: dict) -> tuple:
        body = None if page["html"] is None else page["html"].encode()
        low = None if page["url"] is None else page["url"].lower()
        return page["page_id"], page["url"], page["host"], body if body is None else hashlib.md5(body).hexdigest(), body if body is None else len(body), low and any(w in low for w in T.ACADEMIC_URLS)


class _SearchReader(_PageReader):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("hits", pa.int32())])

    def _hits(self, page: dict) -> int:
        low = (page["html"] or "").lower()
        return sum(w in low for w in set(self.options.get("query", "").lower().split()))

    def keeps(self, page: dict) -> bool:
        return self._hits(page) > 0

    def row(self, page: dict) -> tuple:
        return page["page_id"], page["url"], page["host"], self._hits(page)


class PageScrape(D.DataSource):
    """Pages with host, checksum, size and academic flag; null html has neither checksum nor size."""

    @classmethod
    def name(cls) -> str:
        return "page_scrape"

    def schema(self) -> str:
        return SCRAPED

    def reader(self, schema) -> D.DataSourceReader:
        return _ScrapeReader(self.options)


class PageSearch(D.DataSource):
    """Pages that hold any word of the option ``query``, and how many of its distinct words; no query finds nothing."""

    @classmethod
    def name(cls) -> str:
        return "page_search"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> D.DataSourceReader:
        return _SearchReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session, with filters taken into their scans."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageScrape)
    spark.dataSource.register(PageSearch)


def scrape(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("page_scrape").load(path)


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    register(spark)
    return spark.read.format("page_search").option("query", query).load(path)
