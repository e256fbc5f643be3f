"""Sinks of raw documents and results, and the offline stand-ins for web sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import text as T


def write_raw(docs: DataFrame, path: str, topic: str, url: str, content: str) -> None:
    """Raw documents as text below a folder per topic, with a source comment first."""
    body = F.concat(F.lit("<!-- Source: "), F.col(url), F.lit(" -->\n"), F.col(content))
    docs.select(F.col(topic).alias("topic"), body.alias("value")).write.partitionBy("topic").mode("append").text(path)


def raw_name(url: Column) -> Column:
    return F.concat(F.substring(F.md5(url), 1, 12), F.lit(".md"))


def export(results: DataFrame, path: str, kind: str, title: str | None = None, body: str | None = None) -> None:
    """Results as JSON lines or as markdown sections; other formats are refused."""
    if kind == "json":
        results.write.mode("overwrite").json(path)
    elif kind == "markdown":
        results.select(F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown export format {kind!r}")


def static_search(pages: DataFrame, query: str, url: str, content: str, page: int = 1, size: int = 10) -> DataFrame:
    """A web search over a table of pages: those that hold any word of the query, most words first, a page of them."""
    terms = [w for w in query.lower().split() if w]
    hits = sum((F.lower(F.col(content)).contains(w).cast("int") for w in terms), F.lit(0))
    return pages.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), url).offset((page - 1) * size).limit(size)


def scraped(pages: DataFrame, url: str, content: str) -> DataFrame:
    """The columns that a scrape derives: checksum, bytes, host, academic flag."""
    return pages.select("*", F.md5(content).alias("checksum"), F.octet_length(content).alias("bytes"), F.regexp_extract(url, "://([^/?#]*)", 1).alias("host"), T.contains_any(F.lower(url), T.ACADEMIC_URLS).alias("academic"))
