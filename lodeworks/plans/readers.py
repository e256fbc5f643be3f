"""Reader and chunker queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators.vectors import hashed_embedding
from lodeworks.sources import readers as R
from lodeworks.sources import sinks as SI
from lodeworks.sources import text_tables as TT
from lodeworks.sources import web
from lodeworks.sources.shared import fresh_path

from .views import sql_any, table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def src_html(spark: SparkSession, sf: str) -> DataFrame:
    return R.html_documents(table(spark, sf, "pages"), "page_id", "html")


@query()
def src_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return R.page_texts(table(spark, sf, "pages"), "page_id", "html")


def _order_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A text for every order with its lines as a table: markdown, HTML or CSV, by the order's key."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("part"), "l_returnflag"))).alias("ls"))
    rows = lambda before, between, after: F.array_join(F.transform("ls", lambda x: F.concat(F.lit(before), x["part"], F.lit(between), x["l_returnflag"], F.lit(after))), "\n")
    kind = F.element_at(F.array(*map(F.lit, TT.FORMATS)), (F.col("l_orderkey") % 3 + 1).cast("int"))
    text = (
        F.when(kind == "markdown", F.concat(F.lit("Order text | no table\n\n| no rule |\n| part | mode |\n| --- | --- |\n"), rows("| ", " | ", " |"), F.lit("\n| too | many | cells |\n\nEnd.")))
        .when(kind == "html", F.concat(F.lit("<p>a, b</p><table class='x'><tr><th>part</th><th>mode</th></tr>"), rows("<tr><td> ", "</td><td><b>", "</b></td></tr>"), F.lit("<tr><td>alone</td></tr></table><table></table>")))
        .otherwise(F.concat(F.lit("Some prose.\n \npart, mode\n"), rows("", " , ", ""), F.lit("\none,two,three\n\nEnd without a comma")))
    )
    return lines.select(F.col("l_orderkey").alias("order_key"), kind.alias("kind"), text.alias("body"))


@query(
    """WITH l AS (SELECT l_orderkey AS order_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), l_returnflag) - 1 AS row_no, l_partkey, l_returnflag FROM lineitem)
    SELECT order_key, CAST(row_no AS INTEGER) AS row_no, 'part|mode' AS headers, l_partkey || '|' || l_returnflag AS cells FROM l"""
)
def src_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of all three formats are read back from texts that hold them among other things."""
    found = TT.extract_tables(_order_tables(spark, sf), "order_key", "body", "kind")
    return found.select("order_key", "row_no", F.array_join("headers", "|").alias("headers"), F.array_join("cells", "|").alias("cells"))


@query()
def src_html_tables(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("kind", F.lit("html"))
    found = TT.extract_tables(pages, "page_id", "html", "kind")
    return found.select("page_id", "table_no", "row_no", "cells")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS has_k, 0 AS leaves FROM events")
def src_json(spark: SparkSession, sf: str) -> DataFrame:
    """String leaves and shape of the JSON column; its values are numbers, so it has no string leaf."""
    rows = lambda t: [('"k"' in (R.json_profile(t) or ""), len(R.json_leaves(t)))]
    return R.map_texts(table(spark, sf, "events"), "event_id", "props", "has_k boolean, leaves int", rows)


@query("SELECT n_nationkey, 0 AS row, 'name=' || n_name || ';region=' || n_regionkey AS pairs FROM nation")
def src_csv(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    text = F.concat(F.lit("name, region\n"), F.col("n_name"), F.lit(" ,"), F.col("n_regionkey").cast("string"), F.lit("\nbad,row,here\n\n"))
    r = R.csv_rows(n.select("n_nationkey", text.alias("text")), "n_nationkey", "text")
    return r.select("n_nationkey", "row", F.concat(F.lit("name="), F.col("values")["name"], F.lit(";region="), F.col("values")["region"]).alias("pairs"))


@query("SELECT r_regionkey, r_name || chr(10) || r_regionkey AS content, 'id,name,region' AS tags FROM region")
def src_xml(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "region")
    text = F.concat(F.lit("<?xml version='1.0'?><region><name>"), F.col("r_name"), F.lit("</name><id>"), F.col("r_regionkey").cast("string"), F.lit("</id></region>"))
    got = R.xml_text(text)
    return x.select("r_regionkey", got["content"].alias("content"), F.array_join(got["tags"], ",").alias("tags"))


@query()
def src_lists_and_code(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("html", F.lit(""))
    return table(spark, sf, "pages").select("page_id", F.size(R.list_items(text, "bullet")).alias("bullets"), F.size(R.list_items(text, "numbered")).alias("numbered"), F.size(R.code_snippets(text)).alias("code"))


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, replace(coalesce(text, ''), chr(10) || chr(10) || chr(10), chr(10) || chr(10)) AS t FROM documents),
    c(doc_id, t, k, a, b) AS (
      SELECT doc_id, t, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CASE WHEN length(t) <= 2000 THEN 2000 ELSE {cut} END FROM (SELECT *, substr(t, 1001, 1000) AS half, CAST(0 AS BIGINT) AS a FROM d WHERE t <> '')
      UNION ALL
      SELECT doc_id, t, k, a, CASE WHEN length(t) <= a + 2000 THEN a + 2000 ELSE {cut} END FROM (SELECT doc_id, t, k + 1 AS k, b - 300 AS a, substr(t, b - 300 + 1001, 1000) AS half FROM c WHERE b - 300 < length(t))
    ), s AS (SELECT doc_id, k, trim(substr(t, a + 1, b - a), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)) AS chunk FROM c)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, chunk FROM s WHERE chunk <> ''""".replace(
        "{cut}", "a + CASE WHEN contains(half, chr(10)) THEN 2001 - strpos(reverse(half), chr(10)) WHEN contains(half, ' ') THEN 2001 - strpos(reverse(half), ' ') ELSE 2000 END"
    )
)
def txt_chunks_char(spark: SparkSession, sf: str) -> DataFrame:
    rows = lambda t: list(enumerate(R.chunk_characters(t)))
    return R.map_texts(table(spark, sf, "documents"), "doc_id", "text", "pos long, chunk string", rows)


@query()
def txt_chunks_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.array_join(T.split_sentences(T.clean_boilerplate(F.coalesce("text", F.lit("")))), "\n").alias("text"))
    rows = lambda t: list(enumerate(R.chunk_sentences(t.split("\n")))) if t else []
    return R.map_texts(docs, "doc_id", "text", "pos long, chunk string", rows)


@query("SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))::DOUBLE AS mass FROM conversations")
def txt_hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "conversations").select("conv_id", "turn", hashed_embedding(F.coalesce("text", F.lit(""))).alias("e"))
    return e.select("conv_id", "turn", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("mass"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM pages")
def txt_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.sanitise(F.coalesce("html", F.lit(""))).alias("clean"))


@query(
    """SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, CAST(contains(lower(html), 'the') AS INTEGER) + CAST(contains(lower(html), 'href') AS INTEGER) + CAST(contains(lower(html), 'ould') AS INTEGER) AS hits FROM pages
    WHERE (contains(lower(html), 'the') OR contains(lower(html), 'href') OR contains(lower(html), 'ould')) AND page_id >= 10"""
)
def src_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search of the saved pages; the bound of the key is taken into the scan."""
    return web.search(spark, f"{sf}/pages.parquet", "the HREF ould the").where("page_id >= 10")


@query(f"SELECT page_id, host, md5(html) AS checksum, CAST(strlen(html) AS BIGINT) AS bytes, {sql_any('lower(url)', T.ACADEMIC_URLS)} AS academic FROM (SELECT *, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) WHERE starts_with(url, 'https')")
def src_scrape(spark: SparkSession, sf: str) -> DataFrame:
    return web.scrape(spark, f"{sf}/pages.parquet").where("url LIKE 'https%'").select("page_id", "host", "checksum", "bytes", "academic")


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS topic, count(*) AS lines, sum(length(line)) AS chars FROM (SELECT url, unnest(string_split('<!-- Source: ' || url || ' -->' || chr(10) || replace(html, chr(13), ' '), chr(10))) AS line FROM pages) GROUP BY 1")
def src_raw_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as raw text below a folder for each topic (here the host), and what is read back of them."""
    path = fresh_path(spark, "raw")
    pages = table(spark, sf, "pages").where("url IS NOT NULL AND html IS NOT NULL")
    SI.write_raw(pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "url", F.replace("html", F.lit("\r"), F.lit(" ")).alias("html")), path, "host", "url", "html")
    lines = spark.read.option("lineSep", "\n").schema("value string, topic string").text(path)
    return lines.groupBy("topic").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


@query("SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def src_export(spark: SparkSession, sf: str) -> DataFrame:
    """Results exported as JSON, read back."""
    path = fresh_path(spark, "export")
    found = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    SI.export(found, path, "json")
    return spark.read.schema(found.schema).json(path)
