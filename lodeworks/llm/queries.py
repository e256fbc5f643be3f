"""The registered queries of this subpackage: thin digests of the operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    found = exact_duplicates(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch_path
    from .sharding import shard_documents

    store = shard_documents(_documents(spark, sf_dir), scratch_path(spark, "shards"))
    fewer = len(store.manifest()["shards"]) < max(len(store.manifest(v)["shards"]) for v in store.versions())
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.lit(fewer).alias("compacted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    found = archive_pages(_pages(spark, sf_dir))
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .langid import identify, learn, vocabulary

    docs = _documents(spark, sf_dir)
    fold = (F.crc32(F.col("doc_id").cast("string")) % 3) == 1
    model = learn(docs.where(~fold), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    found = identify(docs, model)
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score")


#: Fixed values of the query: action, host and path of each rule.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge_urls, rule_table

    found = judge_urls(_pages(spark, sf_dir), rule_table(spark, URL_RULES))
    return found.withColumnRenamed("id", "page_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import identifier_digests

    return identifier_digests(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encoding_digests

    found = encoding_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orderminhash import edited_fingerprints

    return edited_fingerprints(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdtree import cluster_vectors

    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair_digests

    return repair_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumnRenamed("id", "conv_id")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import contamination_digests

    return contamination_digests(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


OP2_SQL = """
SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256, true AS compacted FROM documents
"""

OP5_SQL = """
WITH r(action, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), a AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), f AS (
  SELECT u.page_id, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM u LEFT JOIN f ON f.page_id = u.page_id AND f.k = 1
"""

OP8_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  ) WHERE len(w) > 0
), p AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), h AS MATERIALIZED (
  SELECT rid, i, n, item_id FROM (
    SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
  ) JOIN p USING (n, s)
), hits AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""

#: A way of repair so far is its cost, its audit and the text; null where there is none.
_WAY = "CASE WHEN {v} IS NOT NULL{test} THEN {{'c': {v}.c + {cost}, 'e': {v}.e || '{edit}', 't': {v}.t || {text}}} END"


def _way(v: str, cost: str, edit: str, text: str, test: str = "") -> str:
    return _WAY.format(v=v, cost=cost, edit=edit, text=text, test=test and f" AND {test}")


def _step(to: str, kept: dict[str, str], reroled: dict[str, str]) -> str:
    stays = "NOT gone"
    ways = [_way(to, "4", "D", "''"), *[_way(v, "extra", "K", "chr(10) || role || ':' || text", f"{stays} AND role[1] = '{i}'") for v, i in kept.items()]]
    return f"list_min([{', '.join(ways + [_way(v, 'extra + 3', 'R', f"chr(10) || '{r}:' || text", stays) for v, r in reroled.items()])}])"


#: What inserted rows lead to: a user after nothing, a system or an assistant, and then an assistant.
_OPEN_U = f"list_min([vu, {', '.join(_way(v, '3', 'I', "chr(10) || 'user:'") for v in ('v0', 'vs', 'va'))}])"
_OPEN_A = f"list_min([va, {_way('vu', '3', 'I', "chr(10) || 'assistant:'")}])"
_BYTE = "list_reduce(range(8), lambda y, i: xor(y >> 1, (y & 1) * 3988292384), xor(x, b))"

OP12_SQL = f"""
WITH RECURSIVE h AS (
  SELECT *, xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda x, b: {_BYTE}, CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS act
  FROM conversations
), m AS (
  SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE act WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
         unnest(CASE WHEN act = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE act <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(coalesce(length(CAST(conv_id AS VARCHAR)) || ':' || conv_id, '-') || length(role) || ':' || role || text)) AS i FROM m
), f AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM o)
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM f GROUP BY conv_id
), t(conv_id, k, v0, vs, vu, va) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'e': '', 't': ''}}, CAST(NULL AS STRUCT(c BIGINT, e VARCHAR, t VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, e VARCHAR, t VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, e VARCHAR, t VARCHAR)) FROM s
  UNION ALL
  SELECT conv_id, i, {_step("v0", {}, {})}, {_step("vs", {"v0": "s"}, {})},
         {_step("vu", {"v0": "u", "vs": "u", "va": "u"}, {"v0": "user", "vs": "user", "va": "user"})}, {_step("va", {"vu": "a"}, {"vu": "assistant"})}
  FROM (
    SELECT conv_id, i, v0, vs, vu, {_OPEN_A} AS va, role, text, gone, extra FROM (
      SELECT t.conv_id, f.i, v0, vs, {_OPEN_U} AS vu, va, role, text, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra
      FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.k + 1
    )
  )
), e AS (
  SELECT conv_id, list_min([v0, {_OPEN_A}]) AS best FROM (
    SELECT t.conv_id, v0, {_OPEN_U} AS vu, va FROM t JOIN s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.n = t.k
  )
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_FIRST = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS z FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 8)
)"""

_ASSIGN = """, a{i} AS MATERIALIZED (
  SELECT rid, vec_id, v, min(struct_pack(d := d, c := c)) AS m
  FROM (SELECT rid, vec_id, v, c, list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i}) GROUP BY rid, vec_id, v
)"""

_MOVE = """, c{j} AS MATERIALIZED (
  SELECT c, coalesce(y, z) AS z FROM c{i} LEFT JOIN (
    SELECT c, list(y ORDER BY p) AS y FROM (
      SELECT c, p, (sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*) AS y FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p
    ) GROUP BY c
  ) USING (c)
)"""

OP11_SQL = (
    _FIRST + "".join(_ASSIGN.format(i=i) + _MOVE.format(i=i, j=i + 1) for i in range(10)) + _ASSIGN.format(i=10)
    + """
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON c10.c = a10.m.c
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_sharding": op2_sharding,
        "op3_warc": op3_warc,
        "op4_language_id": op4_language_id,
        "op5_url_rules": op5_url_rules,
        "op6_pii": op6_pii,
        "op7_packing": op7_packing,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_order_minhash": op10_order_minhash,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op5_url_rules": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op11_centroid_clustering": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_decontamination": OP13_SQL}
