"""Derivation and analytical queries: an order line is an atom, its order the packet, its part the entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import derivation as D

from .views import ATOMS_SQL, atoms, sql_list, table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("packet"), F.col("l_linenumber").alias("key"), F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("time"), F.col("l_partkey").alias("entity"),
        (F.col("l_returnflag") == "R").alias("conflict"),
    )


_PAIRS = "pairs AS (SELECT a.l_orderkey AS packet, a.l_linenumber AS a, b.l_linenumber AS b, a.l_extendedprice AS va, b.l_extendedprice AS vb FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)"


@query(f"WITH {_PAIRS} SELECT packet, a, b, round(va - vb, 4) AS delta FROM pairs")
def drv_delta(spark: SparkSession, sf: str) -> DataFrame:
    return D.delta(D.consecutive_pairs(_lines(spark, sf), "packet", "key", "value")).select("packet", "a", "b", F.round("delta", 4).alias("delta"))


@query(f"WITH {_PAIRS} SELECT packet, a, b, round((vb - va) / va * 100, 4) AS percent FROM pairs WHERE va <> 0")
def drv_percent(spark: SparkSession, sf: str) -> DataFrame:
    return D.percent_change(D.consecutive_pairs(_lines(spark, sf), "packet", "key", "value")).select("packet", "a", "b", F.round("percent", 4).alias("percent"))


@query(f"WITH {_PAIRS} SELECT packet, a, b, round(va / vb, 4) AS ratio FROM pairs WHERE vb <> 0")
def drv_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return D.ratio(D.consecutive_pairs(_lines(spark, sf), "packet", "key", "value")).select("packet", "a", "b", F.round("ratio", 4).alias("ratio"))


@query("SELECT l_orderkey AS packet, l_linenumber AS key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS INTEGER) AS rank FROM lineitem")
def drv_rank(spark: SparkSession, sf: str) -> DataFrame:
    return D.numeric_rank(_lines(spark, sf), "packet", "key", "value").select("packet", "key", "rank")


@query(
    """SELECT l_orderkey AS packet, arg_min(l_linenumber, (l_shipdate, l_linenumber)) AS earliest, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS latest,
    CAST(epoch(max(l_shipdate)) - epoch(min(l_shipdate)) AS BIGINT) AS seconds, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2"""
)
def drv_chronology(spark: SparkSession, sf: str) -> DataFrame:
    return D.chronology(_lines(spark, sf), "packet", "key", "time")


@query("SELECT entity, count(*) AS support FROM (SELECT min(l_partkey) AS entity FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1 HAVING count(*) >= 2")
def drv_support(spark: SparkSession, sf: str) -> DataFrame:
    x = _lines(spark, sf).withColumn("cite", F.concat_ws("-", "packet", "key"))
    return D.support_rollup(x, "cite", "entity")


@query("SELECT p_brand AS concept, count(*) AS conflicts FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1")
def drv_conflict(spark: SparkSession, sf: str) -> DataFrame:
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("brand"))
    return D.conflict_rollup(_lines(spark, sf).join(brands, "entity"), "conflict", "brand")


@query("SELECT o_orderkey, substr(sha256('delta:' || array_to_string(list_sort([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)]), ',') || ':12-A-v1'), 1, 16) AS claim_id FROM orders")
def drv_claim_id(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", D.claim_id(F.lit("delta"), ids).alias("claim_id"))


_IDS = "array_to_string(list_sort([CAST(a AS VARCHAR), CAST(b AS VARCHAR)]), ',')"


@query(
    f"""WITH {_PAIRS}, r AS (SELECT 'delta' AS rule, packet, {_IDS} AS ids, va - vb AS value FROM pairs UNION ALL SELECT 'percent_change', packet, {_IDS}, (vb - va) / va * 100 FROM pairs WHERE va <> 0
    UNION ALL SELECT 'ratio', packet, {_IDS}, va / vb FROM pairs WHERE vb <> 0)
    SELECT rule, count(*) AS claims, count(DISTINCT substr(sha256(rule || ':' || ids || ':12-A-v1'), 1, 16)) AS ids, round(sum(value), 1) AS total FROM r GROUP BY 1"""
)
def drv_engine(spark: SparkSession, sf: str) -> DataFrame:
    r = D.derive_all(_lines(spark, sf), "packet", "key", "value", "time", "entity").where(F.col("rule").isin("delta", "percent_change", "ratio"))
    return r.groupBy("rule").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("claim_id").alias("ids"), F.round(F.sum("value"), 1).alias("total"))


@query(f"WITH {_PAIRS} SELECT packet, a, b, CASE WHEN abs((va - vb) - round(va - vb, 0)) > 0.25 THEN round(va - vb, 4) END AS computed FROM pairs")
def drv_verify(spark: SparkSession, sf: str) -> DataFrame:
    pairs = D.consecutive_pairs(_lines(spark, sf), "packet", "key", "value").withColumn("claimed", F.round(F.col("va") - F.col("vb"), 0))
    return D.verify(pairs, "delta", "claimed", D.DerivationConfig(tolerance=0.25)).select("packet", "a", "b", F.round("computed", 4).alias("computed"))


@query(
    """SELECT conv_id, turn, list_transform(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9,]+\\.?[0-9]*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v IS NOT NULL), lambda v: v)[1] AS first_number FROM conversations"""
)
def drv_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.get(D.numbers(F.coalesce("text", F.lit(""))), 0).alias("first_number"))


_TOK = f"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1 AND NOT list_contains({sql_list(D.STOPWORDS)}, t)))"
_TURNS = "c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@query(
    f"""WITH {_TURNS}, k AS (SELECT conv_id, turn, {_TOK} AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM c), e AS (SELECT conv_id, n, unnest(t) AS tok FROM k),
    s AS (SELECT conv_id, list(tok) AS sh FROM (SELECT conv_id, tok FROM e GROUP BY conv_id, tok HAVING count(*) = max(n)) GROUP BY 1)
    SELECT k.conv_id, k.turn, coalesce(array_to_string(list_sort(sh), ' '), '') AS shared, len(list_filter(t, lambda x: sh IS NULL OR NOT list_contains(sh, x))) AS own
    FROM k LEFT JOIN s ON s.conv_id = k.conv_id WHERE n >= 2"""
)
def ana_compare(spark: SparkSession, sf: str) -> DataFrame:
    return D.compare_contrast(_turns(spark, sf), "conv_id", "turn", "text").select("conv_id", "turn", F.array_join("shared", " ").alias("shared"), F.size("own").cast("long").alias("own"))


def _side(words: str) -> str:
    return f"len(list_filter(regexp_split_to_array(lower(statement), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '{words}')))"


@query(f"WITH {ATOMS_SQL}, t AS (SELECT atom_id, {_side(D.PRO)} AS p, {_side(D.CON)} AS c FROM atoms) SELECT atom_id, CASE WHEN p = 0 AND c = 0 THEN NULL WHEN p >= c THEN 'pro' ELSE 'con' END AS side FROM t")
def ana_tradeoff(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("atom_id", D.tradeoff(F.col("statement")).alias("side"))


@query(
    """WITH m AS (SELECT conv_id, turn AS method, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = 'user'),
    r AS (SELECT conv_id, turn AS result, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant')
    SELECT m.conv_id, method, result FROM m JOIN r ON r.conv_id = m.conv_id AND r.j = m.i % r.n"""
)
def ana_pairing(spark: SparkSession, sf: str) -> DataFrame:
    return D.pair_methods(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role", ["user"], ["assistant"])


@query(
    f"""WITH {_TURNS}, k AS (SELECT conv_id, turn, {_TOK} AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
    p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.t, b.t))::DOUBLE AS i, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS u FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn <> b.turn),
    o AS (SELECT conv_id, turn, count(*) AS c FROM p WHERE u > 0 AND i > 0 AND i / u >= 0.25 GROUP BY 1, 2)
    SELECT k.conv_id, k.turn, n, coalesce(c, 0) AS overlaps, CASE WHEN coalesce(c, 0) >= (n - 1) / 2 THEN 'consensus' WHEN coalesce(c, 0) = 0 THEN 'divergent' END AS stance
    FROM k LEFT JOIN o ON o.conv_id = k.conv_id AND o.turn = k.turn WHERE n >= 3"""
)
def ana_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return D.consensus(_turns(spark, sf), "conv_id", "turn", "text")


@query(
    """WITH w AS (SELECT s_suppkey, s_nationkey, round((s_suppkey % 10) / 10.0 * CASE s_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.4 END * greatest(1 - (s_suppkey * 13) / 3650.0, 0.1), 6) AS weight FROM supplier)
    SELECT s_suppkey, weight, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY weight DESC, s_suppkey) AS INTEGER) AS rank FROM w"""
)
def ana_authority(spark: SparkSession, sf: str) -> DataFrame:
    from lodeworks.operators.relational import top_per_group

    level = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    w = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", D.authority_weight((F.col("s_suppkey") % 10) / 10.0, level, F.col("s_suppkey") * 13).alias("weight"))
    return top_per_group(w, "s_nationkey", [F.desc("weight"), F.asc("s_suppkey")], 1 << 30).select("s_suppkey", "weight", "rank")


@query(
    """WITH e AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS old_key, arg_max(event_id, (ts, event_id)) AS new_key, arg_min(value, (ts, event_id)) AS o, arg_max(value, (ts, event_id)) AS n, min(ts) AS a, max(ts) AS b
      FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT user_id, old_key, new_key, round(n - o, 6) AS delta, round(CASE WHEN o = 0 THEN 0.0 ELSE (n - o) / o * 100 END, 4) AS percent FROM e WHERE a <> b"""
)
def ana_change(spark: SparkSession, sf: str) -> DataFrame:
    x = D.change_detection(table(spark, sf, "events"), "user_id", "event_id", "ts", "value")
    return x.select("user_id", "old_key", "new_key", F.round("delta", 6).alias("delta"), F.round("percent", 4).alias("percent"))
