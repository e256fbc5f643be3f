"""Vector and graph queries: ``embeddings`` are vectors, their labels domains, and close pairs of a label edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import density as DE
from lodeworks.operators import graph as G
from lodeworks.operators import vectors as V

from .views import sql_list, table

QUERIES, SQL = {}, {}
LEAST = 0.2


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(
    f"""WITH {_V}, p AS (SELECT q.vec_id AS query, d.vec_id AS id, list_cosine_similarity(q.e, d.e) AS sim FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM p) SELECT query, id, round(sim, 5) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def vec_knn(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return V.nearest(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).withColumn("sim", F.round("sim", 5))


@query(f"WITH {_V} SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}")
def vec_threshold_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return V.group_pairs(_vectors(spark, sf), "label", "vec_id", "embedding", LEAST).withColumn("sim", F.round("sim", 5))


@query("SELECT label, round(sum(m), 4) AS total, count(*) AS size FROM (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def vec_centroid(spark: SparkSession, sf: str) -> DataFrame:
    c = V.centroids(_vectors(spark, sf), "label", "embedding")
    return c.select("label", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("centroid").cast("long").alias("size"))


@query("SELECT label, round(sum(m), 4) AS total FROM (SELECT label, i, max(e[i]) AS m FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def vec_pool(spark: SparkSession, sf: str) -> DataFrame:
    c = V.pooled(_vectors(spark, sf), "label", "embedding", "max")
    return c.select("label", F.round(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_CENT = "m AS (SELECT label, i, avg(e[i]) AS x FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM v) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS centroid FROM m GROUP BY 1)"


@query(
    f"""WITH {_V}, {_CENT}, s AS (SELECT vec_id, c.label, list_cosine_similarity(e, centroid) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(e, centroid) DESC, c.label) AS k FROM v, c)
    SELECT vec_id, CASE WHEN sim > 0.5 THEN label END AS label, round(sim, 5) AS sim FROM s WHERE k = 1"""
)
def vec_nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return V.nearest_centroid(v, V.centroids(v, "label", "embedding"), "vec_id", "embedding", "label").withColumn("sim", F.round("sim", 5))


def _leaders_sql(order: str, tail: str) -> str:
    """Rows of a label in order: each joins the first leader at or above .3, else it leads."""
    return f"""WITH RECURSIVE {_V}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}) AS i FROM v),
    t(label, i, vec_id, leader, kept) AS (
      SELECT label, i, vec_id, vec_id, [{{'id': vec_id, 'e': e}}] FROM o WHERE i = 1
      UNION ALL
      SELECT label, i, vec_id, coalesce(found, vec_id), CASE WHEN found IS NULL THEN list_append(kept, {{'id': vec_id, 'e': e}}) ELSE kept END FROM (
        SELECT o.label, o.i, o.vec_id, o.e, kept, list_filter(kept, lambda k: list_cosine_similarity(k.e, o.e) >= 0.3)[1].id AS found FROM t JOIN o ON o.label = t.label AND o.i = t.i + 1)
    ), r AS (SELECT label, vec_id, leader FROM t) {tail}"""


@query(_leaders_sql("vec_id", "SELECT * FROM r"))
def vec_cluster_leader(spark: SparkSession, sf: str) -> DataFrame:
    return V.greedy_clusters(_vectors(spark, sf), "label", "vec_id", "embedding", ["vec_id"], 0.3)


@query(
    f"""WITH RECURSIVE {_V}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM v),
    t(label, i, vec_id, leader, kept) AS (
      SELECT label, i, vec_id, vec_id, [{{'id': vec_id, 's': e, 'n': 1.0::DOUBLE}}] FROM o WHERE i = 1
      UNION ALL
      SELECT label, i, vec_id, CASE WHEN sim > 0.3 THEN kept[hit].id ELSE vec_id END,
        CASE WHEN sim > 0.3 THEN list_transform(kept, lambda k, j: CASE WHEN j = hit THEN {{'id': k.id, 's': list_transform(list_zip(k.s, e), lambda p: p[1] + p[2]), 'n': k.n + 1}} ELSE k END) ELSE list_append(kept, {{'id': vec_id, 's': e, 'n': 1.0}}) END
      FROM (SELECT *, list_max(sims) AS sim, list_position(sims, list_max(sims)) AS hit FROM (
        SELECT o.label, o.i, o.vec_id, o.e, kept, list_transform(kept, lambda k: list_cosine_similarity(k.s, o.e)) AS sims FROM t JOIN o ON o.label = t.label AND o.i = t.i + 1))
    ) SELECT label, vec_id, leader FROM t"""
)
def vec_cluster_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return V.greedy_clusters(_vectors(spark, sf), "label", "vec_id", "embedding", ["vec_id"], 0.3, moving=True)


@query(_leaders_sql("(vec_id % 10) / 10.0 DESC, vec_id", "SELECT label, vec_id, leader, vec_id = leader AS kept FROM r"))
def vec_dedup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Best first by a reliability; a row joins the first kept row that is similar enough."""
    v = _vectors(spark, sf).withColumn("reliability", (F.col("vec_id") % 10) / 10.0)
    return V.greedy_clusters(v, "label", "vec_id", "embedding", ["-reliability", "vec_id"], 0.3).withColumn("kept", F.col("vec_id") == F.col("leader"))


@query(_leaders_sql("vec_id", "SELECT label, leader AS golden, count(*) AS members, list(vec_id ORDER BY vec_id) AS member_ids FROM r GROUP BY 1, 2"))
def vec_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    return V.consolidate(V.greedy_clusters(_vectors(spark, sf), "label", "vec_id", "embedding", ["vec_id"], 0.3), "label", "vec_id")


@query()
def vec_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of k-means differ between libraries, so the clusters are tested on vectors with known ones."""
    return V.kmeans(_vectors(spark, sf), "vec_id", "embedding", 10)


@query()
def vec_density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings as one group; three points make a cluster."""
    return DE.density_clusters(_vectors(spark, sf).withColumn("all", F.lit(0)), "all", "vec_id", "embedding", 3)


@query()
def vec_density_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a segment by nation and balance: the clusters are balances that lie close within a nation."""
    c = table(spark, sf, "customer")
    return DE.density_clusters(c.select("c_mktsegment", "c_custkey", F.array((F.col("c_nationkey") * 10).cast("double"), F.col("c_acctbal").cast("double") / 1000).alias("v")), "c_mktsegment", "c_custkey", "v")


@query("SELECT vec_id, round(greatest(least(1 - (vec_id % 30) / 20.0, 1), 0), 6) AS from_cosine, round(exp(-(vec_id % 30) / 20.0), 6) AS from_other FROM embeddings")
def vec_from_distance(spark: SparkSession, sf: str) -> DataFrame:
    d = (F.col("vec_id") % 30) / 20.0
    return _vectors(spark, sf).select("vec_id", F.round(V.similarity_from_distance(d), 6).alias("from_cosine"), F.round(V.similarity_from_distance(d, "l2"), 6).alias("from_other"))


# Graphs


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of close pairs: three kinds by the sum of the ids; strength is the cosine."""
    pairs = V.group_pairs(_vectors(spark, sf), "label", "vec_id", "embedding", LEAST)
    kind = F.element_at(F.array(*map(F.lit, ["supports", "contradicts", "refines"])), ((F.col("a") + F.col("b")) % 3 + 1).cast("int"))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), kind.alias("relation"), F.round("sim", 4).alias("strength"))


def _once(spark: SparkSession, sf: str) -> bool:
    """Whether no two of ``_edges`` have the same two ends: ids are distinct."""
    return _vectors(spark, sf).groupBy("vec_id").count().where("count > 1").isEmpty()


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select(F.col("vec_id").alias("id"), "label", ((F.col("vec_id") % 10) / 10.0).alias("authority"), ((F.col("vec_id") % 7) / 7.0).alias("pressure"))


_E = f"""{_V}, e AS (SELECT a.vec_id AS src, b.vec_id AS dst, CASE (a.vec_id + b.vec_id) % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' ELSE 'refines' END AS relation, round(list_cosine_similarity(a.e, b.e), 4) AS strength
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}), n AS (SELECT vec_id AS id, label, (vec_id % 10) / 10.0 AS authority, (vec_id % 7) / 7.0 AS pressure FROM v),
  nb AS (SELECT src AS node, dst AS other, relation, strength FROM e UNION ALL SELECT dst, src, relation, strength FROM e)"""


@query(f"WITH {_E}, b AS (SELECT src, dst, relation, strength FROM e UNION ALL SELECT dst, src, relation, strength FROM e WHERE relation IN ('supports', 'contradicts')) SELECT src, dst, relation, max(strength) AS strength FROM b GROUP BY 1, 2, 3")
def gra_add_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    return G.add_edges(_nodes(spark, sf), e.limit(0), e, _once(spark, sf))


@query(f"WITH {_E} SELECT src, dst, relation FROM e WHERE src % 5 <> 0 AND dst % 5 <> 0")
def gra_remove_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.remove_nodes(_edges(spark, sf), _nodes(spark, sf).where("id % 5 = 0")).select("src", "dst", "relation")


@query(f"WITH {_E} SELECT node, count(*) AS degree, round(sum(strength), 4) AS strength FROM nb GROUP BY 1")
def gra_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbours(_edges(spark, sf)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("strength"), 4).alias("strength"))


@query(
    f"""WITH RECURSIVE {_E}, walk(id, other) AS (SELECT id, id FROM n UNION SELECT w.id, nb.other FROM walk w JOIN nb ON nb.node = w.other) SELECT id, min(other) AS component FROM walk GROUP BY 1"""
)
def gra_components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(_edges(spark, sf), _nodes(spark, sf))


@query(
    f"""WITH {_E}, s AS (SELECT DISTINCT node, other FROM nb WHERE strength >= 0.3), h0 AS (SELECT id AS seed, id, 0 AS depth FROM n), h1 AS (SELECT seed, other AS id, 1 AS depth FROM h0 JOIN s ON s.node = h0.id),
    h2 AS (SELECT seed, other AS id, 2 AS depth FROM h1 JOIN s ON s.node = h1.id) SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2"""
)
def gra_expand(spark: SparkSession, sf: str) -> DataFrame:
    return G.expand(_edges(spark, sf), _nodes(spark, sf), 2, 0.3)


@query(
    f"""WITH {_E}, s AS (SELECT node, other, max(strength) AS s FROM nb WHERE strength >= 0.2 GROUP BY 1, 2), t AS (SELECT id FROM n WHERE authority >= 0.8), p1 AS (SELECT other AS here, [id, other] AS nodes, [CAST(s AS DOUBLE)] AS st FROM n JOIN s ON s.node = id WHERE pressure > 0.5 AND other <> id),
    p2 AS (SELECT other AS here, list_append(nodes, other) AS nodes, list_append(st, CAST(s AS DOUBLE)) AS st FROM p1 JOIN s ON s.node = p1.here WHERE NOT list_contains(nodes, other) AND p1.here NOT IN (SELECT id FROM t)),
    a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), d AS (SELECT *, row_number() OVER () AS k FROM a WHERE here IN (SELECT id FROM t)), m AS (SELECT k, avg(authority) AS mean FROM (SELECT k, unnest(nodes) AS id FROM d) JOIN n USING (id) GROUP BY 1)
    SELECT array_to_string(nodes, '-') AS path, CAST(len(st) AS INTEGER) AS hops, round(pow(list_product(st), 1.0 / len(st)) * 0.5 + 0.2 / len(st) + mean * 0.3, 5) AS score FROM d JOIN m USING (k)"""
)
def gra_paths(spark: SparkSession, sf: str) -> DataFrame:
    n = _nodes(spark, sf)
    p = G.paths(n, _edges(spark, sf), n.where("pressure > 0.5"), n.where("authority >= 0.8"), 2, 0.2, _once(spark, sf))
    return p.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), "-").alias("path"), "hops", F.round("score", 5).alias("score"))


_STEP = """SELECT {o}.id, greatest(0, least(1, {o}.a + coalesce(sum(CASE WHEN relation IN ('supports', 'implies') THEN x.a * strength * 0.1 WHEN relation IN ('refines', 'depends_on') THEN x.a * strength * 0.05
  WHEN relation = 'contradicts' AND x.a > {o}.a THEN -x.a * strength * 0.1 ELSE 0 END), 0))) AS a FROM {o} LEFT JOIN nb ON nb.node = {o}.id LEFT JOIN {o} x ON x.id = nb.other GROUP BY {o}.id, {o}.a"""


@query(f"WITH {_E}, a0 AS (SELECT id, CAST(authority AS DOUBLE) AS a FROM n), a1 AS ({_STEP.format(o='a0')}), a2 AS ({_STEP.format(o='a1')}), a3 AS ({_STEP.format(o='a2')}) SELECT id, round(a, 5) AS authority FROM a3")
def gra_propagate_authority(spark: SparkSession, sf: str) -> DataFrame:
    return G.propagate_authority(_nodes(spark, sf), _edges(spark, sf)).withColumn("authority", F.round("authority", 5))


@query(
    f"""WITH {_E}, d AS (SELECT nb.other AS id, sum(h.pressure * nb.strength * 0.3) AS d FROM nb JOIN n h ON h.id = nb.node AND h.pressure >= 0.3 WHERE relation IN ('supports', 'implies') GROUP BY 1)
    SELECT n.id, round(least(1.0, pressure + d), 5) AS after FROM n JOIN d ON d.id = n.id WHERE least(1.0, pressure + d) - pressure > 0.05"""
)
def gra_propagate_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return G.propagate_contradictions(_nodes(spark, sf), _edges(spark, sf)).select("id", F.round("after", 5).alias("after"))


@query(
    f"""WITH {_E}, b AS (SELECT dst AS id, sum(CASE WHEN relation = 'supports' THEN strength ELSE 0 END) AS s, sum(CASE WHEN relation = 'contradicts' THEN strength ELSE 0 END) AS c FROM e WHERE relation IN ('supports', 'contradicts') GROUP BY 1)
    SELECT n.id, round(authority * 0.7 + 0.3 * greatest(0, s - 0.5 * c) / (s + c), 5) AS authority FROM n JOIN b ON b.id = n.id"""
)
def gra_self_correct(spark: SparkSession, sf: str) -> DataFrame:
    return G.self_correct(_nodes(spark, sf), _edges(spark, sf)).withColumn("authority", F.round("authority", 5))


@query(f"WITH {_E} SELECT src AS a, dst AS b FROM e WHERE relation = 'contradicts'")
def gra_missing_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    pairs = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return G.missing_edges(pairs, e.where("relation <> 'contradicts'"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 1 AND NOT list_contains({stop}, t)))"


@query()
def gra_evidence_edges(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return G.elaborates(turns, "conv_id", "turn", "text", 0.15)


def _evidence_sql() -> str:
    from lodeworks.operators.derivation import STOPWORDS

    tok = _TOK.replace("{stop}", sql_list(STOPWORDS))
    return f"""WITH k AS (SELECT conv_id, turn, {tok} AS t FROM conversations), p AS (SELECT a.conv_id, a.turn AS src, b.turn AS dst, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS x, len(b.t) AS y FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn < b.turn)
    SELECT conv_id, src, dst, 'ELABORATES' AS edge_type, round(i / (x + y - i), 4) AS weight FROM p WHERE i > 0 AND i / (x + y - i) >= 0.15"""


SQL["gra_evidence_edges"] = _evidence_sql()


@query(
    """WITH n AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'derived' ELSE 'evidence' END AS node_type, substr(coalesce(text, ''), 1, 120) AS query FROM documents),
    e AS (SELECT doc_id AS src, doc_id + 1 AS dst, CASE WHEN doc_id % 2 = 0 THEN 'DERIVED_FROM' ELSE 'ELABORATES' END AS edge_type FROM documents WHERE doc_id % 4 = 0),
    g AS (SELECT id, query, 0.9 AS priority, 'contradiction' AS gap_type FROM n WHERE node_type = 'contradiction' UNION ALL SELECT id, query, 0.7, 'unsupported_derived' FROM n WHERE node_type = 'derived' AND id NOT IN (SELECT src FROM e WHERE edge_type = 'DERIVED_FROM')
      UNION ALL SELECT id, query, 0.6, 'isolated' FROM n WHERE node_type = 'evidence' AND id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY priority DESC, id) AS k FROM g WHERE query <> '') SELECT id, CAST(priority AS DOUBLE) AS priority, gap_type FROM r WHERE k = 1 ORDER BY priority DESC, id LIMIT 60"""
)
def gra_gaps(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    kind = F.element_at(F.array(*map(F.lit, ["contradiction", "derived", "evidence"])), (F.col("doc_id") % 3 + 1).cast("int"))
    nodes = d.select(F.col("doc_id").alias("id"), kind.alias("node_type"), F.coalesce("text", F.lit("")).alias("content"))
    edges = d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"), F.when(F.col("doc_id") % 2 == 0, "DERIVED_FROM").otherwise("ELABORATES").alias("edge_type"))
    return G.gaps(nodes, edges, 60).select("id", "priority", "gap_type")


@query(
    f"""WITH {_E} SELECT src, dst, CASE WHEN kind = 'relational' AND strength >= 0.85 THEN 'confirmed' WHEN kind = 'analogical' AND strength >= 0.6 AND low >= 0.5 THEN 'confirmed' WHEN kind = 'corrective' AND strength >= 0.5 THEN 'refined' WHEN strength >= 0.7 THEN 'refined' ELSE 'rejected' END AS verdict
    FROM (SELECT src, dst, strength, CASE relation WHEN 'supports' THEN 'relational' WHEN 'contradicts' THEN 'corrective' ELSE 'analogical' END AS kind, least((src % 10) / 10.0, (dst % 10) / 10.0) AS low FROM e)"""
)
def gra_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("relation") == "supports", "relational").when(F.col("relation") == "contradicts", "corrective").otherwise("analogical")
    v = G.hypothesis_verdict(kind, F.col("strength"), (F.col("src") % 10) / 10.0, (F.col("dst") % 10) / 10.0)
    return _edges(spark, sf).select("src", "dst", v.alias("verdict"))


@query(
    f"""WITH {_E}, d AS (SELECT id, id % 4 AS dom FROM n), z AS (SELECT dom, count(*) AS n FROM d GROUP BY 1), c AS (SELECT least(a.dom, b.dom) AS x, greatest(a.dom, b.dom) AS y, sum(strength) AS s FROM e JOIN d a ON a.id = src JOIN d b ON b.id = dst WHERE a.dom <> b.dom GROUP BY 1, 2)
    SELECT x, y, round(s / (p.n * q.n * 10), 6) AS coherence FROM c JOIN z p ON p.dom = x JOIN z q ON q.dom = y"""
)
def gra_coherence(spark: SparkSession, sf: str) -> DataFrame:
    n = _nodes(spark, sf).withColumn("dom", F.col("id") % 4)
    return G.domain_coherence(n, _edges(spark, sf), "dom").withColumn("coherence", F.round("coherence", 6))
