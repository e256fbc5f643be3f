"""Further queries of the knowledge base over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions import scores as S
from lodeworks.functions import text as T
from lodeworks.operators import cognition as CO
from lodeworks.operators import dedup as DD
from lodeworks.operators import knowledge as K
from lodeworks.operators import postings as PO
from lodeworks.operators import vectors as V
from lodeworks.operators.derivation import STOPWORDS
from lodeworks.sources import tables as A

from .texts import _SIG
from .views import ATOMS_SQL, atoms, spread, sql_any, sql_list, sql_words, table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


_C = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def knw_atom_with_evidence(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    return A.enforce_parent(docs, labels, "doc_id").join(labels.select("doc_id", "quality"), "doc_id")


@query(
    """WITH q AS (SELECT ['  t', ' th', 'thi', 'hin', 'ing', 'ng '] AS g), w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM conversations),
    t AS (SELECT conv_id, turn, list_distinct(flatten(list_transform(ws, lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3))))) AS g FROM w)
    SELECT conv_id, turn, round(len(list_intersect(t.g, q.g))::DOUBLE / (len(t.g) + 6 - len(list_intersect(t.g, q.g))), 6) AS similarity FROM t, q"""
)
def knw_trigram(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.round(K.trigram_similarity(F.col("text"), "thing"), 6).alias("similarity"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3)))))"


@query(
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS key, {_GRAMS} AS g FROM conversations), q AS (SELECT * FROM t WHERE key % 20 = 0),
    p AS (SELECT q.key AS query, t.key, len(list_intersect(t.g, q.g)) AS n, len(t.g) + len(q.g) AS m FROM q, t WHERE len(t.g) > 0 AND len(q.g) > 0)
    SELECT query, key, round(n::DOUBLE / (m - n), 6) AS similarity FROM p WHERE n::DOUBLE / (m - n) >= 0.3"""
)
def knw_trigram_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth turn as a query against the trigram index of all turns."""
    t = spread(_turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text"))
    found = PO.trigram_search(PO.gram_index(t, "key", "text"), t.where("key % 20 = 0"), "key", "text")
    return found.select("query", "key", F.round("similarity", 6).alias("similarity"))


@query(
    """WITH s AS (SELECT l_orderkey AS section, list(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS probe, list(DISTINCT l_partkey ORDER BY l_partkey)[1:1 + o_orderkey % 2] AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 20 IN (0, 1) GROUP BY 1)
    SELECT probe, section FROM p JOIN s ON list_has_all(s.ids, p.ids)"""
)
def knw_json_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Reverse provenance: the sections (orders) whose JSON list of atoms (parts) contains a probe's one or two atoms."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    ids = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ids"))
    sections = ids.select(F.col("l_orderkey").alias("section"), F.to_json("ids").alias("atom_ids"))
    probes = ids.where("l_orderkey % 20 IN (0, 1)").select(F.col("l_orderkey").alias("probe"), F.to_json(F.slice("ids", F.lit(1), (1 + F.col("l_orderkey") % 2).cast("int"))).alias("wanted"))
    return PO.containing(sections, "section", "atom_ids", probes, "probe", "wanted").select("probe", F.col("key").alias("section"))


@query("SELECT conv_id, turn, 1.0::DOUBLE AS score FROM conversations WHERE contains(lower(text), 'the') AND role = 'user' ORDER BY conv_id, turn LIMIT 40")
def knw_substring(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "conversations").where(F.lower("text").contains("the") & (F.col("role") == "user"))
    return found.orderBy("conv_id", "turn").limit(40).select("conv_id", "turn", F.lit(1.0).alias("score"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (vec_id % 10) / 10.0 AS importance FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 7)
    SELECT vec_id, round(list_cosine_similarity(v.e, q.e), 5) AS sim FROM v, q WHERE vec_id <> 7 AND list_cosine_similarity(v.e, q.e) > 0.1 ORDER BY list_cosine_similarity(v.e, q.e) * importance DESC, vec_id LIMIT 20"""
)
def knw_cosine_scan(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", ((F.col("vec_id") % 10) / 10.0).alias("importance"))
    one = F.broadcast(v.where("vec_id = 7").select(F.col("embedding").alias("wanted")))
    near = v.where("vec_id <> 7").join(one).withColumn("sim", V.cosine(F.col("embedding"), F.col("wanted"))).where("sim > 0.1")
    return near.orderBy(F.desc(F.col("sim") * F.col("importance")), "vec_id").limit(20).select("vec_id", F.round("sim", 5).alias("sim"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def knw_vector_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id", "label").join(gone, "vec_id", "left_anti")


@query("SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, url FROM pages) WHERE NOT regexp_matches(lower(url), 'ref=|login|\\.pdf') AND host NOT IN (SELECT host FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) GROUP BY 1 HAVING count(*) >= 5)")
def knw_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    """Urls without a blocked part, on hosts with fewer than five records of failure."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "url")
    failing = p.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return p.where(~F.lower("url").rlike(r"ref=|login|\.pdf")).join(failing, "host", "left_anti").select("page_id", "host")


@query(f"WITH {_C} SELECT conv_id, turn, trim(text) = '' OR {sql_any('lower(text)', T.LOW_SIGNAL)} AS low FROM c")
def knw_low_signal(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", T.is_low_signal(F.col("text"), F.lit("two words"), F.lit("")).alias("low"))


@query(
    f"""WITH {_C} SELECT conv_id, turn, length(trim(text)) >= 15 AND NOT regexp_matches(trim(text), '^https?://\\S+$') AND NOT {sql_any('lower(text)', K.LEAKAGE)} AS kept,
      CASE WHEN role = 'assistant' THEN 0.85 WHEN role = 'user' THEN 0.5 ELSE 0.5 END AS confidence FROM c"""
)
def knw_normalise_atom(spark: SparkSession, sf: str) -> DataFrame:
    word = F.when(F.col("role") == "assistant", "high").when(F.col("role") == "user", "medium").otherwise("unclear")
    n = _turns(spark, sf).select("conv_id", "turn", K.normalise_atom(F.col("text"), F.col("role"), word).alias("a"), word.alias("w"))
    return n.select("conv_id", "turn", F.col("a").isNotNull().alias("kept"), F.when(F.col("w") == "high", 0.85).otherwise(0.5).alias("confidence"))


@query(f"WITH {_C}, t AS (SELECT conv_id, turn, role, CASE WHEN regexp_matches(trim(text), '[.!?]$') THEN trim(text) ELSE trim(text) || '.' END AS body FROM c) SELECT conv_id, turn, 'ku_' || substr(sha256(role || ':' || body), 1, 12) AS id FROM t")
def knw_units(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", K.knowledge_unit(F.col("text"), F.col("role"))["id"].alias("id"))


@query("SELECT doc_id, concat_ws(chr(10), nullif(trim(source), ''), nullif(trim(lang), ''), nullif(trim(substr(coalesce(text, ''), 1, 50)), '')) AS document FROM documents")
def knw_atom_document(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", K.document_of(F.col("source"), F.col("lang"), F.substring(F.coalesce("text", F.lit("")), 1, 50)).alias("document"))


_LONG = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) > 3))"


@query(
    f"""WITH {_C}, p AS (SELECT conv_id, turn, {_LONG.format('text')} AS a, {_LONG.format("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS b FROM c)
    SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0.0 ELSE round_even(1 - len(list_intersect(a, b))::DOUBLE / len(a), 3) END AS drift FROM p"""
)
def knw_preservation(spark: SparkSession, sf: str) -> DataFrame:
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return _turns(spark, sf).withColumn("before", before).select("conv_id", "turn", K.preserved(F.col("text"), F.col("before")).alias("drift"))


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 40 THEN 'low_quality' END AS filter_reason FROM events")
def knw_http_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.when(F.get_json_object("props", "$.k").cast("long") >= 40, "low_quality").alias("filter_reason"))


@query(
    """WITH s AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'fetched' WHEN 'purchase' THEN 'condensing' WHEN 'error' THEN 'failed' ELSE 'condensed' END AS state,
      lag(CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'fetched' WHEN 'purchase' THEN 'condensing' WHEN 'error' THEN 'failed' ELSE 'condensed' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
    SELECT event_id, coalesce((prev = 'discovered' AND state IN ('fetched', 'failed')) OR (prev = 'fetched' AND state IN ('filtered_out', 'condensing', 'failed')) OR (prev = 'condensing' AND state IN ('condensed', 'failed')) OR (prev = 'failed' AND state = 'fetched'), false) AS legal FROM s"""
)
def knw_transitions(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    state = F.when(t == "view", "discovered").when(t == "click", "fetched").when(t == "purchase", "condensing").when(t == "error", "failed").otherwise("condensed")
    s = table(spark, sf, "events").select("event_id", "user_id", "ts", state.alias("state"))
    s = s.withColumn("prev", F.lag("state").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return s.select("event_id", F.coalesce(K.legal_move(F.col("prev"), F.col("state")), F.lit(False)).alias("legal"))


@query(f"WITH {ATOMS_SQL} SELECT atom_id, len(regexp_extract_all(statement, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')) + len(regexp_extract_all(statement, '[A-Z][a-z]+[A-Z][A-Za-z]*')) AS phrases FROM atoms")
def knw_entity_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("atom_id", F.size(K.entity_phrases(F.col("statement"))).cast("long").alias("phrases"))


_NAMES = ["", "doi:", "10.5", "Graph ", "www.", "7", "English French "]


@query(
    f"""WITH n AS (SELECT doc_id, ({sql_list(_NAMES)})[doc_id % 7 + 1] || CASE doc_id % 4 WHEN 0 THEN coalesce(split_part(text, ' ', 1), '') WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN 'German' ELSE upper(substr(coalesce(text, ''), 1, 1)) END AS name FROM documents)
    SELECT doc_id, name, {sql_any('lower(name)', T.ARTIFACTS)} OR regexp_matches(name, '://|www\\.|@') OR regexp_matches(name, '^10\\.[0-9]{{2}}') OR regexp_full_match(regexp_replace(name, '[ ,-]', '', 'g'), '[0-9]+') OR regexp_full_match(name, '[A-Z]') AS artifact,
      len(list_filter({sql_words('lower(name)')}, lambda w: list_contains({sql_list(T.LANGUAGES)}, w))) >= 3 AS languages FROM n"""
)
def knw_entity_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Names of many forms, made of the documents' first words, ids and letters."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    n = F.col("doc_id") % 4
    tail = F.when(n == 0, F.coalesce(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(""))).when(n == 1, F.col("doc_id").cast("string")).when(n == 2, "German").otherwise(T.upper_letter(F.substring(F.coalesce("text", F.lit("")), 1, 1)))
    name = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 7 + 1).cast("int")), tail)
    return d.select("doc_id", name.alias("name")).select("doc_id", "name", T.is_artifact(F.col("name")).alias("artifact"), T.is_language_list(F.col("name")).alias("languages"))


_SAYS = ["I really LOVE ", "i hate ", "They prefer ", "I want a "]


@query(
    f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || ({sql_list(_SAYS)})[turn % 4 + 1] || coalesce(split_part(text, '.', 1), 'no') || ', and so. I like it! I dislike ' || role || ' talk' AS text FROM conversations WHERE role = 'user'),
    p AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{K.PREFERENCE}', 1)) AS verb, unnest(regexp_extract_all(text, '{K.PREFERENCE}', 2)) AS object FROM t)
    SELECT conv_id, turn, lower(verb) AS verb, trim(object) AS object FROM p"""
)
def knw_preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of users with a preference stated behind them."""
    t = table(spark, sf, "conversations").where("role = 'user'")
    says = F.element_at(F.array(*map(F.lit, _SAYS)), (F.col("turn") % 4 + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), says, F.coalesce(F.split_part("text", F.lit("."), F.lit(1)), F.lit("no")), F.lit(", and so. I like it! I dislike "), "role", F.lit(" talk"))
    return t.select("conv_id", "turn", F.explode(K.preferences(text)).alias("p")).select("conv_id", "turn", "p.verb", "p.object")


_WORDS_OF = "SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) >= 3)) AS w FROM documents"


@query(
    f"""WITH c AS (SELECT w AS concept, count(*) AS n FROM ({_WORDS_OF}) GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT DISTINCT lower(split_part(text, ' ', 2)) AS t FROM benchmark)
    SELECT concept, n FROM c WHERE NOT list_contains({sql_list(T.NOISE_CONCEPTS)}, concept) AND NOT EXISTS (SELECT 1 FROM k WHERE contains(t, concept) OR contains(concept, t)) ORDER BY n DESC, concept LIMIT 10"""
)
def knw_emergent_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent words of all documents that are not related to any second word of the benchmark."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 3)
    counts = spread(table(spark, sf, "documents").select("text")).select(F.explode(words).alias("concept")).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    known = table(spark, sf, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(2)).alias("title"))
    return DD.emergent_topics(counts, "concept", "n", known, "title")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN '{"atoms": [' || props || ']}' WHEN 3 THEN '{"a": [1, "x"], "p": ' || props || '}' END AS value FROM events"""
)
def knw_json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs with text around the JSON, without its end, with a comma too many, within others, or without any."""
    n, p = F.col("event_id") % 5, F.col("props")
    text = F.when(n == 0, F.concat(F.lit("Here it is: "), p, F.lit(" and {more}"))).when(n == 1, F.substring(p, F.lit(1), F.length(p) - 1)).when(n == 2, F.concat(F.lit("Sure! ["), p, F.lit(",]"))).when(n == 3, F.concat(F.lit('{"a": [1, "x"], "p": '), p)).otherwise("none")
    return CO.repaired_json(table(spark, sf, "events").select("event_id", text.alias("text")), "event_id", "text")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN 1 THEN '2024-13-45T99:00:00.000000' ELSE event_type END AS stamp, '{"' || event_type || '":' || user_id || '}' AS counts, '[' || event_id || ',' || user_id || ']' AS ids FROM events"""
)
def rel_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Strings with timestamps, near-timestamps and others, maps and arrays, as a relational store takes them."""
    e, n = table(spark, sf, "events"), F.col("event_id") % 3
    stamp = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(n == 1, "2024-13-45T99:00:00.000000").otherwise(F.col("event_type"))
    return T.prepared(e.select("event_id", stamp.alias("stamp"), F.create_map("event_type", "user_id").alias("counts"), F.array("event_id", "user_id").alias("ids")))


_TOK3 = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) >= 3))"


@query(
    f"""WITH {_C}, a AS (SELECT conv_id, text AS anchor FROM c WHERE turn = 0), q AS (SELECT c.conv_id, c.turn, trim(regexp_replace(c.text, '\\s+', ' ', 'g')) AS clean, a.anchor, row_number() OVER (PARTITION BY c.conv_id, lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) ORDER BY c.turn) AS k FROM c JOIN a ON a.conv_id = c.conv_id)
    SELECT conv_id, turn, clean FROM q WHERE k = 1 AND clean <> '' AND len(list_intersect({_TOK3.format('clean')}, {_TOK3.format('anchor')})) > 0"""
)
def knw_governance(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    anchor = t.where("turn = 0").select("conv_id", F.col("text").alias("anchor"))
    return K.govern_queries(t.join(anchor, "conv_id"), "conv_id", "text", "turn", "anchor").select("conv_id", "turn", "clean")


_CT = f"list_distinct(list_filter(regexp_split_to_array(lower({{}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda t: length(t) > 1 AND NOT list_contains({sql_list(STOPWORDS)}, t)))"


@query(
    f"""WITH {_C}, a AS (SELECT conv_id, turn, text AS s, {_CT.format('text')} AS sw FROM c WHERE role = 'assistant'), b AS (SELECT conv_id, turn AS chunk, text AS b, {_CT.format('text')} AS bw FROM c WHERE role = 'user'),
    p AS (SELECT a.conv_id, a.turn, chunk, CASE WHEN contains(b, s) OR contains(s, b) THEN 1.0 WHEN len(sw) + len(bw) = 0 THEN 0.0 ELSE len(list_intersect(sw, bw))::DOUBLE / (len(sw) + len(bw) - len(list_intersect(sw, bw))) END AS score FROM a JOIN b ON a.conv_id = b.conv_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, chunk) AS k, min(chunk) OVER (PARTITION BY conv_id, turn) AS f FROM p)
    SELECT conv_id, turn, CASE WHEN score >= 0.15 THEN chunk ELSE f END AS chunk, CASE WHEN score >= 0.15 THEN round(score, 6) END AS score FROM r WHERE k = 1"""
)
def knw_chunk_evidence(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    chunks = t.where("role = 'user'").select("conv_id", F.col("turn").alias("chunk"), F.col("text").alias("body"))
    return K.chunk_evidence(t.where("role = 'assistant'"), chunks, "conv_id", "turn", "text", "chunk", "body").withColumn("score", F.round("score", 6))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS authority_aligned, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS contradiction_bound FROM documents")
def knw_link_signals(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return K.link_signals(table(spark, sf, "documents").select("doc_id"), "doc_id", labels.where("quality = 1"), labels.where("toxic = 1"), "doc_id")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, value / 1000.0 AS r, CAST(event_id AS VARCHAR) AS t FROM events), g AS (SELECT user_id, count(*) AS n, round(avg(r), 6) AS reliability, count(*) FILTER (event_type = 'error')::DOUBLE / (count(*) * 2) AS rate FROM e GROUP BY 1 HAVING count(*) >= 5),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, t) AS k FROM e) SELECT g.user_id, n, reliability, string_agg(t, ' ' ORDER BY k) AS summary FROM g JOIN k ON k.user_id = g.user_id AND k.k <= 5 WHERE rate <= 0.2 GROUP BY 1, 2, 3"""
)
def knw_concepts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.col("event_id").cast("string").alias("t"), (F.col("value") / 1000.0).alias("r"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("bad"))
    return K.build_concepts(e, "user_id", "t", "r", "kind", "bad").select("user_id", "n", F.round("reliability", 6).alias("reliability"), "summary")


@query("SELECT o_orderpriority AS concept, count(DISTINCT o_orderstatus) AS domains, count(DISTINCT o_custkey) AS beliefs, round(least(1.0, 0.3 * least(count(DISTINCT o_orderstatus) / 5.0, 1) + 0.3 * least(count(DISTINCT o_custkey) / 20.0, 1) + 0.4 * CASE WHEN count(DISTINCT o_orderstatus) >= 2 THEN 1.0 ELSE 0.3 END), 6) AS authority FROM orders GROUP BY 1")
def knw_anchors(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("concept"), F.col("o_custkey").alias("belief"), F.col("o_orderstatus").alias("domain"))
    return K.anchors(o, "concept", "belief", "domain").withColumn("authority", F.round("authority", 6))


@query(
    """SELECT a.l_orderkey AS packet, a.l_linenumber AS a, b.l_linenumber AS b, CASE WHEN a.l_discount >= b.l_discount THEN 'a' ELSE 'b' END AS winner, round(greatest(a.l_discount, b.l_discount) * 0.8, 6) AS confidence
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE abs(a.l_discount - b.l_discount) > 0.055"""
)
def knw_adjudicate(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("packet"), "l_linenumber", "l_discount")
    a, b = x.select("packet", F.col("l_linenumber").alias("a"), F.col("l_discount").alias("ca")), x.select("packet", F.col("l_linenumber").alias("b"), F.col("l_discount").alias("cb"))
    pairs = a.join(b, "packet").where("a < b AND abs(ca - cb) > 0.055")
    return K.adjudicate(pairs, "ca", "cb").select("packet", "a", "b", "winner", F.round("confidence", 6).alias("confidence"))


@query(
    """WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT user_id, event_type, n, CASE WHEN event_type = 'error' THEN 'adjudicative' WHEN event_type = 'signup' THEN 'implementation' WHEN n >= 4 THEN 'comparative' ELSE 'descriptive' END AS mode,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS INTEGER) AS section FROM g"""
)
def knw_section_plan(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") == "error", "contradiction").when(F.col("event_type") == "signup", "method").otherwise("claim"))
    return K.section_plan(e, "user_id", "event_type", "event_id", "kind")


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id, max(list_cosine_similarity(q.e, d.e)) AS s FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id GROUP BY 1)
    SELECT vec_id, round(least(1.0, (1 - s) / 1.5), 5) AS novelty, least(1.0, (1 - s) / 1.5) >= 0.3 AS kept FROM p"""
)
def knw_novelty_gate(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    near = V.nearest(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 1)
    n = near.select(F.col("query").alias("vec_id"), K.novelty(near, "sim").alias("n"))
    return n.select("vec_id", F.round("n", 5).alias("novelty"), (F.col("n") >= 0.3).alias("kept"))


@query(
    f"""WITH {ATOMS_SQL}, w AS (SELECT source_id, pos, {sql_words(_SIG)} AS ws FROM atoms), g AS (SELECT DISTINCT source_id, pos, array_to_string(ws[i + 1:i + 4], ' ') AS gram FROM (SELECT source_id, pos, ws, unnest(range(0, greatest(len(ws) - 4, 0) + 1)) AS i FROM w)),
    f AS (SELECT source_id, gram, min(pos) AS pos FROM g GROUP BY 1, 2), n AS (SELECT source_id, pos, count(*) AS new FROM f GROUP BY 1, 2), o AS (SELECT source_id, pos, count(*) AS own FROM g GROUP BY 1, 2),
    x AS (SELECT o.source_id, o.pos, own, coalesce(new, 0) AS new, coalesce(sum(coalesce(new, 0)) OVER (PARTITION BY o.source_id ORDER BY o.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM o LEFT JOIN n ON n.source_id = o.source_id AND n.pos = o.pos)
    SELECT source_id, pos, round(CASE WHEN seen = 0 THEN 1.0 ELSE pow(1 - (own - new)::DOUBLE / (seen + new), 2) END, 6) AS redundancy FROM x"""
)
def knw_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    a = atoms(spark, sf).select("source_id", "pos", T.signature(F.col("statement")).alias("sig"))
    return K.running_redundancy(a, "source_id", "pos", "sig").select("source_id", "pos", F.round("redundancy", 6).alias("redundancy"))


@query("SELECT event_id, round(greatest(0, least(1, round((CASE event_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.0 ELSE 0.5 END) * 0.20 + least((event_id % 6) * 0.05, 0.20) + (event_id % 10) / 10.0 * 0.10 + 1e-9, 3))), 3) AS confidence FROM events")
def knw_confidence(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["academic", "standard", "skip", "other"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.round(S.confidence(kind, F.col("event_id") % 6, (F.col("event_id") % 10) / 10.0 + 1e-8), 3).alias("confidence"))


@query("SELECT user_id, list_sort(list(event_id ORDER BY ts DESC, event_id DESC)[1:10]) AS last_ten FROM events GROUP BY 1")
def knw_bounded_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last ten entries of each history; only ten rows a user reach the aggregation."""
    from lodeworks.operators.relational import top_per_group

    e = top_per_group(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 10)
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("last_ten"))


@query("SELECT o_orderkey, CAST((epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) AS DECIMAL(18,3)) AS seconds FROM orders")
def knw_durations(spark: SparkSession, sf: str) -> DataFrame:
    span = F.lit("1999-01-01").cast("timestamp").cast("double") - F.col("o_orderdate").cast("timestamp").cast("double")
    return table(spark, sf, "orders").select("o_orderkey", span.cast("decimal(18,3)").alias("seconds"))


@query("SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' ORDER BY ts, event_id LIMIT 100")
def knw_timeline(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-06").cast("timestamp_ntz")))
    return e.orderBy("ts", "event_id").limit(100).select("event_id", "user_id", "ts")


@query(
    """WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS da, b.label AS db, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 10 = b.vec_id % 10 AND a.label < b.label)
    SELECT da, db, count(*) AS pairs, round(avg(s), 5) AS mean FROM d GROUP BY 1, 2"""
)
def knw_cross_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity between domains over pairs that share an anchor."""
    v = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("anchor"), "label", "embedding")
    return V.mean_similarities(v, "anchor", "label", "embedding").select(F.col("x").alias("da"), F.col("y").alias("db"), "pairs", F.round("mean", 5).alias("mean"))
