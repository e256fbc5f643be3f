"""Small cases with known results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import scores as S
from lodeworks.functions import text as T
from lodeworks.operators import cognition, dedup, density, derivation, graph, grounding, relational, retrieval, validators, vectors
from lodeworks.plans.extensions import Registry
from lodeworks.sources import readers, sinks, tables, text_tables
from lodeworks.streaming import pipelines


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_numeric_rules(spark):
    atoms = spark.createDataFrame([("p", "A", 10.0), ("p", "B", 7.0)], "g string, k string, v double")
    pairs = derivation.consecutive_pairs(atoms, "g", "k", "v")
    assert derivation.delta(pairs).first()["delta"] == 3.0
    change = spark.createDataFrame([("p", "A", 100.0), ("p", "B", 75.0), ("q", "A", 0.0), ("q", "B", 50.0)], "g string, k string, v double")
    got = derivation.percent_change(derivation.consecutive_pairs(change, "g", "k", "v")).collect()
    assert [(r["g"], r["percent"]) for r in got] == [("p", -25.0)]
    ratio = spark.createDataFrame([("p", "A", 10.0), ("p", "B", 4.0), ("q", "A", 10.0), ("q", "B", 0.0)], "g string, k string, v double")
    assert [r["ratio"] for r in derivation.ratio(derivation.consecutive_pairs(ratio, "g", "k", "v")).collect()] == [2.5]


def test_rank_breaks_ties_by_key(spark):
    atoms = spark.createDataFrame([("p", "B", 10.0), ("p", "A", 10.0), ("p", "C", 30.0), ("p", "D", None)], "g string, k string, v double")
    got = derivation.numeric_rank(atoms, "g", "k", "v").orderBy("rank").collect()
    assert [r["k"] for r in got] == ["C", "A", "B"]


def test_support_counts_a_key_once(spark):
    atoms = spark.createDataFrame([("A", "Python"), ("A", "Python"), ("B", "Python"), ("C", "Java")], "k string, e string")
    assert [tuple(r) for r in derivation.support_rollup(atoms, "k", "e").collect()] == [("Python", 2)]


def test_numbers_and_entities(spark):
    assert one(spark, grounding.stated_numbers(F.lit("Values: 1,000 and 2.5"))) == ["1,000", "2.5"]
    assert one(spark, grounding.entities(F.lit("NASA launched a rocket"))) == []
    assert one(spark, grounding.entities(F.lit("HTML and CSS are web tech"))) == ["CSS"]
    assert one(spark, grounding.tokenise(F.lit("Don't stop"))) == ["don", "t", "stop"]
    assert one(spark, derivation.numbers(F.lit("from $80 to 1,120.5 , x"))) == [80.0, 1120.5]


def test_sliding_windows(spark):
    ten = F.sequence(F.lit(0), F.lit(9))
    assert one(spark, T.sliding_windows(ten, 3, 2)) == [[0, 1, 2], [2, 3, 4], [4, 5, 6], [6, 7, 8]]
    assert one(spark, T.sliding_windows(F.array(*map(F.lit, [1, 2, 3])), 5, 2)) == [[1, 2, 3]]


def test_pooling(spark):
    v = spark.createDataFrame([("g", [1.0, 5.0, 3.0]), ("g", [3.0, 2.0, 5.0])], "g string, v array<double>")
    assert vectors.pooled(v, "g", "v").first()["pooled"] == [2.0, 3.5, 4.0]
    assert vectors.pooled(v, "g", "v", "max").first()["pooled"] == [3.0, 5.0, 5.0]


@pytest.mark.parametrize(
    "fresh, maturity, contra, uses, objections, expected",
    [("stale", "", 0, 0, False, "stale"), ("fresh", "", 0, 0, True, "contested"), ("fresh", "", 0, 2, False, "reusable"), ("fresh", "matured", 0, 0, False, "synthesized"), ("fresh", "", 0, 0, False, "forming")],
)
def test_trust_state(spark, fresh, maturity, contra, uses, objections, expected):
    c = S.trust_state(F.lit(None).cast("string"), F.lit(fresh), F.lit(maturity), F.lit(contra), F.lit(uses), F.lit(objections), F.lit(False))
    assert one(spark, c) == expected


def test_rerank_prefers_authority_and_exact_match(spark):
    plain = S.rerank_score(F.lit(0.85), F.lit(0.85), F.lit(5), {}, F.lit(0.0), F.lit(0.0), F.lit("forming"))
    backed = S.rerank_score(F.lit(0.82), F.lit(0.82), F.lit(5), {"has_authority": F.lit(True), "exact_match": F.lit(True)}, F.lit(0.0), F.lit(0.0), F.lit("forming"))
    assert one(spark, backed) > one(spark, plain)


def test_text_gates(spark):
    gate = lambda t: tuple(one(spark, T.gate_0a(F.lit(t))))
    assert gate("") == ("SKIP", "empty")
    assert gate("a few words") == ("SKIP", "too_short")
    assert gate("word " * 60 + "cookie policy sign in captcha") == ("SKIP", "junk_patterns")
    assert gate(" ".join(f"w{i}" for i in range(100)) + " " + " ".join(f"w{i}" for i in range(101))) == ("SKIP", "repetition")
    assert gate(" ".join(f"w{i}" for i in range(60))) == ("PASS", "")
    assert one(spark, T.clean_boilerplate(F.lit("<p>Hello</p>\nSubscribe now\nEnd"))) == "Hello End"
    assert one(spark, T.repair_fragment(F.lit("- neural network layer"))) == "Neural network layer."
    assert one(spark, T.split_sentences(F.lit("One. Two!  Three? "))) == ["One.", "Two!", "Three?"]


def test_entity_filters_as_their_sql_on_odd_names(spark, tmp_path):
    import duckdb

    from lodeworks.plans import knowledge

    texts = ["A\n", "5\n", "5\r", "A\u2028", "5\u0085", "German\x0bCzech", "ßa", "ŉ", "ᾀ", "ᾈ", "ﬁ", "ΐ", "ǰ", "ꟍ", "é", "\n", "", None]
    rows = [(28 * i + j, t) for i, t in enumerate(texts) for j in range(28)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = c.sql(knowledge.SQL["knw_entity_filters"]).fetchall()
    ours = [tuple(r) for r in knowledge.knw_entity_filters(spark, str(tmp_path)).select("doc_id", "name", "artifact", "languages").collect()]
    assert sorted(ours) == sorted(theirs)


def test_safe_chunks(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(300))
    chunks = one(spark, T.safe_chunks(F.lit(text)))
    assert " ".join(chunks) == text and max(map(len, chunks)) <= 3000
    assert [len(c) for c in one(spark, T.safe_chunks(F.lit("x" * 7000)))] == [3000, 3000, 1000]


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, n string, v double")
    rows = spark.createDataFrame([(1, 9.0, 1), (1, 8.0, 2), (3, 7.0, 1)], "id int, v double, seq int")
    assert sorted(map(tuple, tables.upsert(base, rows, ["id"], "seq").collect())) == [(1, "a", 8.0), (2, "b", 2.0), (3, None, 7.0)]
    with pytest.raises(ValueError):
        tables.delete_where(base, {})
    assert tables.fetch_many(base, {"n": None}).count() == 0
    assert tables.fetch_many(base, {}, limit=0).count() == 2


def test_not_in_with_null_is_empty(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (None,)], "y int")
    assert relational.null_aware_gaps(a, b, "x", "y").count() == 0


def test_lanes_keep_first_and_unkeyed_of_the_first_lane(spark):
    a = spark.createDataFrame([(1, 0), (None, 1)], "id int, pos int")
    b = spark.createDataFrame([(1, 0), (2, 1), (None, 2)], "id int, pos int")
    got = retrieval.merge_lanes([a, b], "id", "pos").collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["lane"]) for r in got) == [(False, 1, 0), (False, 2, 1), (True, 0, 0)]
    assert retrieval.keyword_lane(a.withColumn("t", F.lit("x")), "t", "a an").count() == 0


def test_graph(spark):
    nodes = spark.createDataFrame([(i, 0.5, 0.5) for i in range(1, 7)], "id long, authority double, pressure double")
    edges = spark.createDataFrame([(1, 2, "supports", 0.9), (2, 3, "supports", 0.8), (5, 6, "contradicts", 0.7), (8, 9, "supports", 0.5), (1, 4, "unknown", 0.5)], "src long, dst long, relation string, strength double")
    added = graph.add_edges(nodes, edges.limit(0), edges)
    assert sorted((r["src"], r["dst"]) for r in added.collect()) == [(1, 2), (2, 1), (2, 3), (3, 2), (5, 6), (6, 5)]
    parts = {r["id"]: r["component"] for r in graph.components(added, nodes).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    best = graph.paths(nodes, added, nodes.where("id = 1"), nodes.where("id = 3")).collect()
    assert [r["nodes"] for r in best] == [[1, 2, 3]]
    assert {r["id"] for r in graph.expand(added, nodes.where("id = 1"), 1).collect()} == {1, 2}


def test_greedy_and_nearest(spark):
    rows = [(1, "g", [1.0, 0.0]), (2, "g", [0.99, 0.05]), (3, "g", [0.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, g string, v array<double>")
    got = {r["id"]: r["leader"] for r in vectors.greedy_clusters(v, "g", "id", "v", ["id"], 0.9).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    near = vectors.nearest(v, v.where("id = 1"), "id", "v", 1).collect()
    assert [(r["query"], r["id"]) for r in near] == [(1, 2)]
    assert vectors.nearest(v, v.limit(0), "id", "v", 1).count() == 0
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_mean_similarities_make_no_pairs_of_rows(spark):
    rows = [(0, "a", [1.0, 0.0]), (0, "a", [0.0, 3.0]), (0, "b", [2.0, 0.0]), (0, "b", None), (1, "b", [0.0, -1.0]), (1, "a", [0.0, 5.0]), (2, "c", [1.0, 1.0]), (None, "b", [1.0, 0.0]), (0, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "anchor int, g string, v array<double>")
    assert [tuple(r) for r in vectors.mean_similarities(df, "anchor", "g", "v").collect()] == [("a", "b", 5, 0.0)]
    # Pairs of 20,000 rows with each other would be 100 million.
    many = spark.range(20000).select(F.lit(0).alias("anchor"), (F.col("id") % 2).alias("g"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("v"))
    r = vectors.mean_similarities(many, "anchor", "g", "v").first()
    assert r["pairs"] == 10**8 and round(r["mean"], 9) == round(0.5**0.5, 9)


def test_entities(spark):
    assert one(spark, dedup.canonical_entity(F.lit("The Studies"))) == "Study"
    assert one(spark, dedup.canonical_entity(F.lit("batches"))) == "batch"
    assert one(spark, T.is_artifact(F.lit("10.12/abc"))) and one(spark, T.is_language_list(F.lit("English French German")))
    assert one(spark, T.is_noise_concept(F.lit(" Overview "))) and not one(spark, T.is_noise_concept(F.lit("kernel")))


def test_readers(spark):
    html = "<html><head><title>T</title><meta name='description' content='D'></head><body><nav>Menu entries here</nav><article><h1>Head</h1><p>Body text</p><a href='/x'>go</a></article><script>x()</script></body></html>"
    assert readers.read_html(html) == {"title": "T", "description": "D", "links": [{"href": "/x", "text": "go"}], "content": "Head\nBody text\ngo"}
    assert readers.json_leaves('{"a": ["x", {"b": "y"}], "c": 1}') == ["x", "y"] and readers.json_leaves("no") == []
    text = "word " * 1000
    chunks = readers.chunk_characters(text)
    assert max(map(len, chunks)) <= 2000 and chunks[0].endswith("word")
    assert readers.chunk_characters("") == [] and readers.chunk_sentences([]) == []
    assert readers.chunk_sentences(["a b c", "d e f", "g h"], 4, 3) == ["a b c", "a b c d e f", "d e f g h"]
    assert one(spark, readers.list_items(F.lit("- a\n* b\n1. c"), "bullet")) == ["a", "b"]
    assert [tuple(r) for r in one(spark, readers.code_snippets(F.lit("```py\nx=1\n``` and `y`")))] == [("markdown", "x=1"), ("inline", "y")]


def test_grounding(spark):
    claims = spark.createDataFrame([("Revenue grew by 20 percent", "A1"), ("Revenue fell by 30 percent", "A1"), ("No source", "A9")], "claim string, c string")
    items = spark.createDataFrame([("A1", "The revenue grew 20 percent last year")], "id string, content string")
    got = {r["claim"]: r["valid"] for r in grounding.grounded(claims, items, "claim", "c", "id", "content").collect()}
    assert got == {"Revenue grew by 20 percent": True, "Revenue fell by 30 percent": False, "No source": False}
    seg = one(spark, grounding.citation_segments(F.lit("First claim [A1] second [B2] rest")))
    assert [(s["text"], s["citation"]) for s in seg] == [("First claim", "A1"), ("second", "B2"), ("rest", None)]
    assert one(spark, grounding.repetitions(F.lit("The cat sat down. A dog ran off. The cat sat down now."))) == [2]
    assert one(spark, grounding.polarity_conflict(F.lit("it increases"), F.lit("it decreases")))


def test_pressure_and_budget(spark):
    e = spark.createDataFrame([("m", i, 2.0) for i in range(1, 8)], "m string, i int, b double")
    got = pipelines.budget_pressure(e, "m", ["i"], "b", 100.0).orderBy("i").collect()
    assert [r["level"] for r in got] == ["LOW", "LOW", "HIGH", "HIGH", "CRITICAL", "CRITICAL", "CRITICAL"]
    assert [r["fires"] for r in got] == [True, False, True, False, True, False, False]
    q = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    assert [r["accepted"] for r in pipelines.admit(q, "i", 10, 8).orderBy("i").collect()] == [True, True, False]


def test_registry(spark):
    r = Registry()

    @r.function("twice", "int")
    def twice(x):
        return 2 * x

    with pytest.raises(ValueError):
        r.function("twice", "int")(twice)
    r.install(spark)
    assert spark.sql("SELECT twice(4) AS x").first()["x"] == 8


def test_json_repair():
    assert cognition.repair_json('text {"a": [1, 2') == '{"a": [1, 2]}'
    assert cognition.repair_json('[{"x": "}"},] tail') == '{"atoms": [{"x": "}"}]}'
    assert cognition.repair_json("none") is None


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("t", "http://a.edu/x", "body")], "topic string, url string, content string")
    sinks.write_raw(d, f"{tmp_path}/raw", "topic", "url", "content")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/raw").collect()] == ["<!-- Source: http://a.edu/x -->", "body"]
    sinks.export(d, f"{tmp_path}/json", "json")
    assert spark.read.json(f"{tmp_path}/json").count() == 1
    with pytest.raises(ValueError):
        sinks.export(d, f"{tmp_path}/x", "pdf")
    assert sinks.static_search(d, "body nothing", "url", "content").first()["hits"] == 1
    assert sinks.scraped(d, "url", "content").first()["academic"]


def test_claims_merge_in_order(spark):
    d = spark.createDataFrame([("t", 1, "the sky is very blue", 0.4), ("t", 2, "the sky is very very blue", 0.8), ("t", 3, "grass", 0.5)], "t string, o int, c string, f double")
    got = sorted(map(tuple, cognition.merge_claims(d, "t", "o", "c", "f").collect()))
    assert [(r[1], r[2], round(r[3], 3), r[4]) for r in got] == [("grass", 1, 0.5, 1), ("the sky is very blue", 2, 0.6, 2)]


def test_next_action(spark):
    d = spark.createDataFrame([("a", ["grounding", "verification"], 1), ("b", ["grounding"], 2), ("c", list(cognition.MODES), 0)], "n string, x array<string>, o int")
    assert tuple(cognition.next_action(d, "n", "x", "o").first()) == ("b", "verification")


def test_distil_small_and_large(spark):
    small = "This is an informative sentence about things. " * 3
    assert one(spark, cognition.distil(F.lit(small))) == [small.strip()]
    large = " ".join(f"Sentence number {i} tells of one more thing to know." for i in range(200))
    chunks = one(spark, cognition.distil(F.lit(large)))
    assert len(chunks) == len(range(0, 191, 7)) and chunks[1].startswith("Sentence number 7 ")
    assert one(spark, cognition.distil(F.lit(""))) == []


def test_validators(spark):
    page = "# A study\n\n### Deep\n\n## Up\n\n- one\n\n| a |\n|---|\n\n> said (Smith, 2020): 12.5% on 2024-01-02"
    got = one(spark, validators.validate_source(F.lit(page), F.lit("https://www.mit.edu/x"), "normal"))
    # Host .9; length 98, seven paragraphs, readable, dense; four of seven fields; an indicator.
    n = len(page.split())
    readable = 1 - min(max(sum(map(len, page.split())) / n - 4, 0) / 8, 1)
    parts = len(page) / 1000 + 6 / 10 + readable + 1
    assert got["score"] == pytest.approx(round(0.9 * 0.25 + parts / 4 * 0.35 + 4 / 7 * 0.15 + 0.25, 2)) and got["valid"]
    assert got["hierarchy"] == pytest.approx(2 / 3)
    empty = one(spark, validators.validate_source(F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert (empty["valid"], empty["score"], empty["hierarchy"]) == (False, 0.13, 0.0)
    for text, error in [("short", "Content too short"), (" " * 60, "Empty content"), ("x" * 100_001, "Content too long"), ("x" * 60, "Content quality below threshold")]:
        assert one(spark, validators.validate_content(F.lit(text)))["error"] == error
    rich = one(spark, validators.validate_content(F.lit("# H\n- a\n**b** " + "[1] 5% https://x.y " * 5 + "z" * 1000)))
    assert rich["valid"] and rich["score"] == 1.0


@pytest.mark.parametrize(
    "kind, value, limits, error",
    [
        ("string", "x" * 1000, {}, None), ("string", "x" * 1001, {}, "String too long"), ("string", None, {}, "Value must be a string"), ("boolean", "False", {}, None),
        ("integer", "7", {"max": 6.0}, "Value above the maximum"), ("integer", "7.0", {}, "Value must be an integer"), ("float", "7.0", {"min": 7.0}, None), ("enum", "a", {}, "Enum options must be provided"),
        ("list", "[]", {}, None), ("list", "[]", {"min_items": 1}, "List too short"), ("dict", "[1]", {}, "Value must be a dictionary"), (None, "a", {}, "Invalid value type"),
    ],
)
def test_preference_rules(spark, kind, value, limits, error):
    lit = lambda x: F.lit(x).cast("string") if x is None else F.lit(x)
    check = lambda key, at: validators.validate_preference(F.lit(key), F.lit("content"), lit(kind), lit(value), F.lit("s"), F.lit(0.5), F.lit(at), {k: F.lit(v) for k, v in limits.items()})
    assert one(spark, check("theme", "2024-01-02T03:04:05")) == error
    assert one(spark, check(" ", "2024-01-02")) == "Preference key cannot be empty"
    if error is None:
        assert one(spark, check("theme", "never")) == "Invalid timestamp format"


def _blobs():
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, "g", (rng.normal(0, 0.05, 4) + 3 * (i % 3)).tolist()) for i in range(60)]
    return rows + [(100 + i, "g", (rng.uniform(20, 90, 4)).tolist()) for i in range(4)]


def test_density_clusters(spark):
    schema = "k long, g string, v array<double>"
    more = [(200 + i, "same", [1.0, 2.0]) for i in range(7)] + [(300, "one", [1.0]), (301, "none", None)]
    got = {r["k"]: r["cluster"] for r in density.density_clusters(spark.createDataFrame(_blobs() + more, schema), "g", "k", "v").collect()}
    # Three blobs under their smallest keys; far points, a group that never splits, lone and missing vectors are noise.
    assert got == {i: i % 3 for i in range(60)}
    assert density.density_clusters(spark.createDataFrame([], schema), "g", "k", "v").count() == 0


@pytest.mark.parametrize(("block", "finish"), [(16, 0), (16, 1 << 16), (2048, 40)])
def test_density_clusters_over_blocks(spark, monkeypatch, block, finish):
    """Blobs of several densities, copies and noise over many blocks: as if all were in one task."""
    import numpy as np

    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "FINISH", finish)
    rng = np.random.default_rng(block)
    rows = [(i, "h" if i % 10 < 3 else None, (rng.normal(0, 0.05 * (1 + i % 4), 3) + 4 * (i % 4)).tolist()) for i in range(160)] + [(200 + i, None, rng.uniform(-20, 30, 3).tolist()) for i in range(12)]
    rows += [(300 + i, None, [1.0, 1.0, 1.0]) for i in range(6)] + [(400, "h", None)]
    found = {r["k"]: r["cluster"] for r in density.density_clusters(spark.createDataFrame(rows, "k long, g string, v array<double>"), "g", "k", "v", 4).collect()}
    plain = {}
    for g in ("h", None):
        own = sorted((k, v) for k, h, v in rows if h == g and v)
        points = np.array([v for _, v in own])
        labels = density.condensed_labels(len(own), *density.spanning_edges(points, density.core_distances(points, 4)), 4)
        for c in set(labels) - {-1}:
            members = [k for (k, _), x in zip(own, labels, strict=True) if x == c]
            plain |= {k: min(members) for k in members}
    assert found == plain and len(set(plain.values())) >= 6


def test_density_cells_meet_only_where_needed(spark, monkeypatch):
    """Points of a plane with many copies: as if all were in one task, by far fewer pairs of blocks than there are."""
    import numpy as np

    monkeypatch.setattr(density, "BLOCK", 16)
    met = []
    dealt = density._dealt
    monkeypatch.setattr(density, "_dealt", lambda rows, pairs: met.append(pairs.count()) or dealt(rows, pairs))
    rng = np.random.default_rng(5)
    points = [[10.0 * (i % 6), round(float(rng.uniform(0, 9)), 2)] for i in range(300)]
    rows = [(i, "g", points[i % 300]) for i in range(1200)]
    found = {r["k"]: r["cluster"] for r in density.density_clusters(spark.createDataFrame(rows, "k long, g string, v array<double>"), "g", "k", "v", 5).collect()}
    v = np.array([p for _, _, p in rows])
    labels = density.condensed_labels(len(v), *density.spanning_edges(v, density.core_distances(v, 5)), 5)
    low = {c: int(np.flatnonzero(labels == c)[0]) for c in set(labels.tolist()) - {-1}}
    assert found == {i: low[c] for i, c in enumerate(labels.tolist()) if c >= 0} and len(low) > 6
    # 300 points are 19 blocks at least, with 171 pairs; neighbours, links and further edges meet in fewer.
    assert all(n < 171 / 2 for n in met)


def test_kmeans_finds_blobs(spark):
    rows = [r for r in _blobs() if r[0] < 60]
    got = {r["k"]: r["cluster"] for r in vectors.kmeans(spark.createDataFrame(rows, "k long, g string, v array<double>"), "k", "v", 3).collect()}
    assert len(got) == 60 and len({(i % 3, c) for i, c in got.items()}) == 3
    assert {r["cluster"] for r in vectors.kmeans(spark.createDataFrame(rows[:1], "k long, g string, v array<double>"), "k", "v", 3).collect()} == {0}


def test_idle_activation_is_evicted(spark, tmp_path):
    import time as clock

    for n, rows in enumerate([[(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")], [(2, "2024-01-01 01:00:00")], [(3, "2024-01-20 00:00:00")], [(1, "2024-01-20 01:00:00")]]):
        spark.createDataFrame(rows, "k long, t string").selectExpr("k", "CAST(t AS TIMESTAMP) AS t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        clock.sleep(1.1)
    live = pipelines.activation_stream(pipelines.table_stream(spark, str(tmp_path / "in"), 1), "k", "t")
    seen = []
    query = live.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, n: seen.extend((r["k"], round(r["activation"], 6)) for r in b.collect())).start()
    query.awaitTermination()
    assert seen[-2:] == [(3, 0.5), (1, 0.5)]
    # The states of key 2, idle for good, and of key 1's first time are gone.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    events = spark.read.parquet(str(tmp_path / "in"))
    assert {r["k"]: round(r["activation"], 6) for r in pipelines.activation_batch(events, "k", "t").collect()} == {1: 0.5, 2: 0.995025, 3: 0.5}


def test_activation_batch_folds_many_keys_without_a_frame_for_each(spark):
    rng = random.Random(4)
    uses = [(rng.choice([None, *range(300)]), rng.randrange(4000) * 1800 if rng.random() < 0.95 else None) for _ in range(5000)]
    rows = spark.createDataFrame(uses, "k long, s long").select("k", F.timestamp_seconds("s").alias("t"))
    found = pipelines.activation_batch(rows, "k", "t", 5)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    by_key = {}
    for k, s in uses:
        if s is not None:
            by_key.setdefault(k, []).append(s)
    got = found.collect()
    assert len(got) == len(by_key)
    assert {r["k"]: round(r["activation"], 6) for r in got} == {k: round(pipelines.activation_fold(sorted(v))[0], 6) for k, v in by_key.items()}


def test_table_pattern_fits_the_same_texts():
    import itertools
    import re

    plain, searched = (re.compile(p, re.MULTILINE) for p in (validators.SOURCE_MARKDOWN[3], validators.TABLE))
    for n in range(9):
        for letters in itertools.product("|\n-a", repeat=n):
            text = "".join(letters)
            assert bool(plain.search(text)) == bool(searched.search(text)), text


def test_query_intent_kinds(spark):
    wanted = {
        "Compare Postgres and Spark": "comparative",
        "pros and cons of caching": "comparative",
        "how to build a parser": "procedural",
        "A tutorial, please": "procedural",
        "Why do tides rise": "conceptual",
        "what causes inflation": "conceptual",
        "  What is a monoid": "factual",
        "who was Ada Lovelace": "factual",
        "recent news on batteries": "exploratory",
        "": "exploratory",
    }
    rows = spark.createDataFrame(list(wanted.items()), "q string, want string")
    assert rows.where(T.query_intent(F.col("q")) != F.col("want")).collect() == []


def test_chunk_spans_against_a_plain_cutter():
    """Every cut is after the last newline, else space, of a full chunk's second half; chunks overlap and leave nothing out."""
    import random

    rnd = random.Random(5)
    for _ in range(40):
        text = "".join(rnd.choice("abcdefgh" * 3 + " \n") if rnd.random() < 0.9 else "x" * 40 for _ in range(rnd.randint(0, 900))).replace("\n\n\n", "\n\n")
        size, overlap = rnd.choice([(50, 10), (20, 9), (100, 0)])
        breaks = [[i for i, c in enumerate(text) if c == mark] for mark in "\n "]
        spans = list(readers.chunk_spans(breaks, len(text), size, overlap))
        assert [a for a, _ in spans[1:]] == [b - overlap for _, b in spans[:-1]] and (not text) == (not spans)
        for a, b in spans:
            half = text[a + size // 2 : a + size]
            want = a + size if a + size >= len(text) or not set("\n ") & set(half) else a + size // 2 + max(half.rfind("\n" if "\n" in half else " "), 0) + 1
            assert b == want
        assert not spans or spans[-1][1] - overlap >= len(text)
    with pytest.raises(ValueError):
        next(readers.chunk_spans([[], []], 10, 10, 5))


def test_readable_lines(spark):
    page = "A headline of five words here\n\rSubscribe to us now\ntiny\nRead more about this and that today  second phrase of it\x85Plain words without much"
    assert one(spark, readers.readable_lines(F.lit(page))).split("\n") == ["A headline of five words here", "Read more about this and that today", "second phrase of it", "Plain words without much"]
    assert one(spark, readers.readable_lines(F.lit("Kept before the marker\nMost read stories today\nGone after the marker"))) == "Kept before the marker"
    long = "\n".join(["A line of exactly so many words"] * 20)
    assert one(spark, readers.readable_lines(F.lit(f"{long}\nMost read stories today\nKept after it all"))).endswith("Most read stories today\nKept after it all")
    pages = spark.createDataFrame([(1, "<nav>Menu of the page here</nav><main><p>Some words of the page</p></main>"), (2, None), (3, "")], "id long, html string")
    assert {r["id"]: r["body"] for r in readers.page_texts(pages, "id", "html").collect()} == {1: "Some words of the page", 2: "", 3: ""}


def test_tables_in_texts(spark):
    from lodeworks.sources import text_tables

    rows = [
        (1, "x\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n| 4 |  |\n\n| c |\n| - |\n| 5 |", "markdown"),
        (2, "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><i>2</i></td></tr><tr><td>3</td><td></td></tr><tr><td>4</td></tr></table><table><tr><td>h</td></tr><tr><td>5</td></tr></table>", "html"),
        (3, "no table\n\na, b\n1,2\n3\n\nc,d\n\ne,f\n 6 , 7 ", "csv"), (4, None, "csv"), (5, "a,b\n1,2", None), (6, "a,b\n1,2", "other"), (7, "", "html"), (8, "|" * 5000, "markdown"),
    ]
    df = spark.createDataFrame(rows, "cells long, headers string, kind string")
    found = text_tables.extract_tables(df, "cells", "headers", "kind").toDF("key", "table_no", "row_no", "headers", "found")
    assert sorted((r[0], r[1], r[2], "|".join(r[3]), "|".join(r[4])) for r in found.collect()) == [
        (1, 0, 0, "a|b", "1|2"), (1, 0, 2, "a|b", "4|"), (1, 1, 0, "c", "5"), (2, 0, 0, "a|b", "1|2"), (2, 0, 1, "a|b", "3|"), (2, 1, 0, "h", "5"), (3, 0, 0, "a|b", "1|2"), (3, 1, 0, "e|f", "6|7"),
    ]
    text_tables.register(spark)
    df.createOrReplaceTempView("texts_with_tables")
    assert spark.sql("SELECT t.cells FROM texts_with_tables d, LATERAL tables_in(d.headers, d.kind) t WHERE d.cells = 3").count() == 2


def test_web_sources_take_filters_into_the_scan(spark, tmp_path):
    from lodeworks.sources import web

    rows = [(i, f"https://h{i % 3}.org/p{i}" if i % 4 else f"http://h{i % 3}.org/", "<p>Some words here</p>" if i % 2 else None) for i in range(40)] + [(100, None, "words"), (101, "no host", "é" * 3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    found = web.scrape(spark, f"{tmp_path}/pages.parquet")
    assert found.count() == 42 and {r["page_id"]: (r["host"], r["bytes"]) for r in found.where("page_id >= 100").collect()} == {100: (None, 5), 101: ("", 6)}
    some = found.where("host = 'h1.org' AND page_id < 20 AND length(url) > 5 AND url LIKE 'https%'")
    plan = some._jdf.queryExecution().toString()
    left = [x for x in plan.split("Physical Plan ==")[-1].splitlines() if "Filter" in x and "RuntimeFilters" not in x]
    assert len(left) == 1 and "length(url" in left[0] and "page_id" not in left[0] and "host" not in left[0] and "StartsWith" not in left[0]
    assert sorted(r["page_id"] for r in some.collect()) == [i for i in range(20) if i % 3 == 1 and i % 4]
    hits = web.search(spark, f"{tmp_path}/pages.parquet", "WORDS p words none")
    assert {r["page_id"]: r["hits"] for r in hits.collect()} == {100: 1, **{i: 2 for i in range(40) if i % 2}}
    assert web.search(spark, f"{tmp_path}/pages.parquet", " ").count() == 0


def test_contained_texts(spark):
    """Parts of texts are found without comparing all; short ones, repeats and letter case among them."""
    import random

    rnd = random.Random(3)
    some = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    inner = [some(rnd.randint(1, 5)) for _ in range(40)] + ["", None]
    outer = [some(rnd.randint(1, 12)) for _ in range(60)] + ["", None, "ab", "ab"]
    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "inner string")
    found = sorted(map(tuple, dedup.contained(table(inner), "inner", table(outer).withColumnRenamed("inner", "outer"), "outer").collect()))
    assert found == sorted({(a, b) for a in inner for b in outer if a and b and a in b}) and len(found) > 50
    counts = spark.createDataFrame([("Graph", 9), ("neural", 9), ("rare", 4), ("Kernels", 7), ("overview", 20)], "c string, n long")
    known = spark.createDataFrame([("Deep NEURAL nets",), ("kernel",), (None,)], "t string")
    assert [tuple(r) for r in dedup.emergent_topics(counts, "c", "n", known, "t").collect()] == [("Graph", 9)]
    assert dedup.emergent_topics(counts, "c", "n", known.union(spark.createDataFrame([("",)], "t string")), "t").count() == 0
    assert dedup.emergent_topics(counts, "c", "n", known.limit(0), "t").count() == 3
    merged = dedup.merge_topics(counts, spark.createDataFrame([("Graph", 12), ("new", 5)], "c string, n long"), "c", "n")
    assert {r["c"]: r["n"] for r in merged.collect()} == {"Graph": 12, "neural": 9, "rare": 4, "Kernels": 7, "overview": 20, "new": 5}


def test_completion_asks_again(spark):
    from lodeworks.plans.extensions import Models, completed

    class Once:
        """Refused at first, accepted later."""

        def __init__(self):
            self.n = 0

        def __call__(self, task, prompt):
            self.n += 1
            return f"{task} {self.n}"

    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, t string, p string").coalesce(1)
    assert {r["id"]: r["answer"] for r in completed(rows, "id", "t", "p", Models(complete=Once()), 2, lambda a: a.endswith("3")).collect()} == {1: "a 3", 2: None}
    assert {r["answer"] for r in completed(rows, "id", "t", "p", Models(complete=Once()), 1, lambda a: a.endswith("3")).collect()} == {None}


def test_graph_steps_move_each_edge_once(spark):
    nodes = spark.createDataFrame([(i, i / 10) for i in range(8)], "id long, authority double")
    edges = spark.createDataFrame([(a, b, ["supports", "refines", "contradicts"][(a + b) % 3], 0.5) for a in range(8) for b in range(a)], "src long, dst long, relation string, strength double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    old = spark.createDataFrame([(1, 2, "supports", 0.1), (2, 1, "refines", 0.2), (3, 3, "supports", 0.9)], edges.schema)
    added = graph.add_edges(nodes, old, edges)
    assert plan(added).count("Exchange hashpartitioning") == 1
    last = {(r["src"], r["dst"], r["relation"]): r["strength"] for r in old.collect()}
    for r in edges.collect():
        last |= {(a, b, r["relation"]): 0.5 for a, b in [(r["src"], r["dst"]), (r["dst"], r["src"])][: 1 + (r["relation"] != "refines")]}
    assert {(r["src"], r["dst"], r["relation"]): r["strength"] for r in added.collect()} == last and added.count() == len(last)
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    assert "HashAggregate" not in plan(graph.missing_edges(pairs, edges))
    walked = graph.paths(nodes, edges, nodes.where("id = 0"), nodes.where("id = 7"), 2, 0.5)
    assert "explode" not in plan(walked)
    assert {tuple(r["nodes"]): round(r["score"], 9) for r in walked.collect()} == {
        tuple(p): round(0.25 + 0.2 / (len(p) - 1) + 0.03 * sum(p) / len(p), 9) for p in [[0, 7]] + [[0, i, 7] for i in range(1, 7)]
    }
    assert graph._forest(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).coalesce(1)).count() == 7


def test_rows_of_a_whole_batch_of_texts_are_never_held(spark):
    def rows(text):
        import resource

        return [(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, text * 2000) for _ in range(50)]

    texts = spark.range(5000).coalesce(1).select("id", F.lit("x").alias("text"))
    peak = readers.map_texts(texts, "id", "text", "peak long, chunk string", rows).agg(F.max("peak") - F.min("peak"), F.count("chunk")).first()
    assert peak[1] == 250000 and peak[0] < 200 << 10


def test_redundancy_sorts_no_grams(spark):
    from lodeworks.operators import knowledge

    atoms = spark.createDataFrame([("d", 1, ["a b", "b c"]), ("d", 2, ["b c", "c d"]), ("d", 3, ["a b"]), ("e", 1, ["a b"])], "g string, pos int, sig array<string>")
    found = knowledge.running_redundancy(atoms, "g", "pos", "sig")
    assert found._jdf.queryExecution().executedPlan().toString().count("Window ") == 1
    assert {(r["g"], r["pos"]): round(r["redundancy"], 6) for r in found.collect()} == {("d", 1): 1.0, ("d", 2): round((1 - 1 / 3) ** 2, 6), ("d", 3): round((1 - 1 / 3) ** 2, 6), ("e", 1): 1.0}


def test_scores_evaluate_their_counts_once(spark):
    """Branches share what they count: each pattern occurs once in the expression."""
    text = S.clarity(F.col("t"))._jc.toString()
    assert text.count("regexp_replace") == 2
    assert S.qualifier_quality(F.col("t"))._jc.toString().count("regexp_extract_all") == 1
    assert S.factual_density(F.col("t"))._jc.toString().lower().count("trim(") == 1
    got = one(spark, F.array(S.clarity(F.lit("The cat is in the House.")), S.factual_density(F.lit("The cat is in the House.")), S.qualifier_quality(F.lit("Only if it may"))))
    assert got == pytest.approx([0.35 + 0.35 + 0.08 + 0.15, 2 / 6 * 0.6, 0.74])


def test_repetitions_compare_with_kept_sentences_only(spark):
    """No pair of sentences is intersected in the expression; only kept ones count, empty ones never do."""
    text = "The cat sat down. ... The cat sat up there now. Up there now we go. One two. ..."
    c = grounding.repetitions(F.col("t"))
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string").repartition(1)
    assert [r[0] for r in frame.select(c.alias("r"), "i").orderBy("i").collect()] == [[2], None, []]
    assert "array_intersect" not in frame.select(c)._jdf.queryExecution().toString()


def test_validate_data_parses_an_object_once(spark):
    v = validators.validate_data(F.col("t"), ["k"], {"k": {"type": "numeric", "minimum": 1}, "s": {"type": "string", "constraints": {"length": 2}}})
    assert v._jc.toString().count("try_parse_json") == 1
    frame = spark.createDataFrame([('{"k": 1, "s": "ab"}',), ('{"k": 0}',), ("no",), (None,)], "t string")
    assert [tuple(r[0]) for r in frame.select(v).collect()] == [(True, [], []), (False, [], ["k"]), (False, ["k"], []), (False, ["k"], [])]


def test_extract_tables_takes_batches(spark):
    """One Python call a batch, not one a row; nulls, other formats and texts without a table give no row."""
    frame = spark.createDataFrame([(1, "a,b\n1,2\n3,4", "csv"), (2, None, "csv"), (3, "a,b\n1,2", "none"), (4, "none", "csv"), (None, "x,y\n,5", "csv")], "k long, t string, f string")
    found = text_tables.extract_tables(frame, "k", "t", "f")
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "UDTF" not in plan
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 0, 0, ["a", "b"], ["1", "2"]), (1, 0, 1, ["a", "b"], ["3", "4"]), (None, 0, 0, ["x", "y"], ["", "5"])], key=str)
    assert text_tables.extract_tables(frame.where("k = 4"), "k", "t", "f").collect() == []
