"""Training-data operators against brute force, round trips and hand-made edge cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from lodeworks.llm import bpe, components, exact_dedup, langid, orderminhash, packing, pii, queries, sharding, simhash, urlrules, warc

LONG = "lorem ipsum dolor " * 8000
#: Nulls, empty, blank, repeated rows and ids, ties, letter case, other scripts, very long texts, and clashing extra columns.
ROWS = [
    (1, "Same text here now", "x"), (2, "same TEXT here now", "y"), (3, "SAME text here now", None), (4, None, "z"), (5, "", "z"), (6, " \t\n", "z"), (7, LONG, "z"), (8, LONG, "z"), (9, LONG + "!", "z"),
    (10, "ÉCOLE école", "z"), (11, "école ÉCOLE", "z"), (12, "one", "z"), (13, "日本語 😀 text", "z"), (12, "one", "z"), (None, "one", "z"), (None, "alone", None), (15, "a" * 300, "z"), (16, "a" * 301, "z"),
]
SCHEMA = "doc_id long, text string, keep_id string"


@pytest.fixture(scope="module")
def edge(spark):
    # Extra columns bear names that the operators use themselves.
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("fp", F.lit("x")).withColumn("row", F.lit(1)).withColumn("id", F.lit("y")).withColumn("sequence_id", F.lit(0))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ascii_lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


# 1


def brute_print(text: str | None, n: int) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not w:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints: list[int], bits: int) -> list[int]:
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= bits:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_documents(spark, edge):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(ROWS)
    want = {brute_print(t, 3) for _, t, _ in ROWS}
    assert {r["fp"] & (1 << 64) - 1 for r in got} == want
    by_text = {brute_print(t, 3): i for i, t, _ in ROWS if i is not None}
    assert {r["component_id"] for r in got if r["fp"] & (1 << 64) - 1 == brute_print("alone", 3)} == {None}
    assert len(by_text) <= len(want)
    ids = {r["id"]: r["component_id"] for r in got if r["id"] is not None}
    assert ids[2] == ids[3] == ids[1] == 1 and ids[5] == ids[6] == ids[4] == 4 and ids[8] == 7


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_simhash_links_lose_nothing(spark, bits):
    rng = random.Random(bits)
    prints = []
    for _ in range(12):  # families around a centre, some dense
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([3, 10, 90])):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    block = rng.getrandbits(48) << 16
    prints += [block | rng.getrandbits(16) for _ in range(200)] + [0, (1 << 64) - 1, 1 << 63]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    labels = {r["node"]: r["root"] for r in components.component_labels(simhash.fingerprint_links(df, bits)).collect()}
    roots = brute_components(prints, bits)
    ours = [labels.get(s, s) for s in signed]
    groups = {}
    for o, r in zip(ours, roots, strict=True):
        groups.setdefault(o, set()).add(r)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(roots))


def test_simhash_count_filter_rejects_pairs_of_a_list():
    lists = simhash._Lists(2)
    assert len(lists.masks) == 11
    base, mask = 0x0123456789ABCDEF, lists.masks[0]
    free = [p for p in range(8) if not mask >> (8 * p) & 1]
    near = base ^ 1 << (8 * free[0]) ^ 1 << (8 * free[1])
    far = base ^ sum(1 << (8 * p) for p in free)
    bits = base ^ 7 << (8 * free[0])
    diff = np.array([base ^ near, base ^ far, base ^ bits], np.uint64)
    assert not (diff & np.uint64(mask)).any()  # all three share the list's five bytes
    assert lists.enough_shared(diff).tolist() == [True, False, True] and lists.keep(diff, 0).tolist() == [True, False, False]
    for bits in range(9):
        for positions in itertools.combinations(range(8), min(bits, 8)):
            assert any(all(not m >> (8 * p) & 0xFF for p in positions) for m in simhash._masks(bits))


def test_similar_documents(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]
    rows, family = [], {}
    for f in range(12):
        base = [rng.choice(words) for _ in range(400)]
        for c in range(6):
            copy = list(base)
            for _ in range(c):  # up to five words changed: a similarity of at least 0.88
                copy[rng.randrange(400)] = rng.choice(words)
            family[len(rows)] = f
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 400])))) for i in range(200)] + [(2000, None), (2001, " "), (2002, "")]
    got = {r["id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "n long, text string"), "n").collect()}
    assert len(got) == len(rows) and all(got[i] == i for i in got if 1000 <= i < 2000) and got[2001] == got[2002] == 2000
    together = [got[i] == min(j for j in family if family[j] == family[i]) for i in family]
    assert sum(together) >= 0.95 * len(together)
    assert all(family[got[i]] == family[i] for i in family)
    assert simhash.similar_documents(spark.createDataFrame([], "n long, text string"), "n").count() == 0


def brute_groups(texts: dict, similarity: float = 0.8) -> dict:
    def shingles(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if root[a] != root[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_similar_documents_finds_every_pair_near_the_threshold(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = {}
    for _ in range(150):
        base = [word() for _ in range(300)]
        cut = rng.randrange(24, 38)  # similarities of about 0.77 to 0.86
        other = base[: 300 - cut] + [word() for _ in range(cut)]
        for t in (base, other):
            texts[len(texts)] = " ".join(t)
    got = {r["id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "n long, text string"), "n").collect()}
    want = brute_groups(texts)
    assert got == want and 30 < sum(i != r for i, r in want.items()) < 150


def test_similar_documents_compares_members_unlike_the_first(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = {}
    for _ in range(20):
        base = [word() for _ in range(100)]
        parts = [" ".join(base[at : at + 70]) for at in (0, 10, 20, 30)] + [" ".join(base[:at] + base[at + 30 :]) for at in (20, 40, 60)]
        for t in [*parts, " ".join([*base, word()]), " ".join([*base, word()])]:
            texts[len(texts)] = t
    got = {r["id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "n long, text string"), "n").collect()}
    want = brute_groups(texts)
    assert got == want and all(want[i + 8] == want[i + 7] for i in range(0, len(texts), 9))


def test_similar_documents_large_group_at_the_threshold(spark, monkeypatch):
    """Copies of one text of which only some pairs are similar enough: no link is lost, and few pairs are left to compare one by one."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, texts, sizes = [word() for _ in range(200)], {}, []
    for _ in range(300):
        copy = list(base)
        for at in rng.sample(range(200), rng.choice([2, 2, 3, 5])):
            copy[at] = word()
        texts[len(texts)] = " ".join(copy)

    def counted(df, label, path=None):
        out = materialise(df, label, path)
        if label == "similar-pairs":
            sizes.append(out.count())
        return out

    materialise = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", counted)
    got = {r["id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "n long, text string"), "n").collect()}
    want = brute_groups(texts)
    joined = sum(r == 0 for r in want.values())
    assert got == want and 100 < joined < 300
    alone = 300 - joined
    assert len(sizes) == 3 and sizes[1] <= simhash.BRIDGES * 300 and sizes[2] <= 1.1 * (alone * joined + alone * alone / 2)


def test_similar_documents_takes_candidates_from_fingerprints_and_keeps_unlike_texts_in_their_lists(spark, monkeypatch):
    """Near copies are linked by the SimHash index; texts that share a passage only are no pairs."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage, texts, near, pairs = [word() for _ in range(40)], {}, [], []
    for _ in range(60):
        base = [word() for _ in range(120)]
        texts[len(texts)] = " ".join(base[:60] + passage + base[60:])
    for i in range(0, 60, 10):
        texts[len(texts)] = texts[i] + " end"
    links, materialise = simhash.fingerprint_links, simhash.materialise

    def linked(distinct, most_bits=2):
        out = materialise(links(distinct, most_bits), "links")
        near.append((distinct.count(), out.count()))
        return out

    def counted(df, label, path=None):
        out = materialise(df, label, path)
        if label == "similar-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "fingerprint_links", linked)
    monkeypatch.setattr(simhash, "materialise", counted)
    got = {r["id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "n long, text string"), "n").collect()}
    assert got == brute_groups(texts) == {i: i if i < 60 else 10 * (i - 60) for i in texts}
    assert len(near) == 1 and near[0][0] > 60 and near[0][1] > 0
    assert sum(pairs) < 60


def test_similar_documents_makes_no_pair_of_texts_that_share_most_of_a_list_but_too_little(spark, monkeypatch):
    """Three hundred words in common of four hundred are no near copies, though counts by few ranges allow them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage, texts, pairs = [word() for _ in range(300)], {}, []
    for i in range(60):
        texts[i] = " ".join(passage + [word() for _ in range(100)])
    texts |= {60 + i: texts[10 * i] + " end" for i in range(6)}
    materialise = simhash.materialise

    def counted(df, label, path=None):
        out = materialise(df, label, path)
        if label == "similar-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    monkeypatch.setattr(simhash, "COMMON_SHINGLES", 1)
    got = {r["id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "n long, text string"), "n").collect()}
    assert got == brute_groups(texts) == {i: i if i < 60 else 10 * (i - 60) for i in texts}
    assert sum(pairs[1:]) < 60


def test_possible_pairs_are_the_possibly_similar_ones():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([base[: rng.integers(500, 900)], rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)])) for _ in range(40)]
    sets.append(np.full(600, 7, np.uint64))
    counts = np.empty(len(sets), object)
    counts[:] = [simhash.bucket_counts(s) for s in sets]
    a, b = np.triu_indices(len(sets), 1)
    want = [simhash.possibly_similar(np.frombuffer(counts[i], np.uint8), np.frombuffer(counts[j], np.uint8), 0.8) for i, j in zip(a, b)]
    assert simhash.possible_pairs(counts, a, b, 0.8).tolist() == [bool(w) for w in want]
    assert 0 < sum(want) < len(want)
    assert len(simhash.bucket_counts(sets[0], 5)) == 32 and sum(simhash.bucket_counts(sets[0], 5)) == len(sets[0])


def test_fingerprint_of_hashes_is_the_fingerprint():
    for text in (b"", b"a", b"a b c d e f", " ".join(map(str, range(300))).encode(), b"x y " * 40_000):
        hashes = simhash.shingle_hashes(text, 5)
        assert simhash.fingerprint_of(hashes) == simhash.fingerprint(text, 5)
        assert simhash.range_counts(hashes[:200]).sum() == len(hashes[:200])


def test_bucket_counts_rule_out_no_similar_pair():
    rng = np.random.default_rng(7)
    ruled_out = 0
    for _ in range(600):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0, 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n + 1))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        found = simhash.possibly_similar(*(np.frombuffer(simhash.bucket_counts(x), np.uint8) for x in (a, b)), 0.8)
        assert found or same < 0.8 * (len(a) + len(b) - same)
        ruled_out += not found
    assert ruled_out > 400
    full = np.arange(5000, dtype=np.uint64)  # all in one range
    assert simhash.possibly_similar(*(np.frombuffer(simhash.bucket_counts(x), np.uint8) for x in (full, full[:4500])), 0.8)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 7), (10, 9), (9, 8), (8, -5)] + [(100, i) for i in range(101, 200)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.component_labels(edges).collect()}
    assert got == {2: 1, 3: 1, 8: -5, 9: -5, 10: -5} | {i: 100 for i in range(101, 200)}
    assert components.component_labels(edges.limit(0)).count() == 0


# 2


def test_sharding(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=4000, fan_in=2)
    for i in range(6):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(6)) == i))
    before = store.versions()
    many = len(store.manifest()["shards"])
    store.compact()
    assert store.versions()[: len(before)] == before and len(store.manifest()["shards"]) < many
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, store.read().collect())) == sorted(map(key, docs.collect()))
    assert sorted(map(key, store.read(before[-1]).collect())) == sorted(map(key, docs.collect()))
    stale = store.manifest(before[-1])
    with pytest.raises(RuntimeError):
        store._commit(stale | {"version": before[-1]}, stale["shards"], stale["schema"])
    assert store.read_with_shards().select("_shard").distinct().count() == len(store.manifest()["shards"])


def test_shard_documents_compacts_at_any_size(spark, tmp_path, documents):
    for n, docs in enumerate((documents, documents.limit(30))):
        store = sharding.shard_documents(docs, f"file://{tmp_path}/{n}")
        versions = store.versions()
        assert len(versions) >= 9 and len(store.manifest()["shards"]) < len(store.manifest(versions[-2])["shards"]) and store.read().count() == docs.count()


def test_sharding_merges_each_run_into_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RUNS_PER_JOB", 2)
    docs = spark.range(6000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000, fan_in=3)
    store.append_parts(docs.where("id < 4000").repartition(10), F.col("id") % 2, 2)
    store.append(docs.where("id >= 4000").repartition(4))
    before, version = store.manifest(), store.versions()[-1]
    assert len(store.versions()) == 3 and len(before["shards"]) == 24
    runs = store.plan(before["shards"])
    assert len(runs) > 3 and all(len({store.tier(s["bytes"]) for s in run}) == 1 and len(run) > 1 for run in runs)
    store.compact()
    after = store.manifest(version + 1)["shards"]
    new = [s for s in after if s not in before["shards"]]
    assert len(new) == len(runs)
    ids = lambda shards: {r["id"] for r in store.read_files(shards, before["schema"]).collect()}
    assert sorted(map(sorted, map(ids, runs))) == sorted(sorted(ids([s])) for s in new)
    assert store.read().count() == 6000 and ids(store.manifest()["shards"]) == set(range(6000)) and not store.plan(store.manifest()["shards"])


# 3


PAGES = [(1, "http://a/é b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "日本" * 30000), (6, "", "<p>y</p>"), (None, "http://e", "<p>x</p>"), (2, "http://f", "<p>x</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("same", F.lit(1)).withColumn("keep", F.lit(2))
    got = warc.archive_pages(pages, least_bytes=least).collect()
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        body = (html or "").encode()
        keep = max(j for j, _, h in PAGES if (h or "") == (html or "") and j is not None)
        revisit = i != keep and len(body) >= least
        rows = [r for r in got if r["record_id"] == i]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for r in rows:
            assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body), digest, "revisit" if revisit else "response", keep if revisit else None)


def test_warc_ignores_files_of_other_attempts(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    whole = sorted(map(repr, warc.archive_pages(pages, path=path).collect()))
    # What a lost attempt at a task, or an earlier run, leaves in the folder.
    stale = next((tmp_path / "w").glob("*.warc.zst"))
    (tmp_path / "w" / "part-000000-0009-stale.warc.zst").write_bytes(stale.read_bytes())
    assert warc.read_archives(spark, path).count() > len(PAGES)
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)  # the join that shuffles
    assert sorted(map(repr, warc.archive_pages(pages, path=path).collect())) == whole
    rows = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    manifest = warc.materialise(warc.write_archives(rows, path, shard_bytes=1), "test-manifest")
    back = warc.read_manifest(manifest, path, with_payload=True).collect()
    assert Counter((r["record_id"], bytes(r["payload"]).decode()) for r in back) == Counter((i, h or "") for i, _, h in PAGES)
    with pytest.raises(Exception, match="where the manifest has"):
        warc.read_manifest(manifest.withColumn("records", F.col("records") + 1), path).collect()


def test_warc_validation():
    records = [warc.format_record(i, f"http://x/{i}", b"<html>%d</html>" % i * 50, "response", None) for i in range(100)]
    w = warc.ArchiveWriter(records)
    for r in records:
        w.add(r)
    data = b"".join(w.frames)
    assert list(warc.iterate_records(data)) == records
    assert warc.parse_record(records[3])["payload"] == b"<html>3</html>" * 50
    with pytest.raises(ValueError):
        list(warc.iterate_records(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.iterate_records(data[8:]))
    for wrong in (records[0][:-1], records[0].replace(b"WARC-Date", b"X-Date"), records[0].replace(b"<html>0", b"<html>1", 1), records[0].replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            warc.parse_record(wrong)


# 4


def test_language_forward_sums_all_segmentations():
    m = langid.fit_unigrams({"a": {"▁abab": 5, "▁ba": 3, "▁xyz": 1}, "b": {"▁ba": 7, "zz": 4}}, ["a", "b", "ab", "ba", "▁", "▁a", "▁b", "bab", "z"])

    def brute(word, k):
        w, total = "▁" + word, 0.0
        for cut in itertools.product([0, 1], repeat=len(w) - 1):
            parts = "".join(c + ("|" if x else "") for c, x in zip(w, [*cut, 0], strict=True)).split("|")
            p = 1.0
            for q in parts:
                p *= math.exp(m.logs[m.index[q], k]) if q in m.index else math.exp(m.other) if len(q) == 1 else 0.0
            total += p
        return math.log(total)

    words = ["abab", "b", "xyz", "zzab", "q"]
    got = m.score_words(words)
    assert np.allclose(got, [[brute(w, k) for k in range(2)] for w in words])
    assert np.allclose(m.score_long_words(words), got)


def test_language_long_words_sum_over_block_borders(monkeypatch):
    m = langid.fit_unigrams({"a": {"▁abab": 5, "ba": 3}, "b": {"▁ba": 7, "bab": 4}}, ["a", "b", "ab", "ba", "▁", "▁a", "bab", "abab"])
    rng = random.Random(4)
    words = ["".join(rng.choice("abq") for _ in range(n)) for n in (30, 1500, 25, 400, 31)]

    def brute(word, k):  # logs throughout, one word at a time
        w = "▁" + word
        ahead = [0.0] + [-math.inf] * len(w)
        for end in range(1, len(w) + 1):
            terms = [ahead[s] + m.logs[m.index[w[s:end]], k] for s in range(max(0, end - 4), end) if w[s:end] in m.index]
            if w[end - 1] not in m.index:
                terms.append(ahead[end - 1] + m.other)
            top = max(terms)
            ahead[end] = top + math.log(sum(math.exp(t - top) for t in terms))
        return ahead[-1]

    want = [[brute(w, k) for k in range(2)] for w in words]
    assert np.allclose(m.score_long_words(words), want)
    monkeypatch.setattr(langid, "LONG_LETTERS", 70)
    assert np.allclose(m.score_long_words(words), want)
    table = langid.WordTable(m)
    short, whole = table.classify(["ab ba"]), table.classify(["ab " + words[1] + " ba", words[1]])
    assert all(len(w) <= langid.BLOCK for w in table.place) and len(whole) == 2 and short[0][0] in "ab"


def test_language_learns_unspaced_scripts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        lang, letters = (("x", "日本語文章今天") if i % 2 else ("y", "中国話題明星今天"))
        rows.append((i, "".join(rng.choice(letters) for _ in range(1200)), lang, 0.5, "z"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.learn(df.where("doc_id < 60"), sorted({c for r in rows for c in r[1]} | {"▁", "日本", "今天", "明星"}))
    got = langid.identify(df.where("doc_id >= 60"), model, keep=("doc_id", "lang", "score", "lang_pred")).collect()
    assert all(r["lang"] == r["lang_pred"] and r["score__"] == 0.5 and r["lang_pred__"] == "z" for r in got) and len(got) == 60


def test_language_accuracy_and_edges(spark, documents, edge):
    pieces = langid.vocabulary(P.path("piece_bpe_32k.model"))
    held = (F.crc32(F.col("doc_id").cast("string")) % 3) == 1
    model = langid.learn(documents.where(~held), pieces)
    got = langid.identify(documents, model, keep=("doc_id", "lang")).where(held).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    e = langid.identify(edge, model, keep=("doc_id", "text", "keep_id")).collect()
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in e) and len(e) == len(ROWS)
    none = langid.learn(documents.limit(0), pieces)
    assert {r["lang_pred"] for r in langid.identify(edge, none).collect()} == {"und"}


def test_language_sample_keeps_labels_of_many_copies(spark):
    texts = [(f"aa bb{i:02d} cc", "x") for i in range(2)] * 2000 + [("dd ee ff", "y")] * 4000 + [(f"gg hh{i:04d}", "z") for i in range(900)]
    df = spark.createDataFrame(texts, "text string, lang string")
    order = F.when(F.col("label") == "x", F.lit(-1) - F.length("text")).otherwise(F.xxhash64("text"))
    pieces = [*"abcdefgh0123456789", "▁"]
    assert langid.learn(df, pieces, rows_per_language=4).languages == ["x", "y", "z"]
    assert langid.learn(df, pieces, order=order, rows_per_language=4).languages == ["x", "y", "z"]
    alone, copied = (langid.learn(d, pieces, rows_per_language=1500) for d in (df.distinct(), df))
    assert np.array_equal(alone.logs, copied.logs)


# 5


def test_url_rules_brute(spark):
    rng = random.Random(5)
    hosts = ["com", "net", "a.com", "b.a.com", "xa.com", "c.net", "COM", "a.com:80", ""]
    paths = ["", "/", "/en/", "/en/x", "/e", "/es/y?q=/en/", "/en#f", "?x", "/日/é"]
    urls = [(i, rng.choice(["http://", "https://", "", "x://"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(600)] + [(1000, None), (1001, ""), (1002, "http://a.com/en/"), (1002, "http://a.com/en/")]
    rules = [("allow", "com", "/"), ("block", "a.com", "/en/"), ("allow", "b.a.com", "/e"), ("block", "net", ""), ("block", "com", "/es/"), ("allow", "com", "/es/"), ("block", "", "/日"), ("allow", "a.com", "/en/x")]
    got = urlrules.judge_urls(spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit(0)).withColumn("host", F.lit(0)), urlrules.rule_table(spark, rules)).collect()
    assert len(got) == len(urls)
    want = Counter()
    for i, u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = ascii_lower(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or (h and host.endswith("." + h))) and path.startswith(p)] if host else []
        best = max(fits) if fits else None
        want[i, host, path, best[2] if best else None, best[3] if best else "allow"] += 1
    assert Counter((r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want


def test_url_rules_nested_deeply_over_many_partitions(spark):
    rng = random.Random(55)
    letters = "ab/"
    rules = list({(rng.choice(["allow", "block"]), rng.choice(["com", "a.com", "b.a.com"]), "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))) for _ in range(250)})
    rules = list({(h, p): (a, h, p) for a, h, p in sorted(rules)}.values())
    urls = [(i, "http://" + rng.choice(["com", "a.com", "c.a.com", "b.a.com", "x.b.a.com"]) + "/" + "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))) for i in range(1500)]
    urls += [(2000 + i, f"http://h{i}.com/") for i in range(300)]  # a common (suffix, path)
    table = spark.createDataFrame([(a, h, "/" + p) for a, h, p in rules], "action string, rule_host string, rule_path string")
    got = {r["id"]: (r["rule"], r["verdict"]) for r in urlrules.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), table).collect()}
    for i, u in urls:
        host, path = u[7:].split("/", 1)
        fits = [(len(h + p), len(h), f"{h}/{p}", a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow"))


def test_url_rules_common_keys_are_not_gathered(spark):
    left = spark.range(10_000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.when(F.col("k") != "9", F.struct(F.length("k").alias("x"))))
    got = urlrules._attach(left, right, ["k"], 10_000, 8).collect()
    assert len(got) == 10_000 and all((r["own"]["x"] == len(r["k"])) if r["k"] != "9" else r["own"] is None for r in got)
    rare = right.where("n <= 10000 div 64")
    assert rare.where("k = 'hot'").isEmpty() and right.where("n > 10000 div 64").count() < 64


def test_url_rules_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = urlrules.rule_table(spark, [("block", "a.com", "/")]).limit(0)
    assert [tuple(r) for r in urlrules.judge_urls(pages, rules).collect()] == [(1, "a.com", "/", None, "allow")]


# 6


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 if kind == "card" else True
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_brute(spark, edge):
    rng = random.Random(6)
    parts = ["a", "@", ".", "-", " ", "1", "4", "+", "(", "555", "1.2.3.4", "é", "😀", "a@b.c", "..", "4111 1111 1111 1111", "25", "+1 (555) 555-1234", "_", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(5000, None), (5001, "1 " * 3000), (5002, "a." * 4000 + "@b" + ".c" * 3000), (5003, "1" * 10000), (5004, "a" * 20000)]
    got = pii.identifier_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_id = {r["id"]: r for r in got}
    for i, t in rows:
        spans = base_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert by_id[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(by_id[i]["spans"].split(",")) | {""}
    assert pii.identifier_digests(edge).count() == len(ROWS)


def test_pii_bootstraps_from_contexts(spark):
    rows = [(i, f"Please call me at +1 555 555 {1000 + i} today") for i in range(20)]
    rows += [(100, "Please call me at 555-555-9999 today"), (101, "an order 555-555-8888 now"), (102, None)]
    got = {r["id"]: r["spans"] for r in pii.identifier_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:18:30" and got[101] == "" and got[102] == "" and got[0] == "phone:18:33"


def test_pii_bootstraps_over_two_hops(spark):
    """A second context occurs with no base match: strings found by the first one make it trusted, and it finds further ones."""
    number = lambda i: f"{200 + i}-{300 + 7 * i % 600}-{1000 + 13 * i}"
    rows = [(i, f"Please call me at +1 555 555 {1000 + i} today") for i in range(24)]
    rows += [(100 + i, f"Please call me at {number(i)} today") for i in range(6)]
    rows += [(200 + i, f"the hotline under {number(i)} answers") for i in range(6)]
    rows += [(300 + i, f"the hotline under {number(50 + i)} answers") for i in range(4)]
    # A third hop by what the second found, and contexts of other strings, some with a base match or a known string.
    rows += [(400 + i, f"our desk via {number(50 + i)} helps") for i in range(4)] + [(410 + i, f"our desk via {number(80 + i)} helps") for i in range(2)]
    rows += [(500 + i, f"order number {number(100 + i)} was shipped") for i in range(40)] + [(600, f"order number {number(1)} was shipped"), (601, "order number +1 555 555 4444 was shipped")]
    got = {r["id"]: r["spans"] for r in pii.identifier_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(24)) and all(got[100 + i] == "phone:18:30" for i in range(6))
    assert all(got[i] == "phone:18:30" for i in [*range(200, 206), *range(300, 304)])
    assert all(got[i] == "phone:13:25" for i in [*range(400, 404), 410, 411])
    assert not any(got[i] for i in [*range(500, 540), 600]) and got[601] == "phone:13:28"


def test_pii_finds_planted_unseen_identifiers(spark):
    rng = random.Random(66)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    seen = {"email": lambda: f"{w()}@{w()}.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "phone": lambda: f"+1 {rng.randrange(200, 999)} {d(3)} {d(4)}"}
    dashed = lambda: f"{rng.randrange(200, 999)}-{d(3)}-{d(4)}"
    unseen = {"email": lambda: f"{w()} (at) {w()} (dot) com", "ip": lambda: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)), "phone": dashed}
    other = {"email": lambda: f"meet {w()} [at] {w()}. {w()}", "ip": lambda: f"{rng.randrange(10, 24)}:{d(2)}:{d(2)}:{d(2)}", "phone": dashed}
    places = {
        "email": ["you can write to {} with questions", "contact our editor {} for details"], "ip": ["the request came from {} last night", "blocked address {} was logged"],
        "phone": ["please call me at {} today", "fax or phone number {} during office hours"],
    }
    elsewhere = {"email": ["we will {} tomorrow"], "ip": ["the clip runs from {} onwards", "lap time {} was best"], "phone": ["order number {} was shipped", "the part {} is out of stock"]}
    rows, planted, decoys = [], [], []

    def add(form, value, into=None):
        text = " ".join(w() for _ in range(rng.randrange(3, 9))) + ". " + form.format(value) + ". " + w()
        if into is not None:
            into.append((len(rows), text.index(value), text.index(value) + len(value)))
        rows.append((len(rows), text))

    for kind, forms in places.items():
        for form in forms:
            for k in range(24):
                if k % 3:
                    add(form, seen[kind]())
                else:
                    add(form, unseen[kind](), planted)
    for kind, forms in elsewhere.items():
        for form in forms:
            for k in range(20):
                add(form, other[kind](), decoys)
                if k < 3:  # contexts with some seeds but many more strings of another nature
                    add(form, seen[kind]())
    got = {r["id"]: {tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s} for r in pii.identifier_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit, wrong = (sum((a, b) in got[i] for i, a, b in cases) for cases in (planted, decoys))
    assert len(planted) == 48 and len(decoys) == 100 and hit >= 0.9 * len(planted) and wrong <= 0.05 * len(decoys)


def test_pii_many_matches_in_one_text(spark):
    texts = ["4111-1 " * 20_000, "1.2.3.4 " * 20_000, "é a@b.co, +1 555 555 1000; 555-555-1000 " * 3000]
    got = pii.find_identifiers(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", ("id", "text")).select("id", "base", pii.redact(F.col("text"), F.col("spans")).alias("clean")).collect()
    for r in got:
        assert [tuple(s) for s in r["base"]] == base_spans(texts[r["id"]])
    clean = {r["id"]: r["clean"] for r in got}
    assert clean[1] == "<IP> " * 20_000 and "@" not in clean[2] and clean[2].count("<PHONE>") >= 3000


def test_replace_spans_brute(spark):
    rng = random.Random(67)
    rows = []
    for _ in range(200):
        text = "".join(rng.choice("aé😀 ") for _ in range(rng.choice([0, 5, 1023, 1024, 1025, 2600])))
        starts = sorted(rng.randrange(len(text)) for _ in range(rng.randint(0, 6))) if text else []
        rows.append((text, [(a, rng.randrange(4), min(len(text), a + rng.randint(1, 900))) for a in starts]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,kind:int,end:int>>")
    for r in df.select("text", "spans", pii.redact(F.col("text"), F.col("spans")).alias("got")).collect():
        want, at = "", 0
        for a, k, b in r["spans"]:
            if a >= at:
                want += r["text"][at:a] + f"<{pii.KINDS[k].upper()}>"
            at = max(at, b)
        assert r["got"] == want + r["text"][at:]


def test_redact(spark):
    x = spark.createDataFrame([("call +1 555 555 1000 or a@b.co now 😀",), ("plain",), (None,)], "text string")
    got = [r["t"] for r in pii.find_identifiers(x, "text", ("text",)).select(pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()]
    assert sorted(got, key=str) == ["None" and None, "call <PHONE> or <EMAIL> now 😀", "plain"] or set(got) == {None, "call <PHONE> or <EMAIL> now 😀", "plain"}


# 7


@pytest.mark.parametrize("demand", [{5: 3}, {2048: 4, 1: 7}, {700: 300, 650: 250, 1300: 200}, {n: n % 5 + 1 for n in range(1, 2000, 7)}, {1025: 10, 1024: 10, 1023: 3}, {}])
def test_plan_holds_every_piece_once(demand):
    got, bins = Counter(), 0
    for config, times in packing.plan_sequences(demand):
        assert times > 0 and sum(n * k for n, k in config) <= 2048
        bins += times
        for n, k in config:
            got[n] += k * times
    assert got == Counter({n: k for n, k in demand.items() if k})
    rooms: list[int] = []
    for n in sorted(Counter(demand).elements(), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(2048 - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    assert bins <= len(rooms) * 1.02 + 1


def test_packing(spark, edge):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [*ROWS, (20, "<|endoftext|> x", "z"), (21, "a <|startoftext|>b <|ENDOFTEXT|> <|end", "z")]
    edge = edge.unionByName(spark.createDataFrame(rows[-2:], SCHEMA), allowMissingColumns=True)
    want = Counter()
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            want[i, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    got = packing.pack_documents(edge, P.path("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_word_tokens_equal_the_library():
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        w = packing.WordTokens(f.read())
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for text in ("<|endoftext|> x", "x<|endoftext|>y", "<|ENDOFTEXT|>", "  <|startoftext|> É 12"):
        assert next(iter(w.batch([text]))) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    rng = random.Random(7)
    parts = ["a", "B", "É", "1", "12", ".", ",", "'s", "'", "|", "!", " ", "\n", "ß", "é", "́", "İ", "日", "_", "-", ";", "Σ", "<|endoftext|>", "\x1c", "x" * 70]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert next(iter(w.batch([text]))) == w.whole(text).tobytes()
    letters = [chr(c) for c in range(0x41, 0x260) if chr(c).isalpha()]
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        assert next(iter(w.batch([text]))) == w.whole(text).tobytes(), text


# 8


@pytest.mark.parametrize("most", [64, 32 << 20])
def test_exact_dedup(spark, edge, most, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_BYTES", 16)
    got = exact_dedup.exact_duplicates(edge, first_digit=4, most_bytes=most).collect()
    assert len(got) == len(ROWS)
    classes: dict[str, list] = {}
    for i, t, _ in ROWS:
        classes.setdefault(ascii_lower(t or ""), []).append(i)
    want = Counter()
    for text, ids in classes.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, top, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["sha"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(classes) and all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_carries_rows(spark, edge):
    plain = exact_dedup.exact_duplicates(edge).select("id", "keep_id", "group_size", "kept", "sha")
    got = exact_dedup.exact_duplicates(edge, carry=("text", "keep_id", "doc_id"))
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.select(plain.columns).collect())) == sorted(map(key, plain.collect()))
    kept = got.where("kept").collect()
    assert all(r["doc_id__"] == r["id"] and hashlib.sha256(ascii_lower(r["text__"] or "").encode()).hexdigest() == r["sha"] for r in kept)


def test_radix_classes():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 8, 16, 40]))) for _ in range(400)]
    first = exact_dedup.radix_classes(texts)
    assert all(texts[f] == t and texts.index(t) == f for t, f in zip(texts, first, strict=True))


# 9


def test_bpe_equals_the_library(spark, edge):
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.TextCodec(ranks, P.PATTERN)
    rng = random.Random(9)
    parts = ["a", "b", " ", "  ", "\n", "\t", "1", "'s", "é", "日", "\x1c", "\xa0", "!", "the", "ing", "A", "😀", "　", "aaaa"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, "theing" * 900, " " * 3000, "日" * 1000, "".join(rng.choice("abcdeing") for _ in range(8000))]
    for t in texts:
        ids = codec.encode(t)
        assert ids == enc.encode_ordinary(t) and codec.monoid.decode(ids) == t.encode()
    left, right = codec.monoid.encode(b"theing" * 50), codec.monoid.encode(b"ingthe" * 50)
    assert codec.monoid.join(left, right) == codec.monoid.merge(b"theing" * 50 + b"ingthe" * 50)
    encoded = bpe.encode_texts(edge, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe.decode_ids(encoded, P.path("byte_bpe_50k.tiktoken")).collect()
    assert Counter((r["id"], bytes(r["body"]).decode()) for r in back) == Counter((i, t or "") for i, t, _ in ROWS)
    got = {r["ids_sha256"]: r["n_tokens"] for r in bpe.encoding_digests(edge, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got == {hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(): len(ids) for ids in (enc.encode_ordinary(t or "") for _, t, _ in ROWS)}


# 10


def brute_signature(text: str, size: int = 2, bits: int = 24) -> list[int]:
    """Every hash function applied to every numbered k-mer, over the documented layout of hash and position."""
    import regex
    import xxhash

    low = (1 << bits) - 1

    def mask(x):
        return x & ~low

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    alone = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    tokens = regex.findall(rf"[{alone}]|[^ \t\n\x0b\f\r{alone}]{{1,16}}", text)
    if not tokens:
        return []

    def chain(strings):
        h = 42
        for s in strings:
            h = xxhash.xxh64_intdigest(s.encode(), h)
        return signed(h)

    def long_hash(x, seed):
        return xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)

    def int_hash(x, seed):
        return xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed)

    stretch = 1
    while len(tokens) > (1 << bits) * stretch:
        stretch *= 2
    kmers = [(mask(chain(tokens[i : i + 2])), i // stretch) for i in range(max(1, len(tokens) - 1))]
    seen: Counter = Counter()
    pairs = []
    for h, i in kmers:
        pairs.append((mask(signed(int_hash(seen[h], long_hash(h, 42)))) | i) + (1 << 63))
        seen[h] += 1
    out = []
    for j in range(64):
        minimal = sorted(pairs, key=lambda x: (x - (j << 58)) % (1 << 64))[:size]
        h = 42
        for x in sorted(minimal, key=lambda x: (x & low, signed(mask(x - (1 << 63)) & (1 << 64) - 1))):
            h = long_hash(mask(x - (1 << 63)), h)
        out.append(j * 65536 + (h & 0xFFFF))
    return out


def test_order_minhash_of_texts_beyond_its_positions(spark, documents, monkeypatch):
    """With eight bits of position, texts of thousands of tokens keep their order by stretches; moved halves still tell."""
    monkeypatch.setattr(orderminhash, "_POSITION_BITS", 8)
    monkeypatch.setattr(orderminhash, "_POSITION", 255)
    texts = [" ".join(f"w{i * i % 997}" for i in range(n)) for n in (255, 256, 257, 258, 700, 5000)] + ["x y " * 900]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(orderminhash.order_minhash(F.col("text"))).collect()
    assert [list(r[0]) for r in got] == [brute_signature(t, bits=8) for t in texts]
    words = [f"v{i}" for i in range(4000)]
    a, b = " ".join(words), " ".join(words[2000:] + words[:2000])
    like = spark.createDataFrame([(a, b)], "a string, b string").select(orderminhash.likeness(*[orderminhash.order_minhash(F.col(c)) for c in "ab"])).first()[0]
    assert 0.2 < like < 0.8


def test_order_minhash_brute(spark, documents):
    texts = [r["text"] for r in documents.limit(60).collect()] + ["", " ", "one", "two words", "a b c", "x y " * 50, "z" * 100, "日本語 " * 20, "日本語の文章です", "a b a b a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("sig", orderminhash.order_minhash(F.col("text")))
    for r in df.collect():
        assert r["sig"] == brute_signature(r["text"] or "")


def test_order_minhash_is_sensitive_to_edits_and_to_order(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(200):
        base = [word() for _ in range(rng.choice([12, 40, 300]))]
        few = list(base)
        for _ in range(max(1, len(base) // 40)):
            few[rng.randrange(len(few))] = word()
        at = len(base) // 2
        many = [w if rng.random() < 0.7 else word() for w in base]
        blocks = [base[k : k + 4] for k in range(0, len(base), 4)]
        rng.shuffle(blocks)
        rows.append((i, *[" ".join(x) for x in (base, few, base[:at] + [word() for _ in base[at:]], many, sum(blocks, []), [word() for _ in base])]))
    names = ["base", "few", "half", "many", "moved", "other"]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    like = df.select(*[orderminhash.likeness(orderminhash.order_minhash(F.col("base")), orderminhash.order_minhash(F.col(n))).alias(n) for n in names]).toPandas().mean()
    assert like.base == 1 and like.few > 0.65 and like.few > like.half > 0.05 and like.few > like.many > like.other and like.few > like.moved and like.other < 0.01
    # Texts with the same k-mers in another order share sets but not the order of tuples.
    assert like.moved < 0.6


def test_edited_fingerprints(spark, edge, documents):
    rows = [(i, t) for i, t, _ in ROWS]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    got = orderminhash.edited_fingerprints(edge).collect()
    assert Counter((r["id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert {len(r["fingerprint"]) for r in got} == {0, 256}
    d = orderminhash.edited_fingerprints(documents).toPandas()
    assert d.near_edited.mean() > d.near_next.mean() + 0.05
    cjk = spark.createDataFrame([(2, "日本語の文章です今日は天気が良い"), (1, "全く違う文です")], "doc_id long, text string")
    assert min(r["near_edited"] for r in orderminhash.edited_fingerprints(cjk).collect()) > 0


# Pipeline


def test_pipeline(spark, documents):
    import corpus_pipeline as C

    extra = spark.createDataFrame([(10_001, None, None, "src0", 0), (10_002, "12 34", "en", "src0", 5), (10_003, "Write to me@example.com please, thank you all", "en", "src0", 45)], documents.schema)
    # Repeated rows and ids, and columns named like those that operators add.
    extra = extra.unionByName(extra)
    docs = documents.unionByName(extra)
    for c in ("score", "lang_pred", "spans", "base", "id", "row", "__row", "__text", "col_0", "kept"):
        docs = docs.withColumn(c, F.when(F.col("doc_id") % 2 == 0, F.lit(c)))
    columns = docs.columns
    sizes = []
    for _, stage in C.STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        sizes.append(docs.count())
    rows = docs.collect()
    texts = [r["text"] for r in rows]
    assert len({ascii_lower(t) for t in texts}) == len(texts) and not any("me@example.com" in t for t in texts)
    assert sizes[0] == documents.count() + 2 and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2]
    assert all(r[c] == (c if r["doc_id"] % 2 == 0 else None) for r in rows for c in ("score", "spans", "base", "row", "col_0"))
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[3]


def test_pipeline_near_stage_equals_brute_force(spark, documents):
    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").limit(400)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in C.near_stage(spark, docs, SF).collect()}
    groups = {}
    for i, root in brute_groups({i: ascii_lower(t) for i, t in texts.items()}).items():
        groups.setdefault(root, set()).add(i)
    assert all(len(g & kept) == 1 for g in groups.values())


def test_pipeline_run_leaves_only_what_the_result_needs(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C

    from lodeworks.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = C.run(spark, SF).collect()
    assert got and sorted(p.name.split("-")[0] for p in (tmp_path / "scratch").iterdir()) == ["pieces", "privacy"]


def test_entry_module_without_a_library(monkeypatch):
    import sys

    import __spark_entry__ as entry

    assert {"op1_simhash", "pipeline"} <= set(entry.queries())
    for name in [m for m in sys.modules if m.startswith(("lodeworks.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.warns(UserWarning, match="corpus_pipeline is left out"):
        found = entry.queries()
    assert "pipeline" not in found and "ret_keyword" in found and len(found) >= 206
