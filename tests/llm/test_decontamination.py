"""Benchmark decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import fmindex


def words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text: str | None, items: list[tuple], window: int) -> tuple:
    w, hit, names = words(text), set(), set()
    for name, t in items:
        p = words(t)
        n = min(window, len(p))
        phrases = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in phrases:
                hit |= set(range(i, i + n))
                names.add("" if name is None else str(name))
    ids = ",".join(sorted(names))
    return len(w), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def made(seed: int) -> tuple[list[tuple], list[tuple]]:
    """Few words, so that phrases occur by chance too; copied passages, nested items, null and repeated ids, odd separators."""
    rnd = random.Random(seed)
    stock = ["a", "b", "Cé", "日本", "d4", "E"]
    some = lambda n: rnd.choice([" ", ", ", "\n\x00", "—_"]).join(rnd.choice(stock) for _ in range(n))
    items = [(i, some(rnd.randint(1, 25))) for i in range(12)] + [(11, some(14)), (None, some(12)), (30, None), (31, " ..."), (9, "E"), (100, "zebra Quagga"), (20, "d4 " * 15)]
    docs = [(i, some(rnd.randint(0, 120))) for i in range(60)]
    docs += [(i, f"x y ZEBRA-quagga {some(3)} {items[i % 12][1].upper()} zebra. x") for i in range(60, 90)]
    docs += [(90, None), (91, ""), (92, "zebra"), (92, "zebra quagga"), (None, "quagga zebra quagga"), (93, "zebra zebra quagga " * 4000), (94, "d4 " * 3000), (95, "w" * 100_000)]
    return docs, items


@pytest.mark.parametrize(("window", "block", "shard"), [(10, 1 << 18, 1 << 20), (10, 1 << 18, 300), (4, 40, 100)])
def test_equals_brute_force(spark, monkeypatch, window, block, shard):
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", block)
    monkeypatch.setattr(fmindex, "SHARD_WORDS", shard)
    monkeypatch.setattr(fmindex, "_PIECE", 64)
    docs, items = made(shard)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS id", "2 AS n_words").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    # The window is a parameter of the general operator; its digests are those of the query.
    found = fmindex.find_contamination(df, bench, window=window, carry=("text",))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    rows = found.select("id", "text__", "n_words", hit, F.size("items"), F.sha2(F.array_join("items", ","), 256), F.size("spans") > 0).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(((i, t, *brute(t, items, window)) for i, t in docs), key=repr)


def test_spans_cut_what_was_hit(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short phrase")]
    docs = [
        (1, "Before: One, two three four five six seven eight nine TEN eleven twelve! after"), (2, "a short—phrase, 日本 short phrase"), (3, "one two three four five six seven eight nine"),
        (4, None), (5, ""), (6, "Three four five six seven eight nine ten eleven twelve"), (7, "short phrase"),
    ]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(7)), spark.createDataFrame(items, "item_id long, text string")
    cleaned = fmindex.decontaminate(df, bench)
    assert cleaned.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {1: "Before: ! after", 2: "a short—phrase, 日本 ", 3: docs[2][1], 4: None, 5: "", 6: "", 7: ""}


def test_without_items(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    for items in ([], [(1, None), (2, "..")]):
        found = fmindex.contamination_digests(df, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert [tuple(r) for r in found] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


@pytest.mark.parametrize("kinds", [2, 3, 9, 300])
def test_index_parts(kinds):
    """Suffix order, ranks and accesses of the wavelet tree, and search, against plain versions."""
    rnd = np.random.default_rng(kinds)
    numbers = rnd.integers(0, kinds, 2000)
    numbers[500:900] = 1
    numbers[-1] = 0
    keys = np.concatenate([numbers + 1, [0]])
    assert suffix_equal(keys)
    tree = fmindex.WaveletTree(numbers, kinds)
    at = rnd.integers(0, 2001, 300)
    symbols = numbers[rnd.integers(0, 2000, 300)]
    assert (tree.rank(symbols, at) == [int((numbers[:i] == s).sum()) for s, i in zip(symbols, at, strict=True)]).all()
    got, before = tree.access(np.arange(2000))
    assert (got == numbers).all() and (before == [int((numbers[:i] == numbers[i]).sum()) for i in range(2000)]).all()
    index = fmindex.ShardIndex(numbers, kinds, 2)
    phrases = np.array([numbers[i : i + 3] for i in range(0, 1990, 7) if (numbers[i : i + 3] > 0).all()] + [[1, 1, kinds - 1]])
    which, place = index.search(phrases)
    plain = {(k, i) for k, p in enumerate(phrases) for i in range(1998) if (numbers[i : i + 3] == p).all()}
    assert set(zip(which.tolist(), place.tolist(), strict=True)) == plain and len(which) == len(plain)


def suffix_equal(keys: np.ndarray) -> bool:
    order = fmindex.suffix_order(keys)
    return sorted(range(len(keys)), key=lambda i: keys[i:].tolist()) == order.tolist()
