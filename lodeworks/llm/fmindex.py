"""Benchmark decontamination: an FM-index for every shard of training text, searched with all phrases of a benchmark.

A phrase is a window of ``WINDOW`` consecutive words of an item (a shorter item is one phrase). A shard is a bounded run
of a partition's documents. Its index is over word numbers of the phrases' vocabulary: any other word ends a stretch, and
stretches too short for the shortest phrase are left out, since no phrase can occur there. Backward search by ranks in a
wavelet tree narrows all phrases at once; occurrences are located by stepping to the next sampled suffix position; spans
of occurrences are merged. The phrases are a query set against all rows: they are taken in blocks of bounded size, and
only one block is broadcast at a time. No text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Words of a phrase.
WINDOW = 10
#: Words of benchmark items in one broadcast block, and of training text in one index.
BLOCK_WORDS = 1 << 18
SHARD_WORDS = 1 << 20
#: Every so many positions of the indexed text have their suffix position stored.
SAMPLE = 8
#: Bytes of a text that are split into words at a time.
_PIECE = 1 << 24

#: A word is a run of ASCII letters, digits and all that is not ASCII; A-Z become a-z, other bytes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

FOUND = "n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


class Bits:
    """A bit vector with constant-time counts of the ones before a position."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def ones(self, upto: np.ndarray) -> np.ndarray:
        word = upto >> 6
        low = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """Symbols by bits from the highest; each level is stably parted into zeros and ones."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.depth = max(1, int(kinds - 1).bit_length())
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(self.depth - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        # Where each symbol's run begins below the last level.
        self.begin = np.full(kinds, -1, np.int64)
        seen, first = np.unique(symbols, return_index=True)
        self.begin[seen] = first

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often a symbol that occurs stands before a position."""
        at = upto
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at - self.begin[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a position, and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            ones, bit = bits.ones(at), bits.get(at)
            symbol |= bit.astype(np.int64) << shift
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.begin[symbol]


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling over what is not yet told apart. The last key occurs once."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    head = np.concatenate([[True], np.diff(keys[order]) != 0])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    reach = 1
    open_ = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(open_):
        at = order[open_]
        key = group[open_] * n + rank[np.minimum(at + reach, n - 1)]
        by = np.argsort(key, kind="stable")
        order[open_], key = at[by], key[by]
        head = np.concatenate([[True], np.diff(key) != 0])
        group[open_] = open_[np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0))]
        rank[order[open_]] = group[open_]
        open_ = open_[~(head & np.concatenate([head[1:], [True]]))]
        reach *= 2
    return order


class ShardIndex:
    """The FM-index of one shard: ``numbers`` of words, 0 where a stretch ends (the last is 0)."""

    def __init__(self, numbers: np.ndarray, kinds: int, shortest: int) -> None:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], numbers > 0]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        kept = ends - starts >= shortest
        sizes = (ends - starts + 1)[kept]
        #: Where each indexed symbol stands among all words.
        self.place = np.arange(sizes.sum()) + np.repeat(starts[kept] - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes)
        text = numbers[self.place].astype(np.int64)
        self.size = len(text)
        if not self.size:
            return
        ends = text == 0
        order = suffix_order(np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum())))
        last = np.where(order > 0, text[order - 1], 0)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.tree = WaveletTree(last, kinds)
        # A stretch's first position is sampled too, so that no step back leaves its stretch.
        marked = (order % SAMPLE == 0) | (last == 0)
        self.marked, self.samples = Bits(marked), order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``phrase, place`` of every occurrence of the phrases, all of one length and without a 0."""
        none = np.empty(0, np.int64)
        if not self.size or not len(phrases):
            return none, none
        which = np.arange(len(phrases))
        low, high = self.less[phrases[:, -1]], self.less[phrases[:, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            some = low < high
            which, low, high = which[some], low[some], high[some]
            symbol = phrases[which, j].astype(np.int64)
            there = self.tree.begin[symbol] >= 0
            which, low, high, symbol = which[there], low[there], high[there], symbol[there]
            low, high = (self.less[symbol] + self.tree.rank(symbol, x) for x in (low, high))
        some = high - low
        which, rows = np.repeat(which, some), np.arange(some.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(some)[:-1]]).astype(np.int64), some)
        return which, self.place[self._locate(rows)] if len(rows) else none

    def _locate(self, rows: np.ndarray) -> np.ndarray:
        found, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            known = self.marked.get(rows)
            found[todo[known]] = self.samples[self.marked.ones(rows[known])] + steps
            todo, rows = todo[~known], rows[~known]
            if len(todo):
                symbol, before = self.tree.access(rows)
                rows = self.less[symbol] + before
            steps += 1
        return found


class Phrases:
    """One block of a benchmark: its vocabulary, its distinct phrases by length and the items of each; plain data in ``parts``."""

    def __init__(self, parts: tuple) -> None:
        #: By length: the phrases, and where the items of each begin in the list of all.
        self.numbers, self.items, self.by_length = self.parts = parts
        self.kinds = len(self.numbers) + 1
        lengths = [phrases.shape[1] for phrases, _, _ in self.by_length]
        self.shortest, self.longest = min(lengths, default=0), max(lengths, default=0)

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int) -> Phrases:
        numbers: dict[bytes, int] = {}
        names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(names)}
        by: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for name, words in items:
            codes = [numbers.setdefault(w, len(numbers) + 1) for w in words]
            size = min(window, len(codes))
            for i in range(len(codes) - size + 1 if size else 0):
                by.setdefault(size, {}).setdefault(tuple(codes[i : i + size]), set()).add(at[name])
        lists = [(np.array(list(p), np.int64), np.cumsum([0, *map(len, p.values())]), np.array([i for s in p.values() for i in sorted(s)], np.int64)) for p in by.values()]
        return cls((numbers, names, lists))

    def occurrences(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """``phrase, place`` of all occurrences, with the number of the list and the length; indexes overlap, so that none is lost."""
        for start in range(0, len(numbers), SHARD_WORDS):
            piece = numbers[start : start + SHARD_WORDS + self.longest - 1]
            index = ShardIndex(np.concatenate([piece, [0]]), self.kinds, self.shortest)
            for k, (phrases, _, _) in enumerate(self.by_length):
                which, place = index.search(phrases)
                yield which, place + start, k, phrases.shape[1]


def _merged(numbers: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans of hit words as first and last (exclusive) of all words, and distinct pairs of document and item."""
    cover, pairs = np.zeros(len(numbers) + 1, np.int64), []
    for which, place, k, length in phrases.occurrences(numbers):
        np.add.at(cover, place, 1)
        np.add.at(cover, place + length, -1)
        _, begin, items = phrases.by_length[k]
        seen = np.unique((np.searchsorted(bounds, place, side="right") - 1) * len(begin) + which)
        doc, which = seen // len(begin), seen % len(begin)
        some = begin[which + 1] - begin[which]
        at = np.arange(some.sum()) + np.repeat(begin[which] - np.concatenate([[0], np.cumsum(some)[:-1]]).astype(np.int64), some)
        pairs.append(np.unique(np.repeat(doc, some) * len(phrases.items) + items[at]))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover) > 0]).astype(np.int8)))
    both = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)]))
    return edges[::2], edges[1::2], both // max(1, len(phrases.items)), both % max(1, len(phrases.items))


def _search_shard(texts: list[bytes | None], numbers: list[np.ndarray], phrases: Phrases) -> list[pa.Array]:
    """The columns ``FOUND`` of a shard's documents; ``numbers`` are each document's words."""
    sizes = np.array([len(x) for x in numbers], np.int64)
    # A 0 after every document keeps phrases from reaching into the next.
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.zeros(int(bounds[-1]), np.int64)
    for at, x in zip(bounds, numbers, strict=False):
        joined[at : at + len(x)] = x
    first, last, docs, items = _merged(joined, bounds[:-1], phrases) if phrases.shortest else (np.empty(0, np.int64),) * 4
    spans: list[list[dict]] = [[] for _ in texts]
    names: list[list[str]] = [[] for _ in texts]
    for d, i in zip(docs, items, strict=True):
        names[d].append(phrases.items[i])
    owner = np.searchsorted(bounds, first, side="right") - 1
    for d in np.unique(owner):
        places = np.array([m.span() for m in _WORD.finditer(texts[d].decode())])
        a, b = first[owner == d] - bounds[d], last[owner == d] - bounds[d]
        spans[d] = [{"first": int(x), "last": int(y), "start": int(places[x, 0]), "end": int(places[y - 1, 1])} for x, y in zip(a, b, strict=True)]
    struct = pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])
    return [pa.array(sizes), pa.array(spans, pa.list_(struct)), pa.array(names, pa.list_(pa.string()))]


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of about ``BLOCK_WORDS`` words; only one block is on the driver at a time."""
    held, size = [], 0
    for r in benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL").toLocalIterator():
        words = [w for part in words_of(r["t"].encode()) for w in part]
        held.append((r["k"], words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(docs: DataFrame, items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """``docs`` with the columns ``FOUND`` for one block; ``text__`` is the text and is dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(Phrases.of(items, window).parts)
    carried = [c for c in docs.columns if c != "text__"]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value)
        get = phrases.numbers.get
        for batch in batches:
            texts, begin, size, numbers = batch.column("text__").cast(pa.binary()).to_pylist(), 0, 0, []
            for i, t in enumerate(texts):
                parts = [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)) for words in words_of(t or b"")]
                numbers.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
                size += len(numbers[-1])
                if size >= SHARD_WORDS or i == len(texts) - 1:
                    rows = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in carried], *_search_shard(texts[begin : i + 1], numbers, phrases)], names=[*carried, "n_words", "spans", "items"])
                    begin, size, numbers = i + 1, 0, []

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text__")
    return docs.mapInArrow(search, f"{kinds}, {FOUND}")


def _joined_spans(spans: Column) -> Column:
    """Overlapping and adjacent spans of several blocks made one."""
    kind = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
    top = lambda a: F.get(a, F.size(a) - 1)
    longer = lambda x, y: F.when(x["last"] >= y["last"], F.struct(x["first"], x["last"], x["start"], x["end"])).otherwise(F.struct(x["first"], y["last"], x["start"], y["end"]))
    fold = lambda a, y: F.when(F.size(a).cast("boolean") & (top(a)["last"] >= y["first"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer(top(a), y))).cast(kind)).otherwise(F.concat(a, F.array(y)))
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), fold)


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, n_words, spans, items`` of every document, and the ``carry`` columns under their names with ``__`` appended.

    ``spans`` are the merged runs of hit words, by word (``first`` to ``last``, exclusive) and by code point (``start`` to
    ``end``); ``items`` the ids of the items with an occurring phrase, as strings in their order. A null or empty text has
    no words. Items of the same id are one item, and a null id is the empty string; items without a word have no phrase.
    Repeated documents are judged each for itself. An empty benchmark hits nothing.
    """
    x = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text__"), *[F.col(f"`{c}`").alias(f"{c}__") for c in carry if c != text], *[F.col(f"`{c}`").alias("text__kept") for c in carry if c == text])
    blocks = _blocks(benchmark, item, item_text)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        found = _search(x, first, window)
    else:
        # Several blocks: rows are numbered in a written table, and what the blocks found is put together by number.
        x = materialise(x.withColumn("row__", F.monotonically_increasing_id()), "numbered")
        slim, parts = x.select("row__", "text__"), []
        while first is not None:
            parts.append(materialise(_search(slim, first, window), "block"))
            first, second = second, next(blocks, None)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        merged = every.groupBy("row__").agg(F.max("n_words").alias("n_words"), _joined_spans(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = x.drop("text__").join(merged, "row__").drop("row__")
    return found.withColumnRenamed("text__kept", f"{text}__")


def contamination_digests(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    found = find_contamination(docs, benchmark, key, text)
    return found.select("id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` with the spans cut out; null stays null."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))), ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all occurrences of benchmark phrases cut out of their texts; columns and rows stay."""
    found = find_contamination(docs, benchmark, key, text, carry=tuple(docs.columns))
    return found.select(*[(without_spans(F.col(f"`{c}__`"), F.col("spans")) if c == text else F.col(f"`{c}__`")).alias(c) for c in docs.columns])
