"""SimHash fingerprints and near-duplicate groups over a byte-position inverted index."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_kept, free_shuffles, materialise, named, scratch_path, scratch_scope, shuffle_width
from .components import component_labels

SEED = 42
BYTES = 8
CHUNK = 1 << 16


def _mixed(h: np.ndarray, block: int) -> np.ndarray:
    """Further hash values of shingles for the blocks of a wide fingerprint; block 0 has the hash itself."""
    if not block:
        return h
    z = h + np.uint64(block * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, shingle_words: int) -> int:
    """64-bit SimHash of a UTF-8 text; A-Z are lower-cased, words are runs without ASCII white space."""
    return int.from_bytes(wide_fingerprint(text, shingle_words, 1), "little")


def wide_fingerprint(text: bytes, shingle_words: int, blocks: int) -> bytes:
    """SimHash of ``64 * blocks`` bits, the first block being the 64-bit fingerprint; zeros for a text without words."""
    words = text.lower().split()
    if not words:
        return bytes(8 * blocks)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[min(shingle_words, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    total = np.zeros((blocks, 64), np.int64)
    for at in range(0, len(stops), CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=False)], "<u8")
        for block in range(blocks):
            total[block] += np.unpackbits(_mixed(h, block).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(total.ravel() * 2 > len(stops), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(id, fp)`` of every row; fp is the fingerprint as a signed long. Null and blank texts have fingerprint 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            prints = [fingerprint((t or "").encode(), shingle_words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "fp"])

    source = named(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fp long")


def _free_positions(most_bits: int) -> list[tuple[int, ...]]:
    """Choices of positions that may differ, one more than bits, such that every ``most_bits`` positions lie in one choice."""
    least = min(most_bits, BYTES)
    uncovered = set(combinations(range(BYTES), least))
    choices = {free: set(combinations(free, least)) for free in combinations(range(BYTES), min(least + 1, BYTES))}
    out = []
    while uncovered:
        best = max(choices, key=lambda free: len(choices[free] & uncovered))
        out.append(best)
        uncovered -= choices[best]
    return out


def _masks(most_bits: int) -> list[int]:
    """For every choice, the mask of the bytes that must match."""
    return [sum(0xFF << (8 * p) for p in range(BYTES) if p not in free) for free in _free_positions(most_bits)]


def _forest(m: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, root) of the components of m members linked by a-b."""
    label = np.arange(m)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    inner = np.flatnonzero(label != np.arange(m))
    return inner, label[inner]


class _Lists:
    """Walks posting lists sorted by key and emits verified links, at most one per member of a list.

    A list holds the distinct fingerprints that agree in all the bytes of one choice of positions; a pair's tally of
    shared positional bytes is that number plus its equal bytes among the free positions, of which it must have
    ``least`` in all. A list is at most 2 ** (8 * (most_bits + 1)) long.
    """

    def __init__(self, most_bits: int):
        self.most = most_bits
        self.least = BYTES - most_bits
        self.masks = _masks(most_bits)
        free = min(most_bits + 1, BYTES)
        self.flips = np.array([sum(1 << b for b in bits) for k in range(1, most_bits + 1) for bits in combinations(range(8 * free), k)], np.uint64)

    def _owner(self, diff: np.ndarray) -> np.ndarray:
        """The first choice of positions that avoids every differing byte: the one list that answers for a pair."""
        out = np.full(len(diff), len(self.masks), np.int64)
        for i in range(len(self.masks) - 1, -1, -1):
            out[(diff & np.uint64(self.masks[i])) == 0] = i
        return out

    def enough_shared(self, diff: np.ndarray) -> np.ndarray:
        """Count filter: whether pairs share the guaranteed number of positional bytes."""
        return (np.ascontiguousarray(diff).view(np.uint8).reshape(*diff.shape, 8) == 0).sum(axis=-1) >= self.least

    def keep(self, diff: np.ndarray, choice: int | np.ndarray) -> np.ndarray:
        """Count filter, then verification of what it leaves, then ownership."""
        good = self.enough_shared(diff)
        good[good] = np.bitwise_count(diff[good]) <= self.most
        good[good] = self._owner(diff[good]) == (choice if np.isscalar(choice) else choice[good])
        return good

    def links(self, choice: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(fps)
        if m <= 64:
            a, b = np.triu_indices(m, 1)
        elif m <= 2 * len(self.flips):
            pieces = []
            for i in range(0, m, rows := max(1, (1 << 19) // m)):
                left, right = np.nonzero(self.enough_shared(fps[i : i + rows, None] ^ fps[None, :]))
                left += i
                pieces.append((left[left < right], right[left < right]))
            a, b = (np.concatenate(x) for x in zip(*pieces, strict=True))
        else:
            order = np.argsort(fps)
            fps = fps[order]
            free = [p for p in range(BYTES) if not self.masks[choice] >> (8 * p) & 1]
            pieces_a, pieces_b = [], []
            for flip in self.flips:
                spread = sum(((int(flip) >> (8 * k)) & 0xFF) << (8 * p) for k, p in enumerate(free))
                other = fps ^ np.uint64(spread)
                at = np.minimum(np.searchsorted(fps, other), m - 1)
                hit = np.flatnonzero((fps[at] == other) & (fps < other))
                pieces_a.append(hit)
                pieces_b.append(at[hit])
            a, b = np.concatenate(pieces_a), np.concatenate(pieces_b)
        good = self.keep(fps[a] ^ fps[b], choice)
        if not good.any():
            return fps[:0], fps[:0]
        inner, root = _forest(m, a[good], b[good])
        return fps[inner], fps[root]

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v"]
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]

        def emit(c: np.ndarray, k: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
            new = np.flatnonzero((np.diff(c) != 0) | (np.diff(k) != 0)) + 1
            starts, stops = np.r_[0, new], np.r_[new, len(c)]
            out_u, out_v = [], []
            two = starts[stops - starts == 2]
            if len(two):
                good = self.keep(f[two] ^ f[two + 1], c[two])
                out_u.append(f[two][good])
                out_v.append(f[two + 1][good])
            for s, e in zip(starts[stops - starts > 2], stops[stops - starts > 2], strict=True):
                u, v = self.links(int(c[s]), f[s:e])
                out_u.append(u)
                out_v.append(v)
            if not out_u:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_u, out_v)], names=names)

        for batch in batches:
            c, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held = [np.concatenate(x) for x in zip(held, (c.astype(np.int64), k, f.view(np.uint64)), strict=True)]
            if not len(held[0]):
                continue
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(change):
                cut = change[-1] + 1
                if (made := emit(*(x[:cut] for x in held))) is not None:
                    yield made
                held = [x[cut:] for x in held]
        if len(held[0]) and (made := emit(*held)) is not None:
            yield made


def fingerprint_links(distinct: DataFrame, most_bits: int = 2) -> DataFrame:
    """``distinct(fp)`` without repeats to links ``(u, v)`` whose components are those of all pairs at most ``most_bits`` apart.

    A pair that differs in at most ``most_bits`` bits shares at least ``8 - most_bits`` positional bytes. The inverted
    index has a posting list for the bytes at all but ``most_bits + 1`` positions, under as few choices of these (11
    for two bits) as leave no set of ``most_bits`` positions uncovered. Every qualifying pair meets in a list; the
    members' other bytes complete its tally, pairs that fall short of the minimum are dropped, and the rest verified.
    Lists are short by construction, no list emits more than one link per member, and every qualifying pair is
    answered for by exactly one list.
    """
    masks = _masks(most_bits)

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    postings = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("choice", "part"))
    width = shuffle_width(distinct.sparkSession)
    return (
        postings.select("choice", "part", "fp")
        .repartition(width, "choice", "part")
        .sortWithinPartitions("choice", "part")
        .mapInArrow(_Lists(most_bits), "u long, v long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, most_bits: int = 2) -> DataFrame:
    """One row per input row: ``id, fp`` (signed long) and ``component_id``, the smallest id of its component.

    Documents are linked when their fingerprints differ in at most ``most_bits`` bits, whatever their lengths; blank
    and null texts share fingerprint 0 and are linked like any other. Repeated rows stay repeated. A null id never is
    the component's id unless all ids of the component are null. An empty input gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("low"))
    labels = component_labels(fingerprint_links(distinct.select("fp"), most_bits))
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("id", "fp", "component_id")


#: Texts and shingles of the sample that tells common shingles; they decide the order of keys, never the result.
COMMON_TEXTS = 10_000
COMMON_SHINGLES = 200_000
PAIRS = 1 << 18
#: Orders by which the lists of shingle prefixes choose the member that all others are compared with first.
CENTRES = 4
#: Members of a list's largest joined group that its other members are compared with before all pairs are.
BRIDGES = 64
#: Equal ranges of hashes that a posting has a text's counts of.
RANGES = 32
#: Bits of the ranges, at most, of the counts by which rows of lists that may be alike are compared once more.
LIST_BITS = 8
#: Ids of texts, of eight bytes each, that are broadcast.
MOST_BROADCAST = 1_000_000


def shingle_hashes(text: bytes, shingle_words: int) -> np.ndarray:
    """64-bit hashes of a text's shingles, repeats included, words as in ``fingerprint``; empty for a text without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[min(shingle_words, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))


def shingle_set(text: bytes, shingle_words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle_words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of these shingles, as ``fingerprint`` gives it for the text."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def range_counts(shingles: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of ``RANGES`` equal ranges, up to 255 each."""
    return np.minimum(np.bincount((shingles >> np.uint64(65 - RANGES.bit_length())).astype(np.int64), minlength=RANGES), 255).astype(np.uint8)


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets of that similarity, in one order of all shingles, the first so many of each have one in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def bucket_counts(shingles: np.ndarray, most_bits: int = 64) -> bytes:
    """How many of a set's hashes fall into each of equal ranges: a power of two of at least half as many ranges, if that is not over ``2 ** most_bits``, up to 255 each."""
    bits = min(max(4, len(shingles).bit_length() - 1), most_bits)
    return np.minimum(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def possibly_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets with these bucket counts can have the similarity: in a range they share at most the lesser count."""
    if a.max() == 255 or b.max() == 255:
        return True
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    a = a.reshape(len(b), -1).sum(axis=1, dtype=np.int64)
    return np.minimum(a, b).sum() >= similarity / (1 + similarity) * (a.sum() + b.sum(dtype=np.int64)) - 1e-6


def possible_pairs(counts: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """``possibly_similar`` of the rows a and b of an array of bucket counts (bytes), for sets of like sizes."""
    sizes = np.fromiter(map(len, counts), np.int64, len(counts))
    least, good = np.minimum(sizes[a], sizes[b]), np.zeros(len(a), bool)
    for size in np.unique(least):
        pairs = np.flatnonzero(least == size)
        rows, at = np.unique(np.concatenate([a[pairs], b[pairs]]), return_inverse=True)
        own = [np.frombuffer(c, np.uint8) for c in counts[rows]]
        full = np.array([c.max() == 255 for c in own])
        table = np.stack([c.reshape(size, -1).sum(axis=1, dtype=np.uint32) for c in own])
        total = table.sum(axis=1, dtype=np.int64)
        for start in range(0, len(pairs), step := max(1, (1 << 21) // int(size))):
            some = slice(start, min(start + step, len(pairs)))
            x, y = at[some], at[len(pairs) + some.start : len(pairs) + some.stop]
            both = np.minimum(table[x], table[y]).sum(axis=1, dtype=np.int64)
            good[pairs[some]] = full[x] | full[y] | (both >= similarity / (1 + similarity) * (total[x] + total[y]) - 1e-6)
    return good


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first column, cut between keys only."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        more = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        held = [np.concatenate(x) for x in zip(held, more, strict=True)] if held else more
        change = np.flatnonzero(np.diff(held[0]))
        if len(change):
            yield [x[: change[-1] + 1] for x in held]
            held = [x[change[-1] + 1 :] for x in held]
    if held:
        yield held


def similar_documents(docs: DataFrame, id_col: str, text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, most_bits: int = 2) -> DataFrame:
    """One row per input row: ``id`` and ``component_id``, the smallest id of its group of near duplicates.

    ``id_col`` numbers the rows: longs, unique, not null, and the same whenever ``docs`` is read. Blank and null texts
    are one group. An empty input gives an empty result.

    Near duplicates are all pairs whose sets of shingles have a Jaccard similarity of at least ``similarity``, closed
    transitively, at any size of the table. Equal sets are put together first. Candidates come from the SimHash index of
    ``fingerprint_links``, fingerprints at most ``most_bits`` apart, each verified on the whole sets. Fingerprints do not
    tell every such pair, so an exact index completes them. The shingles have one order: those
    common in a sample of bounded size last, then by hash. Two similar sets share one of their first few shingles, so
    an inverted index of these prefixes holds every pair; which shingles are known as common decides only how long its
    lists are. Pairs whose sizes or places in a list rule out the similarity never leave it, nor do those whose counts of
    hashes by a few ranges do (an upper bound of what they share); then go those that counts by more ranges rule out (an
    eighth to a sixteenth of a set in size). The others are verified on their whole sets.
    Each member of a list is first compared with one other, which is linear and joins large groups of copies; those left
    out are then compared with a few members of the list's largest group, which is linear too; then all pairs of a list
    that no link has joined are compared, so lists of many unlike texts cost their square. Both leave no pairs but
    the rows of a list that take part in one, at most as many as the lists have; only these get their counts by more
    ranges, which rule out most pairs of texts that share a passage before a pair is made. What is written on the way is
    removed as soon as it has been used.
    """
    spark = docs.sparkSession
    free_shuffles(spark)
    path = scratch_path(spark, "similar")
    with scratch_scope(spark):
        return materialise(_similar(docs, id_col, text_col, shingle_words, similarity, most_bits), "similar", path)


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float, most_bits: int) -> DataFrame:
    spark = docs.sparkSession
    width = shuffle_width(spark)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def shingles_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set((t or "").encode(), shingle_words) for t in batch.column(0).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(COMMON_TEXTS * (1 << 20) / max(source.count(), 1))
    tally = source.where(share).select("text").mapInArrow(shingles_of, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = tally.orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toArrow()
    hashes, counts = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    by_hash = np.argsort(hashes)
    common = spark.sparkContext.broadcast((np.append(hashes[by_hash], np.uint64(0)), np.append(counts[by_hash], 0)))

    ranges = [f"r{x}" for x in range(RANGES // 8)]

    def prefixes_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        known, count = common.value
        for batch in batches:
            sets, prints, prefixes = [], [], []
            for t in batch.column(1).to_pylist():
                hashes = shingle_hashes((t or "").encode(), shingle_words)
                prints.append(fingerprint_of(hashes))
                sets.append(np.unique(hashes))
            for s in sets:
                place = np.searchsorted(known[:-1], s)
                rank = np.where(known[place] == s, count[place], 0)
                prefixes.append(s[np.lexsort((s, rank))[: prefix_length(len(s), similarity)]].tobytes())
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array(prefixes, pa.binary()), pa.array(map(bucket_counts, sets), pa.binary())]
            few = np.array([range_counts(s) for s in sets], np.uint8).reshape(-1, RANGES).view(np.int64)
            columns += [pa.array([bucket_counts(s, LIST_BITS) for s in sets], pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), *[pa.array(np.ascontiguousarray(x)) for x in few.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "n", "prefix", "counts", "list_counts", "fp", *ranges])

    def postings_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                prefixes = part.column(2).to_pylist()
                times = [len(x) // 8 for x in prefixes]
                ids, n = (np.repeat(part.column(c).to_numpy(), times) for c in (0, 1))
                place = np.concatenate([np.arange(x, dtype=np.int32) for x in times])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.frombuffer(b"".join(prefixes), np.int64), ids, n, place)], names=["k", "id", "n", "place"])

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of one member go."""
        for columns in _runs(batches):
            new = np.r_[True, np.diff(columns[0]) != 0]
            more = ~(new & np.r_[new[1:], True])
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in columns], names=["k", "id", "n", "place"])

    def possible(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether sets of n and m shingles, the first common one at these places, can have enough in common.

        Of a pair's lists that of its first common shingle answers for it; the others may fail here.
        """
        return np.minimum(n - place, m - other) >= similarity / (1 + similarity) * (n + m) - 1e-6

    def alike(n: np.ndarray, few: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows a and b, whether their counts by range allow the similarity: in a range they share at most the lesser count."""
        return (np.minimum(few[a], few[b]).sum(axis=1) >= similarity / (1 + similarity) * (n[a] + n[b]) - 1e-6) | (few[a].max(axis=1) == 255) | (few[b].max(axis=1) == 255)

    def counted(columns: list[np.ndarray]) -> np.ndarray:
        return np.ascontiguousarray(np.stack(columns, axis=1)).view(np.uint8)

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by key and size: the members of like sizes with the least of them by one of a few orders, which the key picks.

        Lists of the same members thus have few centres, and a pair is seldom compared for more than these.
        """
        for k, i, n, place, *few in _runs(batches):
            few = counted(few)
            orders = [_mixed(i.view(np.uint64), block) for block in range(1, CENTRES + 1)]
            centre, start = np.arange(len(k)), 0
            for stop in [*(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]:
                while start < stop:
                    end = start + int(np.searchsorted(n[start:stop], n[start] / similarity + 1e-9, "right"))
                    order = orders[int(k[start]) % CENTRES]
                    centre[start:end], start = start + int(order[start:end].argmin()), end
            far = np.flatnonzero(centre != np.arange(len(k)))
            far = far[possible(n[centre[far]], place[centre[far]], n[far], place[far])]
            far = far[alike(n, few, centre[far], far)]
            if len(far):
                ends = np.stack([i[centre[far]], i[far]], axis=1)
                pairs = np.unique(np.sort(ends, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def unjoined(k: np.ndarray, n: np.ndarray, place: np.ndarray, label: np.ndarray, part: np.ndarray, few: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows by key and size: all pairs of rows of a list and part that their sizes, places and counts allow and whose labels differ.

        All rows meet the next one of their list, then the one after it, and so on, as far as sizes allow.
        """
        stops, far = np.searchsorted(k, k, "right"), 0
        a = np.arange(len(k))
        while True:
            far += 1
            a = a[a + far < stops[a]]
            a = a[n[a + far] <= n[a] / similarity + 1e-9]
            if not len(a):
                return
            x = a[(label[a] != label[a + far]) & (part[a] == part[a + far])]
            x = x[possible(n[x], place[x], n[x + far], place[x + far])]
            x = x[alike(n, few, x, x + far)]
            if len(x):
                yield x, x + far

    def rows_of(columns: list[np.ndarray], good: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[good]) for x in columns], names=["k", "id", "n", "place", "label", "part", *ranges])

    def bridges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by key and size: those outside the largest group of a list's like sizes that may be like one of a few of that group, and these.

        The label says which of both a row is, the part counts the list's stretches of like sizes.
        """
        for k, i, n, place, label, *ranged in _runs(batches):
            few = counted(ranged)
            order = _mixed(i.view(np.uint64), CENTRES + 1)
            side, part, met, start = np.zeros(len(k), np.int64), np.zeros(len(k), np.int32), np.zeros(len(k), bool), 0
            for stop in [*(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]:
                while start < stop:
                    end = start + int(np.searchsorted(n[start:stop], n[start] / similarity + 1e-9, "right"))
                    part[start:end] = start
                    if (label[start:end] != label[start]).any():
                        groups, group, times = np.unique(label[start:end], return_inverse=True, return_counts=True)
                        inside = group == times.argmax()
                        members, others = start + np.flatnonzero(inside), start + np.flatnonzero(~inside)
                        members = members[np.argsort(order[members], kind="stable")[:BRIDGES]]
                        side[others], side[members] = 2, 1
                        for at in range(0, len(others), PAIRS // BRIDGES):
                            some = others[at : at + PAIRS // BRIDGES]
                            a, b = np.repeat(members, len(some)), np.tile(some, len(members))
                            good = possible(n[a], place[a], n[b], place[b])
                            a, b = a[good], b[good]
                            good = alike(n, few, a, b)
                            met[a[good]] = met[b[good]] = True
                    start = end
            if met.any():
                yield rows_of([k, i, n, place, side, part, *ranged], met)

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by key and size: those that may be like another of their list that they are not joined with yet."""
        for k, i, n, place, label, *ranged in _runs(batches):
            part, met = np.zeros(len(k), np.int32), np.zeros(len(k), bool)
            for a, b in unjoined(k, n, place, label, part, counted(ranged)):
                met[a] = met[b] = True
            if met.any():
                yield rows_of([k, i, n, place, label, part, *ranged], met)

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What ``bridges`` or ``across`` left, by key and size: the pairs that counts by many ranges allow too."""
        for k, i, n, place, label, part, counts, *ranged in _runs(batches):
            size, found = 0, []
            pairs = unjoined(k, n, place, label, part, counted(ranged))
            while True:
                more = next(pairs, None)
                if more is not None:
                    found.append(more)
                    size += len(more[0])
                if found and (more is None or size > PAIRS):
                    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                    good = possible_pairs(counts, a, b, similarity)
                    ends = np.unique(np.sort(np.stack([i[a[good]], i[b[good]]], axis=1), axis=1), axis=0)
                    size, found = 0, []
                    if len(ends):
                        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])
                if more is None:
                    break

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set((t or "").encode(), shingle_words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    def promising(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [possibly_similar(*(np.frombuffer(x.as_buffer(), np.uint8) for x in both), similarity) for both in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in (0, 1)], names=["u", "v"])

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the verified pairs of a task as many as join the same texts: at most one for each."""
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(same >= similarity * (len(both) - same) - 1e-9)
            more = [batch.column(c).to_numpy()[np.array(good, bool)] for c in (0, 1)]
            ids, at = np.unique(np.concatenate([u, more[0], v, more[1]]), return_inverse=True)
            inner, root = _forest(len(ids), at[: len(at) // 2], at[len(at) // 2 :])
            u, v = ids[root], ids[inner]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def bounded(ids: DataFrame) -> DataFrame:
        """Up to ``MOST_BROADCAST`` ids go to the texts; more are joined by key, which shuffles the texts."""
        return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids

    def links(pairs: DataFrame) -> DataFrame:
        left, right = prints.select(F.col("id").alias("u"), F.col("counts").alias("a")), prints.select(F.col("id").alias("v"), F.col("counts").alias("b"))
        pairs = materialise(pairs.distinct(), "similar-pairs")
        pairs = materialise(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(promising, "u long, v long"), "similar-promising")
        needed = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
        needed = materialise(needed, "similar-needed")
        sets = materialise(source.join(bounded(needed), "id", "left_semi").mapInArrow(sets_of, "id long, s binary"), "similar-sets")
        free_shuffles(spark)
        left, right = sets.select(F.col("id").alias("u"), F.col("s").alias("a")), sets.select(F.col("id").alias("v"), F.col("s").alias("b"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(verified, "u long, v long")

    few = ", ".join(f"{r} long" for r in ranges)
    prints = materialise(source.mapInArrow(prefixes_of, f"id long, digest binary, n int, prefix binary, counts binary, list_counts binary, fp long, {few}"), "prefixes")
    low = prints.groupBy("digest").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("times")).where("times > 1").select("digest", "low")
    copies = materialise(prints.select("id", "digest").join(low, "digest").where("id <> low").select("id", "low"), "prefix-copies")
    alone = prints.join(bounded(copies.select("id")), "id", "left_anti")
    postings = alone.select("id", "n", "prefix").mapInArrow(postings_of, "k long, id long, n int, place int")
    lists = postings.repartition(width, "k").sortWithinPartitions("k").mapInArrow(shared, "k long, id long, n int, place int")
    lists = materialise(lists.join(prints.select("id", *ranges), "id").select("k", "id", "n", "place", *ranges), "prefix-lists")
    free_shuffles(spark)

    def joined(labels: DataFrame, candidates: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
        """The labels after the links among these candidates; texts joined already stand as their group."""
        path = scratch_path(spark, "labels")
        with scratch_scope(spark):
            labelled = lists.join(labels, F.col("id") == F.col("node"), "left").select("k", "id", "n", "place", F.coalesce("root", "id").alias("label"), *ranges)
            met = labelled.repartition(width, "k").sortWithinPartitions("k", "n", "id").mapInArrow(candidates, f"k long, id long, n int, place int, label long, part int, {few}")
            met = materialise(met, "similar-met").join(prints.select("id", F.col("list_counts").alias("counts")), "id").select("k", "id", "n", "place", "label", "part", "counts", *ranges)
            further = links(met.repartition(width, "k").sortWithinPartitions("k", "n", "id").mapInArrow(compared, "u long, v long"))
            for end in ("u", "v"):
                further = further.join(labels, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("root", end)).select("u", "v")
            more = materialise(component_labels(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(further.distinct())), "labels", path)
        free_shuffles(spark)
        return more

    def by_prints() -> DataFrame:
        """Texts of equal fingerprints with the first of them, and the first ones of linked fingerprints."""
        lowest = alone.groupBy("fp").agg(F.min("id").alias("low"))
        equal = alone.select("id", "fp").join(lowest, "fp").where("id <> low").select(F.col("low").alias("u"), F.col("id").alias("v"))
        near = fingerprint_links(lowest.select("fp"), most_bits)
        for end in ("u", "v"):
            near = near.join(lowest, F.col(end) == F.col("fp")).withColumn(end, F.col("low")).select("u", "v")
        return equal.unionByName(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))

    first = scratch_path(spark, "labels")
    with scratch_scope(spark):
        centres = lists.repartition(width, "k").sortWithinPartitions("k", "n", "id").mapInArrow(stars, "u long, v long")
        labels = materialise(component_labels(links(by_prints().unionByName(centres))), "labels", first)
    free_shuffles(spark)
    labels = joined(joined(labels, bridges), across)
    stands = prints.select("id").join(copies, "id", "left").select("id", F.coalesce("low", "id").alias("of"))
    return stands.join(labels, F.col("of") == F.col("node"), "left").select("id", F.coalesce("root", "of").alias("component_id"))
