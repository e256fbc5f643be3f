"""Best-fit packing of tokenised documents by a configuration linear program."""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_in_worker, materialise, named

CAPACITY = 2048
ROUNDS = 1200
RATE = 0.5
#: Powers of the length that weights per piece start from; the better of the rounded plans is taken.
STARTS = (1.3, 2.0)
MEMO_ENTRIES = 500_000
MEMO_LENGTH = 64

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordTokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes, remembered word by word.

    The tokenizer normalises and splits at white space, so a text's ids are those of its words in turn; it also splits
    letters and digits from the punctuation after them, and lower-cases. Texts with separators on which libraries
    disagree, or with one of the tokenizer's added tokens, are encoded whole. If it looks for added tokens in normalised
    text, all texts are.
    """

    _ODD = re.compile(r"[\x1c-\x1f]")
    _MARKS = ".,;:!?"
    _BETWEEN = "|"

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.always_whole = any(t.normalized for t in added)
        # Words met lately and those of the generation before; a word met again moves to the newer one.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte_letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.between = self.tokenizer.encode(self._BETWEEN, add_special_tokens=False).ids[0]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Encodes words.

        Latin letters alone are one match of the tokenizer's pattern and already composed, so their lower-case bytes go
        straight to its merges. Other words are encoded together, a mark that none of them contains between each two.
        """
        out, plain, merge, table = {}, [], self.tokenizer.model.tokenize, self.byte_letters
        for w in words:
            if w.isalpha() and (w.isascii() or max(w) < "\u0250" and "\u0130" not in w):
                low = w.lower()
                out[w] = array("I", [t.id for t in merge(low if w.isascii() else low.encode().decode("latin-1").translate(table))]).tobytes()
            elif self._BETWEEN in w:
                out[w] = self.whole(w).tobytes()
            else:
                plain.append(w)
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = self.whole(f" {self._BETWEEN} ".join(part))
            cuts = [-1, *np.flatnonzero(ids == self.between).tolist(), len(ids)]
            body = ids.tobytes()
            out.update(zip(part, [body[4 * a + 4 : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of new words; a word is put together from its core and the punctuation at its end."""
        if len(self.known) > MEMO_ENTRIES:
            self.older, self.known = self.known, {}
        out = {w: self.older[w] for w in new if w in self.older}
        split, wanted = {}, set()
        for word in new.difference(out):
            core = word.rstrip(self._MARKS) if word[-1] in self._MARKS else word
            if core and core[-1].lower()[-1].isalnum():
                tail = word[len(core) :]
                if core.isascii():
                    core = core.lower()
                if tail:
                    wanted.add(tail)
                elif core == word:
                    wanted.add(word)
                    continue
                split[word] = (core, tail)
                wanted.add(core)
            else:
                wanted.add(word)
        known, older = self.known, self.older
        parts = {w: known.get(w) or older.get(w) for w in wanted}
        parts |= self._encode([w for w, ids in parts.items() if ids is None])
        out |= parts
        for word, (core, tail) in split.items():
            out[word] = parts[core] + parts[tail] if tail else parts[core]
        if max(map(len, out)) <= MEMO_LENGTH:
            known.update(out)
        else:
            known.update((w, ids) for w, ids in out.items() if len(w) <= MEMO_LENGTH)
        return out

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if self.always_whole or self._ODD.search(text) or any(a in text for a in self.added):
                yield self.whole(text).tobytes()
                continue
            words = text.split()
            ids = list(map(self.known.get, words))
            if None in ids:
                learnt = self._learn({w for w, i in zip(words, ids, strict=True) if i is None})
                ids = [learnt[w] if i is None else i for w, i in zip(words, ids, strict=True)]
            yield b"".join(ids)


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenises every text, appends ``end_id`` and cuts what is longer than ``capacity``.

    ``part`` and ``place`` number the pieces of each length within a task.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(("words", hash(vocabulary.value)), lambda: WordTokens(vocabulary.value))
        part = TaskContext.get().partitionId()
        placed: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                body = ids + end
                for piece, at in enumerate(range(0, len(body), width)):
                    cut = body[at : at + width]
                    n = len(cut) // 4
                    placed[n] = place = placed.get(n, -1) + 1
                    rows.append((doc, piece, at // 4, n, zlib.crc32(cut), part, place))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _PIECES.split(", ")])

    source = named(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, _PIECES)


def best_configuration(prices: np.ndarray) -> list[tuple[int, int]]:
    """Pricing by an unbounded knapsack: (length, copies) of total length at most the capacity and of the highest price.

    ``prices[l]`` is the price of one piece of length l, minus infinity where there is none.
    """
    capacity = len(prices) - 1
    worth, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        with_last = prices[1 : c + 1] + worth[c - 1 :: -1] if c > 1 else prices[1:2] + worth[:1]
        k = int(with_last.argmax())
        if with_last[k] > worth[c - 1]:
            worth[c], choice[c] = with_last[k], k + 1
        else:
            worth[c] = worth[c - 1]
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c]:
            found[int(choice[c])] = found.get(int(choice[c]), 0) + 1
            c -= int(choice[c])
        else:
            c -= 1
    return sorted(found.items(), reverse=True)


def fractional_plan(demand: dict[int, int], capacity: int, rounds: int = ROUNDS, start: float = STARTS[0]) -> dict[tuple, float]:
    """Approximately solves the configuration linear program by multiplicative weights.

    Minimise the number of sequences such that every length is covered. The weight of a length starts a little above
    its share of all tokens, the more so the longer it is, since long pieces are the harder to place. It falls exponentially as it gets covered; a round prices the best configuration under the weights per
    piece and uses it as far as half its scarcest length, and never beyond what is uncovered.
    """
    left = np.zeros(capacity + 1)
    for n, k in demand.items():
        left[n] = k
    need, cover = left.copy(), np.zeros(capacity + 1)
    present = need > 0
    base = (np.arange(capacity + 1) / capacity) ** start
    plan: dict[tuple, float] = {}
    for _ in range(rounds):
        prices = np.full(capacity + 1, -np.inf)
        open_ = present & (cover < 1 - 1e-9)
        if not open_.any():
            break
        prices[open_] = base[open_] * np.exp(-RATE * cover[open_])
        found = tuple((n, min(k, int(need[n]))) for n, k in best_configuration(prices))
        if not found:
            break
        amount = min(min(0.5, 1 - cover[n]) * need[n] / k for n, k in found)
        plan[found] = plan.get(found, 0.0) + amount
        for n, k in found:
            cover[n] += amount * k / need[n]
    return plan


def round_plan(plan: dict[tuple, float], demand: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Whole numbers of sequences that hold exactly the demanded pieces: ``[(configuration, sequences)]``.

    Configurations of the fractional plan are taken fullest first, rounded down and as far as pieces are left; the
    remainder goes, longest first, to the open sequences that it fits best. Equal sequences are kept as one entry
    with a count, so the work does not depend on the number of pieces.
    """
    left = dict(demand)
    out: list[tuple[tuple, int]] = []
    for config, amount in sorted(plan.items(), key=lambda x: (capacity - sum(n * k for n, k in x[0]), -x[1], x[0])):
        times = min(int(amount), *(left[n] // k for n, k in config))
        if times > 0:
            out.append((config, times))
            for n, k in config:
                left[n] -= k * times
    open_by: dict[int, list[tuple[dict, int]]] = {}
    for n in sorted((n for n, k in left.items() if k), reverse=True):
        todo = left[n]
        for room in sorted(r for r in open_by if r >= n):
            while todo and open_by.get(room):
                held, count = open_by[room].pop()
                each = min(room // n, todo) if count == 1 else room // n
                used = min(count, max(1, todo // each))
                each = min(each, todo)
                if used < count:
                    open_by[room].append((held, count - used))
                open_by.setdefault(room - each * n, []).append((held | {n: held.get(n, 0) + each}, used))
                todo -= each * used
            if not todo:
                break
        while todo:
            each = min(capacity // n, todo)
            used = todo // each
            open_by.setdefault(capacity - each * n, []).append(({n: each}, used))
            todo -= each * used
    for groups in open_by.values():
        out += [(tuple(sorted(held.items(), reverse=True)), count) for held, count in groups]
    return out


def plan_sequences(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple, int]]:
    """Whole sequences first, then the linear program over the other lengths, then rounding.

    The better of two starts; the second is left out where the first has no more sequences than the tokens need.
    """
    whole = demand.get(capacity, 0)
    rest = {n: k for n, k in demand.items() if n < capacity and k}
    out = [(((capacity, 1),), whole)] if whole else []
    if not rest:
        return out
    fewest = -(-sum(n * k for n, k in rest.items()) // capacity)
    best, size = [], math.inf
    for start in STARTS:
        plan = round_plan(fractional_plan(rest, capacity, rounds, start), rest, capacity)
        if (got := sum(times for _, times in plan)) < size:
            best, size = plan, got
        if size <= fewest:
            break
    return out + best


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, rounds: int = ROUNDS
) -> DataFrame:
    """Packs all texts into few sequences of at most ``capacity`` tokens; one row per piece.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null text counts as empty and is the
    end token alone; repeated rows are packed as often as they occur; an empty input gives no piece. Only texts
    longer than the capacity are cut.

    The driver sees the length histogram, which has at most ``capacity`` entries, and the plan, whose size depends on
    the histogram alone. Ranks of equal lengths are counted within tasks and made global by sums over tasks, so that
    a length that holds most of the pieces is never gathered.
    """
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    demand = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    entries = []
    sequences = 0
    used: dict[int, int] = {}
    for config, times in plan_sequences(demand, capacity, rounds):
        at = 0
        for n, k in config:
            first = used.get(n, 0)
            entries.append((n, first, k, sequences, at))
            used[n] = first + k * times
            at += n * k
        sequences += times
    entries.sort()
    plan = spark.sparkContext.broadcast(np.array(entries, np.int64).reshape(-1, 5))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_part.select(F.col("part").alias("p"), F.col("length").alias("l"), before.alias("before"))
    ranked = pieces.join(offsets, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            k = rank - row[:, 1]
            sequence, offset = row[:, 3] + k // row[:, 2], row[:, 4] + k % row[:, 2] * length
            names = [f.split()[0] for f in _PACKED.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(assign, _PACKED)
