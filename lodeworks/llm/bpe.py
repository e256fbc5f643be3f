"""Byte-level BPE encoding and decoding by monoid tree reduction."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, named

#: The characters of the Unicode property White_Space, as a class body.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
MEMO_ENTRIES = 400_000
MEMO_LENGTH = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def split_pattern(pattern: str) -> regex.Pattern:
    r"""The pre-splitting pattern with ``\s`` spelt out, as libraries disagree on the separators 0x1C to 0x1F."""
    body = pattern.replace(r"[^\s", "[^" + WHITE_SPACE).replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
    return regex.compile(body)


class Memo(dict):
    """A bounded table of a function's values, in two generations: a full one becomes the older. Long keys are not kept."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES, length: int = MEMO_LENGTH):
        super().__init__()
        self.make, self.entries, self.length = make, entries // 2, length
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.length:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class TokenMonoid:
    """Encodings of byte strings as elements of a monoid: ``join`` of two encodings is the encoding of both texts.

    Why a join is exact: if every two neighbouring tokens of a sequence, taken alone, encode as themselves, then so
    does the sequence. The first merge across a boundary would have the lowest rank at that moment, both sides would
    look as they do in the pair alone, and the pair would make that merge too. A join re-encodes a window around the
    boundary and widens it on the side whose outer pair is not stable, until both are; what lies outside is then
    proven to stay.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.stable = Memo(self._stable)
        self.short = Memo(self._halves, length=12)
        self.windows = Memo(self.merge, length=32)

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a window: the lowest-ranked, leftmost pair merges first."""
        ranks, n = self.ranks, len(data)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = 0, stop, nxt[j]
            if nxt[i] < n:
                k = nxt[i]
                prv[k] = i
                if (r := ranks.get(data[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if prv[i] >= 0 and (r := ranks.get(data[prv[i] : stop])) is not None:
                heapq.heappush(heap, (r, prv[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = nxt[i]
        return out

    def _stable(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == list(pair)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable[left[-1], right[0]]:
            return left + right
        take_l = take_r = 1
        while True:
            window = self.windows[self.decode(left[-take_l:] + right[:take_r])]
            calm_l = take_l == len(left) or self.stable[left[-take_l - 1], window[0]]
            calm_r = take_r == len(right) or self.stable[window[-1], right[take_r]]
            if calm_l and calm_r:
                return left[: len(left) - take_l] + window + right[take_r:]
            if not calm_l:
                take_l = min(len(left), take_l * 2)
            if not calm_r:
                take_r = min(len(right), take_r * 2)

    def _halves(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.ranks[data]]
        half = (len(data) + 1) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def encode(self, data: bytes) -> list[int]:
        """Encodes a byte string by halves, remembering short parts."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self.short[data] if data else []

    def encode_match(self, data: bytes) -> list[int]:
        """Encodes one match of the splitting pattern; the caller remembers it."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self._halves(data)

    def decode(self, ids: list[int]) -> bytes:
        """Concatenates up the tree."""
        if len(ids) <= 64:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextCodec:
    """Whole texts: splits them by the pattern and joins the pieces' encodings, which meet at proven boundaries."""

    # No match of the pattern goes on past a non-space followed by white space, so a text without other white space
    # can be cut before every run of blanks and line ends.
    _CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    _OTHER_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.monoid = TokenMonoid(ranks)
        self.split = split_pattern(pattern)
        self.plain = all(self.split.findall(x) == y for x, y in ((" az", [" az"]), (" é,", [" é", ","]), (" ß!", [" ß", "!"]), (" 日?", [" 日", "?"])))
        self.chunks = Memo(self._chunk, entries=2 * MEMO_ENTRIES)
        self.matches = Memo(self._match)

    def _match(self, match: str) -> tuple[bytes, bytes]:
        ids = self.monoid.encode_match(match.encode())
        if len(ids) == 1:
            return b"%d" % ids[0], self.monoid.bytes_of[ids[0]]
        return " ".join(map(str, ids)).encode(), self.monoid.decode(ids)

    def _split(self, chunk: str) -> list[str]:
        """Matches of the pattern; a blank, letters and a mark need no regular expression."""
        if chunk[0] == " " and self.plain:
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.split.findall(chunk)

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        parts = list(map(self.matches.__getitem__, self._split(chunk)))
        return parts[0] if len(parts) == 1 else (b" ".join([p[0] for p in parts]), b"".join([p[1] for p in parts]))

    def pieces(self, text: str) -> list[tuple[bytes, bytes]]:
        """(decimal ids, decoded bytes) of consecutive parts of a text."""
        if not text:
            return []
        if self._OTHER_SPACE.search(text):
            return [self._chunk(text)]
        return list(map(self.chunks.__getitem__, self._CHUNK.findall(text)))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces(text) for i in ids.split()]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every row; null texts count as empty and have no ids."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(("codec", hash(frozenset(ranks.value.items())), pattern), lambda: TextCodec(ranks.value, pattern))
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return _source(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(id, ids)`` to ``(id, body binary)``; null ids count as none."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        monoid = TokenMonoid(ranks.value)
        for batch in batches:
            bodies = [monoid.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["id", "body"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, body binary")


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: ``id, n_tokens, ids_sha256, decoded_sha256``.

    Null texts count as empty (no tokens). Rows are independent, so repeated rows give repeated results; the
    vocabulary, whose size is fixed, is the only thing broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(("codec", hash(frozenset(ranks.value.items())), pattern), lambda: TextCodec(ranks.value, pattern))
        for batch in batches:
            counts, ids_sha, body_sha = [], [], []
            for text in batch.column(1).to_pylist():
                parts = codec.pieces(text or "")
                ids = b" ".join([p[0] for p in parts])
                counts.append(ids.count(b" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                body_sha.append(hashlib.sha256(b"".join([p[1] for p in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(body_sha, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _source(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return named(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
