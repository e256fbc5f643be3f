"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import kept_in_worker

#: The bounded sample of labelled rows that a model is fitted on: rows per language, and distinct words per language.
#: Words of over ``FIT_LETTERS`` characters enter the fit in successive parts of that size, of which only the first is marked.
ROWS_PER_LANGUAGE = 1500
FIT_LETTERS = 32
WORDS_PER_LANGUAGE = 40_000
ROUNDS = 3
#: Labels whose bounds are broadcast; more are joined by key. Ranks that a task holds before it hands them on.
MOST_BROADCAST = 10_000
MOST_RANKS = 1_000_000
MARK = "▁"
#: Words up to this length are scored together and remembered; longer ones are scored with rescaling, this many characters at once.
BLOCK = 24
LONG_LETTERS = 1 << 18
RESCALE = 8
GROUP = 256
KNOWN_WORDS = 700_000
UNDETERMINED = "und"


def vocabulary(model_path: str) -> list[str]:
    """The ordinary pieces of a public vocabulary file, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@dataclass
class Unigrams:
    """Log probabilities of pieces, one column per language, and of a character that no piece covers."""

    languages: list[str]
    index: dict[str, int]
    logs: np.ndarray
    other: float
    longest: int

    def lattice(self, word: str) -> list[tuple[int, int, int]]:
        """Edges (from, to, piece) of all segmentations of a marked word or part; piece -1 is a character outside."""
        index, n = self.index, len(word)
        edges = []
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                if (piece := index.get(word[start:end])) is not None:
                    edges.append((start, end, piece))
                elif end - start == 1:
                    edges.append((start, end, -1))
        return edges

    def _edges(self, words: list[str], first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges of all segmentations of many marked words that end from first to last, by end: word, from, to, piece."""
        get, longest = self.index.get, self.longest
        owner, starts, ends, pieces = [], [], [], []
        for at, marked in enumerate(words):
            for end in range(first, min(last, len(marked)) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    if (piece := get(marked[start:end])) is not None:
                        owner.append(at)
                        starts.append(start)
                        ends.append(end)
                        pieces.append(piece)
                if marked[end - 1] not in self.index:
                    owner.append(at)
                    starts.append(end - 1)
                    ends.append(end)
                    pieces.append(-1)
        owner, starts, ends, pieces = (np.array(x, np.int64) for x in (owner, starts, ends, pieces))
        order = np.argsort(ends, kind="stable")
        return owner[order], starts[order], ends[order], pieces[order]

    def _probabilities(self) -> np.ndarray:
        return np.concatenate([np.exp(self.logs), np.full((1, len(self.languages)), math.exp(self.other))])

    def score_words(self, words: list[str]) -> np.ndarray:
        """Forward algorithm over many words of up to ``BLOCK`` characters.

        Per word and language: the log of the summed probability of all segmentations.
        """
        n, k = len(words), len(self.languages)
        owner, starts, ends, pieces = self._edges([MARK + w for w in words], 1, BLOCK + 1)
        prob = self._probabilities()
        ahead = np.zeros((n, BLOCK + 2, k))
        ahead[:, 0] = 1.0
        cuts = np.searchsorted(ends, np.arange(1, BLOCK + 3))
        for end in range(1, BLOCK + 2):
            part = slice(cuts[end - 1], cuts[end])
            if part.start == part.stop:
                break
            gain = ahead[owner[part], starts[part]] * prob[pieces[part]]
            for language in range(k):
                ahead[:, end, language] = np.bincount(owner[part], weights=gain[:, language], minlength=n)
        return np.log(np.maximum(ahead[np.arange(n), [len(w) + 1 for w in words]], 1e-300))

    def score_long_words(self, words: list[str]) -> np.ndarray:
        """The same over words of any length: a ring of the last forward values, rescaled every few characters."""
        out = np.zeros((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order:
            group, letters = [], 0
            while order and (not group or letters + len(words[order[-1]]) <= LONG_LETTERS):
                letters += len(words[order[-1]])
                group.append(order.pop())
            out[group] = self._score_group([words[i] for i in group])
        return out

    def _score_group(self, words: list[str]) -> np.ndarray:
        """Words from the longest down, so that those not ended yet are always the first ones."""
        n, k = len(words), len(self.languages)
        sizes = np.array([len(w) + 1 for w in words])
        words = [MARK + w for w in words]
        prob = self._probabilities()
        ring = np.zeros((n, self.longest + 1, k))
        ring[:, 0] = 1.0
        scale, out = np.zeros((n, k)), np.zeros((n, k))
        alive, known = n, 0
        for end in range(1, sizes[0] + 1):
            if end > known:
                first, known = end, min(int(sizes[0]), end + max(64, LONG_LETTERS // alive))
                owner, starts, ends, pieces = self._edges(words[:alive], first, known)
                cuts = np.searchsorted(ends, np.arange(first, known + 2))
            part = slice(cuts[end - first], cuts[end - first + 1])
            gain = ring[owner[part], starts[part] % len(ring[0])] * prob[pieces[part]]
            here = end % len(ring[0])
            for language in range(k):
                ring[:alive, here, language] = np.bincount(owner[part], weights=gain[:, language], minlength=alive)
            while alive and sizes[alive - 1] == end:
                alive -= 1
                out[alive] = np.log(np.maximum(ring[alive, here], 1e-300)) + scale[alive]
            if end % RESCALE == 0 and alive:
                top = np.maximum(ring[:alive].max(axis=1), 1e-300)
                ring[:alive] /= top[:, None]
                scale[:alive] += np.log(top)
        return out


def fit_unigrams(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Unigrams:
    """Expectation maximisation: piece probabilities per language from counts of marked words, over all segmentations.

    Words are at most ``FIT_LETTERS`` and a mark long, so that probabilities stay above underflow.
    """
    index = {p: i for i, p in enumerate(pieces)}
    longest = min(16, max(map(len, pieces)))
    languages = sorted(counts)
    model = Unigrams(languages, index, np.zeros((len(pieces), 1)), math.log(1e-7), longest)
    columns = []
    for language in languages:
        words = [(model.lattice(w), len(w), n) for w, n in counts[language].items()]
        p = np.full(len(pieces), 1.0 / len(pieces))
        for _ in range(rounds):
            prob = p.tolist()
            gained = [0.0] * len(pieces)
            for edges, n, times in words:
                ahead = [0.0] * (n + 1)
                ahead[0] = 1.0
                for s, e, piece in edges:
                    ahead[e] += ahead[s] * (prob[piece] if piece >= 0 else 1e-7)
                back = [0.0] * (n + 1)
                back[n] = 1.0
                for s, e, piece in reversed(edges):
                    back[s] += back[e] * (prob[piece] if piece >= 0 else 1e-7)
                if ahead[n] > 0:
                    share = times / ahead[n]
                    for s, e, piece in edges:
                        if piece >= 0:
                            gained[piece] += ahead[s] * prob[piece] * back[e] * share
            got = np.array(gained) + 0.05
            p = got / got.sum()
        columns.append(np.log(p))
    model.logs = np.stack(columns, axis=1) if columns else np.zeros((len(pieces), 0))
    return model


def _least_ranks(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k least distinct ranks of each label among a task's rows, or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            labels = np.repeat(np.array(list(held), object), [len(x) for x in held.values()])
            return pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(np.concatenate(list(held.values())))], names=["label", "rank"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes, ranks = coded.indices.to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            for label, part in zip(coded.dictionary.to_pylist(), np.split(ranks[order], np.cumsum(np.bincount(codes))[:-1]), strict=True):
                held[label] = np.unique(np.concatenate([held[label], part]) if label in held else part)[:k]
            if sum(map(len, held.values())) > MOST_RANKS:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def learn(
    labelled: DataFrame, pieces: list[str], text_col: str = "text", label_col: str = "lang", order: Column | None = None,
    rows_per_language: int = ROWS_PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE,
) -> Unigrams:
    """Fits a model on at most ``rows_per_language`` distinct whole texts of each label, chosen by ``order`` (a hash of the text).

    A label with a text is never left without a sample, however often its texts repeat. Rows without a text or label are
    passed over. Words are counted in Spark, those of over ``FIT_LETTERS`` characters in parts of that size; of each
    language the ``words_per_language`` most frequent distinct ones reach the driver, so the fit is of bounded size.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    rank = (F.xxhash64("text") if order is None else order.cast("long")).alias("rank")
    # Tasks keep the least distinct ranks of each label, so that copies of a text neither fill nor empty its sample.
    least = rows.select("label", rank).mapInArrow(_least_ranks(rows_per_language), "label string, rank long")
    best = Window.partitionBy("label").orderBy("rank")
    chosen = least.distinct().withColumn("at", F.row_number().over(best)).where(F.col("at") <= rows_per_language)
    bound = chosen.groupBy("label").agg(F.max("rank").alias("bound"))
    if bound.count() <= MOST_BROADCAST:
        bound = F.broadcast(bound)
    near = rows.select("label", "text", rank).join(bound, "label").where("rank <= bound").select("label", "rank", "text").distinct()
    sample = near.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("rank", "text"))).where(F.col("at") <= rows_per_language)
    words = sample.select("label", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''")
    first = rf"^{MARK}(?s:.){{1,{FIT_LETTERS}}}|(?s:.){{1,{FIT_LETTERS}}}"
    words = words.select("label", F.explode(F.regexp_extract_all(F.concat(F.lit(MARK), "word"), F.lit(first), F.lit(0))).alias("word"))
    words = words.groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    common = words.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))).where(F.col("at") <= words_per_language)
    counts: dict[str, dict[str, int]] = {}
    for label, word, n in common.select("label", "word", "n").collect():
        counts.setdefault(label, {})[word] = n
    return fit_unigrams(counts, pieces)


class WordTable:
    """Scores of words met so far, and texts scored as sums of their words' scores."""

    def __init__(self, model: Unigrams):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 14, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.place))
        if not new:
            return
        if len(self.place) + len(new) > KNOWN_WORDS:
            self.place.clear()
            new = list(words)
        while len(self.table) < len(self.place) + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            first = len(self.place)
            self.table[first : first + len(part)] = self.model.score_words(part)
            self.place.update(zip(part, range(first, first + len(part)), strict=True))

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        model = self.model
        lettered = [bool(t) and bool(model.languages) and (any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t))) for t in texts]
        words = [t.lower().split() if ok else [] for t, ok in zip(texts, lettered, strict=True)]
        lasting = []
        for at, ws in enumerate(words):
            if ws and max(map(len, ws)) > BLOCK:
                lasting += [(at, w) for w in ws if len(w) > BLOCK]
                words[at] = [w for w in ws if len(w) <= BLOCK]
        self._learn(set().union(*words))
        # Long words are seldom met again and are not remembered.
        more: dict[int, np.ndarray] = {}
        for (at, _), score in zip(lasting, model.score_long_words([w for _, w in lasting]) if lasting else [], strict=True):
            more[at] = more.get(at, 0.0) + score
        out = []
        for at, (ok, ws) in enumerate(zip(lettered, words, strict=True)):
            if not ok:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.table[np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))].sum(axis=0) + more.get(at, 0.0)
            best = int(total.argmax())
            out.append((model.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def identify(docs: DataFrame, model: Unigrams, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` of every row, from the whole text.

    A kept column named like one of these two has ``__`` behind its name in the result.

    The score is the posterior probability of the predicted language under equal priors. A null text, one without a
    letter, or a model without languages gives ``und`` and 0. Ties go to the first language in alphabetical order.
    The model (vocabulary times languages) is the only thing broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.index, model.logs, model.other, model.longest))

    key = ("language", hash(tuple(model.languages)), model.logs.tobytes().__hash__())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_in_worker(key, lambda: WordTable(Unigrams(*shared.value)))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [x for at in range(0, len(texts), GROUP) for x in known.classify(texts[at : at + GROUP])]
            names, scores = ([x[i] for x in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    kept = docs.select(*[F.col(f"`{c}`").alias(f"{c}__" if c.lower() in ("lang_pred", "score") else c) for c in keep])
    out = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    text = F.col(f"`{text_col}`").cast("string").alias("__text__")
    return docs.select(*[F.col(f"`{c}`").alias(field.name) for c, field in zip(keep, kept.schema.fields, strict=True)], text).mapInArrow(run, out)
