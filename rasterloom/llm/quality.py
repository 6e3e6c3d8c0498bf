"""Quality rules: counters with a fixed base test, then a hashed n-gram classifier.

Features of the classifier are hashed word 1- and 2-grams and character 3- to 5-grams
(of bytes, case kept), each weighted by its share among the text's features of that kind.
Logistic regression learns their weights in numpy from all labelled rows (whole texts), in rounds
of tasks whose steps are averaged (``averaging``);
a held-out fifth, all of it, calibrates the probability (Platt).  A text is kept if it passes the base
test and its probability of label 1 is at least ``THRESHOLD``.

Scoring is one pass over Arrow batches: an n-gram is one gather from a weight table of fixed size.

Defined results: null, empty and blank texts have counters of 0 and fail the base test.
Without labels of both kinds the base test alone decides.  Every row has one row.  Ids that the
labels contradict themselves about teach nothing; of rows that repeat an id, one text teaches.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import averaging as A
from . import bytetext as B
from .toxicity import _platt, sampled, share_of

BITS = 18
THRESHOLD = 0.35
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: fixed values: the counted symbols
SYMBOLS = B.byte_class([(ord(c), ord(c)) for c in "#*$%&|<>"])
_CONTINUES = B.byte_class([(0x80, 0xBF)])


def _cumulated(flags: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(flags)]


def _later(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, later): items whose (row, value) occurs twice or more, and those with an earlier one."""
    order = np.lexsort((np.arange(len(row)), value, row))
    r, v = row[order], value[order]
    same = np.r_[False, (r[1:] == r[:-1]) & (v[1:] == v[:-1])] if len(r) else np.zeros(0, bool)
    later = np.zeros(len(row), bool)
    later[order] = same
    repeats = np.zeros(len(row), bool)
    repeats[order] = same | np.r_[same[1:], False] if len(r) else same
    return repeats, later


class Measured:
    """Words, counters and n-gram hashes of a column of texts."""

    def __init__(self, column: pa.Array):
        self.rows = len(column)
        self.data, self.offsets = B.text_buffer(column)
        data, offsets = self.data, self.offsets
        self.starts, self.ends = B.runs(B.NOT_BLANK[data], offsets)
        self.row = B.owner(self.starts, offsets)
        self.sums = B.prefix_hash(data)
        self.words = B.span_hash(self.sums, self.starts, self.ends)
        self.n_words = np.bincount(self.row, minlength=self.rows)

    def counters(self) -> dict[str, np.ndarray]:
        data, offsets = self.data, self.offsets
        whole = _cumulated(B.NOT_BLANK[data] & ~_CONTINUES[data])
        symbols = _cumulated(SYMBOLS[data])
        # lines with a word, equal to an earlier line of the text
        cut = np.flatnonzero(data == 10)
        begin = np.sort(np.r_[offsets[:-1], cut + 1])
        begin = np.unique(begin[begin < len(data)]) if len(data) else begin[:0]
        row = B.owner(begin, offsets)
        end = np.minimum(np.r_[begin[1:], len(data)], offsets[row + 1]) if len(begin) else begin
        ends_in_cut = (end > begin) & (data[np.maximum(end - 1, 0)] == 10) if len(begin) else np.zeros(0, bool)
        end = end - ends_in_cut
        word_at = _cumulated(B.NOT_BLANK[data])
        filled = word_at[end] > word_at[begin]
        begin, end, row = begin[filled], end[filled], row[filled]
        _, later = _later(row, B.span_hash(self.sums, begin, end))
        # words in windows that occur twice or more
        k = REPEAT_WINDOW
        covered = np.zeros(len(self.words) + 1, np.int64)
        if len(self.words) >= k:
            chain = self.words
            for i in range(1, k):
                chain = B.mix(chain[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.words[i:])
            inside = np.flatnonzero(self.row[: len(chain)] == self.row[k - 1 :])
            repeats, _ = _later(self.row[inside], chain[inside])
            at = inside[repeats]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + k, -1)
        hit = np.cumsum(covered[:-1]) > 0
        return {
            "n_words": self.n_words,
            "word_chars": whole[offsets[1:]] - whole[offsets[:-1]],
            "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
            "n_dup_lines": np.bincount(row[later], minlength=self.rows),
            "n_repeat_words": np.bincount(self.row[hit], minlength=self.rows),
        }

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, slot) of all n-grams of a kind; five kinds."""
        mask = np.uint64((1 << BITS) - 1)
        yield self.row, (self.words & mask).astype(np.int32)
        pair = np.flatnonzero(self.row[1:] == self.row[:-1])
        yield self.row[pair], (B.mix(self.words[pair] * np.uint64(3) + self.words[pair + 1]) & mask).astype(np.int32)
        owner = np.repeat(np.arange(self.rows), np.diff(self.offsets))
        wide = self.data.astype(np.uint64)
        packed = wide
        for n in (2, 3, 4, 5):
            packed = (packed[:-1] << np.uint64(8)) | wide[n - 1 :] if len(packed) > 1 else packed[:0]
            if n > 2:
                inside = owner[: len(packed)] == owner[n - 1 :] if len(packed) else np.zeros(0, bool)
                slot = ((packed * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int32)
                yield owner[: len(packed)][inside], slot[inside]


KINDS = 5


@dataclasses.dataclass
class Model:
    weights: np.ndarray  # (KINDS, 2**BITS)
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, measured: Measured) -> np.ndarray:
        z = np.full(measured.rows, self.bias)
        for kind, (row, slot) in enumerate(measured.grams()):
            total = np.bincount(row, weights=self.weights[kind][slot], minlength=measured.rows)
            z += total / np.maximum(np.bincount(row, minlength=measured.rows), 1)
        return z

    def probabilities(self, measured: Measured) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(measured) * self.scale + self.shift, -30, 30)))


def _shares(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, slot, share) of the distinct n-grams of each kind."""
    out = []
    for row, slot in Measured(texts).grams():
        key, n = np.unique(row.astype(np.int64) << BITS | slot, return_counts=True)
        row = key >> BITS
        out.append((row, key & ((1 << BITS) - 1), n / np.maximum(np.bincount(row, weights=n, minlength=len(texts)), 1)[row]))
    return out


def initial(share: float) -> np.ndarray:
    """Weights, their squares, bias and its square before training, as one array."""
    return np.concatenate([np.zeros(KINDS << BITS), np.full(KINDS << BITS, 1e-8), [np.log((share + 1e-3) / (1 - share + 1e-3)), 1e-8]]).astype(np.float32)


def _model(state: np.ndarray) -> Model:
    return Model(state[: KINDS << BITS].reshape(KINDS, -1), float(state[-2]))


def train(state: np.ndarray, texts: pa.Array, labels: np.ndarray, seed: int, epochs: int, batch: int = 64, rate: float = 0.5) -> None:
    """Moves the state by Adagrad, before calibration; only one batch's n-grams are held at a time."""
    model = _model(state)
    squares, base = state[KINDS << BITS : -2].reshape(KINDS, -1), float(state[-1])
    order = np.random.default_rng(seed).permutation(len(texts))
    for _ in range(epochs):
        for a in range(0, len(order), batch):
            chosen = order[a : a + batch]
            y, grams = labels[chosen], _shares(texts.take(pa.array(chosen)).cast(pa.string()))
            z = np.full(len(y), model.bias)
            for kind, (row, slot, share) in enumerate(grams):
                z += np.bincount(row, weights=model.weights[kind][slot] * share, minlength=len(y))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            base += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(base)
            for kind, (row, slot, share) in enumerate(grams):
                slope = np.bincount(slot, weights=error[row] * share, minlength=1 << BITS)
                used = np.flatnonzero(slope)
                squares[kind][used] += slope[used] ** 2
                model.weights[kind][used] -= rate * slope[used] / np.sqrt(squares[kind][used])
    state[-2:] = model.bias, base


def _learner(k: int, epochs: int) -> A.Learn:
    def learn(state: np.ndarray, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        own = pa.Table.from_batches(list(batches))
        texts = own.column("text").cast(pa.large_string()).combine_chunks()
        train(state, texts, own.column("label").to_numpy().astype(np.float64), 7 + k, epochs)
        return state

    return learn


def fit(docs: DataFrame, labels: DataFrame, most: int | None = None) -> Model | None:
    """A calibrated model of the labelled rows whose id's text has a crc32 other than 2 modulo 4; None without both labels.

    All of them are read, whole texts, or ``most`` of each label if the caller asks so; the driver sees no text.
    """
    rows, count = sampled(docs, labels, "quality", most)
    rows, check, read, parts = A.divided(rows)
    if not (read[0] and read[1]):
        return None
    model = _model(A.trained(rows, parts, initial(read[1] / (read[0] + read[1])), _learner))
    found = A.counted(check, lambda batch: np.concatenate([model.logits(Measured(b.column("text"))) for b in B.slices(batch, "text")] or [np.zeros(0)]))
    model.scale, model.shift = _platt(*(np.array([f[i] for f in found], np.float64) for i in (1, 2, 3)))
    model.shift -= float(np.log(share_of(count, read, most)))  # the labels' shares in all rows
    return model


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def quality(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the counters, base_failed, kept, probability (1 without a model)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "text", 1 << 20):
                measured = Measured(batch.column("text"))
                found = measured.counters()
                n = found["n_words"]
                failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * n)
                p = model.probabilities(measured) if model is not None else np.ones(batch.num_rows)
                columns = [pa.array(found[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p, pa.float64())], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)

