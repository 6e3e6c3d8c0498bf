"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first 4 to 7
bytes.  Filters of widths 1, 2 and 3 run over the words, each filter keeps its maximum over
the document, and one dense layer gives the score.  Training sees all labelled rows (whole texts),
a fixed seed, and nothing but the text.  It runs in rounds (``averaging``): tasks of bounded size hash
their rows (four bytes a word) and train, and their steps are averaged.  A held-out fifth of the rows,
all of whose logits are counted, calibrates the score (Platt) and one threshold per language (the best F1,
pulled to the overall threshold where a language has few labels, between 0.2 and 0.6).

Scoring is a single pass over Arrow batches; the model (a few MB, bounded by its
sizes, not by the data) travels with the function.

Defined results: null and empty texts have no words, and score like any text without a
toxic word.  Labels of one kind only give a constant score, the share of label 1 (0 without labels).
Unknown or null languages use the overall threshold.  Every row has one row, repeated ids too.
Ids that the labels contradict themselves about teach nothing; of rows that repeat an id, one text teaches.
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

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
DEFAULT_THRESHOLD = 0.3


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, buckets, offsets): each word's hash and its 1 + len(PREFIXES) hashed buckets; the words of each text."""
    data, offsets = B.text_buffer(column)
    low = B.LOWER[data]
    starts, ends = B.runs(B.WORD_AND_DIGIT[low], offsets)
    sums = B.prefix_hash(low)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    hashes = B.span_hash(sums, starts, ends)
    out[:, 0] = hashes >> np.uint64(64 - 17)
    for k, size in enumerate(PREFIXES):
        stop = np.minimum(starts + size, ends)
        h = B.mix(B.span_hash(sums, starts, stop) + np.uint64(k + 1))
        out[:, k + 1] = np.where(ends - starts >= size, (h >> np.uint64(64 - 17)).astype(np.int64), BUCKETS)
    return hashes, out, np.r_[0, np.cumsum(np.bincount(B.owner(starts, offsets), minlength=len(column)))]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets) of :func:`word_features`."""
    return word_features(column)[1:]


@dataclasses.dataclass
class Model:
    embed: np.ndarray  # (BUCKETS + 1, DIM); the last row stays 0
    filters: list[np.ndarray]  # (width * DIM, FILTERS) for each width
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = dataclasses.field(default_factory=dict)
    threshold: float = DEFAULT_THRESHOLD

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        x = self.embed[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            x += self.embed[buckets[:, k]]
        return x

    def pooled(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(maxima, places): each document's largest filter values (0 at least) and, per width, all values."""
        n = len(at) - 1
        size = np.diff(at)
        maxima = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        values = []
        padded = np.vstack([x, np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
        row = np.repeat(np.arange(n), size)
        for w, width in enumerate(WIDTHS):
            z = x @ self.filters[w][:DIM]
            for k in range(1, width):  # a window ends with its document
                part = padded[k : k + len(x)] @ self.filters[w][k * DIM : (k + 1) * DIM]
                inside = np.arange(len(x)) + k < at[row + 1]
                z += part * inside[:, None]
            values.append(z)
            filled = np.flatnonzero(size > 0)
            if len(filled):
                maxima[filled, w * FILTERS : (w + 1) * FILTERS] = np.maximum.reduceat(z, at[filled], axis=0)
        maxima[size > 0] += self.bias
        return np.maximum(maxima, 0), values

    def logits(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at) - 1)
        step = 1 << 17  # words at a time, so that a very long document stays the only large one
        begin = 0
        while begin < len(out):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + step, "right")) - 1)
            part = at[begin : end + 1]
            pooled, _ = self.pooled(self.vectors(buckets[part[0] : part[-1]]), part - part[0])
            out[begin:end] = pooled @ self.out + self.out_bias
            begin = end
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        z = self.logits(*features(column)) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, shapes: list[tuple[int, ...]], rate: float):
        self.m = [np.zeros(s, np.float32) for s in shapes]
        self.v = [np.zeros(s, np.float32) for s in shapes]
        self.rate, self.t = rate, 0

    def step(self, values: list[np.ndarray], slopes: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(values, slopes, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-6)


def initial(share: float, seed: int = 3) -> Model:
    """The network before training, for a share of label 1."""
    rng = np.random.default_rng(seed)
    return Model(
        np.vstack([rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32),
        [rng.normal(0, 0.5 / np.sqrt(w), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        float(np.log((share + 1e-3) / (1 - share + 1e-3))),
    )


def packed(model: Model, squares: np.ndarray) -> np.ndarray:
    """The network and the embeddings' squares as one array."""
    return np.concatenate([model.embed.ravel(), *(f.ravel() for f in model.filters), model.bias, model.out, [model.out_bias], squares]).astype(np.float32)


def unpacked(state: np.ndarray) -> tuple[Model, np.ndarray]:
    wide = len(WIDTHS) * FILTERS
    sizes = [(BUCKETS + 1) * DIM, *(w * DIM * FILTERS for w in WIDTHS), wide, wide, 1, BUCKETS + 1]
    embed, *filters, bias, out, base, squares = np.split(state, np.cumsum(sizes)[:-1])
    return Model(embed.reshape(-1, DIM), [f.reshape(-1, FILTERS) for f in filters], bias, out, float(base[0])), squares


def train(model: Model, squares: np.ndarray, buckets: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, seed: int, epochs: int, batch: int = 32) -> None:
    """Moves the network, before calibration; a text is an array of row numbers of ``buckets``."""
    rng = np.random.default_rng(seed)
    dense = _Adam([f.shape for f in model.filters] + [model.bias.shape, model.out.shape, (1,)], 0.01)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            chosen = order[a : a + batch]
            size = np.array([len(rows[i]) for i in chosen])
            to = np.r_[0, np.cumsum(size)]
            words = buckets[np.concatenate([rows[i] for i in chosen])]
            x = model.vectors(words)
            pooled, values = model.pooled(x, to)
            drop = (rng.random(pooled.shape) < 0.8) / 0.8
            z = (pooled * drop) @ model.out + model.out_bias
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[chosen]).astype(np.float32) / len(chosen)
            d_pooled = error[:, None] * model.out[None, :] * drop * (pooled > 0)
            slopes: list[np.ndarray] = []
            touched, pushed = [], []
            filled = np.flatnonzero(size)
            doc = np.repeat(np.arange(len(filled)), size[filled])
            for w, width in enumerate(WIDTHS):
                slope = np.zeros_like(model.filters[w])
                g = d_pooled[filled, w * FILTERS : (w + 1) * FILTERS]
                if len(filled) and g.any():
                    best = np.maximum.reduceat(values[w], to[filled], axis=0)
                    at, which = np.nonzero(values[w] == best[doc])
                    _, first = np.unique(doc[at] * FILTERS + which, return_index=True)  # each text's and filter's first place of its maximum
                    top = at[first].reshape(len(filled), FILTERS)
                    for k in range(width):
                        own = slice(k * DIM, (k + 1) * DIM)
                        ok = (top + k < to[filled + 1][:, None]) & (g != 0)
                        here = np.where(ok, top + k, 0)
                        slope[own] += np.einsum("dfi,df->if", x[here], g * ok)
                        touched.append(here[ok])
                        pushed.append((model.filters[w][own].T[None] * g[:, :, None])[ok])
                slopes.append(slope)
            slopes += [d_pooled.sum(axis=0), (pooled * drop * error[:, None]).sum(axis=0), np.array([error.sum()], np.float32)]
            base = np.array([model.out_bias], np.float32)
            dense.step([*model.filters, model.bias, model.out, base], [s.astype(np.float32) for s in slopes])
            model.out_bias = float(base[0])
            if touched:  # the embeddings: Adagrad on the rows that a maximum came from
                here, push = words[np.concatenate(touched)], np.concatenate(pushed)
                flat, grads = here.ravel(), np.repeat(push, here.shape[1], axis=0)
                used, inverse = np.unique(flat, return_inverse=True)
                total = np.stack([np.bincount(inverse, weights=grads[:, i], minlength=len(used)) for i in range(DIM)], axis=1).astype(np.float32)
                squares[used] += (total**2).mean(axis=1)
                model.embed[used] -= 0.1 * total / (np.sqrt(squares[used])[:, None] + 1e-6)
                model.embed[BUCKETS] = 0


def _platt(z: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make ``sigmoid(scale * z + shift)`` fit ``hits`` of ``n`` rows at each z (Newton, ridge)."""
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * p - hits) + 1e-2 * (w - [1, 0])
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _best_threshold(p: np.ndarray, hits: np.ndarray, n: np.ndarray, prior: float, share: float = 1.0, strength: float = 20.0) -> float:
    """The threshold of best F1 over ``n`` rows, ``hits`` of label 1, at each p; pulled to ``prior`` as if by ``strength`` labels of 1.

    ``share`` rows of label 0 stand for one that was read.
    """
    total = hits.sum()
    if not total:
        return prior
    p, place = np.unique(-p, return_inverse=True)
    p, own, all_ = -p, np.bincount(place, weights=hits), np.bincount(place, weights=n)
    hit = np.cumsum(own)
    f1 = 2 * hit / (hit + np.cumsum(all_ - own) * share + total)
    best = int(f1.argmax())
    middle = float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)
    weight = total / (total + strength)
    return float(np.clip(weight * middle + (1 - weight) * prior, 0.2, 0.6))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """(rows, counts): the labelled rows (doc_id, text, lang, label, h), and all labels' counts.

    Ids with contradicting labels are not learnt from; an id that repeats with one label counts
    once.  Of the rows that repeat an id, the one of least text hash stays.  Texts enter whole.
    All rows are read unless the caller names a ``most``: then at most so many of each label, chosen
    from the labels alone (least hashes first), before they meet the texts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").select("doc_id", "label", F.xxhash64("doc_id").alias("h"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    ids = known if most is None else known.where("label = 0").orderBy("h", "doc_id").limit(most).unionByName(known.where("label = 1").orderBy("h", "doc_id").limit(most))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where("text is not null").where(F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 != 2).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    rows = texts.join(ids, "doc_id").groupBy("doc_id", "label", "h").agg(F.min(F.struct(F.xxhash64("text").alias("sum"), "text", "lang")).alias("row"))
    return rows.select("doc_id", "row.text", "row.lang", "label", "h"), counts


class Words:
    """Texts as numbers of distinct words, four bytes a word, gathered batch by batch."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.known = np.zeros(0, np.uint64)
        self.buckets = np.zeros((0, 1 + len(PREFIXES)), np.int32)

    def add(self, column: pa.Array) -> None:
        """Texts' words; a word's number is the rank of its hash, settled by :meth:`rows`."""
        hashes, buckets, at = word_features(column)
        self.hashes.append(hashes)
        self.sizes.append(np.diff(at))
        self.known, first = np.unique(np.r_[self.known, hashes], return_index=True)
        self.buckets = np.concatenate([self.buckets, buckets])[first]

    def rows(self) -> list[np.ndarray]:
        """The numbers of each text's words, rows of ``buckets``."""
        out = []
        while self.hashes:
            numbers = np.searchsorted(self.known, self.hashes.pop(0)).astype(np.int32)
            out += np.split(numbers, np.cumsum(self.sizes.pop(0))[:-1])
        return out


def _learner(k: int, epochs: int) -> A.Learn:
    def learn(state: np.ndarray, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        words, labels = Words(), []
        for whole in batches:
            for batch in B.slices(whole, "text"):
                words.add(batch.column("text"))
                labels.append(batch.column("label").to_numpy().astype(np.float64))
        model, squares = unpacked(state)
        rows = words.rows()
        train(model, squares, words.buckets, rows, np.concatenate(labels), 3 + k, epochs)
        return packed(model, squares)

    return learn


def share_of(count: dict[int, int], read: dict[int, int], most: int | None) -> float:
    """How many rows of label 0 one stands for, against one of label 1, where a caller's ``most`` reads the labels apart."""
    return 1.0 if most is None else (count[0] / read[0]) / (count[1] / read[1])


def fit(docs: DataFrame, labels: DataFrame, most: int | None = None) -> Model:
    """A calibrated model of the rows whose labels may be learnt (crc32 of the id's text is not 2 modulo 4).

    All of them are read, or ``most`` of each label if the caller asks so; training, calibration and
    thresholds read whole texts, as scoring does.  The driver sees no text.
    """
    rows, count = sampled(docs, labels, "toxic", most)
    rows, check, read, parts = A.divided(rows)
    if not (read[0] and read[1]):
        return Model(np.zeros((1, DIM)), [], np.zeros(0), np.zeros(0), 0.0, constant=float(read[1] > 0))
    start = packed(initial(read[1] / (read[0] + read[1])), np.zeros(BUCKETS + 1))
    model, _ = unpacked(A.trained(rows, parts, start, _learner))
    share = share_of(count, read, most)
    found = A.counted(check, lambda batch: np.concatenate([model.logits(*features(b.column("text"))) for b in B.slices(batch, "text")] or [np.zeros(0)]))
    lang = np.array([f[0] for f in found])
    z, hits, n = (np.array([f[i] for f in found], np.float64) for i in (1, 2, 3))
    model.scale, model.shift = _platt(z, hits, n)
    model.shift -= float(np.log(share))
    p = 1 / (1 + np.exp(-np.clip(z * model.scale + model.shift, -30, 30)))
    model.threshold = _best_threshold(p, hits, n, DEFAULT_THRESHOLD, share)
    for one in sorted(set(lang.tolist()) - {""}):
        own = lang == one
        model.thresholds[one] = _best_threshold(p[own], hits[own], n[own], model.threshold, share)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, rejected): ``rejected`` holds the score against the threshold of the row's language."""
    table = [(k, v) for k, v in sorted(model.thresholds.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = dict(table)
        for whole in batches:
            for batch in B.slices(whole, "text"):
                score = model.scores(batch.column("text"))
                limit = np.array([limits.get(x, model.threshold) for x in batch.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(score >= limit)], ["doc_id", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, score double, rejected boolean")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, rejected."""
    out = scored(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= DEFAULT_THRESHOLD).cast("int").alias("predicted"), "rejected")


def without_toxic(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    model = fit(labelled_docs, labels)
    table = dict(model.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "text"):
                limit = np.array([table.get(x, model.threshold) for x in batch.column("lang").to_pylist()])
                yield batch.filter(pa.array(model.scores(batch.column("text")) < limit))

    return docs.mapInArrow(run, docs.schema)
