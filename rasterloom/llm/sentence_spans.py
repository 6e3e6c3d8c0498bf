"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences: at line ends and after a stop (``STOPS``), which closing marks
(``CLOSERS``) may follow; a full-width stop ends a sentence where it stands, the
others at the end of a word.  Sentences of ``PIECE`` words or more are cut again before the word of least hash of
every ``PIECE`` consecutive words (the last such word), which depends on those words alone.  So no
piece has over ``PIECE`` words, cuts that lie ``PIECE`` words or more inside a passage are the
same wherever it stands, and 50 words, with stops or without, always hold three whole pieces.
At every sentence a run begins: ``span`` consecutive sentences, and as many more as it takes to reach
``least_words`` words (three sentences of a word each repeat by chance in texts that have
nothing to do with each other).  Its words are hashed (128 bits; white
space doesn't matter).  A run found more than once in the corpus keeps its first place,
the one with the least (doc_id, sentence); sentences that any other place covers go.

The repeated runs come from an aggregation that counts before it shuffles, so a passage
that a third of all documents share is one row per task there; the way back is an inner
join in which Spark can split a hot key.

Defined results: null, empty and blank texts have no sentences and stay as they are
(null stays null).  Rows without an id come after all others.  Rows that share an id, or
have none, are told apart by a hash of their text and come in its order; rows that agree in both are one
place.  A text whose sentences all go becomes empty.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as B
from .scratch import written

PIECE = 12
LONG = PIECE - 1  # sentences of more words are cut, so that the cuts do not depend on what stands around a passage
#: fixed values: marks that end a sentence, those of them that need no white space after them, and marks that may close after one
STOPS = ".!?…؟۔।。．！？"
WIDE_STOPS = "。．！？"
CLOSERS = "\"')]}»”’›」』）】"
_BASES = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
LAST = 2**63 - 1


def _ends_with(data: np.ndarray, ends: np.ndarray, marks: str) -> np.ndarray:
    """For each end, the bytes of the mark of ``marks`` that stands right before it, 0 where none does."""
    size = np.zeros(len(ends), np.int64)
    for mark in marks:
        raw = mark.encode()
        hit = (ends >= len(raw)) & (data[np.maximum(ends - 1, 0)] == raw[-1])
        for k in range(2, len(raw) + 1) if hit.any() else ():
            hit &= data[np.maximum(ends - k, 0)] == raw[-k]
        size[hit] = len(raw)
    return size


def stopped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word ends in a stop, closing marks aside."""
    end = ends.copy()
    todo = np.arange(len(end))
    while len(todo):
        size = _ends_with(data, end[todo], CLOSERS)
        go = (size > 0) & (end[todo] - size > starts[todo])
        todo = todo[go]
        end[todo] -= size[go]
    return _ends_with(data, end, STOPS) > 0


def wide_stops(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places behind full-width stops and the closing marks that follow them, text by text."""
    raw = data.tobytes()
    if not any(mark.encode() in raw for mark in WIDE_STOPS):
        return np.zeros(0, np.int64)
    at = offsets.tolist()
    return np.array([m.end() for a, b in zip(at[:-1], at[1:], strict=True) for m in _WIDE.finditer(raw, a, b)], np.int64)


_WIDE = re.compile(b"(?:" + b"|".join(c.encode() for c in WIDE_STOPS) + b")+(?:" + b"|".join(re.escape(c.encode()) for c in CLOSERS) + b")*")


class Sentences:
    """Sentences of a column of texts: first word and first byte of each."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = B.text_buffer(column)
        starts, ends = B.runs(B.NOT_BLANK[self.data], self.offsets)
        cuts = wide_stops(self.data, self.offsets)
        if len(cuts):  # words go on right behind a full-width stop
            at = np.searchsorted(starts, cuts, "right") - 1
            cuts = cuts[(at >= 0) & (cuts > starts[at]) & (cuts < ends[at])]
            starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
        self.starts, self.ends = starts, ends
        row = B.owner(starts, self.offsets)
        n = len(starts)
        new = np.zeros(n, bool)
        if n:
            lines = np.r_[0, np.cumsum(self.data == 10)]
            new[0] = True
            new[1:] = (row[1:] != row[:-1]) | stopped(self.data, starts, ends)[:-1] | (lines[starts[1:]] > lines[ends[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, n])
            new[self.pieces(np.repeat(np.where(size > LONG, first, -1), size))] = True
        self.first = np.flatnonzero(new)  # word that begins each sentence
        self.row = row[self.first]
        self.count = np.bincount(self.row, minlength=len(column))
        self.at = np.r_[0, np.cumsum(self.count)]
        self.n_words = n

    @cached_property
    def words(self) -> np.ndarray:
        """A hash of each word."""
        return B.span_hash(B.prefix_hash(self.data), self.starts, self.ends)

    def pieces(self, sentence: np.ndarray) -> np.ndarray:
        """Words that begin a piece; ``sentence`` numbers the words' long sentences (-1: a shorter one)."""
        if len(sentence) < PIECE or sentence.max() < 0:
            return np.zeros(0, np.int64)
        low = np.uint64((1 << len(sentence).bit_length()) - 1)
        least = (self.words & ~low) | (low - np.arange(len(sentence), dtype=np.uint64))  # ties: the last word
        least = np.lib.stride_tricks.sliding_window_view(least, PIECE)
        inside = np.flatnonzero((sentence[: len(least)] >= 0) & (sentence[: len(least)] == sentence[PIECE - 1 :]))
        return np.unique(low - (least[inside].min(axis=1) & low)).astype(np.int64)

    def spans(self, span: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sentence number, sentences, two hashes) of each run of ``span`` sentences or more and ``least_words`` words or more."""
        empty = np.zeros(0, np.int64)
        if len(self.first) < span:
            return empty, empty, empty, empty
        edge = np.r_[self.first, self.n_words]
        at = np.arange(len(self.first))
        upto = np.maximum(at + span, np.searchsorted(edge, self.first + least_words))
        ok = upto <= self.at[self.row + 1]
        at, upto = at[ok], upto[ok]
        begin, end = edge[at], edge[upto]
        out = []
        for base, inverse in zip(_BASES, _INVERSES, strict=True):
            power = np.full(self.n_words, base)
            power[:1] = 1
            sums = np.r_[np.uint64(0), np.cumsum(self.words * np.multiply.accumulate(power))]
            back = np.full(self.n_words + 1, inverse)
            back[0] = 1
            back = np.multiply.accumulate(back)
            out.append(B.mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)).view(np.int64))
        return at, upto - at, out[0], out[1]


SIZE_BITS = 20  # of a run's place: its first sentence, shifted, and its number of sentences


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns that tell its rows apart, and their names: doc, and a hash of the text where ids repeat."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    shared = docs.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).count()
    keyed = docs.withColumn("__doc", doc)
    return (keyed.withColumn("__sum", F.xxhash64(F.col("text").cast("string"))), ["doc", "sum"]) if shared else (keyed, ["doc"])


def span_rows(keyed: DataFrame, key: list[str], span: int, least_words: int) -> DataFrame:
    """(doc, ..., place, h1, h2): the run that begins at each sentence of ``keyed(__doc, ..., text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "text"):
                cut = Sentences(batch.column("text"))
                at, size, h1, h2 = cut.spans(span, least_words)
                rows = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False))[cut.row[at]] for c in key]
                place = ((at - cut.at[cut.row[at]]) << SIZE_BITS) | size
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*rows, place, h1, h2)], [*key, "place", "h1", "h2"])

    return keyed.select(*(F.col(f"__{c}").alias(c) for c in key), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in (*key, "place", "h1", "h2")))


def repeated_sentences(keyed: DataFrame, key: list[str], span: int = 3, least_words: int = 8) -> DataFrame:
    """(doc, ..., gone): the numbers of the sentences to remove from each text that has any."""
    spans = span_rows(keyed, key, span, least_words)
    place = F.struct(*key, "place")
    firsts = spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    firsts = written(firsts, "first-spans")  # a table of its own, so that Spark can split a hot key of the join
    later = spans.join(firsts, ["h1", "h2"]).where(place != F.col("first")).select(*key, "place")
    runs = later.groupBy(*key).agg(F.collect_set("place").alias("runs"))
    first = lambda r: F.shiftright(r, SIZE_BITS).cast("int")
    size = lambda r: r.bitwiseAND(F.lit((1 << SIZE_BITS) - 1)).cast("int")
    return runs.select(*key, F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(first(r), first(r) + size(r) - 1))))).alias("gone"))


def substring_dedup(docs: DataFrame, span: int = 3, least_words: int = 8) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and n_sentences, n_removed added."""
    own = ["__doc", "__sum", "__gone", "n_sentences", "n_removed"]
    kept, key = _keyed(docs.drop("n_sentences", "n_removed"))
    gone = repeated_sentences(kept, key, span, least_words).select(*(F.col(c).alias(f"__{c}") for c in key), F.col("gone").alias("__gone"))
    rows = kept.withColumn("text", F.col("text").cast("string")).join(gone, [f"__{c}" for c in key], "left").select(*(c for c in kept.columns if c not in own), "__gone")
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in own), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "text"):
                cut = Sentences(batch.column("text"))
                texts = batch.column("text").to_pylist()
                removed = np.zeros(batch.num_rows, np.int64)
                for i, numbers in enumerate(batch.column("__gone").to_pylist()):
                    if numbers:
                        a, b = cut.at[i], cut.at[i + 1]
                        lo, hi = cut.offsets[i], cut.offsets[i + 1]
                        begin = cut.starts[cut.first[a:b]].copy()
                        begin[0] = lo
                        edges = np.r_[begin, hi]
                        stay = np.ones(b - a, bool)
                        stay[[k for k in numbers if k < b - a]] = False
                        texts[i] = b"".join(cut.data[edges[k] : edges[k + 1]].tobytes() for k in np.flatnonzero(stay)).decode()
                        removed[i] = int((~stay).sum())
                columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in batch.schema.names if name != "__gone"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut.count.astype(np.int64)), pa.array(removed)], [n for n in batch.schema.names if n != "__gone"] + ["n_sentences", "n_removed"])

    return rows.mapInArrow(run, schema)
