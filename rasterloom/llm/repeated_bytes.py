"""Suffix-array removal of repeated byte strings, in shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus
(smaller doc_id, or same document and earlier start).

1. *Anchors.*  Each window of ``LENGTH`` bytes names the place of its least ``GRAM``-byte
   hash (the last such place).  Equal windows name the same place in them, so they meet
   under one anchor hash.  Consecutive windows with one anchor form a context, about 39
   windows long.  Contexts whose anchor hash is alone in the corpus leave here.
2. *Contexts.*  Equal contexts (by 128 bits of hashes) are pre-aggregated to their first place,
   whose bytes are cut from the texts; all later places repeat it.  So a text that a third
   of all documents copy enters one shard once.
3. *Shards.*  Distinct contexts are dealt by anchor hash to shards of bounded size.  Each
   shard sorts its suffixes (recursive induced sorting, see :mod:`.suffix_array`), computes permuted
   common prefixes, and reads off runs of windows that share ``LENGTH`` bytes; all but a run's
   first place go.
   A hot anchor (more than ``SPLIT_OVER`` distinct contexts, as at the edges of a passage that a
   third of all documents share) must not gather in one shard.  Its windows are named again, by their
   2, 4, 8, ... least hashes and at last by all of their bytes; consecutive windows of one name
   form finer contexts, which go through steps 2 and 3 alike until no name is hot.  A name is a
   function of the window's bytes, so equal windows still meet, and all of them in a suffix array.
4. Ranges meet by document, and the remaining bytes are hashed.

Defined results: null and empty texts have no bytes.  Rows without an id come after all
others; rows that repeat an id are one place where their strings agree.  Empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .scratch import discard, written
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 100, 24
SHARD_BYTES = 1 << 19
#: distinct contexts of one name beyond which its windows are named again
SPLIT_OVER = 5_000
#: least hashes that name a window, level by level; after the last one its own bytes do
LEVELS = (2, 4, 8, 16, 32)
LAST = 2**63 - 1


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """(row, start, stop, key, hash) of each context; start and stop are bytes of ``data``, and the hash is 0 unless ``hashed``."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    sums = B.prefix_hash(data)
    key = B.span_hash(sums, np.arange(n - gram + 1), np.arange(gram, n + 1))
    bits = max(24, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    least = (key & ~low) | (low - np.arange(len(key), dtype=np.uint64))  # ties: the last place
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    place = (low - (least & low)).astype(np.int64)
    start = np.arange(len(place))
    row = B.owner(start, offsets)
    ok = start + length <= offsets[row + 1]
    start, row, place = start[ok], row[ok], place[ok]
    if not len(start):
        return none, none, none, none, none
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[first[1:] - 1, len(start) - 1]
    begin, end = start[first], start[last] + length
    return row[first], begin, end, key[place[first]].view(np.int64), B.span_hash(sums, begin, end).view(np.int64) if hashed else np.zeros(len(begin), np.int64)


WIDTH_BITS = 16  # of a place: its start, shifted, and its size


def _anchor_keys(length: int, gram: int):
    """Anchor hashes with their numbers of contexts, counted slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "text"):
                key, n = np.unique(anchors(*B.text_buffer(batch.column("text")), length, gram, hashed=False)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    return run


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "text"):
                data, offsets = B.text_buffer(batch.column("text"))
                row, start, stop, key, hash_ = anchors(data, offsets, length, gram)
                doc, sum_ = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("doc", "sum"))
                place = ((start - offsets[row]) << WIDTH_BITS) | (stop - start)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, hash_, doc[row], sum_[row], place)], ["key", "hash", "doc", "sum", "place"])

    return run


CONTEXTS = "wide boolean, key long, context binary, doc long, sum long, start int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each context."""
    for whole in batches:
        for batch in B.slices(whole, "text"):
            data, offsets = B.text_buffer(batch.column("text"))
            places = batch.column("places")
            count = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = places.flatten()
            row = np.repeat(np.arange(batch.num_rows), count)
            place, key = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False)) for c in ("place", "key"))
            doc, sum_ = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("doc", "sum"))
            start, size = place >> WIDTH_BITS, place & ((1 << WIDTH_BITS) - 1)
            at = np.r_[0, np.cumsum(size)]
            take = np.repeat(offsets[row] + start - at[:-1], size) + np.arange(at[-1])
            yield pa.RecordBatch.from_arrays([flat.field("wide"), pa.array(key), B.binary_array(at, data[take]), pa.array(doc[row]), pa.array(sum_[row]), pa.array(start.astype(np.int32))], ["wide", "key", "context", "doc", "sum", "start"])


def finer_contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, level: int | None) -> tuple[np.ndarray, ...]:
    """(row, start, stop, key, hash) of contexts whose windows share their ``level`` least hashes (None: all of their bytes)."""
    start = np.arange(max(0, len(data) - length + 1))
    row = B.owner(start, offsets)
    ok = start + length <= offsets[row + 1]
    start, row = start[ok], row[ok]
    sums = B.prefix_hash(data)
    if level is None:
        key = B.span_hash(sums, start, start + length)
    else:
        grams = B.span_hash(sums, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1)) if len(start) else np.zeros(length, np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1)[start]
        key = B.mix(np.partition(windows, level - 1, axis=1)[:, :level].sum(axis=1, dtype=np.uint64))
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])]) if len(start) else start
    last = np.r_[first[1:] - 1, len(start) - 1] if len(start) else start
    begin, end = start[first], start[last] + length
    return row[first], begin, end, key[first].view(np.int64), B.span_hash(sums, begin, end).view(np.int64)


def _finer(length: int, gram: int, level: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "context", 1 << 17):
                data, offsets = B.text_buffer(batch.column("context"))
                row, begin, end, key, hash_ = finer_contexts(data, offsets, length, gram, level)
                doc, sum_, start = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("doc", "sum", "start"))
                size = end - begin
                at = np.r_[0, np.cumsum(size)]
                take = np.repeat(begin - at[:-1], size) + np.arange(at[-1])
                place = (start[row] + begin - offsets[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(hash_), B.binary_array(at, data[take]), pa.array(doc[row]), pa.array(sum_[row]), pa.array(place)], ["key", "hash", "context", "doc", "sum", "start"])

    return run


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        """Ranges of the shard's contexts that repeat an earlier string."""
        table = table.combine_chunks()
        data, offsets = B.text_buffer(table.column("context"))
        doc, sum_, start = (table.column(c).to_numpy() for c in ("doc", "sum", "start"))
        size = np.diff(offsets)
        begin = offsets[:-1] + np.arange(len(size))  # a separator after each context
        text = np.ones(len(data) + len(size) + 1, np.uint8)
        text[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data + 2
        text[-1] = 0
        array = suffix_array(text, 256)
        shared = common_prefixes(text, array, length + 2 * int(size.max()))
        context = np.repeat(np.arange(len(size)), size + 1)
        inside = np.arange(len(context)) - begin[context]
        window = np.zeros(len(text), bool)  # places where a whole window of a context begins
        window[:-1] = inside + length <= size[context]
        run_of = np.cumsum(np.r_[True, shared[array[1:]] < length])
        use = window[array]
        place, run_of = array[use].astype(np.int64), run_of[use]
        if not len(place):
            found = np.zeros(0, np.int64)
        else:
            rank = np.unique(doc, return_inverse=True)[1].astype(np.int64)
            order = (rank[context[place]] << 36) + start[context[place]] + inside[place]
            edge = np.flatnonzero(np.r_[True, run_of[1:] != run_of[:-1]])
            least = np.repeat(np.minimum.reduceat(order, edge), np.diff(np.r_[edge, len(order)]))
            found = np.sort(place[order > least])
        owner = context[found]
        new = np.r_[True, (found[1:] != found[:-1] + 1) | (owner[1:] != owner[:-1])] if len(found) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        b = np.r_[a[1:] - 1, len(found) - 1] if len(a) else a
        own = owner[a]
        lo = start[own] + inside[found[a]]
        hi = start[own] + inside[found[b]] + length
        return pa.table({"doc": pa.array(doc[own], pa.int64()), "sum": pa.array(sum_[own], pa.int64()), "start": pa.array(lo.astype(np.int32)), "stop": pa.array(hi.astype(np.int32))})

    return run


RANGES = "doc long, sum long, start int, stop int"


def repeated_ranges(text: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, sum, start, stop): byte ranges of ``text(doc, sum, text)`` to remove; they may overlap."""
    rows = text.mapInArrow(_anchor_rows(length, gram), "key long, hash long, doc long, sum long, place long")
    keys = text.select("text").mapInArrow(_anchor_keys(length, gram), "key long, n long")
    many = written(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "anchors")  # so that the join can split a hot key
    places = written(rows.join(many, "key"), "places")
    at = F.struct("doc", "place", "sum")
    firsts = written(places.groupBy("key", "hash").agg(F.min(at).alias("first"), F.max(at).alias("last")).select("key", "hash", "first.*", (F.col("first") != F.col("last")).alias("again")), "contexts")

    # later places of a context repeat all of it
    size = F.col("place").bitwiseAND((1 << WIDTH_BITS) - 1)
    start = F.shiftright("place", WIDTH_BITS)
    again = firsts.where("again").select("key", "hash", F.col("doc").alias("d"), F.col("place").alias("p"))
    later = places.join(again, ["key", "hash"]).where("doc != d or place != p").select("doc", "sum", start.cast("int").alias("start"), (start + size).cast("int").alias("stop"))
    later = written(later, "later-places")
    discard(places)

    crowded = lambda df: df.groupBy("key").agg((F.count("*") > SPLIT_OVER).alias("wide")).where("wide")
    flat = firsts.join(crowded(firsts), "key", "left").select("doc", "sum", F.struct("key", "place", F.coalesce("wide", F.lit(False)).alias("wide")).alias("place"))
    by_doc = flat.groupBy("doc", "sum").agg(F.collect_set("place").alias("places"))
    cut = text.where(F.octet_length("text") >= length).join(by_doc, ["doc", "sum"]).select("text", "places", "doc", "sum").mapInArrow(_cut, CONTEXTS)
    cut = written(cut, "cut-contexts")
    found = [_sorted(cut.where("not wide"), length), later]
    for level in (*LEVELS, None):
        coarse = cut.where("wide").drop("wide")
        if not coarse.limit(1).count():
            break
        fine = written(coarse.mapInArrow(_finer(length, gram, level), "key long, hash long, context binary, doc long, sum long, start int"), "fine-contexts")
        at = F.struct("doc", "start", "sum", "context")
        distinct = written(fine.groupBy("key", "hash").agg(F.min(at).alias("first"), F.max(F.struct("doc", "start")).alias("last")).select("key", "hash", "first.*", "last"), "fine-firsts")
        again = distinct.where("doc != last.doc or start != last.start").select("key", "hash", F.col("doc").alias("d"), F.col("start").alias("s"))
        found.append(fine.join(again, ["key", "hash"]).where("doc != d or start != s").select("doc", "sum", "start", (F.col("start") + F.octet_length("context")).cast("int").alias("stop")))
        cut = distinct.join(crowded(distinct), "key", "left").select(F.coalesce("wide", F.lit(False)).alias("wide"), "key", "context", "doc", "sum", "start")
        cut = written(cut if level else cut.withColumn("wide", F.lit(False)), "cut-contexts")  # a window's own bytes are one context
        found.append(_sorted(cut.where("not wide"), length))
    return reduce(DataFrame.unionByName, found)


def _sorted(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated ranges of ``contexts``, dealt by their names to suffix arrays of bounded size."""
    shards = max(1, -(-(contexts.agg(F.sum(F.octet_length("context") + 1)).first()[0] or 0) // SHARD_BYTES))
    dealt = contexts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_dealt(_shard(length)), RANGES)


def _dealt(run):
    return lambda table: run(table.select(["context", "doc", "sum", "start"]))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, spans, sha = [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            raw = (text or "").encode()
            at, left, removed, runs, end = 0, hashlib.sha256(), 0, 0, -1
            for r in ranges:
                lo, hi = max(r["start"], at), r["stop"]
                if r["start"] > end:
                    runs += 1
                if hi > at:
                    left.update(raw[at:lo])
                    removed += hi - lo
                    at = hi
                end = max(end, hi)
            left.update(raw[at:])
            n.append(removed)
            spans.append(runs)
            sha.append(left.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("sum"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc", "sum", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    # rows that share an id are told apart by a hash of their text
    shared = text.groupBy("doc").count().where("count > 1").limit(1).count()
    text = text.withColumn("sum", F.xxhash64("text") if shared else F.lit(0).cast("long"))
    ranges = repeated_ranges(text.select("doc", "sum", "text"), length).groupBy("doc", "sum").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("ranges"))
    ranges = written(ranges, "ranges")
    cut = text.select("doc", "sum", "text").join(ranges, ["doc", "sum"]).mapInArrow(_kept, "doc long, sum long, n_removed long, n_spans long, kept_sha256 string")
    cut = cut.dropDuplicates(["doc", "sum"]) if shared else cut
    whole = text.select("doc", "sum", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("own"))
    zero = F.lit(0).cast("long")
    return whole.join(cut, ["doc", "sum"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))
