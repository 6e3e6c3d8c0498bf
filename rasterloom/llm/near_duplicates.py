"""MinHash near-duplicates, candidates verified with odd sketches.

Per document: the distinct 2-word shingles (64-bit hashes), ``SAMPLES`` MinHash values,
``BANDS`` band keys of ``ROWS`` values each, and an odd sketch - a bitmap in which each
(index, MinHash value) flips one bit, so two sketches' XOR has about twice as many set
bits as there are differing samples, and its population count estimates high
similarities closely.

1. Documents of one shingle set form a class; the least id stands for it from here on.
2. In each bucket of the first ``FIRST_BANDS`` bands every class is paired with the bucket's
   least id, so a bucket of n gives n - 1 pairs, not all of them.  Distinct pairs pass the
   sketches' estimate (``ESTIMATE`` lies four and a half standard errors below 0.8), then the
   exact test on full sets.
3. Components of confirmed links, which hold most of any large group.  In each bucket of any
   band the least ids of its components are paired with the bucket's least id and tested alike.
4. Components again.  Where a bucket still holds several components, the
   documents outside its largest one are compared by sketch, block by block, with all its
   others; a pair counts in the first band that it shares only, so no link that could join two
   components is lost and none is looked at twice.  The exact test of what passes is dealt by
   the other document: a document outside comes once for a part, with the list of those it
   may be linked with.  The askers of a part are dealt to chunks of about ``ASK_BYTES`` of text and
   lists, and each text of the part comes once for a chunk.  It leaves as soon as it is
   linked with a component, so a large group's near misses are never rows.
5. Components again, over all confirmed links.

Two sets of similarity 0.8 share no band with probability (1 - 0.8**5)**50 < 3e-9.

Defined results: null, empty or blank texts have no set, link with nothing and stay.  Rows
with a null id link with nothing and stay.  Rows that repeat an id are one document to the
links: what any of their texts links with is one component.  Ties go to the least id.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import contracted_labels
from . import bytetext as B
from .scratch import written

BANDS, ROWS = 50, 5
SAMPLES = BANDS * ROWS
FIRST_BANDS = 6
BITS = 1024
ESTIMATE = 0.675
BLOCK = 256
WIDE_BLOCK = 1 << 12
ASK_BYTES = 8 << 20

_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_C = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND_MIX = _rng.integers(0, 1 << 63, (1, BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's ``size``-word shingles, one of all its words if it has fewer."""
    data, offsets = B.text_buffer(column)
    low = B.LOWER[data]
    starts, ends = B.runs(B.NOT_BLANK[low], offsets)
    word = B.span_hash(B.prefix_hash(low), starts, ends)
    row = B.owner(starts, offsets)
    count = np.bincount(row, minlength=len(column))
    at = np.r_[0, np.cumsum(count)]
    # a shingle of k words: k chained mixes, so no shorter one can equal it
    chain, short = word, {}
    for k in range(1, size):
        short[k] = chain
        chain = B.mix(chain[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k:]) if len(chain) > 1 else chain[:0]
    n = np.maximum(count - size + 1, 0)
    begin = np.repeat(at[:-1], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    out = chain[begin]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        n[few] = 1
        to = np.r_[0, np.cumsum(n)]
        whole = np.empty(int(to[-1]), np.uint64)
        mask = np.ones(len(whole), bool)
        mask[to[few]] = False
        whole[mask] = out
        whole[to[few]] = [B.mix(short[int(count[r])][at[r] : at[r] + 1] + np.uint64(int(count[r])))[0] for r in few]
        return whole, to
    return out, np.r_[0, np.cumsum(n)]


def minhashes(values: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of 64-bit hashes."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        np.minimum(out, (_A * x[None, a : a + 4096] + _C).min(axis=1), out=out)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """A row of BITS / 64 words for each row of MinHash samples: parities of hashed (index, value)."""
    index = np.arange(SAMPLES, dtype=np.uint64)[None, :] << np.uint64(32)
    bit = (B.mix(index | samples.astype(np.uint64)) % np.uint64(BITS)).astype(np.int64)
    flat = (bit + np.arange(len(samples))[:, None] * BITS).ravel()
    odd = np.bincount(flat, minlength=len(samples) * BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(samples), BITS // 64)


def most_different_bits(similarity: float) -> float:
    """The XOR's population count at which the estimate equals ``similarity``."""
    return BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / BITS))


SKETCH_SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "text"):
                hashes, at = shingles(batch.column("text"), size)
                n, keys, samples = [], [], np.zeros((batch.num_rows, SAMPLES), np.uint32)
                for i in range(batch.num_rows):
                    own = np.unique(hashes[at[i] : at[i + 1]])
                    n.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    samples[i] = minhashes(own)
                mixed = (samples.astype(np.uint64).reshape(-1, BANDS, ROWS) + np.uint64(1)) * _BAND_MIX
                bands = B.mix(mixed.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                words = odd_sketches(samples)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), listed(bands), listed(words)], ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "text_a"):
                left, at = shingles(batch.column("text_a"), size)
                right, to = shingles(batch.column("text_b"), size)
                keep, last, own = np.zeros(batch.num_rows, bool), None, None
                a = batch.column("a").to_pylist()
                for i in range(batch.num_rows):
                    if a[i] != last:
                        own, last = np.unique(left[at[i] : at[i + 1]]), a[i]
                    other = np.unique(right[to[i] : to[i + 1]])
                    keep[i] = _similar(own, other, percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _blocks(most: float):
    """Candidates across components: documents of a chunk (``left``) with those of a block, listed by the others' part."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bucket = table.column("bucket")[0].as_py()
        doc, label, minor, left, part = (table.column(c).to_numpy() for c in ("doc", "label", "minor", "left", "part"))
        wide = lambda c: np.asarray(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(doc), -1)
        words, bands = wide("sketch").view(np.uint64), wide("bands")
        right = np.flatnonzero(~left)
        rows: list[dict] = []
        for i in np.flatnonzero(left):
            other = right[(label[right] != label[i]) & (~minor[right] | (doc[right] > doc[i]))]
            other = other[np.bitwise_count(words[other] ^ words[i]).sum(axis=1) <= most]
            shared = bands[other] == bands[i]
            other = other[shared.argmax(axis=1) == int(np.flatnonzero(bands[i] == bucket)[0])] if len(other) else other
            for p in np.unique(part[other]):
                own = other[part[other] == p]
                rows.append({"doc": int(doc[i]), "part": int(p), "others": doc[own].tolist(), "labels": label[own].tolist()})
        return pa.Table.from_pylist(rows, pa.schema([("doc", pa.int64()), ("part", pa.int32()), ("others", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64()))]))

    return run


def _answered(size: int, percent: int):
    """Links between the documents of a part and those that ask for them, one for each asker and component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = pc.is_valid(table.column("others"))
        sets: dict[int, list[np.ndarray]] = {}  # several where rows repeat an id
        a, b = [], []
        for asking in (False, True):
            for whole in table.filter(asks if asking else pc.invert(asks)).to_batches():
                for batch in B.slices(whole, "text"):
                    hashes, at = shingles(batch.column("text"), size)
                    doc = batch.column("doc").to_pylist()
                    if not asking:
                        for i, d in enumerate(doc):
                            sets.setdefault(d, []).append(np.unique(hashes[at[i] : at[i + 1]]))
                        continue
                    for i, (others, labels) in enumerate(zip(batch.column("others").to_pylist(), batch.column("labels").to_pylist(), strict=True)):
                        own, linked = np.unique(hashes[at[i] : at[i + 1]]), set()
                        for other, label in zip(others, labels, strict=True):
                            if label not in linked and any(_similar(own, x, percent) for x in sets[other]):
                                linked.add(label)
                                a.append(min(doc[i], other))
                                b.append(max(doc[i], other))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _chunks(n: Column) -> Column:
    return F.ceil(n / WIDE_BLOCK).cast("int")


def _spread(n: Column) -> Column:
    return F.pmod(F.xxhash64("doc"), n).cast("int")


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _dealt(left: DataFrame, reps: DataFrame, parts_of: int) -> DataFrame:
    """The rows of open buckets for :func:`_blocks`: each chunk of documents outside the major component meets each block.

    Sketches join before the copies, so the join has one row for each place in an open bucket; a bucket of up to
    ``WIDE_BLOCK`` places isn't copied at all.
    """
    sketched = left.join(reps.select(F.col("doc_id").alias("doc"), "sketch", "bands", F.pmod(F.xxhash64("doc_id"), F.lit(parts_of)).cast("int").alias("part")), "doc")
    deal = lambda rows, own, chunk, block: rows.select("bucket", "doc", "label", "minor", F.lit(own).alias("left"), chunk.alias("chunk"), block.alias("block"), "sketch", "bands", "part")
    asking = deal(sketched.where("minor"), True, _spread(F.col("chunks")), _upto(F.col("blocks")))
    return asking.unionByName(deal(sketched, False, _upto(F.col("chunks")), _spread(F.col("blocks"))))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of
    ``size``-word shingles.  The bands are laid out for 80 percent and more.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for 80 percent and more")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(text.mapInArrow(_sketch(size), SKETCH_SCHEMA), "sketches")
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("set_key", "rep")
    classes = written(classes, "classes")  # a table of its own, as are the buckets' heads, so that the join can split a hot key
    members = written(filled.select("doc_id", "set_key").distinct().join(classes, "set_key").where("doc_id != rep").select("doc_id", "set_key", "rep"), "members")
    reps = written(filled.join(members, ["doc_id", "set_key"], "left_anti").select("doc_id", "bands", "sketch"), "representatives")
    # an id that repeats with several sets ties their classes
    several = filled.groupBy("doc_id").agg(F.min("set_key").alias("k"), F.max("set_key").alias("l")).where("k != l").select("doc_id")
    ties = members.join(several, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    entries = reps.select(F.posexplode("bands").alias("band", "bucket"), "doc_id")
    heads = entries.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("head != last").select("bucket", "head", "n")
    heads = written(heads, "heads")
    buckets = written(entries.join(heads, "bucket").select("band", "bucket", "doc_id", "head", "n"), "buckets")
    most = most_different_bits(ESTIMATE)
    sketch_of = reps.select(F.col("doc_id").alias("id"), "sketch")
    different = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return written(full.mapInArrow(_confirm(size, percent), "a long, b long"), name)

    def estimated(pairs: DataFrame) -> DataFrame:
        sketched = pairs.join(sketch_of.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(sketch_of.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        return sketched.where(different <= F.lit(int(most))).select("a", "b")

    def in_buckets(labels: DataFrame) -> DataFrame:
        label_of = labels.select(F.col("id").alias("doc_id"), "label")
        return buckets.join(label_of.hint("merge"), "doc_id", "left").select("bucket", F.col("doc_id").alias("doc"), F.coalesce("label", "doc_id").alias("label"), "n")

    keep = lambda df: written(df, "labels")
    tested = buckets.where((F.col("band") < FIRST_BANDS) & (F.col("doc_id") != F.col("head"))).select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = confirmed(estimated(tested), "links").unionByName(ties)
    labels = contracted_labels(links, keep)
    known = lambda: labels.select(F.col("label").alias("a"), F.col("id").alias("b"))

    # a place of each component in each bucket
    parts = in_buckets(labels).groupBy("bucket", "label").agg(F.min("doc").alias("b"))
    leads = parts.groupBy("bucket").agg(F.min("b").alias("a"), F.max("b").alias("last")).where("a != last").select("bucket", "a")
    between = written(parts.join(leads, "bucket").where("a != b").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    labels = contracted_labels(known().unionByName(confirmed(estimated(between), "links")), keep)

    # buckets that still hold more than one component
    rest = in_buckets(labels).where("n > 2")
    sizes = rest.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1")
    left = rest.join(open_, "bucket").withColumn("minor", F.col("label") != F.col("major.label"))
    left = left.select("bucket", "doc", "label", "minor", _chunks(F.col("n") - F.col("major.k")).alias("chunks"), _chunks(F.col("n")).alias("blocks"))
    left = written(left, "open-buckets")
    if left.limit(1).count():
        others = left.select("doc").distinct()
        parts_of = max(1, -(-others.count() // BLOCK))
        part = F.pmod(F.xxhash64("doc"), F.lit(parts_of)).cast("int").alias("part")
        found = _dealt(left, reps, parts_of).groupBy("bucket", "chunk", "block").applyInArrow(_blocks(most), "doc long, part int, others array<long>, labels array<long>")
        lists = F.sort_array(F.collect_list(F.struct("others", "labels")))
        asks = found.groupBy("doc", "part").agg(lists.alias("l")).select("doc", "part", F.flatten("l.others").alias("others"), F.flatten("l.labels").alias("labels"))
        texts = text.select(F.col("doc_id").alias("doc"), "text")
        none = F.lit(None).cast("array<long>")
        asks = written(asks, "asks")
        sized = asks.join(text.groupBy(F.col("doc_id").alias("doc")).agg(F.sum(F.octet_length("text")).alias("bytes")), "doc")
        chunks = sized.groupBy("part").agg(F.ceil(F.sum(F.col("bytes") + 16 * F.size("others")) / ASK_BYTES).cast("int").alias("chunks"))
        chunks = written(chunks, "chunks")  # a row per part
        asks = asks.join(chunks, "part").withColumn("chunk", _spread(F.col("chunks"))).drop("chunks")
        answers = others.select("doc", part, none.alias("others"), none.alias("labels")).join(chunks, "part").withColumn("chunk", _upto(F.col("chunks"))).drop("chunks")
        parts = asks.unionByName(answers).join(texts, "doc")
        more = written(parts.groupBy("part", "chunk").applyInArrow(_answered(size, percent), "a long, b long"), "more-links")
        labels = contracted_labels(known().unionByName(more), keep)

    label_of = labels.select(F.col("id").alias("rep"), "label")
    out = sketches.select("doc_id", "n_shingles").join(members.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(label_of, "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
