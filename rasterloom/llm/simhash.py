"""SimHash fingerprints, and their classes through pivot distance tables.

1. A text's words (white space apart, A-Z lower-cased) give shingles, repeats included; a bit of the
   fingerprint is set where more than half of the shingles' XXH64 hashes have it.
2. Equal fingerprints are one node.  The pivot table holds each node's Hamming distances to ``PIVOTS``
   reference fingerprints.  By the triangle inequality no coordinate of two linked nodes differs by more
   than the linking distance ``d``.
3. Nodes meet where they agree in one of ``d + 1`` parts of the bits, which linked nodes always do.
   Inside such a bucket they lie in the order of the first coordinate, and a streaming sweep meets only
   those whose first coordinates differ by ``d`` at most; the other coordinates discard pairs by their
   maximum difference, and whole fingerprints verify what survives.
4. A bucket of over ``CROWD`` nodes is split: its nodes agree in half of ``2 d`` parts of the bits left
   free, so each goes to the buckets of all such halves.  Two splits leave 12 bits or so free, and as nodes
   are distinct, no bucket of the last level is larger than that allows, whatever the data.
5. Each sweep passes on a star for each of its local classes; components of these links are the classes.

Defined results: a null or blank text has fingerprint zero and is linked like any other.  Rows of one id
are one document, so their fingerprints are linked; repeated rows stay.  A row without an id takes part
and gets its class's least id, null where the class has none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_labels
from .scratch import discard, written

#: reference fingerprints of the pivot table
PIVOTS = 16
REFERENCES = np.random.default_rng(20240229).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
#: nodes of a bucket that one sweep takes without splitting it
CROWD = 4_096
#: levels of buckets: one and two splits
LEVELS = 3
#: shingles hashed at a time, so that a long text needs no more memory
SHINGLES = 1 << 16
#: rows that a sweep holds, besides those of the window that it still needs
HELD = 1 << 16


# ---- fingerprints ------------------------------------------------------------------------


def fingerprint(text: str | None, size: int) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII alone
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    flat, n = b" ".join(words), max(1, len(words) - size + 1)
    starts, stops = np.concatenate([[0], ends[: n - 1]]), ends[len(words) - n :] - 1
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        spans = zip(starts[at : at + SHINGLES].tolist(), stops[at : at + SHINGLES].tolist(), strict=True)
        h = np.fromiter((hashed(flat[a:b], 42) for a, b in spans), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of each row of ``docs(doc_id, text)``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), size) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, fp long")


# ---- pivot tables ------------------------------------------------------------------------


def pivot_table(nodes: DataFrame) -> DataFrame:
    """``nodes(fp)`` with ``pivots``, a byte for each distance to a reference."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.bitwise_count(_unsigned(batch.column("fp"))[:, None] ^ REFERENCES)
            rows = pa.Array.from_buffers(pa.binary(), len(far), [None, pa.py_buffer(np.arange(0, far.size + 1, PIVOTS, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(far, np.uint8))])
            yield pa.RecordBatch.from_arrays([batch.column("fp"), rows], ["fp", "pivots"])

    return nodes.select("fp").mapInArrow(measured, "fp long, pivots binary")


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` runs of ``bits`` of nearly one length."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in itertools.pairwise(cuts)]


def child_masks(mask: int, distance: int) -> list[int]:
    """Masks of which two words that agree in ``mask`` and differ in ``distance`` bits at most agree in one."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts, fixed = (distance + 1, 1) if mask == 0 else (2 * distance, distance)
    return [mask | sum(chosen) for chosen in itertools.combinations(_parts(free, parts), fixed)]


def mask_tree(distance: int) -> list[tuple[int, int, int]]:
    """(level, mask, child) of all levels; its size depends on the distance alone."""
    rows, masks = [], [0]
    for level in range(LEVELS):
        rows += [(level, _signed(m), _signed(c)) for m in masks for c in child_masks(m, distance)]
        masks = [c for m in masks for c in child_masks(m, distance)]
    return rows


def _in_bucket() -> Column:
    return F.col("fp").bitwiseAND(F.col("mask"))


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links that join all fingerprints of ``nodes(fp)``, distinct, which differ in ``distance`` bits at most.

    Two fingerprints have a path of these links where they have one of links within the distance.
    """
    if not 1 <= distance <= 4:
        raise ValueError("distances of 1 to 4 bits")
    spark = nodes.sparkSession
    tree = spark.createDataFrame(mask_tree(distance), "level int, mask long, child long")
    rows = written(pivot_table(nodes), "pivots").withColumn("mask", F.lit(0).cast("long"))
    found = None
    for level in range(LEVELS):
        children = F.broadcast(tree.where(F.col("level") == level).drop("level"))  # a few thousand rows, whatever the data
        rows = rows.join(children, "mask").select("fp", "pivots", F.col("child").alias("mask")).withColumn("key", _in_bucket())
        if level:  # two parents can have one child
            rows = rows.dropDuplicates(["fp", "mask"])
        crowded = None
        if level + 1 < LEVELS:
            crowded = written(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("mask", "key"), "crowded")
            if not crowded.limit(1).count():
                crowded = None
        few = rows if crowded is None else rows.join(crowded, ["mask", "key"], "left_anti")
        stars = swept(few, distance)
        found = stars if found is None else found.unionByName(stars)
        if crowded is None:
            break
        rows = rows.join(crowded, ["mask", "key"], "left_semi").select("fp", "pivots", "mask")
    return written(found.distinct(), "links")


def swept(rows: DataFrame, distance: int) -> DataFrame:
    """Stars of the local classes of ``rows(mask, key, fp, pivots)``, bucket by bucket."""
    first = F.conv(F.hex(F.substring("pivots", 1, 1)), 16, 10).cast("int")
    dealt = rows.withColumn("first", first).repartition("mask", "key").sortWithinPartitions("mask", "key", "first")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            held.append(_columns(batch))
            n += batch.num_rows
            if n >= HELD:
                block = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                yield _stars(block, distance)
                bucket, pivots = block[0], block[2]
                needed = (bucket == bucket[-1]).all(1) & (pivots[:, 0].astype(int) >= int(pivots[-1, 0]) - distance)
                held, n = [tuple(c[needed] for c in block)], 0
        if n:
            yield _stars(tuple(np.concatenate(c) for c in zip(*held, strict=True)), distance)

    return dealt.select("mask", "key", "fp", "pivots").mapInArrow(sweep, "a long, b long")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(bucket, fingerprint, pivot distances) of a batch."""
    bucket = np.stack([_unsigned(batch.column("mask")), _unsigned(batch.column("key"))], 1)
    far = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), np.uint8).reshape(-1, PIVOTS)
    return bucket, _unsigned(batch.column("fp")), far


def _stars(block: tuple[np.ndarray, ...], distance: int) -> pa.RecordBatch:
    """Links from each row to the first row of its local class.  Rows lie by bucket and first coordinate."""
    bucket, prints, far = block
    n = len(prints)
    new = np.ones(n, bool)
    new[1:] = (bucket[1:] != bucket[:-1]).any(1)
    # the last row that each row's window reaches: of its bucket, the first coordinate at most ``distance`` more
    order = np.cumsum(new) * 256 + far[:, 0]
    last = np.searchsorted(order, order + distance, "right") - 1
    wide = far.astype(np.int8)
    froms, tos = [], []
    alive, step = np.flatnonzero(last > np.arange(n)), 1
    while len(alive):
        a, b = alive, alive + step
        for k in range(1, PIVOTS):  # most pairs are gone after three coordinates
            near = np.abs(wide[a, k] - wide[b, k]) <= distance
            a, b = a[near], b[near]
            if not len(a):
                break
        near = np.bitwise_count(prints[a] ^ prints[b]) <= distance
        froms.append(a[near])
        tos.append(b[near])
        step += 1
        alive = alive[last[alive] >= alive + step]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (froms, tos))
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(n))
    return pa.RecordBatch.from_arrays([pa.array(prints[label[linked]].view(np.int64)), pa.array(prints[linked].view(np.int64))], ["a", "b"])


# ---- classes -----------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs(doc_id, text)``; see the module's docstring."""
    prints = written(fingerprints(docs, size), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    near = links(nodes, distance)
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a != top").select("doc_id", "a")
    same = prints.join(several, "doc_id").select("a", F.col("fp").alias("b")).where("a != b")
    labels = component_labels(near.unionByName(same), keep=lambda df: written(df, "classes"))
    rooted = nodes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(tops, "root").select("fp", "component_id"), "class-of")
    discard(near)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
