"""Token-id files with keyed access through a minimal perfect hash index.

**Format** (little-endian), one file per shard, documents in ascending key order::

    magic "TOKSHRD1" | id bytes u32 (2 or 4) | n_docs u64 | n_ids u64 | n_slots u64 | n_null u64 | n_levels u32
    (the first n_null documents have no key) level sizes in 64-bit words, u64 each | the levels' bit words, u64 each
    per slot: fingerprint u32, document u32
    per document: key i64, first id u64, ids u64
    raw ids

**Index.**  A document's key is hashed, level by level, to a bit; a key that is
alone on its bit lives there and the others go to the next level.  A key's slot is
the number of set bits before its own, so the hash is perfect and minimal: one
slot per key, about three bits a key.  The slot's fingerprint tells absent keys.

**Job.**  Rows are dealt to key ranges in one shuffle (rows without a key, and rows that repeat one,
by a hash of their text, so a hot key is many ranges) and sorted; each task encodes its range
and closes a shard whenever ``SHARD_BYTES`` of ids are reached, so shards and what a task holds
are bounded by bytes.  Shards are written under names of their own, and only the rows that
committed tasks return (the manifest) make a file part of the set, so lost executors and
repeated tasks do no harm.

Defined results: a null or empty text is one end id.  A repeated key keeps all its
documents in the payload; the index finds the first.  Null keys come first and are
not indexed.  An empty table gives no shard.  Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bytetext as B
from .pretokens import BLOCK, distinct, gathered, without_gc, word_blocks, word_starts
from .scratch import new_folder, written

#: bytes of ids at which a shard is closed, of text in a task's range, and the most tasks
SHARD_BYTES, RANGE_BYTES, MOST_RANGES = 16 << 20, 16 << 20, 20_000
#: 16 bytes of bounds each go to the tasks of a keyed lookup
MOST_SHARDS = 8_000_000
MAGIC = b"TOKSHRD1"
MANIFEST_SCHEMA = "shard long, path string, n_docs long, n_tokens long, min_key long, max_key long"


# ---- minimal perfect hash -------------------------------------------------------------


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return B.mix(keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))


def _bit(keys: np.ndarray, level: int, words: int) -> np.ndarray:
    return (_hash(keys, level) % np.uint64(words * 64)).astype(np.int64)


def build_mph(keys: np.ndarray) -> list[np.ndarray]:
    """Bit words of each level for distinct ``keys``."""
    levels, left = [], keys
    while len(left):
        words = -(-len(left) * 2 // 64)
        at = _bit(left, len(levels), words)
        alone = np.bincount(at, minlength=words * 64) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    return levels


class Mph:
    """Lookups in the levels of :func:`build_mph`."""

    def __init__(self, levels: list[np.ndarray]):
        self.sizes = [len(x) for x in levels]
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.bits = np.unpackbits(bits.view(np.uint8), bitorder="little") if len(bits) else np.zeros(0, np.uint8)
        self.before = np.r_[0, np.cumsum(self.bits, dtype=np.int64)]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, -1 where no level has the key's bit."""
        out, begin = np.full(len(keys), -1, np.int64), 0
        for level, words in enumerate(self.sizes):
            todo = np.flatnonzero(out < 0)
            at = begin + _bit(keys[todo], level, words)
            hit = self.bits[at] == 1
            out[todo[hit]] = self.before[at[hit]]
            begin += words * 64
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32-bit check values, from a hash that the levels don't use."""
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


# ---- files ----------------------------------------------------------------------------


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a URI or local path, and the path in it."""
    return pa.fs.FileSystem.from_uri(uri) if ":/" in uri else (pa.fs.LocalFileSystem(), uri)


def shard_bytes(keys: list[int | None], lengths: np.ndarray, payload: list[bytes], id_bytes: int) -> Iterator[bytes]:
    """A shard file, in parts."""
    known = np.array([k for k in keys if k is not None], np.int64)
    documents = np.array([i for i, k in enumerate(keys) if k is not None], np.int64)
    distinct, first = np.unique(known, return_index=True)
    levels = build_mph(distinct)
    slot = Mph(levels).slots(distinct)
    table = np.zeros(len(distinct), [("print", "<u4"), ("doc", "<u4")])
    table["print"][slot], table["doc"][slot] = fingerprints(distinct), documents[first]
    docs = np.zeros(len(keys), [("key", "<i8"), ("first", "<u8"), ("n", "<u8")])
    docs["key"] = [0 if k is None else k for k in keys]
    docs["n"] = lengths
    docs["first"] = np.cumsum(lengths) - lengths
    yield MAGIC + struct.pack("<IQQQQI", id_bytes, len(keys), int(np.sum(lengths)), len(distinct), len(keys) - len(known), len(levels))
    yield np.array([len(x) for x in levels], "<u8").tobytes()
    yield b"".join(x.tobytes() for x in levels)
    yield table.tobytes()
    yield docs.tobytes()
    yield from payload


class Shard:
    """A shard file, opened for keyed and sequential reads."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        head = self.file.read(len(MAGIC) + 40)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.id_bytes, self.n_docs, self.n_ids, slots, self.n_null, n_levels = struct.unpack("<IQQQQI", head[len(MAGIC) :])
        sizes = np.frombuffer(self.file.read(8 * n_levels), "<u8")
        self.mph = Mph([np.frombuffer(self.file.read(8 * int(s)), "<u8") for s in sizes])
        self.slots = np.frombuffer(self.file.read(8 * slots), [("print", "<u4"), ("doc", "<u4")])
        self.docs = np.frombuffer(self.file.read(24 * self.n_docs), [("key", "<i8"), ("first", "<u8"), ("n", "<u8")])
        self.at = self.file.tell()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The document number of each key, -1 if the shard hasn't it."""
        if not len(self.slots):
            return np.full(len(keys), -1, np.int64)
        slot = self.mph.slots(keys)
        entry = self.slots[np.maximum(slot, 0)]
        found = (slot >= 0) & (entry["print"] == fingerprints(keys))
        doc = np.where(found, entry["doc"].astype(np.int64), -1)
        return np.where((doc >= 0) & (self.docs["key"][np.maximum(doc, 0)] == keys), doc, -1)

    def _read(self, first: int, n: int) -> np.ndarray:
        self.file.seek(self.at + first * self.id_bytes)
        return np.frombuffer(self.file.read(n * self.id_bytes), "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    def ids(self, doc: int) -> np.ndarray:
        """A document's ids as unsigned 32-bit integers."""
        return self._read(int(self.docs["first"][doc]), int(self.docs["n"][doc]))

    def all_ids(self) -> np.ndarray:
        """The whole payload; a document's ids begin at its ``first``."""
        return self._read(0, self.n_ids)


# ---- encoding with the tokenizers library ---------------------------------------------


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class LibraryEncoder:
    """Ids by a tokenizers file.

    Words of a byte-level pre-tokenizer are cut in whole arrays and each distinct one goes to the
    library's model; a bounded dictionary holds what it answered.  Texts with special
    tokens, and files of another kind, go through the library's whole pipeline.
    """

    MOST = 500_000

    def __init__(self, path: str, id_bytes: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = False
        self.model, self.kind = self.tokenizer.model, "<u2" if id_bytes == 2 else "<u4"
        self.shown = {i: c for i, c in enumerate(byte_characters())}
        spec = json.loads(self.tokenizer.to_str())
        cutter = spec["pre_tokenizer"] or {}
        self.by_words = cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter.get("use_regex", True) and not spec["normalizer"]
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.known: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words."""
        if len(self.known) > self.MOST:
            self.known.clear()
        known, kind, tokenize = self.known, self.kind, self.model.tokenize
        packed = list(map(known.get, words))
        for i in [i for i, x in enumerate(packed) if x is None]:
            packed[i] = known[words[i]] = np.array([t.id for t in tokenize(words[i].decode("latin-1").translate(self.shown))], kind).tobytes()
        return packed

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the texts of a block."""
        starts = word_starts(data, offsets)
        ends = np.r_[starts[1:], len(data)]
        first, which = distinct(data, starts, ends)
        raw = data.tobytes()
        packed = self.words([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        at = np.r_[0, np.cumsum([len(x) for x in packed])] // np.dtype(self.kind).itemsize
        ids, size = gathered(np.frombuffer(b"".join(packed), self.kind), at.astype(np.int64), which)
        return ids, np.bincount(np.repeat(B.owner(starts, offsets), size), minlength=len(offsets) - 1)

    def column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a slice."""
        data, offsets = B.text_buffer(column)
        raw = data.tobytes() if self.special else b""
        if not self.by_words or any(s in raw for s in self.special):
            return self.whole([t or "" for t in column.to_pylist()])
        if len(data) > 2 * BLOCK:  # one long text
            parts = [self.block(data[s[0] : end], np.array([0, end - s[0]]))[0] for s, end in word_blocks(data)]
            return [np.concatenate(parts)] if len(column) == 1 else [x for i in range(len(column)) for x in self.column(column.slice(i, 1))]
        ids, count = self.block(data, offsets)
        return np.split(ids, np.cumsum(count)[:-1])


_encoders: dict = {}


def library_encoder(path: str, id_bytes: int) -> LibraryEncoder:
    """The worker's encoder for a tokenizers file; it outlives a task."""
    if (path, id_bytes) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, id_bytes] = LibraryEncoder(path, id_bytes)
    return _encoders[path, id_bytes]


# ---- jobs -----------------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_bytes_: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES, id_bytes: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` into token shards; returns the manifest, a row per shard.

    Shards ascend with the key; one is closed after the document that brings its ids to ``shard_bytes_``.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-total // range_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, id_bytes)
        end = np.array([end_id], f"<u{id_bytes}").tobytes()
        part, k = TaskContext.get().partitionId(), 0
        keys, lengths, payload, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            store, path = open_store(folder)
            store.create_dir(path, recursive=True)
            shard = (part << 32) + k
            name = f"{part:06d}-{k:06d}-{uuid.uuid4().hex}.tok"
            n = np.array(lengths, np.int64)
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                for piece in shard_bytes(keys, n, payload, id_bytes):
                    out.write(piece)
            own = [x for x in keys if x is not None]
            return pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name}", "n_docs": len(keys), "n_tokens": int(n.sum()), "min_key": min(own, default=None), "max_key": max(own, default=None)}], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("min_key", pa.int64()), ("max_key", pa.int64())]))

        for whole in batches:
            for batch in B.slices(whole, "text", BLOCK):
                with without_gc():
                    found = encoder.column(batch.column("text"))
                for key, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                    keys.append(key)
                    lengths.append(len(ids) + 1)
                    payload += (ids.tobytes(), end)
                    held += id_bytes * (len(ids) + 1)
                    if held >= shard_bytes_:
                        yield close()
                        keys, lengths, payload, held = [], [], [], 0
                        k += 1
        if keys:
            yield close()

    return written(dealt.mapInArrow(save, MANIFEST_SCHEMA), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``before``: the ids of all shards before each; sums of a thousand ranges first, so no task sees all rows."""
    group = F.shiftright("shard", 32 + 10)
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = manifest.withColumn("g", group)
    groups = rows.groupBy("g").agg(F.sum("n_tokens").alias("own"))
    groups = groups.select("g", F.coalesce(F.sum("own").over(upto(W.orderBy("g"))), zero).alias("base"))  # a row for 1,024 ranges
    inner = F.coalesce(F.sum("n_tokens").over(upto(W.partitionBy("g").orderBy("shard"))), zero)
    return rows.withColumn("inner", inner).join(groups, "g").withColumn("before", F.col("base") + F.col("inner")).drop("g", "inner", "base")


DOCUMENT_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, found boolean"


def read_documents(manifest: DataFrame) -> DataFrame:
    """Each document of the files, looked up by its key: doc_id, start, n_tokens, ids_crc32, shard, found.

    ``start`` is the number of ids of all documents before it.  Ids come from the slot that the
    index leads a key to; only documents without a key, and a repeated key's later ones,
    are read by place (``found`` false).  A key that its own index misses is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                keys = shard.docs["key"].astype(np.int64)
                place = np.arange(len(keys))
                null = place < shard.n_null
                again = np.r_[False, (keys[1:] == keys[:-1]) & ~null[:-1]] if len(keys) else null
                doc = shard.find(keys)
                if (doc[~null] < 0).any():
                    raise ValueError(f"{row['path']}: the index misses keys of its own")
                by_place = null | again
                doc = np.where(by_place, place, doc)
                first, n, ids = shard.docs["first"].astype(np.int64)[doc], shard.docs["n"].astype(np.int64)[doc], shard.all_ids()
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(row["before"] + first), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), row["shard"])), pa.array(~by_place)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "found"])

    rows = with_starts(manifest).select("shard", "path", "before")
    return rows.repartition(min(MOST_RANGES, max(1, manifest.count())), "path").mapInArrow(read, DOCUMENT_SCHEMA)


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of each ``keys(doc_id)`` that the files hold: its shard by binary search in the shards' last keys, its ids by the index.

    The shards' last keys go to the tasks, 16 bytes for each ``SHARD_BYTES`` of ids; over ``MOST_SHARDS`` of them is an error.
    """
    indexed = manifest.where("max_key is not null")
    if indexed.count() > MOST_SHARDS:
        raise ValueError(f"over {MOST_SHARDS} shards: look keys up in parts of the set")
    bounds = indexed.select("shard", "max_key").orderBy("shard").toPandas()
    shards, last = bounds["shard"].to_numpy(np.int64), bounds["max_key"].to_numpy(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("doc_id").to_numpy()
            at = np.searchsorted(last, asked)
            here = at < len(last)
            yield pa.RecordBatch.from_arrays([pa.array(asked[here], pa.int64()), pa.array(shards[at[here]], pa.int64())], ["doc_id", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            asked, paths = batch.column("doc_id").to_numpy(), batch.column("path").to_pylist()
            for own in dict.fromkeys(paths):
                if own != path:
                    path, shard = own, Shard(own)
                mine = asked[[p == own for p in paths]]
                doc = shard.find(mine)
                here = [(int(k), shard.ids(int(d)).tolist()) for k, d in zip(mine, doc, strict=True) if d >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in here], pa.int64()), pa.array([x for _, x in here], pa.list_(pa.int64()))], ["doc_id", "ids"])

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    dealt = wanted.mapInArrow(place, "doc_id long, shard long").join(manifest.select("shard", "path"), "shard")
    return dealt.sortWithinPartitions("path", "doc_id").select("doc_id", "path").mapInArrow(read, "doc_id long, ids array<bigint>")
