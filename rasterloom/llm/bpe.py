"""Byte-level BPE as a streaming transducer with a bounded lookahead.

**Lookahead.**  Compare the merges of ``u v`` and ``u w`` in the order of the merge list.
At first the two symbol sequences agree up to the end of ``u``.  A merge ``(a, b)`` can
move the place where they begin to differ to the left by ``len(a)`` at most, and only if
the symbol ``b`` begins at that place, so ``b`` is, or was built on its left edge from, a
symbol that an earlier such merge put there.  The longest chain of merges in list order,
each of whose right sides has the one before's left side on its left edge, weighed by
``len(a)``, therefore bounds how far any later text can reach back.  Tokens of ``u`` that
end that many bytes before the end of what has been read are stable.

**Encoding.**  Every text is read in blocks of at most ``BLOCK`` bytes, cut at words of the
pre-tokenizer (words are independent).  Every word goes through the transducer in windows of
``WINDOW`` bytes and the lookahead: the tokens that are stable are emitted and the rest
is read again with the next bytes; a window in which its word ends makes all its tokens
stable.  The windows of a block's distinct words move on together, one array pass for each
round of merges.  Ids are hashed and decoded as they are emitted, so beside
the text itself a block is held, whatever the length of a text or a word.

**Decoding.**  Ids become bytes by table, and bytes become text by an incremental UTF-8
state machine that holds at most three bytes between chunks.

Defined results: a null or empty text has no ids and decodes to the empty text; every
input row has one row; an empty table gives none; other columns are ignored.  A tokenizer
file that isn't plain byte-level BPE (a normalizer, another pattern, added tokens
that strip blanks, dropout and the like) raises an error.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .pretokens import BLOCK, distinct, gathered, word_blocks, word_starts

#: a window's bytes besides the lookahead
WINDOW = 1024


def byte_of_character() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeList:
    """A tokenizer file's vocabulary and merges, as byte strings and arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_of_character()
        cutter, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not spec.get("normalizer")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        if not plain or odd:
            raise ValueError(f"{path} is no plain byte-level BPE file: {odd or cutter}")
        known = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*known.values(), *self.special.values()]) + 1)
        for shown, i in known.items():
            self.bytes_of[i] = bytes(byte[c] for c in shown)
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = np.array([known[a] for a, _ in pairs], np.int64)
        self.right = np.array([known[b] for _, b in pairs], np.int64)
        self.made = np.array([known[a + b] for a, b in pairs], np.int64)
        self.first = np.array([known[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], np.int64)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.blob_at = np.r_[0, np.cumsum(self.size)]
        self.lookahead = self._lookahead()
        # pairs in sorted order for array lookups
        key = self.left << 32 | self.right
        self.rank_order = np.argsort(key)
        self.keys = key[self.rank_order]
        two = np.arange(256)
        self.pair_rank = self.ranks(np.repeat(self.first[two], 256), np.tile(self.first[two], 256)).astype(np.int32)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _lookahead(self) -> int:
        """The sufficient lookahead in bytes (see the module's text)."""
        length = [len(b) for b in self.bytes_of]
        edge: dict[int, int] = {}  # symbol -> the symbol on its left edge, one merge down
        for a, m in zip(self.left.tolist(), self.made.tolist(), strict=True):
            edge.setdefault(m, a)
        best: dict[int, int] = {}
        most = 0
        for a, b in zip(reversed(self.left.tolist()), reversed(self.right.tolist()), strict=True):
            reach = length[a] + best.get(a, 0)
            most = max(most, reach)
            at: int | None = b
            while at is not None:
                best[at] = max(best.get(at, 0), reach)
                at = edge.get(at)
        return most + max(length, default=1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's place in the merge list; its length where there is none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_order[at], len(self.keys))

    def merged(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, counts): every word ``data[at[i]:at[i + 1]]`` merged to the end.

        Each round merges, in each word, the leftmost pair of least rank.
        """
        n = len(at) - 1
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
        symbol = self.first[data]
        done_s, done_o = [], []
        none = len(self.keys)
        rank = np.full(len(symbol), none, np.int32)
        if len(symbol) > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.pair_rank[data[:-1].astype(np.int32) << 8 | data[1:]], none)
        while len(symbol):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[start, len(symbol)])
            least = np.minimum.reduceat(rank, start)
            over = np.repeat(least == none, size)
            if over.any():  # finished words leave
                done_s.append(symbol[over])
                done_o.append(owner[over])
                symbol, owner, rank = symbol[~over], owner[~over], rank[~over]
                if not len(symbol):
                    break
                keep = least != none
                size, least = size[keep], least[keep]
                start = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # every place of the least pair may merge at once, except overlapping ones ("aaa"): from the left, every other
            follows = np.r_[False, (hit[1:] == hit[:-1] + 1)]
            if follows.any():
                run = np.arange(len(hit)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
                hit = hit[run % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            left = np.ones(len(symbol), bool)
            left[hit + 1] = False
            touched = np.zeros(len(symbol), bool)
            touched[hit] = True
            touched[hit[hit > 0] - 1] = True
            # the symbol before a merge may itself have been swallowed: then the one before it changes
            before = hit[hit > 1]
            touched[before[~left[before - 1]] - 2] = True
            symbol, owner, rank, touched = symbol[left], owner[left], rank[left], touched[left]
            redo = np.flatnonzero(touched)
            inner = redo[redo + 1 < len(symbol)]
            rank[redo] = none
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        if not done_s:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        s, o = np.concatenate(done_s), np.concatenate(done_o)
        return s[np.argsort(o, kind="stable")], np.bincount(o, minlength=n)

    def text_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, sizes): the bytes of each id."""
        return gathered(self.blob, self.blob_at, ids.astype(np.int64))


class Transducer:
    """Encodes words window by window; ``windows`` counts them.

    :meth:`feed` and :meth:`finish` take one word as a stream of bytes, :meth:`words` and
    :meth:`long` take words that lie in an array.
    """

    def __init__(self, merges: MergeList, window: int = WINDOW):
        self.merges, self.window, self.held, self.windows = merges, window, b"", 0

    def step(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, bytes): what the next window of each word emits, and how far each word moves on."""
        size = np.minimum(ends - at, self.window + self.merges.lookahead)
        to = np.r_[0, np.cumsum(size)]
        ids, count = self.merges.merged(data[np.repeat(at - to[:-1], size) + np.arange(to[-1])], to)
        self.windows += len(at)
        owner = np.repeat(np.arange(len(at)), count)
        end = np.cumsum(self.merges.size[ids]) - to[owner]  # of each token in its window
        stable = (size == ends - at)[owner] | (end <= self.window)
        ids, owner = ids[stable], owner[stable]
        return ids, np.bincount(owner, minlength=len(at)), np.bincount(owner, weights=self.merges.size[ids], minlength=len(at)).astype(np.int64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of each word; the words' windows move on together."""
        at, open_ = starts.copy(), np.arange(len(starts))
        ids, owner = [], []
        while len(open_):
            found, count, moved = self.step(data, at[open_], ends[open_])
            ids.append(found)
            owner.append(np.repeat(open_, count))
            at[open_] += moved
            open_ = open_[at[open_] < ends[open_]]
        if len(ids) == 1:
            return ids[0], np.bincount(owner[0], minlength=len(starts))
        own = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        return (np.concatenate(ids)[np.argsort(own, kind="stable")] if ids else own), np.bincount(own, minlength=len(starts))

    def long(self, data: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
        """Ids of one word, as they become stable."""
        at, stop = np.array([start]), np.array([end])
        while at[0] < end:
            ids, _, moved = self.step(data, at, stop)
            at = at + moved
            yield ids

    def feed(self, more: bytes) -> Iterator[int]:
        """Ids that no later byte can change."""
        self.held += more
        while len(self.held) >= self.window + self.merges.lookahead:
            data = np.frombuffer(self.held, np.uint8)
            ids, _, moved = self.step(data, np.array([0]), np.array([1 << 60 if len(data) == self.window + self.merges.lookahead else len(data)]))
            yield from ids.tolist()
            self.held = self.held[int(moved[0]) :]

    def finish(self) -> Iterator[int]:
        """The rest, when the word has ended."""
        data, self.held = np.frombuffer(self.held, np.uint8), b""
        for ids in self.long(data, 0, len(data)):
            yield from ids.tolist()


class Encoder:
    """Ids of texts, block by block."""

    def __init__(self, merges: MergeList):
        self.merges, self.transducer = merges, Transducer(merges)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of each text of a block, without special tokens."""
        starts = word_starts(data, offsets)
        ends = np.r_[starts[1:], len(data)]
        words, which = distinct(data, starts, ends)
        ids, count = self.transducer.words(data, starts[words], ends[words])
        ids, size = gathered(ids, np.r_[0, np.cumsum(count)], which)
        return ids, np.bincount(np.repeat(B.owner(starts, offsets), size), minlength=len(offsets) - 1)

    def plain(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of one text of any length, without special tokens."""
        if len(data) <= BLOCK:
            yield self.batch(data, np.array([0, len(data)]))[0]
            return
        for starts, end in word_blocks(data, BLOCK):
            if len(starts) == 1:
                yield from self.transducer.long(data, int(starts[0]), end)
            else:
                yield self.batch(data[starts[0] : end], np.array([0, end - starts[0]]))[0]

    def text(self, text: str) -> Iterator[np.ndarray]:
        """Ids of one text of any length."""
        for part in self.merges.cut.split(text) if self.merges.cut else (text,):
            if part in self.merges.special:
                yield np.array([self.merges.special[part]])
            elif part:
                yield from self.plain(np.frombuffer(part.encode(), np.uint8))

    def column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(row, ids, last) for each text of a slice: short texts in one piece, long ones in several."""
        data, offsets = B.text_buffer(column)
        raw = data.tobytes() if self.merges.special else b""
        if len(data) <= 2 * BLOCK and not any(s.encode() in raw for s in self.merges.special):
            ids, count = self.batch(data, offsets)
            at = np.r_[0, np.cumsum(count)]
            for i in range(len(column)):
                yield i, ids[at[i] : at[i + 1]], True
            return
        for i, text in enumerate(column.to_pylist()):
            for ids in self.text(text or ""):
                yield i, ids, False
            yield i, np.zeros(0, np.int64), True


class Decoder:
    """Ids to text, chunk by chunk; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(self.merges.text_bytes(np.asarray(ids, np.int64))[0].tobytes())

    def finish(self) -> str:
        return self.state.decode(b"", True)


_workers: dict[str, Encoder] = {}


def worker(path: str) -> Encoder:
    """The Python worker's encoder for a tokenizer file."""
    if path not in _workers:
        _workers[path] = Encoder(MergeList(path))
    return _workers[path]


CHUNK = 1 << 15


def _decoded(merges: MergeList, ids: np.ndarray) -> Iterator[str]:
    stream = Decoder(merges)
    for a in range(0, len(ids), CHUNK):
        yield stream.feed(ids[a : a + CHUNK])
    yield stream.finish()


ENCODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class _Digest:
    """Count and hashes of one text's ids and of what they decode to, as the ids come."""

    def __init__(self, merges: MergeList):
        self.n, self.ids, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges)

    def update(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.ids.update(ids.astype("<u4").tobytes())
        for a in range(0, len(ids), CHUNK):
            self.text.update(self.decoder.feed(ids[a : a + CHUNK]).encode())

    def finish(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.finish().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of the decoded ids' text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(tokenizer)
        for whole in batches:
            for batch in B.slices(whole, "text", BLOCK):
                rows, digest = [], _Digest(encoder.merges)
                for _, ids, last in encoder.column(batch.column("text")):
                    digest.update(ids)
                    if last:
                        rows.append(digest.finish())
                        digest = _Digest(encoder.merges)
                n, sha, text_sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED_SCHEMA)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): every document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(tokenizer)
        for whole in batches:
            for batch in B.slices(whole, "text", BLOCK):
                found = list(encoder.column(batch.column("text")))
                count = np.bincount([i for i, *_ in found], weights=[len(x) for _, x, _ in found], minlength=batch.num_rows)
                at = np.r_[0, np.cumsum(count)].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([x for _, x, _ in found]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of ``rows(doc_id, ids)``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = worker(tokenizer).merges
        for batch in batches:
            texts = ["".join(_decoded(merges, np.array(x if x is not None else [], np.int64))) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
