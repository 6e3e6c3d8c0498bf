"""Benchmark decontamination through a distributed positional inverted index.

**Index.** Documents are grouped into *segments* of whole documents.  A segment
has one row per term with that term's postings (ascending positions in the
segment's own position space, stored as differences of one, two or four bytes)
and one header row that says which document holds which positions.  No posting
crosses the network while the index is built, and it is written once as a table.

**Search.** Query phrases and their terms are tables.  The terms select postings
by a join (Spark broadcasts the written term table only below its size
threshold); a phrase whose terms all occur is joined through its rarest term to
the segments that can hold it.  A posting list goes to the blocks of phrases that have its
term and ask its segment for something, and to no others.  Postings and phrases meet by segment and block, where every phrase intersects offset-adjusted position lists, rarest
term first.  Segments and blocks are bounded, so no key can make a group large,
and no phrase passes through the driver.

Position spaces leave a gap between documents, so a phrase never crosses them.
Terms are 64-bit hashes of the words.

Defined results: null and empty texts have no words and one row; every input
row has its own row (repeated rows and null ids too); an empty table gives no
rows; other columns are ignored.  Items without an id count as one item that the
hash doesn't list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .scratch import written

INDEX_SCHEMA = "segment long, term long, n int, width int, postings binary, docs array<struct<doc:int,doc_id:long,base:int,n_words:int>>"
PHRASE_SCHEMA = "phrase array<long>, item_id long"
SEGMENT_BYTES = 16 << 20
SEGMENT_DOCS = 1 << 17
BLOCK_WORDS = 1 << 19
WINDOW = 10


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of each word ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    low = B.LOWER[data]
    starts, ends = B.runs(B.WORD_AND_DIGIT[low], offsets)
    return B.span_hash(B.prefix_hash(low), starts, ends).view(np.int64), B.owner(starts, offsets)


def _postings(terms: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct terms with counts, difference widths and packed differences."""
    order = np.argsort(terms, kind="stable")
    t, p = terms[order], positions[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    step = p.copy()
    step[1:] -= p[:-1]
    step[first] = p[first]
    top = np.maximum.reduceat(step, first)
    width = np.where(top < 256, 1, np.where(top < 65536, 2, 4)).astype(np.int32)
    n = np.diff(np.r_[first, len(t)]).astype(np.int32)
    at = np.r_[0, np.cumsum(n.astype(np.int64) * width)]
    out = np.zeros(int(at[-1]), np.uint8)
    each, where = np.repeat(width, n), np.repeat(at[:-1], n) + (np.arange(len(t)) - np.repeat(first, n)) * np.repeat(width, n)
    for w in (1, 2, 4):
        chosen = each >= w
        for k in range(w // 2, w):
            out[where[chosen] + k] = (step[chosen] >> (8 * k)).astype(np.uint8)
    return t[first], n, width, at, out


def _unpacked(n: int, width: int, packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, {1: np.uint8, 2: "<u2", 4: "<u4"}[width], n), dtype=np.int64)


def _segment(number: int, ids: list, lengths: np.ndarray, terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    base = np.r_[0, np.cumsum(lengths + 1)[:-1]] if len(lengths) else np.zeros(0, np.int64)
    positions = np.arange(len(terms)) + np.repeat(np.arange(len(lengths)), lengths)
    docs = [[{"doc": i, "doc_id": d, "base": int(b), "n_words": int(n)} for i, (d, b, n) in enumerate(zip(ids, base, lengths, strict=True))]]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("doc", pa.int32()), ("doc_id", pa.int64()), ("base", pa.int32()), ("n_words", pa.int32())]))]
    names = ["segment", "term", "n", "width", "postings", "docs"]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([number], [None], [None], [None], [None], docs), types, strict=True)], names)
    if len(terms):
        term, n, width, at, packed = _postings(terms, positions)
        for i in range(0, len(term), 100_000):
            j = min(i + 100_000, len(term))
            blob = B.binary_array(at[i : j + 1] - at[i], packed[at[i] : at[j]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, number)), pa.array(term[i:j]), pa.array(n[i:j]), pa.array(width[i:j]), blob, pa.nulls(j - i, types[5])], names)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part, k = context.partitionId() if context else 0, 0
    ids: list = []
    lengths: list[np.ndarray] = []
    terms: list[np.ndarray] = []
    size = 0
    for whole in batches:
        for batch in B.slices(whole, "text"):
            data, offsets = B.text_buffer(batch.column("text"))
            term, row = words_of(data, offsets)
            ids += batch.column("doc_id").to_pylist()
            lengths.append(np.bincount(row, minlength=batch.num_rows))
            terms.append(term)
            size += len(data)
            if size >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                yield from _segment((part << 24) + k, ids, np.concatenate(lengths), np.concatenate(terms))
                ids, lengths, terms, size, k = [], [], [], 0, k + 1
    if ids:
        yield from _segment((part << 24) + k, ids, np.concatenate(lengths), np.concatenate(terms))


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of ``docs(doc_id, text)``, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_index, INDEX_SCHEMA), "postings")


def document_rows(index: DataFrame) -> DataFrame:
    """(segment, doc, doc_id, n_words): a row for each indexed document."""
    return index.where("term is null").select("segment", F.explode("docs").alias("d")).select("segment", "d.doc", "d.doc_id", F.col("d.n_words").cast("long").alias("n_words"))


def _windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.slices(whole, "text"):
                terms, row = words_of(*B.text_buffer(batch.column("text")))
                lengths = np.bincount(row, minlength=batch.num_rows)
                n = np.minimum(lengths, window)
                many = np.where(n > 0, lengths - n + 1, 0)
                item = np.repeat(np.arange(batch.num_rows), many)
                start = np.repeat(np.cumsum(lengths) - lengths - np.cumsum(many) + many, many) + np.arange(len(item))
                for i in range(0, len(item), 20_000):
                    of, at = item[i : i + 20_000], start[i : i + 20_000]
                    ends = np.cumsum(n[of])
                    places = np.repeat(at - ends + n[of], n[of]) + np.arange(ends[-1])
                    phrase = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(terms[places]))
                    yield pa.RecordBatch.from_arrays([phrase, batch.column("item_id").take(pa.array(of))], ["phrase", "item_id"])

    return run


def phrases(items: DataFrame, window: int) -> DataFrame:
    """(phrase, item_id): the distinct windows of each item as term lists, written to the shared folder."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_windows(window), PHRASE_SCHEMA).distinct(), "phrases")


def _exact(lists: Callable[[int], np.ndarray], phrase: tuple[int, ...]) -> np.ndarray:
    """Start positions of a phrase: offset-adjusted lists, the rarest first."""
    order = sorted(range(len(phrase)), key=lambda i: len(lists(phrase[i])))
    at = lists(phrase[order[0]]) - order[0]
    for i in order[1:]:
        other = lists(phrase[i])
        where = np.searchsorted(other, at + i)
        where[where == len(other)] = 0
        at = at[other[where] == at + i]
        if not len(at):
            break
    return at


def _near(lists: Callable[[int], np.ndarray], phrase: tuple[int, ...], reach: int) -> np.ndarray:
    """Positions of the rarest word that have every other word within ``reach``."""
    words = sorted(set(phrase), key=lambda t: len(lists(t)))
    at = lists(words[0])
    for t in words[1:]:
        other = lists(t)
        after = np.searchsorted(other, at)
        right = np.abs(other[np.minimum(after, len(other) - 1)] - at) <= reach
        left = np.abs(other[np.maximum(after - 1, 0)] - at) <= reach
        at = at[left | right]
        if not len(at):
            break
    return at


MATCH_SCHEMA = "segment long, doc int, item_id long, start int, stop int"
NOTHING = pa.table({"segment": pa.array([], pa.int64()), "doc": pa.array([], pa.int32()), "item_id": pa.array([], pa.int64()), "start": pa.array([], pa.int32()), "stop": pa.array([], pa.int32())})


def _searcher(reach: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(lists_of: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return NOTHING
        segment = lists_of.column("segment")[0].as_py()
        packed: dict[int, tuple] = {}
        docs = None
        for t, n, w, b, d in zip(*(lists_of.column(c).to_pylist() if c != "docs" else lists_of.column(c) for c in ("term", "n", "width", "postings", "docs")), strict=True):
            if t is None:
                docs = d.values
            else:
                packed[t] = (n, w, b)
        ids = asked.column("item_id").combine_chunks().dictionary_encode("encode")
        phrases: dict[tuple[int, ...], list[int]] = {}
        for phrase, i in zip(asked.column("phrase").to_pylist(), ids.indices.to_pylist(), strict=True):
            phrases.setdefault(tuple(phrase), []).append(i)
        opened: dict[int, np.ndarray] = {}

        def lists(term: int) -> np.ndarray:
            if term not in opened:
                at = _unpacked(*packed[term])
                opened[term] = at if reach is None else at + lift_of(at)
            return opened[term]

        base = docs.field("base").to_numpy(zero_copy_only=False).astype(np.int64)

        def lift_of(at: np.ndarray) -> np.ndarray:
            """Moves documents so far apart that no two are within ``reach``."""
            return (np.searchsorted(base, at, "right") - 1) * (reach + 1)

        items, starts, stops = [], [], []
        for phrase, of in phrases.items():
            if all(t in packed for t in phrase):
                if reach is None:
                    at = _exact(lists, phrase)
                    begin, end = at, at + len(phrase)
                else:
                    at = _near(lists, phrase, reach)
                    at = at - (np.searchsorted(base + np.arange(len(base)) * (reach + 1), at, "right") - 1) * (reach + 1)
                    begin, end = at, at + 1
                for item in of if len(at) else ():
                    items.append(np.full(len(at), item))
                    starts.append(begin)
                    stops.append(end)
        if not items:
            return NOTHING
        item, start, stop = map(np.concatenate, (items, starts, stops))
        doc = np.searchsorted(base, start, "right") - 1
        order = np.lexsort((start, doc, item))
        item, doc, start, stop = item[order], doc[order], start[order], stop[order]
        # occurrences of one item in one document that touch become one row
        group = np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])]
        lift = np.cumsum(group) * (int(stop.max()) + 1)
        reached = np.maximum.accumulate(stop + lift)
        new = np.r_[True, (start + lift)[1:] > reached[:-1]]
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(new) - 1]
        return pa.table({"segment": pa.array(np.full(len(first), segment, np.int64)), "doc": pa.array(doc[first].astype(np.int32)), "item_id": ids.dictionary.take(pa.array(item[first])), "start": pa.array((start[first] - base[doc[first]]).astype(np.int32)), "stop": pa.array(((reached - lift)[last] - base[doc[first]]).astype(np.int32))})

    return search


def asked_lists(index: DataFrame, posted: DataFrame, asking: DataFrame) -> DataFrame:
    """Posting lists and headers by (segment, block): lists ``posted`` go to the ``blocks`` that have their term, where these ask ``asking(at, of)`` anything of the segment."""
    pairs = asking.select(F.col("at").alias("segment"), F.col("of").alias("block")).distinct()
    headers = index.where("term is null").join(pairs, "segment")
    lists = posted.select(*index.columns, F.explode("blocks").alias("block")).join(pairs, ["segment", "block"], "left_semi")
    return lists.unionByName(headers.select(*index.columns, "block"))


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, reach: int | None = None) -> DataFrame:
    """(segment, doc, item_id, start, stop): where ``items(item_id, text)`` occur.

    With ``reach`` None, exact phrases: maximal word ranges ``[start, stop)`` covered by
    occurrences of windows of ``window`` consecutive item words (an item of fewer
    words is one window).  Else proximity: places of a window's rarest word that have each
    of the window's other words within ``reach`` words of them in the document.
    """
    asked = phrases(items, window)
    blocks = max(1, -(-asked.count() * window // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("phrase", "item_id"), F.lit(blocks)).cast("int")
    terms = asked.select(block.alias("block"), F.explode("phrase").alias("term")).groupBy("term").agg(F.collect_set("block").alias("blocks"))
    posted = index.join(written(terms, "terms"), "term")
    # the rarest term of each phrase whose terms all occur; it leads to the segments that can hold the phrase
    seen = written(posted.groupBy("term").agg(F.sum("n").alias("n")), "frequencies")
    each = asked.withColumn("term", F.explode(F.array_distinct("phrase"))).join(seen, "term")
    rarest = each.groupBy("phrase", "item_id").agg(F.min(F.struct("n", "term"))["term"].alias("term"), F.count("*").alias("k")).where("k = size(array_distinct(phrase))")
    asking = rarest.select("phrase", "item_id", "term", block.alias("of")).join(posted.select(F.col("segment").alias("at"), "term"), "term")
    asking = written(asking.select("at", "of", "phrase", "item_id"), "asking")
    found = asked_lists(index, posted, asking).groupBy("segment", "block").cogroup(asking.groupBy("at", "of")).applyInArrow(_searcher(reach), MATCH_SCHEMA)
    return _touching(found)


def _touching(ranges: DataFrame) -> DataFrame:
    """Ranges of one item in one document that overlap or touch, found in several blocks, as one."""
    along = Window.partitionBy("segment", "doc", "item_id").orderBy("start", "stop")
    upto = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.withColumn("new", F.when(F.col("start") <= upto, 0).otherwise(1)).withColumn("run", F.sum("new").over(along))
    return runs.groupBy("segment", "doc", "item_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of a window of any item is hit.  Without
    occurrences the hash is that of the empty string.
    """
    index = build_index(docs)
    found = matches(index, items, window)
    spans = found.groupBy("segment", "doc").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.collect_set(F.struct("item_id")).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto")),
        lambda a: a["n"].cast("long"),
    )
    hits = spans.select("segment", "doc", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i["item_id"].cast("string")))).alias("listed"))
    return document_rows(index).join(hits, ["segment", "doc"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )
