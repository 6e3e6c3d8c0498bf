"""The positional index: contamination, exact phrases and proximity, against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontamination as D
from rasterloom.llm.oracles import ORACLES

from .conftest import SF, pairs

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def places(own, phrase):
    return [i for i in range(len(own) - len(phrase) + 1) if own[i : i + len(phrase)] == phrase]


def contaminated(texts, items, window=10):
    out = Counter()
    for d, t in texts:
        own, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            if not w:
                continue
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                for at in places(own, w[i : i + n]):
                    hit |= set(range(at, at + n))
                    found.add(item)
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        out[d, len(own), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)] += 1
    return out


def test_whole_table_against_sql(documents, spark):
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = D.contamination(documents, spark.read.parquet(f"{SF}/benchmark.parquet"))
    expected = base.sql(ORACLES["op1_decontamination"])
    assert found.columns == expected.columns
    rows = Counter(map(tuple, found.collect()))
    assert rows == Counter(expected.fetchall())
    assert any(r[5] for r in rows)


@pytest.mark.parametrize("block", [20, 1 << 19])
def test_small_tables(spark, awkward, monkeypatch, block):
    """Null, empty, short and repeated items, self-overlaps, and many blocks of phrases."""
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    items = [(1, "a a a"), (2, None), (3, "..."), (4, "WORD"), (10, "word"), (None, "word"), (5, "one two three four five six seven eight nine ten eleven twelve"), (5, "again five"), (6, "東京都は日本の首都です")]
    texts = [(100, "zero one two three four five six seven eight nine ten one TWO"), (101, "two three four five six seven eight nine ten eleven twelve"), (102, "again, five; word"), (103, "a b a a"), (100, "again five")]
    docs = awkward.select("doc_id", "text", "segment", "n").unionByName(spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, segment long, n long"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = Counter(map(tuple, D.contamination(docs, benchmark).collect()))
    assert found == contaminated(pairs(docs), items)


def test_items_without_an_id(spark):
    """They count as one item together, as in the query's SQL."""
    docs = spark.createDataFrame([(1, "a word"), (2, "b other word"), (3, "c")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "word"), (None, "other"), (4, "b")], "item_id long, text string")
    base = duckdb.connect()
    base.sql("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'a word'), (2, 'b other word'), (3, 'c')) t(doc_id, text)")
    base.sql("CREATE TABLE benchmark AS SELECT * FROM (VALUES (NULL, 'word'), (NULL, 'other'), (4, 'b')) t(item_id, text)")
    assert Counter(map(tuple, D.contamination(docs, benchmark).collect())) == Counter(base.sql(ORACLES["op1_decontamination"]).fetchall())


def test_ranges_join_across_blocks(spark, monkeypatch):
    """Maximal ranges don't depend on how phrases are dealt to blocks."""
    text = " ".join(f"w{i % 24}" for i in range(200))
    index = D.build_index(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    items = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(23)))], "item_id long, text string")
    expected = {(24 * k, 24 * k + 23) for k in range(8)}
    for words_a_block in (1 << 19, 20):
        monkeypatch.setattr(D, "BLOCK_WORDS", words_a_block)
        assert {(r.start, r.stop) for r in D.matches(index, items).collect()} == expected


def test_lists_go_to_the_blocks_that_ask(documents, spark, monkeypatch):
    """A hundred blocks of phrases and several segments: each list stands once for each block that has its term and asks its segment for something."""
    monkeypatch.setattr(D, "BLOCK_WORDS", 100)
    seen, asked_lists = [], D.asked_lists
    monkeypatch.setattr(D, "asked_lists", lambda *tables: seen.append((tables[2], asked_lists(*tables))) or seen[-1][1])
    items = documents.select(F.col("doc_id").alias("item_id"), F.substring("text", 30, 400).alias("text")).where("doc_id < 20")
    index = D.build_index(documents.repartition(3, "doc_id"))
    found = D.matches(index, items)
    asking, lists = seen[0]
    held = {(r["segment"], r["term"]) for r in index.select("segment", "term").collect()}
    asks = {(r["at"], r["of"]) for r in asking.collect()}
    blocks = -(-D.phrases(items, 10).count() * 10 // 100)
    block = F.pmod(F.xxhash64("phrase", "item_id"), F.lit(blocks)).cast("int")
    block_of = {(r["b"], r["t"]) for r in D.phrases(items, 10).select(block.alias("b"), F.explode("phrase").alias("t")).collect()}
    got = [(r["segment"], r["block"], r["term"]) for r in lists.select("segment", "block", "term").collect()]
    assert len({b for _, b in asks}) > 50 and len({a for a, _ in asks}) > 1
    assert Counter(g for g in got if g[2] is not None) == Counter((a, b, t) for a, b in asks for c, t in block_of if c == b and (a, t) in held)
    assert Counter(g[:2] for g in got if g[2] is None) == Counter(asks)
    assert {r.item_id for r in found.select("item_id").distinct().collect()} == {r.item_id for r in items.collect() if words(r.text)}


def test_empty_tables(documents, no_documents, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(no_documents, spark.createDataFrame([(1, "word")], nothing.schema)).count() == 0
    found = D.contamination(documents, nothing)
    assert found.count() == documents.count() and found.where("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_proximity(spark):
    texts = ["alpha x x beta", "beta alpha", "alpha x x x x beta", "alpha", "x beta", "alpha beta x x x alpha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = D.build_index(docs)
    near = D.matches(index, spark.createDataFrame([(7, "alpha beta")], "item_id long, text string"), reach=3)
    found = near.join(D.document_rows(index), ["segment", "doc"]).select("doc_id").distinct()
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 5]


def test_small_segments(documents, spark, monkeypatch):
    """Many segments give the same rows as one; the workers read the module's own constant, so rows are dealt instead."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = D.contamination(documents.coalesce(1), benchmark).agg(F.sum(F.hash("*").cast("long"))).first()
    many = D.contamination(documents.repartition(17), benchmark).agg(F.sum(F.hash("*").cast("long"))).first()
    assert one == many
