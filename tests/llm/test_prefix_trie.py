import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import prefix_trie
from rasterloom.llm.oracles import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Every node by its whole sequence of turns."""
    own = defaultdict(list)
    for c, n, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    found = []
    for node, convs in members.items():
        children = [b for b in below[node] if len(b) == len(node) + 1]
        leaves = [b for b in below[node] if len(below[b]) == 1]
        saved = sum((len(members[b]) - 1) * len(b[-1][1].encode()) for b in below[node] if b)
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(node))))
        found.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def nodes(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def made(seed, n=120):
    """Conversations with many shared turns, ties, nulls, absent bases and a long one."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), n):
        for t in range(rng.choice([0, 1, 2, 5, 12])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "user", None]), rng.choice(["", "a", "b", "é" * 3, None])))
    rows += [(500, t, "user", str(t % 3)) for t in range(150)] + [(501, t, "user", str(t % 3)) for t in range(150)] + [(502, t, "user", str(t % 3)) for t in range(90)]
    return rows + [(None, 1, "user", "nobody"), rows[0], rows[0]]


@pytest.mark.parametrize(("block", "span"), [(64, 4096), (4, 3)])
def test_against_every_sequence(spark, monkeypatch, block, span):
    """Small blocks rank conversations over several levels; small spans hash ends in many strings."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rows = made(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert nodes(prefix_trie.conversation_trie(df)) == brute(rows)


def test_intervals_nest(spark):
    rows = prefix_trie.conversation_trie(spark.createDataFrame(made(9), SCHEMA)).select("node", "end", "depth").orderBy("node").collect()
    assert [r.node for r in rows] == list(range(1, len(rows) + 1))
    open_ = []
    for r in rows:
        while open_ and open_[-1].end < r.node:
            open_.pop()
        assert len(open_) == r.depth and all(r.end <= o.end for o in open_)
        open_.append(r)


def test_against_sql(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    assert nodes(prefix_trie.conversation_trie(conversations)) == sorted(con.sql(f"select {', '.join(COLUMNS)} from ({ORACLES['op12_prefix_trie']})").fetchall(), key=str)


def test_turnless_and_empty(spark):
    alone = [(8, 0, "user", "x")]  # its base is absent, and its one turn is among those it gives up
    assert nodes(prefix_trie.conversation_trie(spark.createDataFrame(alone, SCHEMA))) == brute(alone)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    clashing = spark.createDataFrame(alone, SCHEMA).withColumns({n: F.lit("z") for n in ("conv", "pos", "s1", "one", "node", "rank", "__part")})
    assert nodes(prefix_trie.conversation_trie(clashing)) == brute(alone)


def test_sums_over_task_ends(spark):
    """A key that spans many tasks is summed once, and in order."""
    rows = [(k, i, i % 7) for k, n in ((1, 500), (2, 3), (5, 900), (9, 1)) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = prefix_trie.running(spark.createDataFrame(rows, "k long, i long, v long"), "k", ["i"], {"s": "v"}, {"x": "v"}, ["k", "i"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, xors = {}, {}
    for k, i, v in rows:
        sums[k, i] = sums.get((k, i - 1), 0) + v
        xors[k, i] = xors.get((k, i - 1), 0) ^ v
    assert {(r.k, r.i): (r.s, r.x) for r in got} == {key: (sums[key], xors[key]) for key in sums}
