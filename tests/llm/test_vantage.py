import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import vantage
from rasterloom.llm.oracles import ORACLES

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100):
    """All scores of each anchor, in Python's integers."""
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    found = []
    for i, (anchor, q, label) in enumerate(kept):
        if anchor % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), v, other == label) for j, (v, x, other) in enumerate(kept) if j != i)
        for s, v, _ in [t for t in scores if t[2]][:5]:
            inside = [(n, w) for n, w, same in scores if not same and 30 * -s <= 100 * -n <= 90 * -s]
            found += [(anchor, v, k + 1, w, -s, -n) for k, (n, w) in enumerate(inside[:10])]
    return sorted(found)


def mined(df):
    return sorted(map(tuple, vantage.hard_negatives(df).select(*COLUMNS).collect()))


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(params=["one", "many"])
def sizes(request, monkeypatch):
    """One shard, and many small ones with small leaves."""
    if request.param == "many":
        for name, n in (("SAMPLE", 60), ("SHARD", 40), ("LEAVES", 8), ("LEAF", 7), ("ANCHORS", 3)):
            monkeypatch.setattr(vantage, name, n)


def clustered(seed=1):
    """Clusters, a vector that a third of the rows share, ties, repeated rows and awkward ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, 8))
    rows = [(int(i), [float(x) for x in (np.round(centres[i % 6] + rng.normal(0, 0.08, 8), 2) if i % 3 else centres[0])], int(rng.integers(0, 4))) for i in rng.permutation(400)]
    rows += [rows[0], rows[5], (0, rows[3][1], 2), (1200, [0.0] * 8, 1), (1300, [], 1), (1400, [0.1, 0.2], 3)]
    rows += [(None, [0.1] * 8, 1), (1, None, 1), (2, [0.1] * 8, None), (100, [float("nan")] * 8, 1), (200, [float("inf")] + [0.0] * 7, 1), (300, [None] + [0.0] * 7, 1)]
    return rows


def test_against_all_scores(spark, sizes):
    rows = clustered()
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_against_sql(spark, sizes):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    assert mined(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")) == sorted(con.sql(f"select {', '.join(COLUMNS)} from ({ORACLES['op13_hard_negatives']})").fetchall())


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 3e4, 3)], i % 2) for i in range(60)] + [(100, [2e5, 1e5, 0.0], 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    a, b = rng.integers(-(1 << 30), 1 << 30, (4, 3)), rng.integers(-(1 << 30), 1 << 30, (5, 3))
    assert vantage.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    with pytest.raises(OverflowError):
        vantage.products(np.full((1, 2), 1 << 40), np.full((1, 2), 1 << 40))


def test_few_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    alone = [(100, [0.5, 0.5], 1), (3, [0.4, 0.4], 1), (4, [0.3, 0.3], 2), (8, [0.2, 0.2], 2)]
    df = spark.createDataFrame(alone, SCHEMA).withColumns({n: F.lit("z") for n in ("row", "leaf", "windows", "anchor", "w")})
    assert mined(df) == brute(alone) != []


def test_trees_bound_their_leaves():
    points = np.random.default_rng(2).normal(size=(500, 6))
    tree = vantage.Tree.over(points, 20)
    assert sorted(np.concatenate(tree.members)) == list(range(500))
    asked = np.random.default_rng(3).normal(size=(9, 6))
    for t, rows in ((tree, tree.members), (tree.as_dealer(), [np.flatnonzero(tree.place(points) == i) for i in range(len(tree.members))])):
        nearest, farthest = t.reach(asked)
        for i, members in enumerate(rows):
            if len(members):
                far = np.sqrt(((asked[:, None] - points[members]) ** 2).sum(2))
                assert (nearest[:, i] <= far.min(1) + 1e-9).all() and (farthest[:, i] >= far.max(1) - 1e-9).all()
    assert vantage.Tree.over(np.ones((300, 3)), 20).members[0].size == 300  # equal rows stay together
