"""Faults that the fourth review found."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import expr as E
from rasterloom.operators import features as X
from rasterloom.sources import rasters as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_descriptors_are_no_rows(spark):
    """All of them share a substring, so an index of substrings would give a row for each pair."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 1 << 47, (80, 2)).tolist()
    words[70:] = words[:10]  # equal ones too
    rows = spark.createDataFrame(list(enumerate(words)), "id long, bits array<long>")
    found = X.match_descriptors(rows.where("id % 2 = 0"), rows, 60, apart=True)
    assert "Join" not in plan(found)
    far = lambda a, b: sum((p ^ q).bit_count() for p, q in zip(a, b, strict=True))
    want = {i: min((far(words[i], b), j) for j, b in enumerate(words) if j != i) for i in range(0, 80, 2)}
    assert {r.id_a: (r.distance, r.id_b) for r in found.collect()} == {i: w for i, w in want.items() if w[0] < 60}


def test_descriptors_take_one_shuffle(spark):
    """Box means come from the tiles that the tests look up in, also for rasters of several tiles and for floats."""
    rng = np.random.default_rng(6)
    values = rng.integers(0, 256, (7, 270))
    pairs = X.brief_pairs(128, 1, 2)
    r = S.literal(spark, values.tolist())
    for raster in (r, r.withColumn("v", F.col("v").cast("double"))):
        found = X.brief(raster, r.where("x between 2 and 267 and y between 2 and 4").select("img", "x", "y"), pairs)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        got = {(k.x, k.y): k.bits for k in found.collect()}
        assert set(got) == {(x, y) for x in range(2, 268) for y in range(2, 5)}
        for x, y in ((2, 2), (254, 3), (255, 4), (256, 2), (267, 4)):
            mean = lambda o: int(np.floor(values[max(0, y + o[1] - 2) : y + o[1] + 3, max(0, x + o[0] - 2) : x + o[0] + 3].mean()))  # noqa: B023, E731
            tests = [mean(p) < mean(q) for p, q in pairs][1:] + [False]
            assert [w % (1 << 64) for w in got[x, y]] == [int("".join("01"[t] for t in tests[i : i + 64]), 2) for i in (0, 64)]


@pytest.mark.parametrize("words, threshold, apart", [(2, 64, True), (2, 50, False), (4, 140, True), (2, 300, True)])
def test_blocks_leave_the_nearest(words, threshold, apart):
    rng = np.random.default_rng(words)
    held = rng.integers(0, 1 << 63, (300, words)).astype(np.uint64)
    held[::3] = held[0] ^ rng.integers(0, 8, (100, words)).astype(np.uint64)
    held = rng.permutation(np.unique(held, axis=0))
    ids = rng.permutation(1000)[: len(held)]
    second = np.where(np.arange(len(held)) % 5, ids, ids + 1000)
    q = np.r_[ids[:100], second[100:140], np.arange(5000, 5060)]
    asked = np.r_[held[:140], rng.integers(0, 1 << 63, (60, words)).astype(np.uint64)]
    ask = X.Asked(q, asked, threshold, apart, [X._flips(0)])
    for some in np.array_split(np.arange(len(held)), 3):
        ask.meet(ids[some], second[some], held[some])
    far = np.bitwise_count(asked[:, None] ^ held).sum(2, dtype=int)
    near = lambda i: [(int(far[i, k]), int(name)) for k in range(len(held)) if far[i, k] < threshold for name in (ids[k], second[k]) if not (apart and name == q[i])]
    assert [tuple(r.values()) for r in ask.found().to_pylist()] == [(int(q[i]), *min(near(i))) for i in range(len(q)) if near(i)]


def test_rounding_is_that_of_sql(spark):
    """Doubles at and beside halves of the sixth place, where the shortest decimal and the scaled double part."""
    half = (np.arange(0, 2_000_000, 997) + 0.5) / 1e6
    values = np.concatenate([np.nextafter(half, 0), half, np.nextafter(half, 3), -half, [0.0, 1e300, np.inf, -np.inf]]).tolist()
    want = [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x double").coalesce(1).orderBy("k")
    assert [r.y for r in rows.select(E.rounded("x", 6).alias("y")).collect()] == want
    assert [r.y for r in rows.select(F.round("x", 6).alias("y")).collect()] != want
