"""Faults that the third review found."""

import math
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import near_duplicates as N
from rasterloom.operators import components as G
from rasterloom.operators import coords as C
from rasterloom.operators import features as X
from rasterloom.operators import outlines as O
from rasterloom.operators import regions as R
from rasterloom.operators import stencil as T
from rasterloom.sources import rasters as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_brief_asks_its_tile(spark):
    pairs = X.brief_pairs(128, 1, 2)
    rng = np.random.default_rng(5)
    values = rng.integers(0, 256, (9, 300))
    r = S.literal(spark, values.tolist())
    found = X.brief(r, r.where("x between 1 and 298 and y between 2 and 5").select("img", "x", "y"), pairs, 1)
    assert "Join" not in plan(found)  # no row for each test of each keypoint
    wide = np.pad(values, 1, constant_values=-1)
    blocks = [[[v for v in wide[y : y + 3, x : x + 3].ravel() if v >= 0] for x in range(300)] for y in range(9)]
    mean = [[sum(b) // len(b) for b in row] for row in blocks]
    got = {(k.x, k.y): k.bits for k in found.collect()}
    assert set(got) == {(x, y) for x in range(2, 298) for y in range(2, 6)} | {(x, y) for x in (1, 298) for y in range(2, 6) if all(0 <= x + dx < 300 for pair in pairs for dx, _ in pair)}
    for x, y in ((2, 2), (255, 3), (256, 5), (297, 4)):
        tests = [mean[y + p[1]][x + p[0]] < mean[y + q[1]][x + q[0]] for p, q in pairs][1:] + [False]
        words = [int("".join("01"[int(t)] for t in tests[i : i + 64]), 2) for i in (0, 64)]
        assert [w % (1 << 64) for w in got[x, y]] == words


def test_far_descriptors_ask_no_flipped_keys(spark, monkeypatch):
    asked = []
    flips = X._flips
    monkeypatch.setattr(X, "_flips", lambda n: asked.append(n) or flips(n))
    monkeypatch.setattr(X, "CACHED", 7)
    rng = np.random.default_rng(3)
    bits = rng.integers(-(1 << 63), (1 << 63) - 1, (60, 2)).tolist()
    rows = spark.createDataFrame(list(enumerate(bits)), "id long, bits array<long>")
    got = {k.id_a: (k.distance, k.id_b) for k in X.match_descriptors(rows, rows, 64, apart=True).collect()}
    far = lambda a, b: sum((p ^ q).bit_count() if (p ^ q) >= 0 else ((p ^ q) + (1 << 64)).bit_count() for p, q in zip(a, b, strict=True))
    want = {i: min((far(a, b), j) for j, b in enumerate(bits) if j != i) for i, a in enumerate(bits)}
    assert got == {i: w for i, w in want.items() if w[0] < 64}
    assert max(asked) < X.ROUNDS


def test_even_rasters_stay_even(spark):
    values = [[v] * 8 for v in range(1, 256)]
    r = S.literal(spark, [row for row in values for _ in range(5)])
    middle = F.col("y") % 5 == 2  # whose five rows are alike
    for sigma in (0.6, 0.8, 1.0):
        assert T.gaussian_blur(r, sigma).where(middle).where(F.col("v") != F.floor(F.col("y") / 5) + 1).count() == 0
    assert T.bilateral_filter(r, 1, 2.0, T.gaussian_color(20.0)).where(middle).where(F.col("v") != F.floor(F.col("y") / 5) + 1).count() == 0


@pytest.mark.parametrize("method", ["ccorr_normalized", "sse_normalized"])
def test_scores_of_flat_places_divide(spark, method):
    zero, one = S.literal(spark, [[0, 0]]), S.literal(spark, [[3, 4]])
    score = X.match_template(zero, one, method, divide=True).first().score
    assert math.isnan(score) if method.startswith("ccorr") else score == math.inf
    assert X.match_template(zero, one, method).first().score == (0 if method.startswith("ccorr") else 25)


def refuse(*_, **__):
    raise AssertionError("rounds of joins for rasters of one tile")


def test_small_rasters_need_no_rounds(spark, monkeypatch):
    for module in (R, O):
        monkeypatch.setattr(module, "component_labels", refuse)
    rng = np.random.default_rng(11)
    r = S.literal(spark, rng.integers(0, 3, (40, 60)).tolist())
    assert R.connected_components(r, 8).count() == R.hysteresis(r, 1.0, 2.0).count() == R.flood_fill(r, 3, 3, 9).count() == 2400
    assert O.find_contours(r).count() > 0


def labels(r, n):
    return {(k.x, k.y): k.v for k in R.connected_components(r, n).collect()}


@pytest.mark.parametrize("connectivity", [4, 8])
def test_tiles_join_to_the_same_regions(spark, monkeypatch, connectivity):
    rng = np.random.default_rng(connectivity)
    values = rng.integers(0, 3, (9, 12))
    r = S.literal(spark, values.tolist())
    whole, filled = labels(r, connectivity), {(k.x, k.y): k.v for k in R.flood_fill(r, 5, 5, 9).collect()}
    grown = {(k.x, k.y): k.v for k in R.hysteresis(r, 1.0, 2.0).collect()}
    contours = sorted(map(tuple, O.find_contours(r).fillna(-1).collect()))
    monkeypatch.setattr(T, "TILE", 6)
    monkeypatch.setattr(R, "ONE_TILE", "w <= 6 AND h <= 6")
    monkeypatch.setattr(R, "SEVERAL", "w > 6 OR h > 6")
    assert labels(r, connectivity) == whole
    assert {(k.x, k.y): k.v for k in R.flood_fill(r, 5, 5, 9).collect()} == filled
    assert {(k.x, k.y): k.v for k in R.hysteresis(r, 1.0, 2.0).collect()} == grown
    assert sorted(map(tuple, O.find_contours(r).fillna(-1).collect())) == contours


@pytest.mark.parametrize("border", [7, "replicate"])
def test_warps_send_each_place_once(spark, monkeypatch, border):
    rng = np.random.default_rng(2)
    r = S.literal(spark, rng.integers(0, 256, (30, 41)).tolist())
    turned = lambda: C.rotate_about_center(r, 0.4, "bicubic", border)
    assert "posexplode" not in plan(turned())
    whole = {(k.x, k.y): k.v for k in turned().collect()}
    monkeypatch.setattr(T, "TILE", 8)
    assert {(k.x, k.y): k.v for k in turned().collect()} == whole


def test_haar_values_look_up_one_row(spark):
    r = S.literal(spark, np.arange(42).reshape(6, 7).tolist())
    values = X.haar_values(r, X.haar_features(spark, 4, 3))
    assert "sum((weight" not in plan(values)  # no row for each corner of each feature
    assert values.count() == X.haar_features(spark, 4, 3).count()


def test_seams_go_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(4)
    r = S.literal(spark, rng.integers(0, 256, (9, 12)).tolist())
    step = r
    for _ in range(3):
        step = O.remove_vertical_seam(step, O.find_vertical_seam(step))
    want = {(k.w, k.x, k.y, k.v) for k in step.collect()}
    monkeypatch.setattr(O, "find_vertical_seam", refuse)
    assert {(k.w, k.x, k.y, k.v) for k in O.shrink_width(r, 9).collect()} == want


def test_places_of_open_buckets_are_not_copied(spark):
    """600 places, a third outside the major component: no copies of places in one block, none in the join of several."""
    left = spark.range(600).select(F.lit(7).alias("bucket"), F.col("id").alias("doc"), F.col("id").alias("label"), (F.col("id") < 200).alias("minor"), N._chunks(F.lit(200)).alias("chunks"), N._chunks(F.lit(600)).alias("blocks"))
    reps = spark.range(600).select(F.col("id").alias("doc_id"), F.array(F.lit(1)).alias("sketch"), F.array(F.lit(7)).alias("bands"))
    found = N._dealt(left, reps, 3)
    assert found.count() == 600 + 200
    lines = plan(found).split("\n")
    depth = lambda word: min(i for i, x in enumerate(lines) if word in x)
    assert depth("Generate") < depth("Join")  # copies come after the join


def test_labels_go_through_no_broadcast(spark):
    edges = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    plans = []
    found = G.component_labels(edges, lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or G.checkpointed(df))
    assert {r.label for r in found.collect()} == {0}
    assert not any("BroadcastHashJoin" in p for p in plans[3:])  # the rounds'


@pytest.mark.parametrize("levels", [1, 4])
@pytest.mark.parametrize("forest", [3, 1 << 18])
def test_contractions_find_the_least_ids(spark, monkeypatch, levels, forest):
    """Chains in any order, stars, hubs that meet, repeated edges and loops, over several tasks."""
    rng = np.random.default_rng(2)
    walk = (rng.permutation(60) + 100).tolist()
    pairs = [*pairwise(walk), *pairwise(range(200, 240)), *((300, 301 + k) for k in range(50)), *((340, 360 + k) for k in range(50)), (500, 501), (501, 500), (7, 7), (None, 8)]
    pairs = [pairs[k] for k in rng.permutation(len(pairs))]
    monkeypatch.setattr(G, "LEVELS", levels)
    monkeypatch.setattr(G, "FOREST", forest)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    want = {x: least for group in (range(100, 160), range(200, 240), (*range(300, 351), *range(360, 410)), (500, 501)) for least in [min(group)] for x in group}
    found = G.contracted_labels(edges).collect()
    assert len(found) == len(want) and {r.id: r.label for r in found} == want


def test_classes_of_documents_take_few_shuffles(spark, monkeypatch):
    """Each exchange of the driver's plans costs it threads and memory; the labels took most of them."""
    plans, real = [], N.written

    def counted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString() if name == "labels" else "")
        return real(df, name)

    monkeypatch.setattr(N, "written", counted)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[:k] + [f"new{k}"] + words[k + 1 :]) for k in range(30)] + [f"text {k} of its own" for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in N.near_duplicates(docs, 2).collect()}
    assert found == {k: 0 if k < 30 else k for k in range(60)}
    assert sum(p.count("Exchange") for p in plans) <= 24
