"""The toxicity network and the quality rules: counters by brute force, verdicts on held-out rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import quality as Q
from rasterloom.llm import toxicity as T

from .conftest import pairs

LARGE = "/root/testdata/sf0.1"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def large(spark):
    return tuple(spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))


@pytest.fixture(scope="module")
def toxicity_model(large):
    return T.fit(*large)


@pytest.fixture(scope="module")
def quality_model(large):
    return Q.fit(*large)


def joined(rows, labels, label):
    known = {r.doc_id: r[label] for r in labels.collect()}
    rows = [r for r in rows if r.doc_id in known and held_out(r.doc_id)]
    return rows, np.array([known[r.doc_id] for r in rows])


def test_toxicity_on_held_out_rows(large, toxicity_model):
    docs, labels = large
    rows, y = joined(T.scored(docs, toxicity_model).collect(), labels, "toxic")
    score, rejected = np.array([r.score for r in rows]), np.array([r.rejected for r in rows])
    assert len(rows) > 300 and ((score >= 0) & (score <= 1)).all()
    order = np.argsort(np.argsort(score))
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.95
    assert (rejected & (y == 1)).sum() > 0.8 * y.sum()
    assert (rejected & (y == 0)).sum() < 0.03 * (y == 0).sum()
    assert abs(score.mean() - y.mean()) < 0.05  # calibrated
    assert set(toxicity_model.thresholds) and all(0.2 <= v <= 0.6 for v in toxicity_model.thresholds.values())


def test_toxicity_rows(awkward, toxicity_model):
    rows = T.scored(awkward, toxicity_model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in pairs(awkward))
    assert all(0 <= r.score <= 1 and r.rejected == (r.score >= toxicity_model.thresholds.get("en", toxicity_model.threshold)) for r in rows if r.doc_id)


def test_toxicity_columns(spark, awkward, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = T.toxicity(awkward, none)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert {(r.score, r.predicted, r.held_out == held_out(r.doc_id)) for r in found.collect()} == {(0.0, 0, True)}
    assert T.toxicity(no_documents, none).count() == 0
    kept = T.without_toxic(awkward, awkward, none)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_one_text_scores_alone_as_in_a_batch(toxicity_model):
    texts = ["", "one", None, "some words about a river and its boats", "x " * 5_000, "zwei drei"]
    together = toxicity_model.scores(pa.array(texts, pa.string()))
    alone = [toxicity_model.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(together, alone)


@pytest.mark.parametrize("module, label", [(T, "toxic"), (Q, "quality")])
def test_what_stands_late_in_a_long_text_is_learnt(module, label, spark):
    """The evidence stands after 8,192 characters only."""
    late = [" cruel vile insult", " calm kind remark"]
    docs = spark.createDataFrame([(i, "x" * 9_000 + late[i % 2], "en") for i in range(800)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(800)], f"doc_id long, {label} int")
    model = module.fit(docs, labels)
    if module is T:
        p = model.scores(pa.array(["x" * 9_000 + t for t in late]))
    else:
        p = model.probabilities(Q.Measured(pa.array(["x" * 9_000 + t for t in late])))
    assert p[0] > p[1] + 0.3


def test_the_sample_is_bounded_after_the_join(spark):
    """Ids that repeat in the documents or the labels; ids that the labels contradict themselves about."""
    docs = spark.range(5_000).selectExpr("id % 40 as doc_id", "concat('text ', id % 3) as text", "'en' as lang")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3 + [(i, 1 - i % 2) for i in range(0, 40, 4)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    rows, counts = T.sampled(docs, labels, "toxic", 5)
    found = rows.collect()
    able = [i for i in range(40) if i % 4 and not held_out(i)]
    assert counts == Counter(i % 2 for i in able)
    assert Counter(r.label for r in found) == {0: min(5, counts[0]), 1: 5}
    assert len({r.doc_id for r in found}) == len(found) and all(r.doc_id in able and r.label == r.doc_id % 2 for r in found)
    again = T.sampled(docs.repartition(7), labels.repartition(3), "toxic", 5)[0].collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_toxicity_scores_by_hand(toxicity_model):
    """The forward pass, word by word."""
    m = toxicity_model
    for text in ("a short and kind text", "one", "Größe und 東京, mixed words about 3 boats and boats and boats", "zwei drei vier " * 9):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        vectors = []
        for word in words:
            raw = np.frombuffer(word.encode(), np.uint8)
            slots = [int(T.B.span_hash(T.B.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0] >> np.uint64(47))]
            for k, n in enumerate(T.PREFIXES):
                if len(raw) >= n:
                    h = T.B.span_hash(T.B.prefix_hash(raw), np.array([0]), np.array([n]))
                    slots.append(int(T.B.mix(h + np.uint64(k + 1))[0] >> np.uint64(47)))
            vectors.append(sum(m.embed[s].astype(float) for s in slots))
        pooled = []
        for w, width in enumerate(T.WIDTHS):
            for f in range(T.FILTERS):
                best = max(sum(float(vectors[i + k] @ m.filters[w][k * T.DIM : (k + 1) * T.DIM, f]) for k in range(width) if i + k < len(words)) for i in range(len(words)))
                pooled.append(max(0.0, best + float(m.bias[w * T.FILTERS + f])))
        z = (float(np.dot(pooled, m.out)) + m.out_bias) * m.scale + m.shift
        assert abs(m.scores(pa.array([text]))[0] - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_verdict_by_hand(quality_model):
    m = quality_model
    for text in ("Plain prose about a river, its boats and the people on them. " * 3, "x", "BUY $$$ now <<< click", "東京 は 都"):
        raw = text.encode()
        spans = [(a.start(), a.end()) for a in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        data = np.frombuffer(raw, np.uint8)
        words = [int(T.B.span_hash(T.B.prefix_hash(data), np.array([a]), np.array([b]))[0]) for a, b in spans]
        kinds = [[w % (1 << Q.BITS) for w in words]]
        kinds.append([int(T.B.mix(np.array([(3 * a + b) % 2**64], np.uint64))[0]) % (1 << Q.BITS) for a, b in zip(words, words[1:], strict=False)])
        kinds += [[((int.from_bytes(raw[i : i + n], "big") * (0x9E3779B97F4A7C15 + 2 * n)) % 2**64) >> (64 - Q.BITS) for i in range(len(raw) - n + 1)] for n in (3, 4, 5)]
        z = m.bias + sum(sum(float(m.weights[k][s]) for s in slots) / max(1, len(slots)) for k, slots in enumerate(kinds))
        p = m.probabilities(Q.Measured(pa.array([text])))[0]
        assert abs(p - 1 / (1 + np.exp(-(z * m.scale + m.shift)))) < 1e-4


def test_labels_of_held_out_rows_are_never_read(large, spark):
    docs, labels = large
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    small = docs.where("doc_id < 600")
    one, two = T.fit(small, labels, 100), T.fit(small, turned, 100)
    assert np.array_equal(one.embed, two.embed) and one.thresholds == two.thresholds


def counters(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_quality_counters(which, request):
    docs = request.getfixturevalue(which)
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.quality(docs, None).collect())
    assert found == Counter((d, *counters(t)) for d, t in pairs(docs))


def test_quality_on_held_out_rows(large, quality_model):
    docs, labels = large
    rows, y = joined(Q.quality(docs, quality_model).collect(), labels, "quality")
    kept, p = np.array([r.kept for r in rows]), np.array([r.probability for r in rows])
    assert all(r.kept == (not r.base_failed and r.probability >= Q.THRESHOLD) for r in rows)
    assert kept[y == 1].mean() > 0.9 and kept[y == 0].mean() < 0.4
    assert abs(p.mean() - y.mean()) < 0.08


def test_quality_without_labels_or_rows(spark, awkward, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.fit(awkward, none) is None
    assert all(r.kept != r.base_failed for r in Q.quality(awkward, None).collect())
    assert Q.quality(no_documents, None).count() == 0


def test_all_labelled_rows_are_read(spark):
    """More rows of a label than a task takes, or the former sample of 2,500 of each label."""
    docs = spark.range(9_000).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = spark.range(9_000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as toxic")
    rows, counts = T.sampled(docs, labels, "toxic")
    assert rows.count() == sum(counts.values()) == sum(not held_out(i) for i in range(9_000)) > 5_000


@pytest.mark.parametrize("module, label", [(T, "toxic"), (Q, "quality")])
def test_parts_are_averaged(module, label, spark, monkeypatch):
    """Several parts learn what one part does, and the same however the rows are dealt."""
    monkeypatch.setattr(T.A, "TASK_ROWS", 150)
    late = ["cruel vile insult ", "calm kind remark "]
    docs = spark.createDataFrame([(i, f"word{i} " + late[i % 2] * 3, "en") for i in range(1_200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(1_200)], f"doc_id long, {label} int")
    score = lambda m: m.scores(pa.array(late)) if module is T else m.probabilities(Q.Measured(pa.array(late)))
    one, two = (score(module.fit(d, labels)) for d in (docs, docs.repartition(7)))
    assert one[0] > one[1] + 0.3 and np.array_equal(one, two)
