"""Near-duplicates, repeated bytes and repeated sentences, against brute force."""

import hashlib
import random
import re
from collections import Counter
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import bytetext as B
from rasterloom.llm import near_duplicates as N
from rasterloom.llm import repeated_bytes as R
from rasterloom.llm import sentence_spans as S
from rasterloom.llm.oracles import ORACLES
from rasterloom.llm.queries import queries
from rasterloom.llm.suffix_array import common_prefixes, suffix_array

from .conftest import SF, by_id, pairs

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- near-duplicates --------------------------------------------------------------------


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def linked(texts, size, percent=80):
    """(set size, component) of each document, by comparing all pairs."""
    sets = [(d, shingle_set(t, size)) for d, t in texts if d is not None]
    top = {d: d for d, _ in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    top[q] = p
    return {d: root(d) for d in top}


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_near_duplicates(which, size, request):
    docs = request.getfixturevalue(which)
    texts = pairs(docs)
    component = linked(texts, size)
    found = Counter(map(tuple, N.near_duplicates(docs, size).collect()))
    assert found == Counter((d, len(shingle_set(t, size)), component.get(d), d is None or component[d] == d) for d, t in texts)


def test_chains_and_large_groups(spark):
    """Links at exactly 80 percent, chains of them, and one large group of copies and near copies."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60):
        changed = list(base)
        changed[i] = f"new{i % 7}"
        texts.append(" ".join(changed))
    texts += [" ".join(base)] * 40
    step = [f"s{i}" for i in range(101)]  # 100 shingles
    for i in range(12):  # each is the last one, moved on by 11 shingles: 89 / 111 = 0.8018
        texts.append(" ".join(f"s{j}" for j in range(11 * i, 11 * i + len(step))))
    for i in range(12):  # moved on by 12: 88 / 112 = 0.786
        texts.append(" ".join(f"t{j}" for j in range(12 * i, 12 * i + len(step))))
    texts += ["a b c d e f g h i j", "a b c d e f g h i", "a b c d e f g h"]  # 8/9, then 7/8, 7/9
    docs = frame(spark, texts)
    found = {d: r.component_id for d, r in by_id(N.near_duplicates(docs, 2)).items()}
    assert found == linked(list(enumerate(texts)), 2)


def test_askers_of_a_part_are_dealt_to_chunks(spark, monkeypatch):
    """A family of near misses with a few links: no group holds all texts, and no link is lost."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        changed = list(base)
        for k in rng.sample(range(200), 8):
            changed[k] = f"n{i}x{k}"
        texts.append(" ".join(changed))
        if i % 10 == 0:
            changed[5] = f"m{i}"
            texts.append(" ".join(changed))
    answered = N._answered
    most = sum(map(len, texts)) // 2

    def bounded(size, percent):
        inner = answered(size, percent)

        def run(table):
            asked = table.filter(table.column("others").is_valid())
            total = sum(len(t) for t in asked.column("text").to_pylist())
            if total > most:
                raise ValueError(f"a group's askers have {total} bytes of text")
            return inner(table)

        return run

    monkeypatch.setattr(N, "_answered", bounded)
    monkeypatch.setattr(N, "ASK_BYTES", most // 8, raising=False)
    found = {d: r.component_id for d, r in by_id(N.near_duplicates(frame(spark, texts), 2)).items()}
    assert found == linked(list(enumerate(texts)), 2)


def test_rows_that_repeat_an_id_tie_their_texts(spark):
    """An id whose texts belong to different classes, or near them, joins those."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    near = lambda t: t.replace("30 ", "30x ")
    texts = [(3, one), (4, two), (7, one), (7, near(two)), (8, two), (5, three), (9, three), (9, one + " more"), (11, near(three)), (12, "alone here"), (12, "alone there"), (13, None), (13, "alone there")]
    component = linked(texts, 2)
    found = Counter(map(tuple, N.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect()))
    assert found == Counter((d, len(shingle_set(t, 2)), component[d], component[d] == d) for d, t in texts)
    assert component[4] == component[5] == 3


def test_odd_sketch_estimates():
    rng = np.random.default_rng(6)
    for share in (0.7, 0.8, 0.9, 0.97):
        errors = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
            rest = rng.integers(0, 1 << 63, 2000 - len(both), dtype=np.uint64)
            a = N.minhashes(np.r_[both, rest[: len(rest) // 2]])
            b = N.minhashes(np.r_[both, rest[len(rest) // 2 :]])
            x, y = N.odd_sketches(np.stack([a, b])).view(np.uint64)
            bits = int(np.bitwise_count(x ^ y).sum())
            estimate = 1 + N.BITS / (4 * N.SAMPLES) * np.log(1 - 2 * bits / N.BITS)
            errors.append(estimate - share)
        assert abs(np.mean(errors)) < 0.02
        assert np.max(np.abs(errors)) < 0.8 - N.ESTIMATE


def test_only_eighty_percent_and_more(documents):
    with pytest.raises(ValueError, match="80 percent"):
        N.near_duplicates(documents, 2, 70)


@pytest.mark.parametrize("name", ["op4_near_duplicates", "op6_repeated_bytes"])
def test_whole_table_against_sql(spark, name):
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = base.sql(ORACLES[name])
    found = queries()[name](spark, SF)
    assert found.columns == expected.columns
    assert Counter(map(tuple, found.collect())) == Counter(expected.fetchall())


# ---- repeated bytes ---------------------------------------------------------------------


def without_repeats(texts, length):
    """{doc_id: (bytes, removed, runs, hash)} by a dictionary of all strings."""
    seen, out = set(), {}
    for d, t in sorted(texts, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            one = raw[i : i + length]
            if one in seen:
                gone[i : i + length] = True
            seen.add(one)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out[d] = (len(raw), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-1][:-1]]).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest())
    return out


def removed(docs, length=100):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.remove_repeats(docs, length).collect()}


def test_repeated_bytes(documents):
    assert removed(documents) == without_repeats(pairs(documents), 100)


def test_repeated_bytes_within_and_across(spark):
    rng = random.Random(8)
    letters = "abcdefgh é東"
    some = ["".join(rng.choice(letters) for _ in range(300)) for _ in range(6)]
    texts = []
    for i in range(80):
        parts = [rng.choice(some)[rng.randrange(150) :][: rng.randrange(80, 300)] if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
    texts += ["a" * 99, "a" * 100, "a" * 101, "ab" * 500, "abc" * 3_000, None, "", "z" * 5_000, some[0], some[0], "\n".join(["the same line, of well over a hundred bytes, again and again " * 2] * 50)]
    docs = frame(spark, texts)
    assert removed(docs) == without_repeats(list(enumerate(texts)), 100)


@pytest.mark.parametrize("most", [20, 1])
def test_hot_anchors_get_finer_names(spark, monkeypatch, most):
    """Many different texts around one string: the anchor's windows are named by more of their hashes, at last by all of their bytes."""
    monkeypatch.setattr(R, "SPLIT_OVER", most)
    rng = random.Random(9)
    middle = "".join(rng.choice("abcdefghij") for _ in range(90))
    texts = ["".join(rng.choice("klmnopqrst") for _ in range(5)) * (i % 3 + 1) + middle + rng.choice("uvw") * rng.randrange(30) for i in range(150)]
    docs = frame(spark, texts)
    levels, finer = [], R._finer
    monkeypatch.setattr(R, "_finer", lambda length, gram, level: levels.append(level) or finer(length, gram, level))
    assert removed(docs) == without_repeats(list(enumerate(texts)), 100)
    assert levels and (most > 1 or levels == [*R.LEVELS, None])


@pytest.mark.parametrize("level", [*R.LEVELS, None])
def test_finer_contexts_hold_each_window_once(level):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 99, 100, 101, 176, 400)] + [b"ab" * 90, b"z" * 150, b"a" * 100]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    row, begin, end, key, _ = R.finer_contexts(np.frombuffer(b"".join(texts), np.uint8), offsets, 100, 24, level)
    windows, names = Counter(), {}
    for r, a, b, k in zip(row.tolist(), begin.tolist(), end.tolist(), key.tolist(), strict=True):
        for i in range(a, b - 99):
            windows[r, i - int(offsets[r])] += 1
            assert names.setdefault(texts[r][i - offsets[r] : i - offsets[r] + 100], k) == k
    assert windows == Counter((r, i) for r, t in enumerate(texts) for i in range(len(t) - 99))
    assert not len(R.finer_contexts(np.zeros(0, np.uint8), np.zeros(1, np.int64), 100, 24, level)[0])


def test_repeated_bytes_of_awkward_rows(awkward, no_documents):
    found = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in R.remove_repeats(awkward).collect())
    plain = without_repeats([(d, t) for d, t in pairs(awkward) if d is not None and (d, t) != (3, "word")], 100)
    assert found == Counter([*((d, n, m) for d, (n, m, *_) in plain.items()), (3, 4, 0), (3, 4, 0), (None, 4, 0), (None, 0, 0)])
    assert R.remove_repeats(no_documents).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 50, 700):
        text = np.r_[rng.integers(1, letters + 1, n), 0].astype(np.uint8)
        array = suffix_array(text, 256)
        whole = text.tobytes()
        assert array.tolist() == sorted(range(n + 1), key=lambda i: whole[i:])
        shared = common_prefixes(text, array, n + 1)
        for before, at in zip(array[:-1], array[1:], strict=True):
            k = 0
            while at + k < n + 1 and before + k < n + 1 and text[at + k] == text[before + k]:
                k += 1
            assert shared[at] == k


def test_substrings_are_sorted_by_recursion(documents):
    """Shards of real text go down several levels, each at most half as long; prefixes give the repeats."""
    raw = b"\x01".join((t or "").encode() for _, t in pairs(documents)[:40])
    text = np.r_[np.frombuffer(raw, np.uint8) + 2, 0].astype(np.uint8)
    levels = []
    array = suffix_array(text, 256, levels)
    assert len(levels) >= 3 and all(2 * b <= a for a, b in zip(levels, levels[1:], strict=False))
    whole = text.tobytes()
    assert all(whole[a : a + 4_000] <= whole[b : b + 4_000] for a, b in zip(array[:-1].tolist(), array[1:].tolist(), strict=True))
    assert sorted(array.tolist()) == list(range(len(text)))


# ---- repeated sentences -----------------------------------------------------------------


@cache
def hashed(word):
    return int(B.span_hash(B.prefix_hash(np.frombuffer(word, np.uint8)), np.array([0]), np.array([len(word)]))[0])


STOP = re.compile("[" + S.STOPS + "][" + re.escape(S.CLOSERS) + "]*$")
WIDE = re.compile("[^" + S.WIDE_STOPS + "]*[" + S.WIDE_STOPS + "]+[" + re.escape(S.CLOSERS) + "]*|[^" + S.WIDE_STOPS + "]+")


def sentences(text):
    """The sentences of a text as (first byte, words), by the rule in the module's text."""
    out, now, end, stop = [], [], 0, True
    text = text or ""
    for m in re.finditer("[^\x20\x09-\x0D]+", text):
        for w in WIDE.finditer(m.group()):
            at = m.start() + w.start()
            if now and (stop or "\n" in text[end:at]):
                out.append(now)
                now = []
            now.append((len(text[:at].encode()), w.group().encode()))
            stop, end = STOP.search(w.group()), m.start() + w.end()
    if now:
        out.append(now)
    short = []
    for s in out:
        cuts = {0}
        if len(s) > S.LONG:
            order = [hashed(w) >> 20 for _, w in s]
            for a in range(len(s) - S.PIECE + 1):
                cuts.add(max(range(a, a + S.PIECE), key=lambda i: (-order[i], i)))
        edges = [*sorted(cuts), len(s)]
        short += [s[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    return text.encode(), [(s[0][0], tuple(w for _, w in s)) for s in short]


def runs(own, span, least):
    """(first, end) of the run that begins at each sentence."""
    for i in range(len(own)):
        j = i + span
        while j < len(own) and sum(map(len, own[i:j])) < least:
            j += 1
        if j <= len(own) and sum(map(len, own[i:j])) >= least:
            yield i, j


def without_spans(texts, span=3, least=8):
    """{(doc_id, text): (sentences, removed, text left)}; rows of one id come in the order of ``told_apart``."""
    first, cut = {}, {}
    texts = sorted(set(texts), key=lambda x: (x[0] is None, x[0] or 0, told_apart(x[1])))
    for d, t in texts:
        cut[d, t] = sentences(t)
        own = [w for _, w in cut[d, t][1]]
        for i, j in runs(own, span, least):
            first.setdefault(sum(own[i:j], ()), (d, t, i))
    out = {}
    for (d, t), (raw, own) in cut.items():
        gone, words = set(), [w for _, w in own]
        for i, j in runs(words, span, least):
            if first[sum(words[i:j], ())] != (d, t, i):
                gone |= set(range(i, j))
        edges = [0, *(s for s, _ in own[1:]), len(raw)]
        left = b"".join(raw[edges[k] : edges[k + 1]] for k in range(len(own)) if k not in gone) if own else raw
        out[d, t] = (len(own), len(gone), left.decode() if t is not None else None)
    return out


def test_runs_of_any_length_of_words(spark):
    """With ``least_words`` 1 every run of three sentences counts, however short; with the default, short ones stay."""
    texts = ["A. B. C.", "A. B. C.", "One two. Three. Four five.", "x. One two. Three. Four five. y.", "Own words. Here. Only.", ""]
    docs = frame(spark, texts)
    found = by_id(S.substring_dedup(docs, least_words=1))
    plain = without_spans(list(enumerate(texts)), least=1)
    assert {(d, t): (found[d].n_sentences, found[d].n_removed, found[d].text) for d, t in enumerate(texts)} == plain
    assert [found[i].n_removed for i in range(4)] == [0, 3, 0, 3]
    assert {r.n_removed for r in S.substring_dedup(docs).collect()} == {0}


HASHES = {}


def told_apart(text):
    return HASHES.get(text, 0)


def spans_left(docs):
    """Rows of the operator and of brute force over the same table, and whether they agree."""
    rows = docs.withColumn("h", F.xxhash64("text")).select("doc_id", "text", "h").collect()
    HASHES.clear()
    HASHES.update({r.text: r.h for r in rows})
    plain = without_spans([(r.doc_id, r.text) for r in rows])
    found = S.substring_dedup(docs).select("doc_id", "n_sentences", "n_removed", "text").collect()
    assert Counter(map(tuple, found)) == Counter((r.doc_id, *plain[r.doc_id, r.text]) for r in rows)
    return found


def test_sentence_spans(documents):
    assert sum(r.n_removed > 0 for r in spans_left(documents)) > 10


def test_sentence_spans_of_small_texts(spark):
    passage = "One small sentence here. A second one follows it! Is the third the last? "
    long = " ".join(f"word{i}" for i in range(70))
    quoted = 'He said "it is so." (She did not!) »Why?« they asked. '
    wide = "これは 文です。次の 文「です。」三つ 目！四つ 目？終わり"
    texts = ["Before it. " + passage + "After it.", passage, passage + passage, "Other.\n" + passage.replace(" ", "\t "), long, "Start. " + long, "a. b. c. a. b. c.", "", None, " \n", quoted, "Then " + quoted, wide, "前。" + wide, "x 終。", "...y", "終。」", "」z。a", "。", "。b", "...' \"' .", "。。。！」 x。"]
    found = {r.doc_id: r for r in spans_left(frame(spark, texts))}
    assert found[1].text == "" and found[3].text == "Other.\n" and found[6].n_removed == 0 and found[8].text is None
    assert found[12].n_sentences == 5 and found[13].n_removed >= 4
    short = "No. Yes. Well, well. Oh. So. Then go. "  # one or two words a sentence: the run goes on
    assert [r.n_removed for r in spans_left(frame(spark, [short, "Ah. " + short + "Now."]))] == [0, 6]


def test_rows_of_one_id_are_told_apart(spark):
    """What repeats in one row of an id, or without an id, never takes another row's text."""
    passage = "One small sentence here. A second one follows it! Is the third the last? "
    other = "This text stands nowhere else. It has words of its own. Nothing repeats it here."
    rows = [(1, passage), (None, passage), (None, other), (7, "Short row of seven. Nothing else."), (7, passage + "More."), (7, "Quite another one. With two of them. And a third."), (None, None), (7, None), (1, passage)]
    found = spans_left(spark.createDataFrame(rows, "doc_id long, text string"))
    left = Counter((r.doc_id, r.text) for r in found)
    assert left[1, passage] == 2 and left[None, ""] == 1 and left[7, "More."] == 1 and left[None, other] == 1


def test_long_unbroken_passages_are_found_at_any_offset(spark):
    """A passage of over 50 words without a stop, in the middle of other sentences."""
    rng = random.Random(12)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(56))
    texts = [f"{' '.join(f'q{d}x{i}' for i in range(k))} {passage} {' '.join(f'r{d}x{i}' for i in range(9))}." for d, k in enumerate((0, 3, 7, 13, 22))]
    found = by_id(S.substring_dedup(frame(spark, texts)))
    assert found[0].n_removed == 0
    assert all(found[d].n_removed > 0 for d in range(1, 5))


def test_passages_with_stops_are_found_at_any_offset(spark):
    """Passages of 51 to 95 words with stops anywhere, first after a stop, then in the middle of a sentence."""
    rng = random.Random(13)
    stops = [(n, {k}) for n in (51, 63, 80, 95) for k in range(n)]
    stops += [(n, set(range(first, n, every))) for n in (51, 95) for every in (3, 5, 11, 12, 13, 17, 24) for first in range(min(every, 5))]
    stops += [(n, {16, 33, n - 1}) for n in range(51, 96, 4)]
    passages, texts = [], []
    for i, (n, at) in enumerate(stops):
        words = [f"p{i}x{rng.randrange(10**6)}" + "." * (k in at) for k in range(n)]
        passages.append(words)
        texts.append(f"Text {i} begins so. {' '.join(words)} It ends{i} here{i}.")
        before = [f"see{i}x{k}" for k in range(2 + i % 23)]
        texts.append(f"{' '.join(before)} {' '.join(words)} {' '.join(f'z{i}x{k}' for k in range(i % 19))}")
    found = by_id(S.substring_dedup(frame(spark, texts)))
    for i, words in enumerate(passages):
        assert found[2 * i].text == texts[2 * i]
        left, whole = found[2 * i + 1].text.split(), texts[2 * i + 1].split()
        gone = Counter(whole) - Counter(left)
        assert not gone - Counter(words) and sum(gone.values()) >= len(words) - 30, (stops[i], sum(gone.values()))


def test_sentence_spans_of_awkward_rows(awkward, no_documents):
    found = S.substring_dedup(awkward)
    assert [f.name for f in found.schema.fields if f.name not in ("n_sentences", "n_removed")] == [c for c in awkward.columns if c not in ("n_sentences", "n_removed")]
    assert found.count() == awkward.count()
    assert found.where(F.col("text").isNull()).count() == 2
    assert S.substring_dedup(no_documents).count() == 0


def test_sentences_class_reads_nulls():
    cut = S.Sentences(pa.array([None, "", "One. Two. Three."], pa.string()))
    assert cut.count.tolist() == [0, 0, 3]
