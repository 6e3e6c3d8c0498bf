"""Token ids, files of them and decoding, against the tokenizers library."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import bpe, pretokens, token_files
from rasterloom.llm.queries import BYTE_BPE

from .conftest import by_id, pairs

PATH = public_tokenizers.path(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeList(PATH)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_round_trip(which, request, library):
    docs = request.getfixturevalue(which)
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect())
    assert found == Counter((d, *expected(library, t)) for d, t in pairs(docs))


def test_encode_then_decode(awkward, library):
    ids = bpe.encode(awkward, PATH)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs(awkward))
    texts = bpe.decode(ids, PATH)
    assert Counter(map(tuple, texts.collect())) == Counter((d, t or "") for d, t in pairs(awkward))


def ids_of(encoder, texts):
    out = [[] for _ in texts]
    for i, ids, _ in encoder.column(pa.array(texts, pa.string())):
        out[i] += ids.tolist()
    return out


LETTERS = "aaeest  ''\n\t.,0189srvdlmßé東🙂 <|>\u3000\u00a0\x1c\x85"


def test_random_strings(library, merges):
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(4_000)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(bpe.Encoder(merges), texts) == expected
    assert [x.tolist() for x in token_files.LibraryEncoder(PATH, 2).column(pa.array(texts))] == expected


@pytest.mark.parametrize("most", [40, 64, 257])
def test_blocks_cut_where_the_whole_text_is_cut(most):
    rng = random.Random(most)
    for _ in range(300):
        text = "".join(rng.choice([rng.choice(LETTERS), "x" * rng.randrange(90), " " * rng.randrange(90), "12" * rng.randrange(60), "'re", "東" * rng.randrange(30)]) for _ in range(rng.randrange(40)))
        data = np.frombuffer(text.encode(), np.uint8)
        blocks = list(pretokens.word_blocks(data, most))
        whole = pretokens.word_starts(data, np.array([0, len(data)]))
        assert np.concatenate([s for s, _ in blocks] or [whole]).tolist() == whole.tolist()
        assert [e for _, e in blocks[:-1]] == [int(s[0]) for s, _ in blocks[1:]]


def test_every_word_goes_through_windows(library, merges, documents, monkeypatch):
    """A small window: most words take several, and long texts come block by block; nothing else makes ids."""
    monkeypatch.setattr(bpe, "BLOCK", 700)
    encoder = bpe.Encoder(merges)
    texts = [t or "" for _, t in pairs(documents)][:80]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(encoder, texts) == expected
    words = encoder.transducer.windows
    assert words > 3_000
    pieces = sum(1 for i, *_ in encoder.column(pa.array(["word after word, " * 2_000])))
    assert pieces > 20
    one = bpe.Transducer(merges, 8)
    long = np.frombuffer(b"abcdefghij" * 300, np.uint8)
    emitted = list(one.long(long, 0, len(long)))
    assert one.windows == len(emitted) > 100
    assert np.concatenate(emitted).tolist() == library.encode("abcdefghij" * 300, add_special_tokens=False).ids


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(pretokens.B, "span_hash", lambda sums, a, b: (b - a).astype(np.uint64))
    data = np.frombuffer(b" one two one six", np.uint8)
    starts = pretokens.word_starts(data, np.array([0, len(data)]))
    ends = np.r_[starts[1:], len(data)]
    first, which = pretokens.distinct(data, starts, ends)
    assert [data[starts[first[k]] : ends[first[k]]].tobytes() for k in which] == [b" one", b" two", b" one", b" six"]


def test_other_tokenizer_files_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"model": {**spec["model"], "dropout": 0.1}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "tokenizer.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="byte-level"):
            bpe.MergeList(str(path))


def test_a_stream_needs_no_more_than_the_lookahead(library, merges):
    rng = random.Random(2)
    for letters in ("a", "ab", "etaoinshrdlu", "0123456789", "é", "東京"):
        word = "".join(rng.choice(letters) for _ in range(3_000))
        if letters.isdigit():
            word = word[:3_000]
        stream, ids = bpe.Transducer(merges, 64), []
        data = word.encode()
        at = 0
        while at < len(data):
            step = rng.randrange(1, 200)
            ids += stream.feed(data[at : at + step])
            assert len(stream.held) <= 64 + merges.lookahead + step
            at += step
        ids += stream.finish()
        assert ids == library.encode(word, add_special_tokens=False).ids


def test_decoder_is_incremental(merges, library):
    text = "🙂é東" * 50 + "�"
    ids = library.encode(text, add_special_tokens=False).ids
    stream = bpe.Decoder(merges)
    assert "".join(stream.feed([i]) for i in ids) + stream.finish() == text
    broken = ids[:1]
    stream = bpe.Decoder(merges)
    assert stream.feed(broken) + stream.finish() == library.decode(broken, skip_special_tokens=False)


def test_token_files(documents, library):
    manifest = token_files.write_shards(documents, PATH)
    found = by_id(token_files.read_documents(manifest))
    start = 0
    for d, t in sorted(pairs(documents)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        r = found.pop(d)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert not found


def test_token_files_of_awkward_rows(awkward, no_documents, library):
    manifest = token_files.write_shards(awkward, PATH)
    found = token_files.read_documents(manifest)
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in pairs(awkward)]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found.collect()) == Counter((d, len(x), zlib.crc32(packed(x))) for d, x in ids)
    starts = sorted((r.start, r.n_tokens) for r in found.collect())
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert token_files.read_documents(token_files.write_shards(no_documents, PATH)).count() == 0


def test_shards_are_bounded_by_bytes_and_split_hot_keys(spark, library):
    """Many small ranges and shards; a third of all rows has no key, a third repeats one."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * (i % 5)) for i in range(300)] + [(1, "long " * 3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_shards(docs, PATH, shard_bytes_=200, range_bytes=400)
    sizes = manifest.collect()
    assert len(sizes) > 20 and sum(r.n_docs for r in sizes) == 301
    assert all(r.n_tokens * 2 <= 200 + 60 or r.min_key == 1 for r in sizes)
    assert sum(r.min_key is None for r in sizes) > 2 and sum(r.min_key == r.max_key == 7 for r in sizes) > 2
    found = token_files.read_documents(manifest).collect()
    ids = [(d, [*library.encode(t, add_special_tokens=False).ids, 2]) for d, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((d, len(x), zlib.crc32(packed(x))) for d, x in ids)
    found.sort(key=lambda r: r.start)
    assert found[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:], strict=False))
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    plan = token_files.read_documents(manifest)._jdf.queryExecution().toString() + token_files.lookup(manifest, docs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_come_through_the_index(documents, monkeypatch):
    """An index that leads nowhere, or to other documents, is noticed."""
    manifest = token_files.write_shards(documents, PATH)
    path = manifest.first().path
    shard = token_files.Shard(path)
    assert (shard.find(shard.docs["key"].astype(np.int64)) == np.arange(shard.n_docs)).all()
    raw = open(path.removeprefix("file:"), "rb").read()
    at = len(raw) - shard.n_ids * shard.id_bytes - 24 * shard.n_docs - 8 * len(shard.slots)
    broken = bytearray(raw)
    for i in range(len(shard.slots)):
        broken[at + 8 * i] ^= 1  # the fingerprints
    folder = path.rpartition("/")[0].removeprefix("file:").replace("//", "/")
    with open(f"{folder}/broken.tok", "wb") as out:
        out.write(broken)
    row = manifest.limit(1).withColumn("path", F.lit(f"file://{folder}/broken.tok"))
    with pytest.raises(Exception, match="misses keys"):
        token_files.read_documents(row).collect()


def test_lookup(spark, documents, awkward, library):
    manifest = token_files.write_shards(documents, PATH, shard_bytes_=5_000, range_bytes=50_000)
    texts = dict(pairs(documents))
    asked = [*list(texts)[::7], -5, 10**12, None, 3, 3]
    found = {r.doc_id: r.ids for r in token_files.lookup(manifest, spark.createDataFrame([(k,) for k in asked], "doc_id long")).collect()}
    assert found == {k: [*library.encode(texts[k] or "", add_special_tokens=False).ids, 2] for k in asked if k in texts}
    of_awkward = token_files.write_shards(awkward, PATH)
    assert token_files.lookup(of_awkward, awkward).count() == awkward.where("doc_id is not null").select("doc_id").distinct().count()


@pytest.mark.parametrize("n", [0, 1, 2, 100, 10_000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**9, n, replace=False).astype(np.int64) - 10**8
    index = token_files.Mph(token_files.build_mph(keys))
    assert sorted(index.slots(keys).tolist()) == list(range(n))


def test_empty_table(no_documents):
    assert bpe.round_trip(no_documents, PATH).count() == 0
