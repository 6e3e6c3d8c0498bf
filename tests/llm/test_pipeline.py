"""The pipeline's stages, each on its predecessor's rows, against what they should keep."""

import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rasterloom.llm import toxicity
from rasterloom.llm.queries import BYTE_BPE

from .conftest import SF, pairs
from .test_decontamination import contaminated
from .test_duplicates import linked, without_spans


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "bpe"]


def test_stages(spark, documents):
    stage = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.toxicity_stage(spark, documents, SF).persist()
    assert kept.schema == documents.schema
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scored(documents, model).collect() if r.rejected}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect()} - bad

    before = pairs(kept)
    kept = stage["near_duplicates"](spark, kept, SF).persist()
    assert kept.columns == documents.columns
    component = linked(before, 5)
    assert sorted(pairs(kept)) == sorted((d, t) for d, t in before if component[d] == d)

    before = pairs(kept)
    kept = stage["substring_dedup"](spark, kept, SF).persist()
    assert kept.columns == documents.columns
    plain = without_spans(before)
    assert sorted(pairs(kept)) == sorted((d, t if not plain[d, t][1] else plain[d, t][2]) for d, t in before if not plain[d, t][1] or plain[d, t][1] < plain[d, t][0])
    assert kept.where(F.col("n_chars") != F.length("text")).count() == 0

    before = pairs(kept)
    kept = stage["decontamination"](spark, kept, SF).persist()
    assert kept.columns == documents.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for (d, *_, bad), _ in contaminated(before, items).items() if bad}
    assert sorted(pairs(kept)) == sorted((d, t) for d, t in before if d not in hit)

    library = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    found = {r.doc_id: r.n_tokens for r in stage["bpe"](spark, kept, SF).collect()}
    assert found == {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in pairs(kept)}


def test_run_takes_awkward_documents(spark, awkward, tmp_path):
    awkward.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "WORD"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in found]
    assert set(ids) >= {None, 0, 1, 2, 4, 5, 6, 7, 8, 9} and 3 not in ids
    assert all(re.fullmatch("[0-9a-f]{64}", r.ids_sha256) for r in found)


def test_decontamination_tells_rows_apart(spark, tmp_path):
    """Rows without an id are judged by their text, as are rows that share an id; extra columns stay."""
    phrase = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"leaks {phrase} here", "a"), (None, "clean without an id", "b"), (7, f"{phrase} leaks", "c"), (7, "clean and shares an id", "d"), (8, None, "e"), (9, "", "f"), (10, "twice", "g"), (10, "twice", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row key` string").withColumns({n: F.lit("z") for n in ("segment", "contaminated", "term", "hit")})
    kept = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r["row key"] for r in kept.collect()) == ["b", "d", "e", "f", "g", "g"]


def test_stages_of_no_documents(spark, documents, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, SF).collect() == [], name


def test_entry_points_have_the_pipeline(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and sum(bool(re.match(r"op\d+_", n)) for n in found) == 13
    assert set(__spark_entry__.oracle_sql()) <= set(found)
