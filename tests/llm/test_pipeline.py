"""The pipeline's stages, one after the other, each against a plain version on its own input."""

import collections

import corpus_pipeline
from strataline.llm import secret_scan, token_counts, toxicity
from strataline.llm.common import written

from .test_text_operators import plain_components


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    calm = written(stages["toxicity"](spark, docs, folder), "test")
    judged = {r["doc_id"] for r in toxicity.op2_toxicity(spark, folder).filter("predicted = 0").collect()}
    assert calm.columns == columns and calm.exceptAll(docs).isEmpty() and {r["doc_id"] for r in calm.collect()} == judged

    single = written(stages["near_duplicates"](spark, calm, folder), "test")
    rows = [(r["doc_id"], r["text"]) for r in calm.collect()]
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == {i for i, n, c in plain_components(rows) if not n or c == i}

    clean = written(stages["secrets"](spark, single, folder), "test")
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    guesser = secret_scan.Guesser(secret_scan.ranked_words(token_counts.tokenizer_path()))
    for r in clean.collect():
        assert r["text"] == secret_scan.redacted(before[r["doc_id"]], secret_scan.scan(before[r["doc_id"]], guesser)) and r["n_chars"] == len(r["text"])
    assert clean.columns == columns

    mix = written(stages["mixing"](spark, clean, folder), "test")
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    times = collections.Counter(r["doc_id"] for r in mix.collect())
    assert mix.columns == columns and max(times.values()) <= 2 and abs(words(mix) / words(clean) - 1.5) < 0.2

    pieces = stages["packing"](spark, mix, folder)
    assert pieces.select("doc_id").distinct().count() == len(times)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0 and corpus_pipeline.ORACLE_SQL is None
