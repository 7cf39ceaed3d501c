"""The pipeline's stages, each on its own input."""

import corpus_pipeline
from turnlens.llm import gam, jaccard

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).checkpoint()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < seen
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16}' OR n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and last.where("NOT round_trip OR n_tokens = 0").count() == 0


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = gam.accept(docs, gam.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).checkpoint()
    found = jaccard.digest(kept)
    first = {r["doc_id"] for r in found.where("doc_id = component_id").collect()}
    assert {r["doc_id"] for r in out.collect()} <= first
    assert len(first) - out.count() < 20
