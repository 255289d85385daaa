"""The pipeline's stages: order, columns, and decisions that take effect."""

import corpus_pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) < set(out.columns) and {"n_tokens", "ids"} <= set(out.columns)
    assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() > 0
