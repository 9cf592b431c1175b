"""The pipeline's stages on awkward rows, and the whole on a small table."""

import corpus_pipeline
from tests.llm.fixtures import awkward_documents, empty_documents
from tests.llm.test_jaccard import brute
from veinworks.llm.common import materialise


def test_whole(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    start, spoken, clean, distinct, packed = kept
    assert len(start - spoken) < 5
    assert len(toxic & clean) < 0.25 * len(toxic & spoken) and len(spoken - clean - toxic) < 0.12 * len(spoken)
    want = brute([(d, texts[d]) for d in sorted(clean)], 5, 80, 100)
    assert distinct == {d for d, _, c in want if d == c}
    assert packed == distinct
    assert sum(r.length for r in docs.collect()) > 0


def test_awkward(spark, sf_dir):
    for df in (awkward_documents(spark, long_words=2000), empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf_dir)
            assert out.count() <= max(df.count(), 1) + 20
