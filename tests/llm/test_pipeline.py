"""The pipeline's rows against a plain run over the same documents."""

import re

import corpus_pipeline
from newsweft.llm import mixing, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if score[r.doc_id] < toxicity.THRESHOLD}
    best = {}
    for i in sorted(texts):
        key = re.sub(r"[\x20\x09-\x0D]", "", texts[i])
        if key not in best or len(texts[i]) > len(texts[best[key]]):
            best[key] = i
    texts = {i: texts[i] for i in best.values()}
    near = brute.near_components(texts.items())
    texts = {i: t for i, t in texts.items() if near[i][1] == i}
    left = docs.where(docs.doc_id.isin(list(texts)))
    mixed = {r.doc_id for r in mixing.keep_mixed(left).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == mixed and 0 < len(mixed) < len(texts)
    assert len({(r.doc_id, r.piece) for r in got}) == len(got)


def test_all_but_the_last_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.packing_stage(spark, docs, SF).count() == 0
