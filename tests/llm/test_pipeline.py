"""The pipeline's stages against plain versions."""

import corpus_pipeline
from stratalens.llm import jaccard, packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        if name == "ngram_jaccard_join":
            ids = {r.component_id for r in jaccard.jaccard_join(docs).collect()}
            assert {r.doc_id for r in rows} == ids and len(rows) == len(ids)
        elif name == "secret_scans":
            assert len(rows) == len(before) and all(r.text == before[r.doc_id].text or "[" in r.text for r in rows)
        elif name == "mixing":
            assert all(before[r.doc_id].text == r.text or before[r.doc_id].text.split()[: len(r.text.split())] == r.text.split() for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert got.filter("start = 0").count() == docs.count()
    assert got.columns == packing.pack(docs).columns
