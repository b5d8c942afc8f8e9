from __future__ import annotations

import corpus_pipeline
from folioscan.llm import jaccard, pii, queries


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    schema, names = docs.schema, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        names.append(name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == schema.names and docs.count() <= before
        if name == "near_duplicates":
            assert jaccard.classes(docs, k=5, percent=80).where("id <> component").count() == 0
        if name == "pii":
            assert not any(pii.find(r.text) for r in docs.select("text").collect() if "[" not in (r.text or ""))
    assert docs.count() > 0


def test_queries_are_registered():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and set(queries.oracle_sql()) <= set(names)
