"""The registered queries: SQL where there is some, and the pipeline against its stages done plainly."""

import pytest

import corpus_pipeline
from meterlake.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, same, name):
    same(queries.QUERIES[name](spark, D), queries.ORACLE_SQL[name])


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "simhash", "mixing", "bpe"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, D).collect(), docs.schema)
        assert docs.columns == columns
        seen[name] = docs.collect()
    texts = [r.text for r in seen["quality"]]
    assert sorted(set(texts)) == sorted(r.text for r in seen["exact_dedup"])
    best = {}
    for r in seen["quality"]:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in seen["exact_dedup"])
    assert {r.doc_id for r in seen["simhash"]} <= {r.doc_id for r in seen["exact_dedup"]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in last.collect()) == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, D).collect())
