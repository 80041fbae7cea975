"""The pipeline against its stages applied by hand, and the queries with SQL twins."""

import pytest

import corpus_pipeline
import oracle_check
from siltmark.llm import bpe, decontamination, exact_dedup, near_dedup, quality, queries

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [r for r in docs.collect() if model.score(r.text) >= 0.5]
    good = spark.createDataFrame(kept, docs.schema)
    good.write.parquet(str(tmp_path / "good"))
    good = spark.read.parquet(str(tmp_path / "good"))
    ids = {r.doc_id for r in exact_dedup.mark_copies(good).filter("kept").collect()}
    good = good.filter(good.doc_id.isin(*ids))
    good.write.parquet(str(tmp_path / "one"))
    good = spark.read.parquet(str(tmp_path / "one"))
    ids = {r.doc_id for r in near_dedup.near_duplicates(good).filter("kept").collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in good.collect() if r.doc_id in ids]
    rows = [r for r, x in zip(rows, decontamination.brute_force([r.text for r in rows], bench), strict=True) if not x[-1]]
    t = bpe.transducer(bpe.default_path())
    want = sorted((r.doc_id, *x) for r, x in zip(rows, t.digests([r.text for r in rows]), strict=True))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want
    assert 0 < len(want) < docs.count()


def test_stages_keep_columns(spark, docs):
    d = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        if stage in (corpus_pipeline.good_quality, corpus_pipeline.without_near_copies):
            continue  # test_texts and test_pipeline_stages have these
        d = stage(spark, d, SF)
        assert d.columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    ok, msg = oracle_check.compare(spark, oracle_check.duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, msg
