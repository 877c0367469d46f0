import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_pipeline(spark):
    import corpus_pipeline
    from frametide.llm import decontaminate, minhash, quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, at = docs.columns, docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, DATA).cache()
        assert at.columns == columns, name
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    assert kept[0] > kept[1] >= kept[2] and kept[3] <= kept[2]
    # each stage against the operator it stands for, on its own input
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert kept[0] == {r.doc_id for r in quality.score(docs, model).where("score >= 0.7").collect()}
    left = docs.where(docs.doc_id.isin(list(kept[0])))
    assert kept[1] == {r.doc_id for r in minhash.classes(left).where("kept").collect()}
    left = docs.where(docs.doc_id.isin(list(kept[1])))
    hits = {r.doc_id for r in decontaminate.find(left, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert kept[2] == kept[1] - hits
    last = corpus_pipeline.run(spark, DATA)
    assert last.columns[: len(columns)] == columns and {r.doc_id for r in last.select("doc_id").collect()} == kept[3]


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_stages_stand_odd_rows(spark, case):
    import corpus_pipeline

    rows = [] if case == "empty" else [(1, None, None, None, None), (None, "some text", "en", None, 3), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "w " * 50_000, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as size", "2 as shard_of", "3 as h1", "4 as taken", "5 as _score", "6 as _raw")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == len(rows)
