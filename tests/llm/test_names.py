"""Names that differ in case only, and rows that share an id."""

import random

from pyspark.sql import functions as F

from frametide.llm import decontaminate, minhash, quality

WORDS = [f"word{k}" for k in range(300)]


def draw(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_score_replaces_a_column_in_any_case(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, draw(rng, 60)) for k in range(40)], "doc_id long, text string").withColumn("Score", F.lit("old")).withColumn("_RAW", F.lit(1))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "_RAW", "score"]
    assert all(0 <= r.score <= 1 for r in out.select("score").collect())


def test_clean_finds_the_text_in_any_case(spark):
    rng = random.Random(2)
    item = draw(rng, 40)
    docs = spark.createDataFrame([(1, draw(rng, 50) + " " + item), (2, draw(rng, 90))], "doc_id long, TEXT string").withColumn("last", F.lit("no text"))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]


def test_dedup_keeps_a_fixed_row_of_an_id(spark):
    rng = random.Random(3)
    b, a = sorted([draw(rng, 30), draw(rng, 30)], reverse=True)
    rows = [(1, b, 5, {"k": 1}), (1, a, 9, {"k": 2}), (1, a, 3, {"k": 3}), (2, draw(rng, 40), 1, {}), (None, a, 1, {}), (None, a, 1, {}), (3, None, 2, {}), (3, "", 1, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, m map<string,int>").withColumn("_NTH", F.lit(1))
    for n in (1, 5):
        kept = {r.doc_id: r for r in minhash.dedup(docs.repartition(n)).where("doc_id is not null").collect()}
        assert set(kept) == {1, 2, 3} and (kept[1].text, kept[1].n, kept[1].m) == (a, 3, {"k": 3}) and kept[3].text is None
    assert minhash.dedup(docs).where("doc_id is null").count() == 2 and minhash.dedup(docs).columns == docs.columns
