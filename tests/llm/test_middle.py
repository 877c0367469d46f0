import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frametide.llm import middle, queries

from .test_layout import DATA

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\x0b\x0c\r]*[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+", "char": r"(?s)."}


def plain_version(id, text, unit="line", rate=100, spm_rate=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if id is None else id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    units = re.findall(PATTERN[unit], text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab\n \t\r<>PSMé\U0001f600\x85 \0"), max_size=40), st.sampled_from(sorted(middle.ENDS)), st.integers(0, 10**6))
def test_any_text(text, unit, id):
    h = hashlib.sha256(f"7:{id}".encode()).hexdigest()
    got = middle.rearrange(text, unit, tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8)), 100, 50)
    assert got == plain_version(id, text, unit)
    assert middle.rebuilt(got[4], got[1]) == text


ODD = [None, "", "\n", "\n\n\n", "no end", "a\nb\n", "holds <S> here\nb", "<P", "x<\n<S\n>P>", "é\n\U0001f600\n", " lead  two\n", "long line " * 30_000, "\n" * 50_000, "a\r\nb\rc"]


@pytest.mark.parametrize("unit, rate, spm_rate", [("line", 100, 50), ("word", 60, 0), ("char", 100, 100)])
def test_rows(spark, unit, rate, spm_rate):
    rows = [(k, t) for k, t in enumerate(ODD * 4)] + [(3, "again\nand\nagain"), (3, "again\nand\nagain"), (None, "x\ny"), (-5, "x\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N", F.lit("clash")).withColumn("output", F.lit(1)).withColumn("row", F.lit(2))
    out = middle.transform(docs, unit=unit, rate=rate, spm_rate=spm_rate)
    got = middle.restore(out).collect()
    assert sorted(map(str, ((r.doc_id, *r[1:6]) for r in got))) == sorted(map(str, ((i, *plain_version(i, t, unit, rate, spm_rate)) for i, t in rows)))
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
    kept = middle.transform(docs, unit=unit, keep=True).select("row.*", "form")
    assert kept.columns == [*docs.columns, "form"] and kept.count() == len(rows)
    assert middle.restore(out.withColumn("Restored", F.lit(1))).columns[-1] == "_restored"
    assert middle.restore(middle.transform(docs.limit(0))).count() == 0


def test_no_shuffle(spark):
    plan = middle.transform(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        middle.transform(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), unit="page")


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op13_middle"]).df()
    got = queries.op13_middle(spark, DATA).toPandas()[list(want.columns)]
    key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    norm = lambda df: df.assign(prefix_chars=df.prefix_chars.astype(float), middle_chars=df.middle_chars.astype(float))
    assert key(norm(got)) == key(norm(want)) and (got.form != "plain").sum() > 100
