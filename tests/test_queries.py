"""Every query that has SQL gives the SQL's rows; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from frametide import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    if pd.isna(x):
        return ""
    return f"{float(x):.8g}" if not isinstance(x, str | bool) else str(x)


def rows(df):
    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nearest_two_of_every_event(spark):
    """Each event of the table asks, not a share of them, and finds what a comparison with all events of its type finds."""
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type", "value", "user_id").toPandas()
    got = queries.nearest_two(spark, DATA).toPandas()
    assert set(got.a) == set(events.event_id)
    own = events[events.event_type == "click"].sort_values("event_id")
    d = (own.value.to_numpy()[:, None] - own.value.to_numpy()) ** 2 + (own.user_id.to_numpy()[:, None] - own.user_id.to_numpy()) ** 2.0
    want = {a: sorted((x, b) for x, b in zip(row, own.event_id, strict=True) if b != a)[:2] for a, row in zip(own.event_id, d, strict=True)}
    found = {a: [(x, b) for x, b in zip(g.d, g.b, strict=True)] for a, g in got[got.event_type == "click"].sort_values("nth").groupby("a")}
    assert {a: [b for _, b in x] for a, x in found.items()} == {a: [b for _, b in x] for a, x in want.items()}
    assert all(x == pytest.approx(y, abs=1e-6) for a in want for (x, _), (y, _) in zip(found[a], want[a], strict=True))
