import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.operators import joins, neighbours

VECTORS = "frame string, id long, v array<double>"


def plain(queries, points, k, apart=False):
    out = {}
    for frame, a, v in queries:
        own = [(float(((np.array(v) - np.array(w)) ** 2).sum()), b) for f, b, w in points if f == frame and len(w) == len(v) and not (apart and a == b)]
        for nth, (d, b) in enumerate(sorted(own)[:k]):
            out[frame, a, nth + 1] = (b, pytest.approx(d))
    return out


def points(n, dim, seed=0, frames=("f", "g")):
    rng = np.random.default_rng(seed)
    return [(frames[k % len(frames)], k, (rng.normal(size=dim) + 5 * (k % 7)).round(3).tolist()) for k in range(n)]


@pytest.mark.parametrize("dim, k, cell", [(1, 1, 20), (2, 2, 16), (3, 3, 30), (16, 2, 50), (2, 2, 10_000)])
def test_exact(spark, dim, k, cell):
    rows = points(700, dim, seed=dim)
    asked = [(f, i + 5000, [x + 0.01 for x in v]) for f, i, v in rows[::9]]
    got = neighbours.search(spark.createDataFrame(asked, VECTORS), spark.createDataFrame(rows, VECTORS), "frame", k, cell=cell).collect()
    assert {(r.frame, r.a, r.nth): (r.b, r.d) for r in got} == plain(asked, rows, k)


def test_copies_ties_and_odd_rows(spark):
    rows = [("f", k, [1.0, 1.0]) for k in range(300)]  # alike: no cut parts them, so they are dealt into parts
    rows += [("f", 300 + k, [float(k % 5), float(k // 5)]) for k in range(50)]
    rows += [("one", 1, [0.0]), ("mixed", 1, [0.0, 1.0]), ("mixed", 2, [0.0])]
    odd = [("f", 900, None), ("f", 901, []), ("f", 902, [float("nan"), 0.0]), ("f", 903, [None, 1.0]), ("f", None, [1.0, 1.0]), (None, 904, [1.0, 1.0]), ("f", 905, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumn("cell", F.lit("clash"))
    got = neighbours.search(df, df, "frame", 2, apart=True, cell=20).collect()
    assert {(r.frame, r.a, r.nth): (r.b, r.d) for r in got} == plain(rows, rows, 2, apart=True)
    assert neighbours.search(df.limit(0), df, "frame").count() == 0 and neighbours.search(df, df.limit(0), "frame").count() == 0


def test_boxes_spare_comparisons(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    df = spark.createDataFrame([("f", k, v.tolist()) for k, v in enumerate(rng.uniform(size=(n, 2)))], VECTORS)
    found = neighbours.index(df, "frame", cell=64)
    sizes = found.cells.groupBy("cell").count().agg(F.max("count")).first()[0]
    assert sizes <= 64 and len(found.cuts) <= 6
    got = neighbours.search(df.where("id % 100 = 0"), found, "frame", 2, apart=True, counted=True)
    assert got.agg(F.avg("compared")).first()[0] < n / 50


def test_few_levels(spark):
    """Each level reads and writes all points, so there must be few of them; halving two dimensions a level takes five here at least."""
    rng = np.random.default_rng(11)
    skewed = np.stack([rng.gamma(1, 5, 20_000).round(2), rng.integers(0, 40, 20_000).astype(float)], 1)
    df = spark.createDataFrame([("f", k, v.tolist()) for k, v in enumerate(skewed)], VECTORS)
    found = neighbours.index(df, "frame", cell=64)
    sizes = found.cells.groupBy("cell", "part").count().agg(F.max("count"), F.avg("count")).first()
    assert len(found.cuts) <= 3 and sizes[0] <= 64 and sizes[1] > 16
    asked = [(("f", k, skewed[k].tolist())) for k in range(0, 20_000, 1000)]
    got = neighbours.search(spark.createDataFrame(asked, VECTORS), found, "frame", 3, apart=True).collect()
    assert {(r.frame, r.a, r.nth): (r.b, r.d) for r in got} == plain(asked, [("f", k, v) for k, v in enumerate(skewed)], 3, apart=True)


def test_matches(spark):
    rows = points(240, 4, seed=8)
    left, right = rows[:120], rows[120:]
    a, b = spark.createDataFrame(left, VECTORS), spark.createDataFrame(right, VECTORS)
    forth, back = plain(left, right, 2), plain(right, left, 1)
    mutual = {(r.frame, r.a, r.b) for r in joins.mutual_nearest(a, b, "frame").collect()}
    assert mutual == {(f, i, j) for (f, i, n), (j, _) in forth.items() if n == 1 and back[f, j, 1][0] == i}
    ratio = {(r.frame, r.a, r.b) for r in joins.ratio_matches(a, b, "frame", 0.8).collect()}
    near = lambda f, i, n: forth[f, i, n][1].expected**0.5
    assert ratio == {(f, i, j) for (f, i, n), (j, _) in forth.items() if n == 1 and near(f, i, 1) < 0.8 * near(f, i, 2)}


def test_no_list_of_pairs(spark):
    df = spark.createDataFrame(points(50, 2), VECTORS)
    plan = neighbours.search(df, df, "frame", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_list" not in plan and "CartesianProduct" not in plan
