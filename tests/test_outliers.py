import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from frametide.functions import kernels
from frametide.operators import outliers, tracks


def frame(spark, groups):
    rows = [(k, i, *map(float, x)) for k, points in groups.items() for i, x in enumerate(points)]
    width = len(rows[0]) - 2
    return spark.createDataFrame(rows, "k string, id long, " + ", ".join(f"x{j} double" for j in range(width))), [f"x{j}" for j in range(width)]


def test_local_outliers_as_in_one_piece(spark):
    rng = np.random.default_rng(2)
    groups = {"a": np.concatenate([rng.normal(size=(150, 2)), [[9.0, 9.0]]]), "b": rng.normal(size=(12, 2)), "one": [[1.0, 1.0]], "two": [[0.0, 0.0], [1.0, 1.0]], "same": np.ones((40, 2)), None: rng.normal(size=(35, 2))}
    df, names = frame(spark, groups)
    df = df.unionByName(spark.createDataFrame([("a", 900, None, 1.0), ("a", 901, float("nan"), 1.0)], df.schema)).withColumn("frame", F.lit("clash"))
    got = {}
    for r in outliers.local_outliers(df, ["k"], names, "id").collect():
        got.setdefault(r.k, {})[r.id] = r
    for k, points in groups.items():
        factor, keep = plain.local_outlier_factor(np.array(points))
        assert [got[k][i].anomaly for i in range(len(points))] == pytest.approx(factor.tolist())
        assert [got[k][i].inlier for i in range(len(points))] == (factor <= np.quantile(factor, 0.9) * (1 + 1e-9)).tolist()
    assert set(got["a"]) == set(range(151)) and not got["a"][150].inlier


def test_local_outliers_short_and_long_alike(spark):
    """Recordings in one array have the factors that joins give, with shared and missing ids too; their neighbours are never rows."""
    rng = np.random.default_rng(9)
    rows = [(k, i, float(a), float(b)) for k, n in [("a", 130), ("b", 20), (None, 33), ("two", 2)] for i, (a, b) in enumerate(rng.normal(size=(n, 2)).round(1))]
    rows += [("a", None, 0.0, 0.0), ("b", 3, *next(r[2:] for r in rows if r[:2] == ("b", 3))), ("pair", 5, 1.0, 1.0), ("pair", 5, 1.0, 1.0), ("none", None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double").repartition(3)
    order = lambda r: (str(r.k), -1 if r.id is None else r.id, r.anomaly)
    one, cut, joined = (sorted(outliers.local_outliers(df, ["k"], ["x", "y"], "id", neighbours=7, whole=whole).collect(), key=order) for whole in (4096, 50, 0))
    assert len(one) == len(rows)
    for other in (cut, joined):
        assert [(r.k, r.id, r.inlier) for r in one] == [(r.k, r.id, r.inlier) for r in other]
        assert [r.anomaly for r in one] == pytest.approx([r.anomaly for r in other])
    plan = outliers.local_outliers(df, ["k"], ["x", "y"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_components_of_each_recording(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) + 50, "b": rng.normal(size=(9, 4)), None: rng.normal(size=(5, 4))}
    df, names = frame(spark, groups)
    out, made = outliers.principal(df, ["k"], names, 2)
    assert made == ["component1", "component2"] and out.count() == 74
    for k, x in groups.items():
        rows = sorted(out.where(F.col("k").eqNullSafe(k)).collect(), key=lambda r: r.id)
        want = plain.principal(np.array(x), 2)
        assert np.allclose(np.abs([[r.component1, r.component2] for r in rows]), np.abs(want), atol=1e-8)


def test_forest_in_blocks(spark):
    rng = np.random.default_rng(1)
    groups = {"a": np.concatenate([rng.normal(size=(3000, 3)), np.full((3, 3), 12.0)]), "b": rng.normal(size=(20, 3)), "one": [[1.0, 2.0, 3.0]], "same": np.ones((5, 3))}
    df, names = frame(spark, groups)
    whole = {(r.k, r.id): r for r in outliers.isolated(df, ["k"], names, "id", seed=3).collect()}
    assert len(whole) == 3003 + 20 + 1 + 5
    for i in (3000, 3001, 3002):
        assert not whole["a", i].inlier
    assert sum(r.inlier for (k, _), r in whole.items() if k == "a") > 2000 and whole["one", 0].anomaly == 0.0 and all(whole["same", i].inlier for i in range(5))
    # the trees depend on the sample alone: neither blocks nor how rows are dealt change a score
    cut = {(r.k, r.id): r.anomaly for r in outliers.isolated(df.repartition(5), ["k"], names, "id", seed=3, block=400).collect()}
    assert all(cut[at] == pytest.approx(r.anomaly) for at, r in whole.items())
    few = {(r.k, r.id): r for r in outliers.isolated(df, ["k"], names, "id", seed=3, pool=500, components=2).collect()}
    assert len(few) == len(whole) and not any(few["a", i].inlier for i in (3000, 3001, 3002))


def test_forest_beyond_its_pool(spark):
    """Rows that no tree may draw change neither the trees nor each other's scores; short recordings take no part in pools."""
    rng = np.random.default_rng(4)
    df, names = frame(spark, {"a": rng.normal(size=(2500, 2)), "b": rng.normal(size=(90, 2)), None: rng.normal(size=(7, 2))})
    one, cut = ({(r.k, r.id): r.anomaly for r in outliers.isolated(df, ["k"], names, "id", seed=3, pool=300, block=block).collect()} for block in (5000, 310))
    assert set(one) == set(cut) and len(one) == 2597 and all(cut[at] == pytest.approx(v, abs=1e-12) for at, v in one.items())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        few = {(r.k, r.id): r.anomaly for r in outliers.isolated(df, ["k"], names, "id", seed=3, pool=300, block=5000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert few == one


@pytest.mark.parametrize(("fraction", "degree"), [(0.5, 1), (0.2, 2)])
def test_smoothing_in_blocks(spark, fraction, degree):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in (("long", 900), ("longer", 1300), (None, 700), ("short", 40)):
        x = np.round(np.sort(rng.uniform(0, 50, n)), 1)  # with ties
        y = np.sin(x / 5) + rng.normal(0, 0.1, n)
        y[:: 97] += 5
        rows += [(k, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [("exact", float(i), 2.0 * i + 1) for i in range(400)] + [("long", None, 1.0), ("long", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    one = {tuple(r)[:3]: r.smooth for r in tracks.smoothed(df, ["k"], "x", "y", fraction, degree).collect()}
    cut = {tuple(r)[:3]: r.smooth for r in tracks.smoothed(df, ["k"], "x", "y", fraction, degree, whole=150).collect()}
    assert set(one) == set(cut) and len(one) == len({r for r in rows if r[1] is not None and r[2] == r[2]})
    assert all(cut[at] == pytest.approx(v, abs=1e-9) for at, v in one.items())
    assert all(cut["exact", float(i), 2.0 * i + 1] == pytest.approx(2.0 * i + 1) for i in range(400))


def test_support_vectors_side_by_side(spark, monkeypatch):
    """Many recordings in one call have the fits of each by itself; before, each was a call and every step made its kernel anew."""
    rng = np.random.default_rng(7)
    x = {k: np.sort(rng.uniform(0, 30, n)) for k, n in [("a", 60), ("b", 55), ("c", 9), ("one", 1), ("long", 150), (None, 31), ("flat", 40)]}
    x["flat"][:] = 3.0
    y = {k: np.sin(v / 4) * 30 + rng.normal(size=len(v)) for k, v in x.items()}
    y["b"] = np.zeros(55)
    rows = [(k, float(a), float(b)) for k in x for a, b in zip(x[k], y[k], strict=True)] + [("a", None, 1.0), ("a", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    got = {k: [] for k in x}
    for r in tracks.support_fit(df, ["k"], "x", "y").collect():
        got[r.k].append((r.x, r.y, r.smooth))
    for k in x:
        if k != "flat":
            assert [r[2] for r in sorted(got[k])] == pytest.approx(kernels.support_vector(x[k], y[k]).tolist(), abs=1e-12)
    assert len(got["flat"]) == 40
    bounds = np.cumsum([0, *map(len, x.values()), 0])
    whole = [np.concatenate(list(d.values())) for d in (x, y)]
    monkeypatch.setattr(kernels, "_BLOCK", 8000)  # the longest by itself, the others in several turns
    assert np.allclose(kernels.support_vectors(*whole, bounds), np.concatenate([kernels.support_vector(x[k], y[k]) for k in x]), atol=1e-12)


def test_numbered(spark):
    rng = np.random.default_rng(6)
    rows = [(["a", "b", None][i % 3], int(v)) for i, v in enumerate(rng.integers(0, 50, 3000))]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    got = tracks.numbered(df, ["k"], ["v"], "n").collect()
    for k in ("a", "b", None):
        own = sorted((r.n, r.v) for r in got if r.k == k)
        assert [n for n, _ in own] == list(range(1000)) and [v for _, v in own] == sorted(v for kk, v in rows if kk == k)
