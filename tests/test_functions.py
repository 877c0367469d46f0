import math

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from frametide.functions import kernels, scalars, stats
from frametide.operators import statistics


@pytest.mark.parametrize(("u", "n", "m", "p"), [(133, 29, 5, 0.0007079811396699442), (140, 29, 9, 0.3786547838175811), (29, 9, 5, 0.21878121878121878)])
def test_recorded_rank_tests(u, n, m, p):
    assert stats.mann_whitney_p(u, n, m) == pytest.approx(p, rel=1e-9)


def test_recorded_regression():
    assert stats.slope_p(0.09163411309782292, 38, "greater") == pytest.approx(0.2921363241555903, rel=1e-9)
    assert stats.slope_p(0.09163411309782292, 38) == pytest.approx(0.5842726483111806, rel=1e-9)


def test_student_tail_against_known_values():
    assert stats.student_tail(0.0, 7) == pytest.approx(0.5)
    assert stats.student_tail(1.0, 1) == pytest.approx(0.25)
    assert stats.student_tail(-1.0, 1) == pytest.approx(0.75)


def test_loess_keeps_lines_and_ignores_a_spike():
    x = np.arange(40.0)
    assert np.allclose(kernels.loess(x, 3 * x - 2), 3 * x - 2)
    assert np.allclose(kernels.loess(x, x * x, degree=2), x * x)
    y = 2 * x + np.sin(7 * x) / 10  # without any noise most residuals are 0 and there is no scale to judge a spike by
    y[20] += 500
    assert abs(kernels.loess(x, y, robust=4)[20] - 40) < 5
    assert len(kernels.loess(np.array([1.0]), np.array([2.0]))) == 1


def test_forest_finds_planted_outliers_and_repeats():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 3)), np.full((3, 3), 12.0)])
    score, keep = kernels.isolation_forest(x, seed=3)
    assert set(np.argsort(-score)[:3]) == {300, 301, 302} and not keep[300:].any()
    assert (score == kernels.isolation_forest(x, seed=3)[0]).all()
    assert kernels.isolation_forest(np.ones((5, 2)))[1].all()


def test_local_outliers():
    x = np.concatenate([np.random.default_rng(2).normal(size=(200, 2)), [[9.0, 9.0]]])
    factor, keep = plain.local_outlier_factor(x)
    assert factor.argmax() == 200 and not keep[200]


def test_principal_components():
    x = np.random.default_rng(0).normal(size=(50, 1)) @ np.array([[1.0, 2.0, 3.0]])
    p = plain.principal(x, 2)
    assert np.allclose(p[:, 1], 0) and np.isclose(p[:, 0].var(), x.var(0).sum())


def test_support_vector_follows_a_smooth_curve():
    x = np.linspace(0, 6, 60)
    fit = kernels.support_vector(x, np.sin(x), c=10.0)
    assert np.abs(fit - np.sin(x)).max() < 0.2


def test_names_and_dates(spark):
    rows = [("data2/moth22_2022-01-26.cine",), ("data2/Moth7_2022_02_02a.cine",), ("data2/none.cine",), (None,)]
    f = F.col("f")
    got = spark.createDataFrame(rows, "f string").select(scalars.animal_name(f), scalars.animal_id(f), scalars.recording_date(f).cast("string"), scalars.recording_date_strict(f), scalars.stem(f)).collect()
    assert [tuple(r) for r in got] == [("moth22", "22", "2022-01-26", "2022-01-26", "moth22_2022-01-26"), (None, "7", "2022-02-02", "2022-02-02", "Moth7_2022_02_02a"), (None, None, None, None, "none"), (None,) * 5]


def test_points_and_rounding(spark):
    got = spark.createDataFrame([("1,2;3.5,4",), ("",), (None,), ("1,x",)], "p string").select(scalars.points(F.col("p")).alias("q")).collect()
    assert [None if r.q is None else [tuple(p) for p in r.q] for r in got] == [[(1.0, 2.0), (3.5, 4.0)], [], None, [(1.0, None)]]
    assert spark.range(1).select(scalars.percent(F.lit(0.0025)), scalars.percent(F.lit(0.12345))).first()[:] == (0.2, 12.3)


@pytest.mark.parametrize(("values", "median"), [([7], 255), ([1, 9], 9), ([1, 5, 9], 9), ([1, 2, 3, 4], 3), ([1, 2, 3, 4, 5], 4)])
def test_biased_median(spark, values, median):
    df = spark.createDataFrame([(1, v) for v in values], "k int, v int")
    assert statistics.biased_median(df, ["k"], "v").first()["median"] == median


def test_mann_whitney_from_rows(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 6, 7, 8)] + [("b", float(v)) for v in (1, 2, 3)], "g string, v double")
    out = statistics.mann_whitney(df, "g", "v", "a", "b")
    assert out["u"] == 12 and out["p"] == pytest.approx(1 / math.comb(7, 3))
    assert statistics.mann_whitney(df, "g", "v", "a", "c") == {"u": None, "p": None}


def test_loess_against_one_fit_a_point():
    rng = np.random.default_rng(2)
    for n, degree in ((12, 0), (40, 1), (41, 2)):
        x, y = rng.permutation(n).astype(float), rng.normal(size=n)
        x[:3] = x[0]  # ties
        k = int(np.ceil(0.5 * n))
        want = np.empty(n)
        for i in range(n):
            far = np.abs(x - x[i])
            w = np.clip(1 - (far / np.sort(far)[k - 1]) ** 3, 0, 1) ** 1.5
            want[i] = np.linalg.lstsq(np.vander(x - x[i], degree + 1) * w[:, None], y * w, rcond=None)[0][-1]
        assert np.allclose(kernels.loess(x, y, 0.5, degree, robust=0), want)
