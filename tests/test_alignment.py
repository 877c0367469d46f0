import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.operators import alignment, blobs, statistics

MATCH = "pair string, id long, x double, y double, u double, v double"


def planted(pair, n, wrong, angle, tx, ty, seed):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = draw.uniform(0, 200), draw.uniform(0, 200)
        u, v = math.cos(angle) * x - math.sin(angle) * y + tx, math.sin(angle) * x + math.cos(angle) * y + ty
        if k % n < wrong:
            u, v = draw.uniform(0, 200), draw.uniform(0, 200)
        rows.append((pair, k, x, y, u + draw.gauss(0, 0.05), v + draw.gauss(0, 0.05)))
    draw.shuffle(rows)
    return rows


def test_rotations_among_wrong_matches(spark):
    truth = {f"p{k}": (0.1 * k - 0.4, 3.0 * k, 10.0 - k) for k in range(8)}
    rows = [r for k, (p, t) in enumerate(truth.items()) for r in planted(p, 60 + k, 30, *t, seed=k)]
    rows += planted("few", 3, 0, 0.1, 0, 0, 9) + [("still", k, 1.0, 2.0, 1.0, 2.0) for k in range(10)] + [(None, 1, 0.0, 0.0, 0.0, 0.0), ("p0", 99, None, 0.0, 0.0, 0.0)]
    got = {r["pair"]: r for r in alignment.rigid_motions(spark.createDataFrame(rows, MATCH).withColumn("n", F.lit("clash")), "pair", "id").collect()}
    assert set(got) == {*truth, "few", "still"}
    for k, (p, (angle, tx, ty)) in enumerate(truth.items()):
        r = got[p]
        assert r.n == 60 + k and 30 + k <= r.inliers <= 33 + k
        assert (r.angle, r.tx, r.ty) == (pytest.approx(angle, abs=1e-3), pytest.approx(tx, abs=0.1), pytest.approx(ty, abs=0.1))
    for p in ("few", "still"):
        assert (got[p].inliers, got[p].angle, got[p].tx) == (0, None, None)
    again = {r["pair"]: r for r in alignment.rigid_motions(spark.createDataFrame(rows, MATCH).repartition(7), "pair", "id").collect()}
    assert all(again[p].inliers == got[p].inliers for p in got)


def test_moved(spark):
    motions = spark.createDataFrame([("a", math.pi / 2, 1.0, 2.0), ("b", None, None, None)], "pair string, angle double, tx double, ty double")
    points = spark.createDataFrame([("a", 3.0, 0.0), ("b", 3.0, 1.0), ("c", 5.0, 6.0)], "pair string, x double, y double")
    got = {r["pair"]: (r.x, r.y, r.aligned) for r in alignment.moved(points, motions, "pair", "x", "y").collect()}
    assert got == {"a": (pytest.approx(1.0), pytest.approx(5.0), True), "b": (3.0, 1.0, False), "c": (5.0, 6.0, False)}


def grid(spark, images):
    rows = [(k, r, c, float(v)) for k, image in enumerate(images) for r, line in enumerate(image) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame int, row int, col int, value double")


def test_planted_discs(spark):
    y, x = np.mgrid[:60, :80]
    image = np.zeros((60, 80))
    discs = [(15, 20, 3.0), (40, 55, 6.0), (45, 12, 4.5)]
    for r, c, s in discs:
        image[(y - r) ** 2 + (x - c) ** 2 <= 2 * s * s] = 1
    sigmas = [1.5, 3.0, 4.5, 6.0, 7.5]
    got = sorted((r.row, r.col, r.sigma) for r in blobs.blobs(grid(spark, [image, np.zeros((60, 80))]), ["frame"], sigmas).collect())
    assert len(got) == len(discs)
    for (r, c, s), found in zip(sorted(discs), got, strict=True):
        assert abs(found[0] - r) <= 1 and abs(found[1] - c) <= 1 and abs(found[2] - s) <= 1.5
    every = blobs.blobs(grid(spark, [image]), ["frame"], sigmas, overlap=None).count()
    assert every >= len(discs)


def test_responses_against_plain(spark):
    image = np.random.default_rng(1).normal(size=(5, 7))
    sigma = 1.2
    radius = int(4 * sigma + 0.5)
    g, d = (np.array(w) for w in blobs.weights(sigma, radius))
    p = np.pad(image, radius, mode="symmetric")
    want = np.array([[-(sigma**2) * (p[r : r + 2 * radius + 1, c : c + 2 * radius + 1] * (np.outer(d, g) + np.outer(g, d))).sum() for c in range(7)] for r in range(5)])
    got = blobs.responses(grid(spark, [image]), ["frame"], [sigma, 0.5])
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.where("scale = 0").collect():
        assert r.response == pytest.approx(want[r.row, r.col])


def test_overlap(spark):
    peaks = spark.createDataFrame([(1.0, 0, 0, 2.0, 0, 0), (1.0, 0, 0, 2.0, 0, 9), (2.0, 0, 0, 2.0, 0, 2)], "sigma double, row int, col int, _s double, _r int, _c int")
    shared = [r[0] for r in peaks.select(blobs._shared()).collect()]
    assert shared[0] == 1.0 and shared[1] == pytest.approx(0.0) and 0.4 < shared[2] < 0.6


def test_circle(spark):
    rows = [("a", math.pi / 36 + 2 * math.pi * k, 2.0) for k in (-2, 0, 5)] + [("a", -0.01, 1.0), ("b", None, 1.0), ("a", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, angle double, w double")
    (r,) = statistics.circular_histogram(df, ["k"], "angle", "w").collect()
    assert r.k == "a" and r.bins[0] == 6.0 and r.bins[35] == 1.0 and sum(r.bins) == 7.0
    bins = np.random.default_rng(2).uniform(size=(4, 36))
    want = bins.copy()
    for _ in range(6):
        want = (np.roll(want, 1, 1) + want + np.roll(want, -1, 1)) / 3
    df = spark.createDataFrame([(k, b.tolist()) for k, b in enumerate(bins)], "k int, bins array<double>")
    got = {r.k: r for r in df.select("k", statistics.circular_smooth(F.col("bins")).alias("s"), statistics.circular_peaks(F.col("bins")).alias("p")).collect()}
    for k in range(4):
        assert got[k].s == pytest.approx(want[k].tolist())
        assert got[k].p == [i for i in range(36) if bins[k, i] > bins[k, i - 1] and bins[k, i] > bins[k, (i + 1) % 36]]


def test_bootstrap_covers(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{g}", g * 1000 + k, float(x)) for g in range(40) for k, x in enumerate(rng.normal(10, 2, 80))] + [("one", 1, 5.0), (None, 2, 1.0), (None, 3, 3.0), ("none", 4, None)]
    df = spark.createDataFrame(rows, "k string, id long, x double")
    got = {r.k: r for r in statistics.bootstrap_band(df, ["k"], "x", "id").collect()}
    held = [got[f"g{g}"] for g in range(40)]
    assert sum(r.low <= 10 <= r.high for r in held) >= 33 and all(0.5 < r.high - r.low < 1.3 for r in held)
    assert (got["one"].low, got["one"].mean, got["one"].high) == (5.0, 5.0, 5.0) and got[None].mean == 2.0 and "none" not in got
    again = {r.k: r for r in statistics.bootstrap_band(df.repartition(5), ["k"], "x", "id").collect()}
    assert all(again[k].low == pytest.approx(got[k].low) for k in got)


@pytest.mark.parametrize("overlap", [None, 0.5])
def test_blobs_of_whole_frames(spark, monkeypatch, overlap):
    """Frames as arrays have the blobs that their pixels as rows have, and no row is sorted or shuffled for them."""
    rng = np.random.default_rng(12)
    shapes = {"a": (9, 7), "b": (3, 7), "c": (9, 7), None: (1, 7)}
    images = {k: rng.normal(size=v).round(2) for k, v in shapes.items()}
    images["plain"] = np.zeros((4, 7))
    images["plain"][1, 2:4] = 3.0  # a plateau
    rows = [(k, v.ravel().tolist()) for k, v in images.items()]
    rows[0][1][5] = rows[2][1][-1] = rows[2][1][-2] = None
    pixels = [(k, i // 7, i % 7, x) for k, v in rows for i, x in enumerate(v) if k is not None]
    frames = spark.createDataFrame([("c", rows[2][1][:-2]) if r[0] == "c" else r for r in rows] + [("none", None), ("empty", [])], "k string, v array<double>")
    monkeypatch.setattr(blobs, "PIXELS", 70)
    got = blobs.grid_blobs(frames, ["k"], "v", 7, [1.0, 1.5, 2.0], threshold=0.05, overlap=overlap)
    want = blobs.blobs(spark.createDataFrame(pixels, "k string, row int, col int, value double"), ["k"], [1.0, 1.5, 2.0], threshold=0.05, overlap=overlap)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.where("k is not null").collect())) == sorted(map(tuple, want.collect())) != []
    if overlap is None:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
