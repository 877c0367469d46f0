import numpy as np
import pytest

from frametide import schemas
from frametide.operators import evaluation, selection
from frametide.plans import feeding
from frametide.streaming import live


def test_feeding(spark):
    men, pro = [], []
    for name in ("data2/moth1_2022-01-01.cine", "data2/mothdelta_2022-01-01.cine"):
        for k in range(10):
            men.append((name, k, 100.0 + 2 * k, *[0.0] * 12))
            if k != 4:
                pro += [(name, k, *[0.0] * 4, sure, 1.0, 0.0, 1, 1, low, 5, 1.0, 1.0) for sure, low in ((0.9, 130), (0.9, 130), (0.5, 300), (0.8, 120))]
    number = {"frame_num": "bigint", "minrow": "int", "mincol": "int", "maxrow": "int", "maxcol": "int"}
    frame = lambda rows, names: spark.createDataFrame(rows, "filename string, " + ", ".join(f"{n} {number.get(n, 'double')}" for n in names))
    rows = feeding.track(frame([r[:15] for r in men], schemas.MENISCUS), frame(pro, schemas.PROBOSCIS), smooth=True)
    assert rows.groupBy("filename").count().first()["count"] == 2 * 8  # ties fan out; frame 4 and the last are missing
    units = spark.createDataFrame([("data2/moth1_2022-01-01.cine", None, 30), ("data2/mothdelta_2022-01-01.cine", 11.0, 30)], "filename string, px double, framerate int")
    done = feeding.with_units(rows, units)
    first = done.where("filename like '%moth1%' and frame_num = 0").first()
    assert first.submergence == pytest.approx(30 * 0.5) and first.rate == pytest.approx(2 * 0.1 / 11 * 30) and str(first.date) == "2022-01-01" and first.mothname == "moth1"
    postures = spark.createDataFrame([("other.cine", "yes", "no")], schemas.POSTURES)
    out = feeding.per_recording(done, postures).collect()
    assert [r.filename for r in out] == ["data2/moth1_2022-01-01.cine"] and out[0].category is None


def test_overlap_and_samples(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "i int, p int")
    b = spark.createDataFrame([(1, 2), (1, 3), (3, 1)], "i int, p int")
    assert {r.i: r.iou for r in evaluation.overlap(a, b, ["i"], "p").collect()} == {1: pytest.approx(1 / 3), 2: 0.0, 3: 0.0}
    net = spark.createDataFrame([("v", 0, 1, 0.95, 7.0), ("v", 1, 1, 0.95, 9.0), ("v", 2, 1, 0.5, 99.0)], "f string, k int, frame int, intensity_mean double, maxrow double")
    cls = spark.createDataFrame([("v", 0, -1.0), ("v", 1, 1.0)], "f string, k int, intensity_mean double")
    assert [tuple(r) for r in evaluation.best_by_frame(net, cls, ["f"], "k", "frame", "maxrow").collect()] == [("v", 1, 7.0)]
    rows = spark.range(100).selectExpr("id % 2 as g", "id")
    assert selection.sample(rows, ["g"], "id", 5).collect() == selection.sample(rows, ["g"], "id", 5).collect()
    assert selection.sample_with_replacement(rows, ["g"], "id", 60).groupBy("g").count().collect()[0]["count"] == 60
    x = spark.createDataFrame([(float(v),) for v in np.r_[np.zeros(50), np.full(50, 10.0)]], "v double")
    assert 0 < selection.isodata_threshold(x, "v") < 10


def test_windows(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, "2024-01-01 00:00:10"), ("a", 5.0, "2024-01-01 00:00:50"), ("a", 2.0, "2024-01-01 00:02:00")], "k string, v double, t string").selectExpr("k", "v", "cast(t as timestamp) t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v double, t timestamp").parquet(str(tmp_path / "in"))
    q = live.windowed_range(stream, "t", ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("ranges").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.lo, r.hi, r.n) for r in spark.sql("select * from ranges").collect()) == [(1.0, 5.0, 2), (2.0, 2.0, 1)]
