import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.functions import scalars
from frametide.operators import frames, joins, selection, statistics, tracks
from frametide.plans import segmentation
from frametide.sources import buckets, images, measurements, sinks

KINDS = [(np.uint8, 1), (np.uint8, 2), (np.uint8, 3), (np.uint8, 4), (np.uint16, 1), (np.uint16, 3)]


@pytest.mark.parametrize("filters", [0, 1, 2, 3, 4, [4, 1, 3, 0, 2]])
@pytest.mark.parametrize("kind", KINDS, ids=str)
def test_png_filters(filters, kind):
    rng = np.random.default_rng(7)
    smooth = np.add.outer(np.arange(9), np.arange(13))[:, :, None] * 3 + rng.integers(0, 4, (9, 13, kind[1]))
    for image in (smooth.astype(kind[0]), rng.integers(0, np.iinfo(kind[0]).max, (9, 13, kind[1])).astype(kind[0])):
        assert (images.decode(images.encode(image, filters)) == image).all()


def raw_png(width, height, bits, colour, lines, extra=b""):
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_palettes_and_bits():
    import struct
    import zlib

    bitmap = images.decode(raw_png(10, 2, 1, 0, bytes([0, 0b10100000, 0b01000000, 0, 0xFF, 0xC0])))
    assert bitmap[:, :, 0].tolist() == [[255, 0, 255, 0, 0, 0, 0, 0, 0, 255], [255] * 10]
    assert images.decode(raw_png(3, 1, 4, 0, bytes([0, 0x0F, 0x80])))[0, :, 0].tolist() == [0, 255, 8 * 255 // 15]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colours = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6, 7, 8, 9])) + chunk(b"tRNS", bytes([10, 20]))
    assert images.decode(raw_png(4, 1, 2, 3, bytes([0, 0b00011000]), colours))[0].tolist() == [[1, 2, 3, 10], [4, 5, 6, 20], [7, 8, 9, 255], [1, 2, 3, 10]]


def test_png_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "deep").mkdir()
    want = {}
    for k in range(12):
        image = rng.integers(0, 256, (6, 5 + k % 3, 1 + 2 * (k % 2))).astype(np.uint8)
        path = tmp_path / ("deep" if k % 2 else ".") / f"clip_{k}.png"
        path.write_bytes(images.encode(image, k % 5))
        want[f"clip_{k}.png"] = image
    (tmp_path / "notes.txt").write_text("no image")
    (tmp_path / "bad_1.png").write_bytes(b"no image")
    damaged = bytearray((tmp_path / "clip_0.png").read_bytes())
    damaged[60] ^= 1
    (tmp_path / "bad_2.png").write_bytes(damaged)
    images.register(spark)
    df = spark.read.format("png").option("bytesPerTask", "200000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    rows = {os.path.basename(r.filename): r for r in df.collect()}
    for name, image in want.items():
        r = rows[name]
        assert (r.height, r.width, r.channels) == image.shape and bytes(r.pixels) == image.tobytes()
    assert rows["bad_1.png"].error == "not a PNG file" and rows["bad_2.png"].error.startswith("damaged") and rows["bad_2.png"].pixels is None
    grey = {os.path.basename(r.filename): r for r in images.as_frames(df).collect()}
    assert len(grey) == 12 and all(bytes(grey[n].pixels) == want[n][:, :, 0].tobytes() and grey[n].frame_num == int(n[5:-4]) for n in want)
    assert spark.read.format("png").load(str(tmp_path / "clip_0.png")).count() == 1


def tracks_of(spark, rows):
    return spark.createDataFrame(rows, "filename string, frame_num long, pos double, note string")


def folder(path):
    return {n: (path / n).read_text() for n in sorted(os.listdir(path))}


def test_text_for_each_recording(spark, tmp_path):
    out = tmp_path / "tracks"
    rows = [(f"data2/m{k % 5}_é.cine", k, k / 4, None if k % 3 else "x") for k in range(40)]
    sinks.write_tracks(tracks_of(spark, rows).repartition(7), str(out))
    got = folder(out)
    assert set(got) == {f"m{k}_%C3%A9.tsv" for k in range(5)}
    assert got["m1_%C3%A9.tsv"].splitlines()[:2] == ["1\t0.25\t", "6\t1.5\tx"]
    sinks.write_tracks(tracks_of(spark, [("data2/m1_é.cine", 99, 1.0, "more"), ("new.cine", 1, 2.0, "n")]), str(out), mode="append")
    again = folder(out)
    assert again["m1_%C3%A9.tsv"] == got["m1_%C3%A9.tsv"] + "99\t1.0\tmore\n" and again["new.tsv"] == "1\t2.0\tn\n" and len(again) == 6
    read = measurements.read_tracks(spark, str(out), "frame_num long, pos double, note string", sep="\t")
    assert read.count() == 42 and read.agg(F.sum("frame_num")).first()[0] == sum(range(40)) + 100
    sinks.write_tracks(tracks_of(spark, rows[:1]), str(out), mode="overwrite", header=True)
    assert folder(out) == {"m0_%C3%A9.tsv": "frame_num\tpos\tnote\n0\t0.0\tx\n"}


def test_failed_writes_leave_nothing(spark, tmp_path):
    out = tmp_path / "tracks"
    sinks.write_tracks(tracks_of(spark, [("a.cine", 1, 1.0, "x")]), str(out))
    before = folder(out)
    many = [(f"r{k}.cine", k, 1.0, "x") for k in range(20)]
    for bad in ([("b.cine", 1, 1.0, "with\ttab")], [("b.cine", 1, 1.0, "line\nend")], [(None, 1, 1.0, "x")], [("one/c.cine", 1, 1.0, "x"), ("c.tif", 2, 1.0, "x")]):
        with pytest.raises(Exception):  # noqa: B017
            sinks.write_tracks(tracks_of(spark, many + bad), str(out))
        assert folder(out) == before
    failing = tracks_of(spark, many).withColumn("note", F.when(F.col("frame_num") == 19, F.raise_error("late")).otherwise(F.col("note")))
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_tracks(failing, str(out), mode="overwrite")
    assert folder(out) == before


def test_parquet_for_each_recording(spark, tmp_path):
    rows = tracks_of(spark, [(f"m{k % 3}", k, 1.0, "x") for k in range(9)])
    measurements.write_by_recording(rows, str(tmp_path / "p"))
    measurements.write_by_recording(rows, str(tmp_path / "p"))
    assert sorted(n for n in os.listdir(tmp_path / "p") if n.startswith("filename=")) == [f"filename=m{k}" for k in range(3)]
    assert spark.read.parquet(str(tmp_path / "p")).count() == 18


def test_recordings_in_buckets(spark, tmp_path):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    top = spark.range(3000).selectExpr("concat('m', id % 20) as filename", "id div 20 as frame_num", "cast(id as double) as submergence")
    tip = top.select("filename", "frame_num", (F.col("submergence") * 2).alias("rate"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        buckets.open_layout(spark)
        buckets.save(top, "top_track", buckets=4)
        buckets.save(tip, "tip_track", buckets=4)
        joined = joins.tracks(spark.table("top_track"), spark.table("tip_track"), ["filename", "frame_num"])
        moving = tracks.forward_derivative(joined, ["filename"], "frame_num", "submergence")
        medians = statistics.medians(moving.select("filename", "submergence", "rate", "derivative"), ["filename"])
        rows = {r.filename: r for r in medians.collect()}
        plan = medians._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = {r.filename: r for r in statistics.medians(tracks.forward_derivative(joins.tracks(top, tip, ["filename", "frame_num"]), ["filename"], "frame_num", "submergence").drop("frame_num"), ["filename"]).collect()}
        assert {k: (r.submergence, r.rate, r.derivative) for k, r in rows.items()} == {k: (r.submergence, r.rate, r.derivative) for k, r in want.items()}
    finally:
        for t in ("top_track", "tip_track"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_rejects_with_reasons(spark):
    a = np.zeros((6, 8), np.uint8)
    a[1:3, 1:4] = 200
    good = [("v", k, 6, 8, a.tobytes()) for k in range(5)]
    damaged = [("v", 5, 6, 8, a.tobytes()[:-1]), ("w", 0, 6, 8, None)]
    df = spark.createDataFrame(good + damaged, frames.FRAME)
    calls = spark.sparkContext.accumulator(0)

    def predict(stack):
        calls.add(1)
        return stack / 255.0

    kept, rejects, counts = measurements.split_rejects(frames.regions_or_reasons(df, predict))
    assert counts == {"good": 5, "rejected": 2}
    whole = sorted(map(tuple, frames.regions(df.where("filename = 'v' and frame_num < 5"), lambda s: s / 255.0).collect()))
    assert sorted(map(tuple, kept.collect())) == whole
    rows = {(r.filename, r.frame_num): r._error for r in rejects.collect()}
    assert set(rows) == {("v", 5), ("w", 0)} and rows["v", 5].startswith("ValueError")
    assert calls.value == 5  # each frame once, though both tables were read
    assert {r.filename: r.failures for r in measurements.skipped(rejects).collect()} == {"v": 1, "w": 1}


def test_rejects_by_rule(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 1.0), (3, None), (-1, -1.0)], "x int, y double")
    good, bad = measurements.with_rejects(df, {"no x": F.col("x").isNotNull(), "x below 0": F.col("x") >= 0, "y below 0": F.col("y") >= 0})
    assert [tuple(r) for r in good.collect()] == [(1, 1.0)]
    assert sorted(r._error for r in bad.collect()) == ["no x", "x below 0", "y below 0"]


def test_lookup_by_suffix(spark):
    table = spark.createDataFrame([("data2/a_1.cine", 1, 2.0), ("data2/b_1.cine", 2, None), ("old/a_1.cine", 3, 6.0)], "path string, k int, px double")
    names = spark.createDataFrame([("a_1.cine",), ("old/a_1.cine",), ("b_1.cine",), ("a_1.cine",)], "name string").withColumn("px", F.lit("clash"))
    with pytest.warns(UserWarning, match="1 names"):
        got = joins.looked_up(names, "name", table, "path", "k", "px", "scale")
    assert sorted((r.name, r.scale) for r in got.collect()) == [("a_1.cine", 2.0), ("a_1.cine", 2.0), ("b_1.cine", 4.0), ("old/a_1.cine", 6.0)]
    with pytest.raises(LookupError, match="nowhere"):
        joins.looked_up(spark.createDataFrame([("a_1.cine",), ("nowhere",)], "name string"), "name", table, "path", "k", "px")


def test_names_numbers_and_shares(spark):
    (r,) = spark.createDataFrame([("data2/mothM6_2022-09-22_Cine1.cine", bytes([0, 51, 255]))], "p string, b binary").select(scalars.words_but_last(F.col("p")).alias("w"), scalars.pixel_shares(F.col("b")).alias("s")).collect()
    assert r.w == "mothM6 2022 09 22 Cine1" and r.s == [0.0, 0.2, 1.0]
    (r,) = spark.createDataFrame([(b"",)], "b binary").select(scalars.pixel_shares(F.col("b")).alias("s")).collect()
    assert r.s == []
    draw = random.Random(3)
    names = [f"{draw.randrange(10**6)}é" for _ in range(5000)] + [None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.k for r in tracks.factorize(df, "n", "k").collect()}
    assert got == {n: k for k, n in enumerate(sorted({n for n in names if n}, key=str.encode))}


def test_widest_region(spark):
    rows = [("v", 0, 1, 0, 0, 5, 9, "a"), ("v", 0, 2, 0, 0, 5, 30, "b"), ("v", 0, 3, 0, 3, 5, 12, "c"), ("v", 1, 1, 0, 0, 5, 50, "d")]
    df = spark.createDataFrame(rows, "filename string, frame_num int, label int, minrow int, mincol int, maxrow int, maxcol int, what string")
    assert [r.what for r in selection.widest_region(df, 20).collect()] == ["a"]
    assert sorted(r.what for r in selection.widest_region(df).collect()) == ["b", "d"]


def test_large_frames(spark):
    rng = np.random.default_rng(4)
    stack = rng.integers(0, 256, (7, 70, 90)).astype(np.uint8)
    rows = [("v", k, 70, 90, x.tobytes()) for k, x in enumerate(stack)] + [("one", 0, 70, 90, stack[0].tobytes()), ("none", 0, 0, 0, b"")]
    df = spark.createDataFrame(rows, frames.FRAME)
    back = frames.median_images(df)
    got = {(r.filename, r.block): np.frombuffer(r.pixels, np.uint8) for r in back.collect()}
    want = np.sort(stack, axis=0)[4].ravel()
    assert (np.concatenate([got["v", 0], got["v", 1]]) == want).all() and (got["one", 0] == 255).all() and len(got) == 4
    for r in frames.differences(df, back).collect():
        d = np.frombuffer(r.difference, "<i2")
        if r.filename == "v":
            assert (d == stack[r.frame_num].ravel().astype(int) - want).all()
        else:
            assert len(d) == r.height * r.width
    assert frames.negative_only(np.array([-3, 4])).tolist() == [-3, 0]


def test_labels_as_by_spreading():
    rng = np.random.default_rng(11)
    for shape in ((1, 1), (5, 9), (30, 40), (3, 200)):
        for share in (0.1, 0.45, 0.7):
            mask = rng.uniform(size=shape) < share
            seen, want, n = set(), np.zeros(shape, int), 0
            for at in zip(*np.nonzero(mask), strict=True):
                if at in seen:
                    continue
                n += 1
                todo = [at]
                seen.add(at)
                while todo:
                    r, c = todo.pop()
                    want[r, c] = n
                    for q in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if 0 <= q[0] < shape[0] and 0 <= q[1] < shape[1] and mask[q] and q not in seen:
                            seen.add(q)
                            todo.append(q)
            label, count = frames.labelled(mask)
            assert count == n and (label == want).all()


def test_forest_on_features(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(4):
        image, truth = rng.normal(0.3, 0.1, (24, 24)), np.zeros((24, 24), int)
        r, c = rng.integers(4, 14, 2)
        image[r : r + 6, c : c + 8] += 0.4
        truth[r : r + 6, c : c + 8] = 1
        rows += [(k, i, j, float(image[i, j]), int(truth[i, j]) if k < 3 else None, int(truth[i, j])) for i in range(24) for j in range(24)]
    px = spark.createDataFrame(rows, "image int, row int, col int, value double, label int, truth int")
    model = segmentation.fit(px, ["image"], "label", trees=15, depth=5, radii=(1, 2))
    out = segmentation.predict(model, px.where("image = 3"), ["image"], radii=(1, 2))
    hit = out.agg(F.avg((F.col("marked") == (F.col("truth") == 1)).cast("double")), F.count("*")).first()
    assert hit[1] == 576 and hit[0] > 0.95
    again = segmentation.predict(segmentation.fit(px.repartition(3), ["image"], "label", trees=15, depth=5, radii=(1, 2)), px.where("image = 3"), ["image"], radii=(1, 2))
    assert math.isclose(again.agg(F.sum("probability")).first()[0], out.agg(F.sum("probability")).first()[0], rel_tol=0.05)
    f, names = segmentation.features(px.where("image = 0"), ["image"], (1,))
    assert names == ["f_value", "f_mean1", "f_var1", "f_dx1", "f_dy1"]
    values = {(r.row, r.col): r for r in f.collect()}
    square = np.array([[values[i, j].value for j in (0, 1, 2)] for i in (0, 1, 2)])
    assert math.isclose(values[1, 1].f_mean1, square.mean()) and math.isclose(values[1, 1].f_var1, square.var(), rel_tol=1e-6)
    assert math.isclose(values[1, 1].f_dx1, square[1, 2] - square[1, 0]) and values[0, 0].f_dy1 == 0.0
