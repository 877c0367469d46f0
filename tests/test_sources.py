import json
import struct
import zipfile

import pytest

from frametide import schemas
from frametide.operators import frames as frame_ops
from frametide.sources import annotations, cine, measurements


def write_cine(path, images, rate=30, cut=0):
    """images: lists of rows, top-down, written bottom-up as the format has them."""
    h, w = len(images[0]), len(images[0][0])
    head = bytearray(0x60)
    struct.pack_into("<I", head, 20, len(images))
    struct.pack_into("<I", head, 0x20, 0x60)
    struct.pack_into("<ii", head, 0x30, w, h)
    struct.pack_into("<I", head, 0x40, w * h)
    struct.pack_into("<H", head, 0x54, rate)
    body, offsets, at = b"", [], 0x60 + 8 * len(images)
    for k, image in enumerate(images):
        note = 4 + 4 * (k % 3)
        offsets.append(at + len(body))
        body += struct.pack("<I", note) + b"\0" * (note - 4) + b"".join(bytes(r) for r in reversed(image))
    data = bytes(head) + struct.pack(f"<{len(images)}Q", *offsets) + body
    path.write_bytes(data[: len(data) - cut])


@pytest.fixture
def video(tmp_path):
    images = [[[k, k + 1, k + 2], [10 * k, 0, 255]] for k in range(5)]
    write_cine(tmp_path / "a.cine", images)
    write_cine(tmp_path / "b.cine", images[:3], rate=0, cut=2)
    return tmp_path


def test_cine(spark, video):
    cine.register(spark)
    videos = spark.read.format("cine").option("kind", "videos").load(str(video)).orderBy("filename").collect()
    assert [(r.image_count, r.width, r.height, r.image_size, r.framerate) for r in videos] == [(5, 3, 2, 6, 30), (3, 3, 2, 6, None)]
    df = spark.read.format("cine").option("framesPerTask", "2").load(str(video))
    got = {(r.filename[-6:], r.frame_num): bytes(r.pixels) for r in df.collect()}
    assert len(got) == 7 and ("b.cine", 2) not in got  # the file ends inside it
    assert got["a.cine", 3] == bytes([3, 4, 5, 30, 0, 255])
    assert [r.frame_num for r in cine.frame_at(df, 4).collect()] == [4]
    assert cine.frame_at(df, 9).count() == 0
    assert sorted(r.frame_num for r in cine.frames_between(df.where("filename like '%a.cine'"), 0, 5, 2).collect()) == [0, 2, 4]
    medians = {r.pixel: r["median"] for r in frame_ops.temporal_median(df.where("filename like '%a.cine'")).collect()}
    assert medians == {0: 3, 1: 4, 2: 5, 3: 30, 4: 0, 5: 255}
    diff = frame_ops.difference(df.where("filename like '%a.cine' and frame_num = 0"), frame_ops.temporal_median(df.where("filename like '%a.cine'")))
    assert [r.difference for r in diff.orderBy("pixel").collect()] == [-3, -3, -3, -30, 0, 0]


def test_measurement_map(spark, tmp_path):
    rows = {"data2/moth1_a.cine": [[float(k), *range(1, 14)] for k in range(3)], "data2/empty.cine": []}
    rows["data2/moth1_a.cine"][1][3] = float("nan")
    (tmp_path / "m.json").write_text(json.dumps(rows))
    df = measurements.read_map(spark, str(tmp_path / "m.json"), schemas.MENISCUS)
    got = df.orderBy("frame_num").collect()
    assert [r.frame_num for r in got] == [0, 1, 2] and got[1].intensity_mean_m is None and got[0].area_m == 6.0
    measurements.write_map(df.fillna(0.0), str(tmp_path / "out"), schemas.MENISCUS)
    again = measurements.read_lines(spark, str(tmp_path / "out"), schemas.MENISCUS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.fillna(0.0).collect()))


def test_tables(spark, tmp_path):
    (tmp_path / "u.csv").write_text("filename,distance(pixels),distance(mm),error,ratio\na,31.4,5.5,0.02,\nb,,5.5,,\n")
    got = measurements.read_table(spark, str(tmp_path / "u.csv"), schemas.UNITS).collect()
    assert [(r.filename, r.px) for r in got] == [("a", 31.4), ("b", None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("1 2.5\n2 3.5\n")
    assert measurements.read_tracks(spark, str(tmp_path / "t"), "frame int, pos double", sep=" ").where("filename like '%x.txt'").count() == 2
    good, bad = measurements.with_rejects(spark.createDataFrame([(1,), (None,)], "x int"), __import__("pyspark").sql.functions.col("x") > 0)
    assert good.count() == 1 and bad.count() == 1


def test_spreadsheet(spark, tmp_path):
    t, x = "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    cell = lambda s: f"<t:table-cell><x:p>{s}</x:p></t:table-cell>" if s else '<t:table-cell t:number-columns-repeated="1"/>'
    row = lambda *c: "<t:table-row>" + "".join(map(cell, c)) + "</t:table-row>"
    xml = f'<d xmlns:t="{t}" xmlns:x="{x}"><t:table>{row("filename", "isPerched", "curled")}{row("a.cine", "yes", "no")}{row("b.cine", "", "yes")}</t:table></d>'
    with zipfile.ZipFile(tmp_path / "p.ods", "w") as z:
        z.writestr("content.xml", xml)
    got = measurements.read_spreadsheet(spark, str(tmp_path / "p.ods"), schemas.POSTURES).orderBy("filename").collect()
    assert [tuple(r) for r in got] == [("a.cine", "yes", "no"), ("b.cine", None, "yes")]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<annotations><image name="i1" width="10" height="8"><points label="m" points="2.0,3.0"/><polyline label="p" points="0,0;3,0;99,0"/><box label="b" xtl="1" ytl="2" xbr="3" ybr="4"/></image><image name="i2" width="10" height="8"/></annotations>')
    images = annotations.read_xml(spark, str(tmp_path / "a.xml"))
    assert images.count() == 2
    assert [(r.image, r.points[0].x, r.points[0].y) for r in annotations.shapes(images, "points").collect()] == [("i1", 2.0, 3.0)]
    assert [(r.x0, r.y1) for r in annotations.boxes(images).collect()] == [(1.0, 4.0)]
    pixels = annotations.line_pixels(annotations.shapes(images, "polyline"), 8, 10)
    assert sorted((r.row, r.col) for r in pixels.collect()) == [(0, c) for c in range(10)]
    (tmp_path / "c.json").write_text(json.dumps({"licenses": [], "info": {}, "categories": [{"id": 1, "name": "m"}], "images": [{"id": 5, "file_name": "f"}], "annotations": [{"id": 9, "image_id": 5, "category_id": 1, "bbox": [1, 2, 3, 4]}]}))
    pictures, notes, kinds = annotations.read_coco(spark, str(tmp_path / "c.json"))
    assert notes.join(pictures, notes.image_id == pictures.id).select("x", "y", "w", "h", "file_name").collect() == [(1.0, 2.0, 3.0, 4.0, "f")]
    assert kinds.count() == 1
