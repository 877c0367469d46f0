import numpy as np
import pytest

from frametide.operators import frames


def row(name, k, image):
    image = np.asarray(image, np.uint8)
    return name, k, image.shape[0], image.shape[1], image.tobytes()


@pytest.fixture
def two(spark):
    a = np.zeros((6, 8), np.uint8)
    a[1:3, 1:4] = 200
    a[3, 4] = 200  # touches by a corner
    a[5, 7] = 220
    return spark.createDataFrame([row("v", 0, a), row("v", 1, np.zeros((6, 8)))], frames.FRAME)


def test_regions(two):
    got = sorted(tuple(r) for r in frames.regions(two, lambda s: s / 255.0).collect())
    assert [(r[1], r[2], r[5:9], r[9]) for r in got] == [(0, 1, (1, 1, 4, 5), 7.0), (0, 2, (5, 7, 6, 8), 1.0)]
    assert got[0][3] == pytest.approx((1 * 3 + 2 * 3 + 3) / 7) and got[1][13] == pytest.approx(0.0)


def test_labels_follow_bends():
    mask = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert frames.labelled(mask)[1] == 1
    assert frames.labelled(np.zeros((2, 2), bool))[1] == 0
    assert frames.labelled(np.ones((2, 2), bool))[0].tolist() == [[1, 1], [1, 1]]


def test_map_and_augment(two):
    assert [r.width for r in frames.map_frames(two, lambda x: x[:, :5]).collect()] == [5, 5]
    once, again = (sorted(map(tuple, frames.augmented(two, 3, seed=1, shift_x=1, shift_y=1).collect())) for _ in range(2))
    assert len(once) == 6 and once == again


def test_tube():
    x = np.full((60, 200), 120, np.uint8)
    x[20:40, 95:105] = 10
    assert 94 <= frames.tube_column(x) <= 105
    assert frames.tube_crop(x).shape == (60, 100)
    y = np.roll(x, -90, axis=1)
    assert frames.tube_crop(y).shape == (60, 100)


def test_region_properties_of_known_shapes():
    mask = np.zeros((20, 30), bool)
    mask[2:8, 3:13] = True
    (r,) = frames.region_rows(mask, mask.astype(float))
    diameter, feret, perimeter, extent = r[-4:]
    assert diameter == pytest.approx(2 * np.sqrt(60 / np.pi)) and extent == 1.0 and perimeter == 2 * (5 + 9)
    points = [(x + a, y + b) for x, y in zip(*np.nonzero(mask), strict=True) for a, b in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]
    assert feret == pytest.approx(max(np.hypot(p[0] - q[0], p[1] - q[1]) for p in points for q in points))


def test_morphology():
    mask = np.zeros((12, 12), bool)
    mask[2:8, 2:8] = True
    mask[10, 10] = True
    assert frames.eroded(mask).sum() == 16 and frames.dilated(frames.eroded(mask))[2:8, 2:8].sum() == 32
    assert frames.opened(mask, corners=True).sum() == 36 and frames.without_small(mask, 2).sum() == 36
    assert not frames.opened(np.zeros((3, 3), bool)).any()


def test_largest_region_as_measurements(two):
    from frametide.schemas import MENISCUS

    one = frames.measurements(frames.largest(frames.regions(two, lambda s: s / 255.0)))
    assert tuple(one.columns) == ("filename", *MENISCUS)
    (r,) = one.collect()
    assert (r.frame_num, r.area_m) == (0, 7.0)
    assert [r.frame_num for r in frames.labelled_only(two).collect()] == [0]
    assert frames.largest(frames.regions(two.limit(0), lambda s: s / 255.0)).count() == 0


def test_difference_from_the_median(two):
    back = frames.temporal_median(two)
    rows = {(r.frame_num, r.pixel): r.difference for r in frames.difference(two, back).collect()}
    want = {r.pixel: r.median for r in back.collect()}
    for f in two.collect():
        for k, v in enumerate(f.pixels):
            assert rows[f.frame_num, k] == v - want[k]
