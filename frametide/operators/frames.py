"""Operators on frames (filename, frame_num, height, width, pixels): one pass, a frame at a time, with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FRAME, MENISCUS, REGION
from ..storage import store_of, stored


def image(row) -> np.ndarray:
    return np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)


def map_frames(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each frame's image through kernel (uint8 to uint8)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            new = [kernel(image(r)) for r in rows.itertuples()]
            yield rows.assign(height=[x.shape[0] for x in new], width=[x.shape[1] for x in new], pixels=[np.ascontiguousarray(x, np.uint8).tobytes() for x in new])

    return frames.mapInPandas(run, FRAME)


#: Pixels of a block: its histograms take 4 MB.
BLOCK = 4096


def median_images(frames: DataFrame) -> DataFrame:
    """(filename, block, pixels): each block of BLOCK pixels of a recording's biased histogram median, in order of pixels.

    Frames are cut into blocks in the JVM and dealt by recording and block, a byte for each pixel and frame, so a long recording is as
    many tasks as it has blocks. A task adds the blocks of all frames to 256 bins a pixel as they stream by; arrays of bins never
    leave it, and the median is read from their running sums. Frames of other sizes than a recording's other frames count where they
    have pixels.
    """
    places = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("pixels") / F.lit(BLOCK)).cast("int") - 1)), lambda k: F.struct(k.alias("block"), F.substring("pixels", k * BLOCK + 1, F.lit(BLOCK)).alias("part")))
    parts = frames.where(F.octet_length("pixels") > 0).select("filename", F.inline(places))
    parts = parts.repartition("filename", "block").sortWithinPartitions("filename", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, np.zeros(0, np.int64)
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([_medians(bins).tobytes()])], ["filename", "block", "pixels"])
        for batch in batches:
            for name, block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (name, block) != now:
                    if now is not None:
                        yield made()
                    now, bins = (name, block), np.zeros(0, np.int64)
                values = np.frombuffer(part.as_buffer(), np.uint8)
                if len(bins) < len(values) * 256:
                    bins = np.concatenate([bins, np.zeros(len(values) * 256 - len(bins), np.int64)])
                bins[np.arange(len(values)) * 256 + values] += 1
        if now is not None:
            yield made()

    return parts.mapInArrow(run, "filename string, block int, pixels binary")


def _medians(bins: np.ndarray) -> np.ndarray:
    upto = bins.reshape(-1, 256).cumsum(1)
    n = upto[:, -1:]
    above = upto > (n + 1) // 2
    return np.where((n[:, 0] > 1) & above.any(1), above.argmax(1), 255).astype(np.uint8)


def temporal_median(frames: DataFrame) -> DataFrame:
    """(filename, pixel, median): the same, a row for each pixel."""
    digits = F.hex("pixels")
    byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.octet_length("pixels") - 1), lambda k: F.struct((F.col("block") * BLOCK + k).alias("pixel"), byte(k).alias("median")))
    return median_images(frames).select("filename", F.inline(rows))


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components, numbered from 1 in reading order: runs of a row that touch runs of the row above are joined."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    stop = np.nonzero(edges == -1)[1]
    width = mask.shape[1] + 2
    # places on one line, a row after another, so that the touching runs above are found by search
    first, last = np.searchsorted(row * width + stop, (row - 1) * width + start, side="left"), np.searchsorted(row * width + start, (row - 1) * width + stop, side="right")
    above = list(range(len(row)))

    def root(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    for k in np.flatnonzero(last > first).tolist():
        for other in range(first[k], last[k]):
            a, b = root(k), root(other)
            if a != b:
                above[max(a, b)] = min(a, b)
    roots, number = np.unique([root(k) for k in range(len(row))], return_inverse=True) if len(row) else (np.empty(0, int), np.empty(0, int))
    label = np.zeros(mask.shape, np.int64)
    label[mask] = np.repeat(number + 1, stop - start)
    return label, len(roots)


def _spread(mask: np.ndarray, corners: bool) -> np.ndarray:
    """Each pixel's neighbours, stacked, itself first; what is outside is False."""
    p = np.pad(mask, 1)
    steps = [(0, 0)] + [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not (i and j))]
    return np.stack([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i, j in steps])


def dilated(mask: np.ndarray, corners: bool = False) -> np.ndarray:
    return _spread(mask, corners).any(0)


def eroded(mask: np.ndarray, corners: bool = False) -> np.ndarray:
    """Pixels whose neighbours are all in; beyond the image counts as in."""
    return ~_spread(~mask, corners).any(0)


def opened(mask: np.ndarray, corners: bool = False) -> np.ndarray:
    return dilated(eroded(mask, corners), corners)


def without_small(mask: np.ndarray, least: int = 50) -> np.ndarray:
    """The components (corners touch) of at least so many pixels."""
    label, _ = labelled(mask)
    return mask & (np.bincount(label.ravel())[label] >= least)


def perimeter(mask: np.ndarray) -> float:
    """The length of the border's pixels: 1 along an edge, the root of 2 along a diagonal, their mean at a corner."""
    p = np.pad(mask, 1)
    border = (p & ~eroded(p)).astype(int)
    q = np.pad(border, 1)
    at = lambda i, j: q[1 + i : q.shape[0] - 1 + i, 1 + j : q.shape[1] - 1 + j]
    beside = at(0, 1) + at(0, -1) + at(1, 0) + at(-1, 0)
    across = at(1, 1) + at(1, -1) + at(-1, 1) + at(-1, -1)
    kind = (border + 2 * beside + 10 * across) * border
    # fixed values: the border's weights by neighbours beside (2 each) and across (10 each)
    weights = dict.fromkeys((5, 7, 15, 17, 25, 27), 1.0) | dict.fromkeys((21, 33), 2**0.5) | dict.fromkeys((13, 23), (1 + 2**0.5) / 2)
    return float(sum(weights.get(k, 0.0) * n for k, n in zip(*np.unique(kind, return_counts=True), strict=True)))


def feret(rows: np.ndarray, cols: np.ndarray) -> float:
    """The largest distance between points of the outline, which runs half a pixel outside the pixels' centres."""
    ends = []
    for a, b, turn in ((rows, cols, False), (cols, rows, True)):
        order = np.lexsort((b, a))
        first = np.flatnonzero(np.diff(a[order], prepend=-1))
        last = np.append(first[1:], len(a)) - 1
        pts = np.concatenate([np.stack([a[order][k], b[order][k]], 1) for k in (first, last)])
        ends.append(pts[:, ::-1] if turn else pts)
    points = np.concatenate([np.concatenate(ends) + np.array(s) for s in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
    most = 0.0
    for p in points:  # one for each end of a row or column
        most = max(most, float(((points - p) ** 2).sum(1).max()))
    return most**0.5


def region_rows(mask: np.ndarray, intensity: np.ndarray) -> list[tuple]:
    """Centroid, box, area, moment axes, orientation, eccentricity, intensities, diameter of a disc of its area, feret diameter,
    perimeter and share of its box, of each component."""
    label, n = labelled(mask)
    out = []
    for k in range(1, n + 1):
        rows, cols = np.nonzero(label == k)
        r, c, v = rows.mean(), cols.mean(), intensity[rows, cols].astype(float)
        # second moments; 1/12 is a pixel's own
        a, b, d = ((rows - r) ** 2).mean() + 1 / 12, ((cols - c) ** 2).mean() + 1 / 12, ((rows - r) * (cols - c)).mean()
        root = np.hypot((a - b) / 2, d)
        major, minor = (a + b) / 2 + root, max((a + b) / 2 - root, 0.0)
        turn = 0.5 * np.arctan2(2 * d, a - b)
        own = (label == k)[rows.min() : rows.max() + 1, cols.min() : cols.max() + 1]
        out.append((k, r, c, rows.min(), cols.min(), rows.max() + 1, cols.max() + 1, float(len(rows)), 4 * np.sqrt(major), 4 * np.sqrt(minor), turn, np.sqrt(1 - minor / major) if major else 0.0, v.mean(), v.max(), v.min(), 2 * np.sqrt(len(rows) / np.pi), feret(rows, cols), perimeter(own), len(rows) / own.size))
    return out


def regions(frames: DataFrame, predict: Callable[[np.ndarray], np.ndarray], threshold: float = 0.5) -> DataFrame:
    """A row for each region that `predict`, a batch of images to a batch of probabilities, puts above the threshold.

    predict is the hook for a trained network; an Arrow batch is its batch. Frames of one batch must be of one size.
    """
    names = [x.split()[0] for x in REGION.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if not len(rows):
                continue
            stack = np.stack([image(r) for r in rows.itertuples()])
            found = [(f, k, *x) for f, k, p in zip(rows.filename, rows.frame_num, predict(stack), strict=True) for x in region_rows(p > threshold, p)]
            yield pd.DataFrame(found, columns=names)

    return frames.mapInPandas(run, REGION)


def attempted(frames: DataFrame, kernel: Callable[[pd.Series], list[tuple]], columns: str) -> DataFrame:
    """Rows (filename, frame_num, *columns, _error): what kernel gives for each frame, or one row with the reason if it fails.

    kernel takes a frame's row and gives its tuples; an exception, or a tuple of the wrong length, is that frame's failure and leaves
    other frames as they are. A frame may give no row.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for _, row in rows.iterrows():
                try:
                    found = [(row.filename, row.frame_num, *x, None) for x in kernel(row)]
                    if any(len(x) != len(names) + 3 for x in found):
                        raise ValueError("the kernel gave rows of another length")
                    out += found
                except Exception as e:  # noqa: BLE001  a frame's failure is a row, whatever it is
                    out.append((row.filename, row.frame_num, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["filename", "frame_num", *names, "_error"], dtype=object)

    kinds = dict(frames.dtypes)
    return frames.mapInPandas(run, f"filename {kinds['filename']}, frame_num {kinds['frame_num']}, {columns}, _error string")


def regions_or_reasons(frames: DataFrame, predict: Callable[[np.ndarray], np.ndarray], threshold: float = 0.5) -> DataFrame:
    """regions(), a frame at a time, with a row and its reason for each frame that can't be measured."""

    def kernel(row: pd.Series) -> list[tuple]:
        p = predict(image(row)[None])[0]
        return [tuple(x) for x in region_rows(p > threshold, p)]

    return attempted(frames, kernel, ", ".join(REGION.split(", ")[2:]))


def largest(found: DataFrame) -> DataFrame:
    """Of regions() the one with most pixels in each frame; of equal ones the first in reading order."""
    best = F.max_by(F.struct(*found.columns), F.struct("area", -F.col("label")))
    return found.groupBy("filename", "frame_num").agg(best.alias("_best")).select("_best.*")


def measurements(found: DataFrame) -> DataFrame:
    """Regions under the names and in the order of the measurement files, ready for their writer."""
    columns = ("frame_num", "centroid_row", "centroid_col", "intensity_mean", "intensity_max", "intensity_min", "area", "major_axis", "minor_axis", "equivalent_diameter", "feret_max", "orientation", "perimeter", "eccentricity")
    return found.select("filename", *(F.col(c).alias(name) for c, name in zip(columns, MENISCUS, strict=True)))


def labelled_only(masks: DataFrame) -> DataFrame:
    """The frames with at least one pixel that is not 0."""
    return masks.where(F.translate(F.hex("pixels"), "0", "") != "")


def differences(frames: DataFrame, background: DataFrame) -> DataFrame:
    """(filename, frame_num, height, width, difference): each frame less its recording's median, signed, as one binary of 16-bit
    little-endian numbers a frame. background is what median_images() gives; pixels that it lacks are left as they are.

    Frames stay where they are. The background is written to the shared folder in order of recordings, and a task reads that of the
    recording it is at, one image at a time.
    """
    uri = stored(background.repartitionByRange("filename").sortWithinPartitions("filename", "block"), "background")
    kinds = dict(frames.dtypes)
    names = ["filename", "frame_num", "height", "width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset

        store, path = store_of(uri)
        table, now, median = dataset.dataset(path, filesystem=store), None, None
        for batch in batches:
            new = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(4), strict=True):
                if median is None or name != now:
                    blocks = table.to_table(filter=dataset.field("filename") == name).sort_by("block").column("pixels").to_pylist() if name is not None else []
                    now, median = name, np.frombuffer(b"".join(blocks), np.uint8).astype(np.int16)
                values = np.frombuffer(raw.as_buffer() or b"", np.uint8).astype("<i2")
                n = min(len(values), len(median))
                values[:n] -= median[:n]
                new.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(new, pa.binary())], [*names, "difference"])

    return frames.select(*names, F.coalesce("pixels", F.lit(b"")).alias("pixels")).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", difference binary")


def difference(frames: DataFrame, background: DataFrame) -> DataFrame:
    """(filename, frame_num, pixel, difference): the same, a row for each pixel. background is (filename, pixel, median)."""
    blocks = background.withColumn("block", F.floor(F.col("pixel") / BLOCK).cast("int")).groupBy("filename", "block").agg(F.sort_array(F.collect_list(F.struct("pixel", "median"))).alias("m"))  # BLOCK at most
    blocks = blocks.select("filename", "block", F.unhex(F.array_join(F.transform("m", lambda x: F.lpad(F.hex(x["median"]), 2, "0")), "")).alias("pixels"))
    digits = F.hex("difference")
    at = lambda k: F.conv(F.concat(F.substring(digits, 4 * k + 3, F.lit(2)), F.substring(digits, 4 * k + 1, F.lit(2))), 16, 10).cast("int")
    signed = lambda v: F.when(v < 32768, v).otherwise(v - 65536)
    rows = F.transform(F.sequence(F.lit(0), (F.octet_length("difference") / 2 - 1).cast("int")), lambda k: F.struct(k.alias("pixel"), signed(at(k)).alias("difference")))
    return differences(frames, blocks).where(F.octet_length("difference") > 0).select("filename", "frame_num", F.inline(rows))


def negative_only(values: np.ndarray) -> np.ndarray:
    """Differences with what is brighter than the background set to 0."""
    return np.minimum(values, 0)


def sobel(x: np.ndarray, axis: int) -> np.ndarray:
    """The gradient along an axis, smoothed across it."""
    p = np.pad(x.astype(float), 1, mode="edge")
    p = p if axis == 0 else p.T
    diff = (p[2:] - p[:-2]) / 2
    out = (diff[:, :-2] + 2 * diff[:, 1:-1] + diff[:, 2:]) / 4
    return out if axis == 0 else out.T


def li_threshold(x: np.ndarray) -> float:
    """Li's iterative minimum cross entropy threshold."""
    low = x.min()
    v = x.astype(float).ravel() - low
    t, last = v.mean(), -1.0
    while abs(t - last) > 1e-6 and 0 < t < v.max():
        last = t
        a, b = v[v > t].mean(), v[v <= t].mean()
        if b <= 0:
            break
        t = (b - a) / (np.log(b) - np.log(a))
    return float(t + low)


def tube_column(x: np.ndarray) -> int:
    """The column with most strong horizontal edges."""
    edges = np.abs(sobel(x, 0))
    return int((edges > li_threshold(edges)).sum(0).argmax())


def tube_crop(x: np.ndarray, half: int = 50) -> np.ndarray:
    """The columns around the tube, always 2 * half wide where the image is: at an edge the window moves in instead of shrinking."""
    at = min(max(tube_column(x) - half, 0), max(0, x.shape[1] - 2 * half))
    return x[:, at : at + 2 * half]


def augmented(frames: DataFrame, repeats: int, seed: int = 0, shift_x: int = 20, shift_y: int = 200) -> DataFrame:
    """Each frame `repeats` times, flipped and shifted by a seeded hash of its name, number and repeat; what leaves the image is 0."""
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), "filename", "frame_num", "repeat", F.lit(k)), F.lit(n)).cast("int")
    rows = frames.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.select("*", draw(0, 2).alias("flip"), (draw(1, 2 * shift_x + 1) - shift_x).alias("dx"), (draw(2, 2 * shift_y + 1) - shift_y).alias("dy"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            new = []
            for r in rows.itertuples():
                x = image(r)
                x = x[::-1] if r.flip else x
                h, w = x.shape
                out = np.zeros_like(x)
                dy, dx = max(-h, min(h, r.dy)), max(-w, min(w, r.dx))
                out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = x[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
                new.append(out.tobytes())
            yield rows.assign(pixels=new).drop(columns=["flip", "dx", "dy"])

    return rows.mapInPandas(run, FRAME + ", repeat int")
