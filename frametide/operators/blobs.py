"""Bright blobs over scales: the scale-normalised Laplacian of Gaussians as a separable stencil.

Whole frames as arrays stay in their rows: no pixel is a row, and nothing is sorted or shuffled for responses and maxima. Where pixels are
rows (frame key, row, col, value), as for frames too large for an array, all is in the JVM: two window frames, along rows and then along columns, gather a pixel's neighbourhood and
weigh it for all scales at once; maxima over (scale, row, column) are windows too. A frame's rows and columns are dealt over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weights(sigma: float, radius: int) -> tuple[list[float], list[float]]:
    """A Gaussian of sum 1, cut at four sigma, and its second derivative, as weights from -radius to radius."""
    cut = int(4 * sigma + 0.5)
    g = [math.exp(-0.5 * (k / sigma) ** 2) if abs(k) <= cut else 0.0 for k in range(-radius, radius + 1)]
    g = [x / sum(g) for x in g]
    return g, [x * (k * k / sigma**4 - 1 / sigma**2) for k, x in zip(range(-radius, radius + 1), g, strict=True)]


def _reflected(rows: DataFrame, at: str, size: str, radius: int) -> DataFrame:
    """The rows, and their reflections at both borders as far as the radius; the border pixel is repeated."""
    turns = F.ceil(F.lit(radius) / (2 * F.col(size))).cast("int")
    shifts = F.transform(F.sequence(-turns, turns), lambda m: 2 * F.col(size) * m)
    places = F.flatten(F.transform(shifts, lambda s: F.array(F.col(at) + s, s - 1 - F.col(at))))
    inside = F.filter(places, lambda p: (p >= -radius) & (p < F.col(size) + radius))
    return rows.withColumn("_at", F.explode(inside))


def _dot(values: Column, w: list[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*[F.lit(x) for x in w]), lambda v, x: v * x), F.lit(0.0), lambda acc, x: acc + x)


def _part(scale: int, side: str) -> Column:
    """One scale's values of the first pass."""
    return F.transform("_v", lambda p: F.get(p, F.lit(scale))[side])


def responses(pixels: DataFrame, key: list[str], sigmas: list[float]) -> DataFrame:
    """(key, row, col, scale, response): how much each pixel is the centre of a bright blob of each sigma.

    pixels (key, row, col, value) is a whole grid from 0 for each key; a null value is 0. Borders are reflected.
    """
    radius = max(int(4 * s + 0.5) for s in sigmas)
    kernels = [weights(s, radius) for s in sigmas]
    rows = pixels.select(*key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    sizes = rows.groupBy(*key).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    rows = rows.join(sizes, key)

    around = Window.partitionBy(*key, "row").orderBy("_at").rowsBetween(-radius, radius)
    across = _reflected(rows, "col", "_w", radius).withColumn("_v", F.collect_list("value").over(around)).where(F.col("_at").between(0, F.col("_w") - 1))
    passes = F.array(*[F.struct(_dot(F.col("_v"), g).alias("g"), _dot(F.col("_v"), d).alias("d")) for g, d in kernels])
    across = across.select(*key, "row", F.col("_at").alias("col"), "_h", passes.alias("_p"))

    around = Window.partitionBy(*key, "col").orderBy("_at").rowsBetween(-radius, radius)
    down = _reflected(across, "row", "_h", radius).withColumn("_v", F.collect_list("_p").over(around)).where(F.col("_at").between(0, F.col("_h") - 1))
    scaled = []
    for k, (s, (g, d)) in enumerate(zip(sigmas, kernels, strict=True)):
        scaled.append((_dot(_part(k, "g"), d) + _dot(_part(k, "d"), g)) * F.lit(-(s * s)))
    return down.select(*key, F.col("_at").alias("row"), "col", F.posexplode(F.array(*scaled)).alias("scale", "response"))


def blobs(pixels: DataFrame, key: list[str], sigmas: list[float], *, threshold: float = 0.2, overlap: float | None = 0.5) -> DataFrame:
    """(key, scale, sigma, row, col, response) of the pixels that respond most among their neighbours in scale, row and column and more
    than the threshold; all pixels of a plateau are given. Of two blobs of a frame, discs of radius sigma times the root of 2, the
    smaller goes if they share more than `overlap` of it; None keeps all. A frame's blobs are compared with each other only."""
    found = responses(pixels, key, sigmas)
    near = lambda by, order: Window.partitionBy(*key, *by).orderBy(order).rowsBetween(-1, 1)
    found = found.withColumn("_m", F.max("response").over(near(["scale", "row"], "col")))
    found = found.withColumn("_m", F.max("_m").over(near(["scale", "col"], "row")))
    found = found.withColumn("_m", F.max("_m").over(near(["row", "col"], "scale")))
    size = F.get(F.array(*[F.lit(float(s)) for s in sigmas]), F.col("scale"))
    peaks = found.where((F.col("response") == F.col("_m")) & (F.col("response") > threshold)).select(*key, "scale", size.alias("sigma"), "row", "col", "response")
    return peaks if overlap is None else _apart(peaks, key, overlap)


#: Pixels that are weighed at once in a task.
PIXELS = 1 << 18


def grid_responses(values: np.ndarray, sigmas: list[float]) -> np.ndarray:
    """(frame, scale, row, col) of values (frame, row, col), as responses() gives them, with sums in the same order."""
    radius = max(int(4 * s + 0.5) for s in sigmas)

    def weighed(x: np.ndarray, w: list[float], axis: int) -> np.ndarray:
        size = x.shape[axis]
        at = np.arange(-radius, size + radius) % (2 * size)
        wide, out = np.take(x, np.where(at < size, at, 2 * size - 1 - at), axis), np.zeros(x.shape)
        for k, weight in enumerate(w):
            out += (wide[:, :, k : k + size] if axis == 2 else wide[:, k : k + size]) * weight
        return out

    found = []
    for s in sigmas:
        g, d = weights(s, radius)
        found.append((weighed(weighed(values, g, 2), d, 1) + weighed(weighed(values, d, 2), g, 1)) * -(s * s))
    return np.stack(found, 1)


def grid_blobs(frames: DataFrame, key: list[str], values: str, width: int, sigmas: list[float], *, threshold: float = 0.2, overlap: float | None = 0.5) -> DataFrame:
    """blobs() of frames whose pixels are an array, row by row, `width` in each; a null pixel is 0, a last row that is not full is filled
    with 0. A frame without pixels has none. Frames are weighed where they are read, a bounded number at once."""
    kinds = dict(frames.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(key))
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]):
                alike, height = np.flatnonzero(sizes == size), -(-int(size) // width)
                step = max(1, PIXELS // (height * width))
                for lo in range(0, len(alike), step):
                    own = alike[lo : lo + step]
                    flat = pa.compute.fill_null(lists.take(pa.array(own)).flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(len(own), size)
                    found = grid_responses(np.pad(flat, ((0, 0), (0, height * width - size))).reshape(len(own), height, width), sigmas)
                    most = found
                    for axis in (1, 2, 3):
                        room = np.pad(most, [(0, 0)] * axis + [(1, 1)] + [(0, 0)] * (3 - axis), constant_values=-np.inf)
                        n = most.shape[axis]
                        most = np.max([np.take(room, range(k, k + n), axis) for k in range(3)], 0)
                    frame, scale, row, col = np.nonzero((found == most) & (found > threshold))
                    keys = [batch.column(k).take(pa.array(own[frame])) for k in range(len(key))]
                    made = [scale.astype(np.int32), np.array(sigmas, float)[scale], row.astype(np.int32), col.astype(np.int32), found[frame, scale, row, col]]
                    yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, made)], [*key, "scale", "sigma", "row", "col", "response"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "scale int, sigma double, row int, col int, response double"])
    peaks = frames.select(*key, F.col(values).cast("array<double>")).mapInArrow(run, schema)
    return peaks if overlap is None else _apart(peaks, key, overlap)


def _apart(peaks: DataFrame, key: list[str], overlap: float) -> DataFrame:
    """The peaks that share no more than `overlap` of their discs with a larger one of their frame."""
    larger = peaks.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("sigma").alias("_s"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    first = (F.col("_s") > F.col("sigma")) | ((F.col("_s") == F.col("sigma")) & (F.struct("_r", "_c") < F.struct("row", "col")))
    # The distance bounds the pairs of a frame: discs that don't touch share nothing.
    close = F.pow(F.col("row") - F.col("_r"), 2) + F.pow(F.col("col") - F.col("_c"), 2) < F.pow((F.col("sigma") + F.col("_s")) * F.sqrt(F.lit(2.0)), 2)
    condition = first & close & (_shared() > overlap)
    for c in same:
        condition = condition & c
    return peaks.join(larger, condition, "left_anti")


def _shared() -> Column:
    """The share of the smaller disc (sigma, row, col) that the larger one (_s, _r, _c) covers."""
    r, big = F.col("sigma") * F.sqrt(F.lit(2.0)), F.col("_s") * F.sqrt(F.lit(2.0))
    d = F.sqrt(F.pow(F.col("row") - F.col("_r"), 2) + F.pow(F.col("col") - F.col("_c"), 2))
    one = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    a = F.acos(one((d * d + r * r - big * big) / (2 * d * r)))
    b = F.acos(one((d * d + big * big - r * r) / (2 * d * big)))
    lens = r * r * a + big * big * b - 0.5 * F.sqrt(F.greatest(F.lit(0.0), (-d + r + big) * (d + r - big) * (d - r + big) * (d + r + big)))
    return F.when(d <= big - r, 1.0).when(d == 0, 1.0).otherwise(lens / (F.pi() * r * r))
