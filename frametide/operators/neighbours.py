"""Nearest neighbours by a table of cells, exact by bounds.

Points are cut into cells at quantiles, a few dimensions at a time, until a cell holds a bounded number of points; the cuts are made by
aggregation and each cell has a box around its points. A query first looks into its own cell, which gives it a bound; then it walks
down the boxes and visits only cells whose box comes within that bound. A cell's points are compared as arrays, and of each visit no
more than the k nearest leave the task, so no list of pairs exists anywhere. Where boxes don't help, as in many dimensions, all cells are
visited and the result is still exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: A cell of more points is cut; a cell that cannot be, as its points are alike, is dealt into parts.
CELL = 512
#: Dimensions cut at once; and a cell has up to 2**BITS cells below it, of two dimensions each in eight, of one in 64.
CUTS, BITS = 3, 6
#: Quantiles of a dimension that cuts are chosen from.
_SHARES = [k / (1 << BITS) for k in range(1, 1 << BITS)]
#: Queries that are compared with a part of a cell in one task's step.
QUERIES = 2048
#: Cells of the usual size that one step compares, one after another.
TOGETHER = 32


@dataclass
class Index:
    """cells: (frame, dim, cell, part, id, v). cuts: of each level the cuts of the cells above it; boxes: of each level its cells'. parts: the
    number of parts of each cell, None where all have one."""

    cells: DataFrame
    cuts: list[DataFrame]
    boxes: list[DataFrame]
    parts: DataFrame | None


def _usable(rows: DataFrame, frame: str) -> DataFrame:
    """(frame, dim, id, v) of the rows whose vector has components, all of them finite numbers. Unlike lengths never meet."""
    v = F.transform("v", lambda x: x.cast("double"))
    rows = rows.select(F.col(frame).alias("frame"), "id", v.alias("v")).where(F.col("frame").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))).select("frame", F.size("v").alias("dim"), "id", "v")


def _boxes(cells: DataFrame) -> DataFrame:
    """Of each cell: its number of points and, in order of dimensions, the least and the greatest component."""
    ends = cells.select("frame", "dim", "cell", F.posexplode("v").alias("at", "x")).groupBy("frame", "dim", "cell", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    sides = ends.groupBy("frame", "dim", "cell").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "lo", "hi"))).alias("s"))  # a struct a dimension
    return sides.select("frame", "dim", "cell", "n", F.transform("s", lambda x: x["lo"]).alias("lo"), F.transform("s", lambda x: x["hi"]).alias("hi"))


def _cuts(cells: DataFrame, cell: int) -> DataFrame:
    """(frame, dim, cell, cuts): of each cell with more than `cell` points the dimensions that spread most, each with as many of its
    quantiles as part it into cells of about that size."""
    each = cells.select("frame", "dim", "cell", F.posexplode("v").alias("at", "x")).groupBy("frame", "dim", "cell", "at")
    spread = each.agg(F.var_pop("x").alias("s"), F.percentile_approx("x", _SHARES, 1000).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    own = Window.partitionBy("frame", "dim", "cell")
    chosen = spread.where((F.col("n") > cell) & (F.col("lo") < F.col("hi"))).withColumn("nth", F.row_number().over(own.orderBy(F.desc("s"), "at"))).where(F.col("nth") <= CUTS)
    chosen = chosen.withColumn("m", F.count("*").over(own))
    most = F.shiftleft(F.lit(1), BITS).cast("double")
    pieces = F.ceil(F.pow(F.least(most, F.col("n") * 1.25 / cell), 1 / F.col("m")) - 1e-9)  # some cells get more than their share
    pieces = F.greatest(F.lit(2), F.least(pieces, F.floor(F.pow(most, 1 / F.col("m")) + 1e-9))).cast("int")
    places = F.transform(F.sequence(F.lit(1), F.col("p") - 1), lambda k: F.get("q", F.floor(k * (1 << BITS) / F.col("p")).cast("int") - 1))
    # A quantile at the low end would leave one side empty; if all are, the cut is just above it.
    chosen = chosen.withColumn("p", pieces).withColumn("q", F.filter(F.array_distinct(places), lambda x: x > F.col("lo")))
    q = F.when(F.size("q") > 0, F.col("q")).otherwise(F.array((F.col("lo") + F.col("hi")) / 2))
    return chosen.groupBy("frame", "dim", "cell").agg(F.sort_array(F.collect_list(F.struct("nth", "at", q.alias("q")))).alias("cuts"))  # CUTS at most


def _below(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows, each in the cell below its own. A cell without cuts has one below it, numbered as if all went to the low side."""
    side = lambda c: F.size(F.filter(c["q"], lambda m: F.get("v", c["at"]) >= m))
    bits = F.aggregate("cuts", F.lit(0).cast("long"), lambda acc, c: acc * F.floor(F.pow(F.lit(float(1 << BITS)), 1 / F.size("cuts")) + 1e-9) + side(c))
    out = rows.join(cuts, ["frame", "dim", "cell"], "left")
    return out.withColumn("cell", F.col("cell") * (1 << BITS) + F.coalesce(bits, F.lit(0).cast("long"))).drop("cuts")


def index(points: DataFrame, frame: str, *, cell: int = CELL) -> Index:
    """Cells of points (frame, id, v). Each level costs an aggregation and a join; there are log(rows / cell) / log(64) of them, none
    where no frame has more points than a cell."""
    rows = written(_usable(points, frame).withColumn("cell", F.lit(0).cast("long")), "points")
    cuts, boxes, largest = [], [], rows.groupBy("frame", "dim").count().agg(F.max("count")).first()[0] or 0
    while largest > cell and len(cuts) * BITS < 60:
        made = written(_cuts(rows, cell), "cuts")
        if made.isEmpty():  # cells of points that are alike
            break
        cuts.append(made)
        rows = written(_below(rows, made), "cells")
        boxes.append(written(_boxes(rows), "boxes"))
        largest = boxes[-1].agg(F.max("n")).first()[0]
    part, parts = F.lit(0).cast("long"), None
    if largest > 4 * cell:
        parts = rows.groupBy("frame", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(4 * cell)).alias("parts"))
        rows, part = rows.join(parts, ["frame", "dim", "cell"]), F.pmod(F.xxhash64("id"), F.col("parts"))
    return Index(rows.select("frame", "dim", "cell", part.alias("part"), "id", "v"), cuts, boxes, parts)


def _gap(v: str, lo: str, hi: str) -> Column:
    """The squared distance of a vector from a box."""
    beyond = F.zip_with(v, F.arrays_zip(lo, hi), lambda x, b: F.greatest(b[lo] - x, x - b[hi], F.lit(0.0)))
    return F.aggregate(beyond, F.lit(0.0), lambda acc, x: acc + x * x)


def _compare(visits: DataFrame, found: Index, k: int, apart: bool) -> DataFrame:
    """(frame, dim, a, b, d, compared): of each visit (frame, dim, cell, a, v) the k nearest points of each part of the cell."""
    cells = found.cells
    if found.parts is None:
        asked = visits.withColumn("part", F.lit(0).cast("long"))
    else:
        asked = visits.join(found.parts, ["frame", "dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    load = visits.groupBy("frame", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("blocks"))
    asked = asked.join(load, ["frame", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("a"), "blocks")).drop("blocks")
    held = cells.join(load, ["frame", "dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    kinds = dict(cells.dtypes) | {"a": dict(visits.dtypes)["a"]}
    key = ["frame", "dim", "cell", "part"]
    buckets = -(-cells.count() // (TOGETHER * CELL)) or 1
    names = ["frame", "dim", "a", "b", "d", "compared"]

    def near(name: tuple, asking: np.ndarray, q: np.ndarray, ids: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
        order = np.argsort(ids, kind="stable")  # of equal distances the smallest id comes first
        p, ids = p[order], ids[order]
        most, out = min(k, len(ids)), []
        step = max(1, (1 << 20) // p.size)
        for lo in range(0, len(q), step):
            d = ((q[lo : lo + step, None, :] - p[None]) ** 2).sum(-1)
            if apart:
                d[asking[lo : lo + step, None] == ids[None]] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :most]
            a = np.repeat(np.arange(lo, lo + len(d)), most)
            out.append((a, near.ravel(), np.take_along_axis(d, near, 1).ravel()))
        a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
        found = np.isfinite(d)
        columns = (np.array([name[0]] * found.sum(), object), np.full(found.sum(), name[1]), asking[a[found]], ids[b[found]], d[found], np.where(np.arange(len(a)) % most == 0, len(ids), 0)[found])
        return dict(zip(names, columns, strict=True))

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(points):
            held, ids, p = points.groupby(key, sort=False).indices, points.id.to_numpy(), points.v.to_numpy()
            asking, q = queries.a.to_numpy(), queries.v.to_numpy()
            for name, at in queries.groupby([f"asked_{c}" for c in key], sort=False).indices.items():
                if name in held:
                    out.append(near(name, asking[at], np.stack(q[at]), ids[held[name]], np.stack(p[held[name]])))
        return pd.DataFrame({c: np.concatenate([x[c] for x in out]) if out else np.empty(0, object) for c in names})

    schema = f"frame {kinds['frame']}, dim int, a {kinds['a']}, b {kinds['id']}, d double, compared long"
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket")
    asked = asked.select(*[F.col(c).alias(f"asked_{c}") for c in key], bucket.alias("asked_bucket"), F.col("block").alias("asked_block"), "a", "v")  # both sides come from the cells
    return asked.groupBy("asked_bucket", "asked_block").cogroup(held.select("*", bucket).groupBy("bucket", "block")).applyInPandas(run, schema)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ranked; partial ranking in the map tasks keeps k rows a query there."""
    nth = F.row_number().over(Window.partitionBy("frame", "a").orderBy("d", "b"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def _visits(queries: DataFrame, boxes: list[DataFrame]) -> DataFrame:
    """(frame, dim, cell, a, v, home) of the cells whose box lies within a query's bound, by descending through the boxes."""
    at = queries.withColumn("_above", F.lit(0).cast("long"))
    for level in boxes:
        step = level.select("frame", "dim", F.col("cell").alias("_cell"), "lo", "hi").withColumn("_above", F.shiftright("_cell", BITS))
        at = at.join(step, ["frame", "dim", "_above"]).where(_gap("v", "lo", "hi") <= F.col("bound") * (1 + 1e-9)).drop("_above", "lo", "hi").withColumnRenamed("_cell", "_above")
    return at.withColumnRenamed("_above", "cell")


def search(queries: DataFrame, points: DataFrame | Index, frame: str, k: int = 2, *, apart: bool = False, cell: int = CELL, counted: bool = False) -> DataFrame:
    """(frame, a, nth, b, d): the k nearest points (frame, id, v) of each query (frame, id, v) by squared distance d, ties by id; nth
    counts from 1. With counted=True also `compared`, the number of points that the query was compared with.

    With apart=True a query does not find the point of its own id. Rows without a frame or id, and vectors that are null, empty or not
    finite, neither search nor are found; vectors of unlike length do not meet. Fewer than k points give fewer rows, a query without
    any gives none. Queries of one frame and id are one query and should be alike.
    """
    found = points if isinstance(points, Index) else index(points, frame, cell=cell)
    asked = _usable(queries, frame).withColumnRenamed("id", "a").withColumn("cell", F.lit(0).cast("long"))
    for cuts in found.cuts:
        asked = _below(asked, cuts)
    asked = asked.dropDuplicates(["frame", "a"])
    if found.cuts or counted:
        asked = written(asked, "queries")
    home = _compare(asked.select("frame", "dim", "cell", "a", "v"), found, k, apart)
    if found.cuts or counted:
        home = written(home, "home")
    if found.cuts:
        bound = _nearest(home, k).where(F.col("nth") == k).select("frame", "a", F.col("d").alias("bound"))
        rest = asked.withColumnRenamed("cell", "home").join(bound, ["frame", "a"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        visits = _visits(rest, found.boxes).where("cell <> home").select("frame", "dim", "cell", "a", "v")
        home = written(home.unionByName(_compare(visits, found, k, apart)), "found")
    out = _nearest(home, k).select(F.col("frame").alias(frame), "a", F.col("nth").cast("int").alias("nth"), "b", "d")
    if counted:
        out = out.join(home.groupBy(F.col("frame").alias(frame), "a").agg(F.sum("compared").alias("compared")), [frame, "a"])
    return out
