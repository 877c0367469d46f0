"""Near-duplicate embeddings by lattice hashing.

Random projections take a unit vector to a few times eight dimensions, where each eight are decoded to the nearest point of the E8
lattice; the points together name a cell, and several tables use several projections. A vector lies in its own cell and probes the
nearest neighbouring ones. Vectors that meet in a cell, at least one of them at home there, are compared by their exact cosine. The
more vectors, the more points a cell has, so that cells stay small. Cells are compared in blocks of bounded size, which give counts and
spanning edges, never their pairs. Equal vectors are one node with a count.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, mix, partitions, shared_dir, written

COSINE = 0.93
BLOCK = 1024


@dataclass(frozen=True)
class Plan:
    """E8 points of a cell, tables, probes of a vector in each, and the scale of 64 dimensions."""

    points: int
    tables: int
    probes: int
    scale: float


#: (most vectors of one label, plan). All miss about one true link in a thousand at the threshold; unrelated vectors meet with a chance
#: of about 3, 0.4, 0.03 and 0.002 %. README has figures by dimension.
PLANS = ((1_000, Plan(1, 5, 4, 5.0)), (200_000, Plan(2, 8, 6, 3.5)), (20_000_000, Plan(3, 14, 10, 3.25)), (None, Plan(4, 20, 12, 3.0)))


def plan_for(vectors: int) -> Plan:
    return next(plan for most, plan in PLANS if most is None or vectors <= most)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minuses."""
    pairs = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where the rounded sum is odd, the worst coordinate is rounded the other way."""
    near = np.rint(x)
    odd = near.sum(1) % 2 != 0
    worst = np.abs(x - near).argmax(1)
    rows = np.arange(len(x))
    near[rows, worst] += np.where(odd, np.where(x[rows, worst] >= near[rows, worst], 1, -1), 0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: the even-sum integer points, or the same moved by 1/2, whichever is nearer."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, plan: Plan) -> np.ndarray:
    """64-bit names of cells, (rows, tables, 1 + probes): the vector's own cell first, then those it probes.

    Eight of few dimensions hold more of a vector than eight of many, so the scale follows the root of the dimension. Vectors of fewer
    dimensions than the plan's points need are wholly in fewer points; what is left of a plan's tables and probes stays.
    """
    dim = unit.shape[1]
    points = max(1, min(plan.points, dim // 8))
    scale = (plan.scale if points == plan.points else PLANS[points - 1][1].scale) * (dim / 64) ** 0.5
    out = []
    for t in range(plan.tables):
        rng = np.random.default_rng([dim, t])
        width = 8 * points
        frame = np.linalg.qr(rng.normal(size=(max(width, dim), width)))[0][:dim]
        y = unit @ (frame * scale) + rng.random(width) * 2
        home = np.concatenate([decode(y[:, k : k + 8]) for k in range(0, width, 8)], 1)
        toward = np.concatenate([(y - home)[:, k : k + 8] @ ROOTS.T for k in range(0, width, 8)], 1)
        nearest = np.argsort(-toward, axis=1, kind="stable")[:, : plan.probes]
        which, root = np.divmod(nearest, len(ROOTS))
        cell = np.repeat(home[:, None], 1 + plan.probes, axis=1)
        moved = cell.reshape(len(unit), 1 + plan.probes, points, 8)
        moved[np.arange(len(unit))[:, None], np.arange(plan.probes) + 1, which] += ROOTS[root]
        name = np.full(cell.shape[:2], t + 1, np.uint64)
        for k in range(width):
            name = mix(name ^ (np.rint(moved.reshape(cell.shape)[:, :, k] * 2).astype(np.int64).view(np.uint64)))
        out.append(name)
    return np.stack(out, 1)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _named(nodes: DataFrame, plan: Plan) -> DataFrame:
    """nodes (id, n, label, dim, unit, uid) with `codes`, the cells' names; label and dimension are part of a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            codes = np.empty((batch.num_rows, plan.tables * (1 + plan.probes)), np.int64)
            for dim in np.unique(dims):
                all_rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(all_rows), 1024):
                    rows = all_rows[lo : lo + 1024]
                    own = cells(_matrix(batch.column(4).take(pa.array(rows)), dim), plan)
                    salt = batch.column(2).take(pa.array(rows)).to_numpy().astype(np.int64).view(np.uint64)
                    codes[rows] = mix(own ^ mix(salt * np.uint64(2654435761) + np.uint64(dim))[:, None, None]).reshape(len(rows), -1).view(np.int64)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, "codes"])

    return nodes.mapInArrow(run, "id long, n long, label long, dim int, unit array<double>, uid long, codes array<long>")


def _meet(home: np.ndarray, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs (a, b) with the smaller number first, the one cell in which they count: their first common home, or else the first of
    either's homes, by table, that the other probes. 0 where they do not meet."""
    same = home[a] == home[b]
    out = np.where(same.any(1), home[a, same.argmax(1)], 0)
    rest = np.flatnonzero(~same.any(1))
    a, b = a[rest], b[rest]
    forth, back = (codes[b] == home[a][:, :, None]).any(2), (codes[a] == home[b][:, :, None]).any(2)
    both = forth | back
    first, rows = both.argmax(1), np.arange(len(rest))
    out[rest] = np.where(both.any(1), np.where(forth[rows, first], home[a, first], home[b, first]), 0)
    return out


def _compare(block: pa.Table, cosine: float, tables: int) -> list[tuple[int, int | None, int]]:
    """(id, None, links counted here) and (id, other, 0) for spanning edges, from one pair of blocks of one cell."""
    name, side = block.column(0)[0].as_py(), block.column("side").to_numpy()
    ids, n, order = (block.column(c).to_numpy() for c in ("id", "n", "uid"))
    unit = _matrix(block.column("unit"), block.column("dim")[0].as_py())
    width = len(block.column("codes")[0])
    codes = _matrix(block.column("codes"), width).reshape(len(ids), tables, width // tables)
    left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    out: dict[int, int] = {}
    near = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(left), 256):
        part = left[lo : lo + 256]
        near[lo : lo + 256] = unit[part] @ unit[right].T >= cosine
    i, j = np.nonzero(near)
    a, b = left[i], right[j]
    once = (order[a] < order[b]) if (side == 2).all() else (order[a] != order[b])
    a, b = a[once], b[once]
    low = order[a] < order[b]
    a, b = np.where(low, a, b), np.where(low, b, a)
    home = codes[:, :, 0]
    count = np.zeros(len(ids), np.int64)
    for lo in range(0, len(a), 1 << 16):
        x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
        mine = _meet(home, codes, x, y) == name
        np.add.at(count, x[mine], n[y[mine]])
        np.add.at(count, y[mine], n[x[mine]])
    # each vector's least neighbour, until nothing changes, gives the spanning stars
    least = ids.copy()
    while len(a):
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        if (before == least).all():
            break
    return [(int(ids[k]), None, int(count[k])) for k in np.flatnonzero(count)] + [(int(ids[k]), int(least[k]), 0) for k in np.flatnonzero(least != ids)]


def classes(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (the smallest id reachable) and kept.

    Rows link when their labels are equal and not null and their cosine in double precision is at least `cosine`. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do rows without an id or vectors of unlike
    length. Rows with equal vectors and labels link with each other; rows with one id are one node, with the links of all its vectors.
    The cosine of every link is exact; a true link is missed if its ends never meet in a cell, with a chance of about 0.001 at the
    threshold and less above, whatever the dimension and the number of rows (README has figures).
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(embedding, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    top = F.array_max(F.transform("v", F.abs))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & (top > 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    nodes = rows.where("valid").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x * x))
    nodes = nodes.withColumn("s", scaled).withColumn("norm", norm)
    nodes = nodes.select("id", "n", "label", F.size("v").alias("dim"), F.transform("s", lambda x: x / F.col("norm")).alias("unit"), F.monotonically_increasing_id().alias("uid"))  # fixed when written
    nodes = written(nodes, "vectors")
    plan = plan_for(nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    nodes = written(_named(nodes, plan), "nodes")

    places = nodes.select("uid", F.posexplode("codes").alias("at", "cell")).select("uid", "cell", (F.col("at") % (1 + plan.probes) == 0).cast("int").alias("home"))
    live = places.groupBy("cell").agg(F.count("*").alias("m"), F.sum("home").alias("homes")).where("m > 1 and homes > 0")
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    places = places.join(live, "cell").select("cell", "uid", blocks.alias("blocks")).withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    places = places.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    places = places.select("cell", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "uid")
    placed = places.join(nodes, "uid").select("cell", "lo", "hi", "side", "id", "uid", "n", "dim", "unit", "codes")
    placed = placed.repartition(partitions(spark), "cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for block in groups(batches, 3):
            out += _compare(block, cosine, plan.tables)
            if len(out) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])

    found = written(placed.mapInArrow(run, "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "id")
    parts = components(found.where("b is not null").select("a", "b"))
    own = nodes.select("id", "n").groupBy("id").agg(F.sum(F.col("n") - 1).alias("copies"))
    own = own.join(counts, "id", "left").join(parts, "id", "left")

    by_vector = rows.where("valid").groupBy(F.col("label").alias("l"), F.col("v").alias("w")).agg(F.min("vec_id").alias("id"))
    same = (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")) & F.col("valid")
    out = rows.join(by_vector, same, "left").join(own, "id", "left")
    component = F.coalesce(F.col("component"), F.col("id"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce(F.col("copies") + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
