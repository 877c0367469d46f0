"""Which rows of a group: largest, first, several, a sample; filters over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax_ties(df: DataFrame, key: list[str], value: str, where: Column | None = None) -> DataFrame:
    """All rows that reach their group's largest value. The filter comes before the choice, which Catalyst would not reorder."""
    df = df if where is None else df.where(where)
    return df.withColumn("_most", F.max(value).over(Window.partitionBy(*key))).where(F.col(value) == F.col("_most")).drop("_most")


def argmax_single(df: DataFrame, key: list[str], value: str, tie: list[str], where: Column | None = None) -> DataFrame:
    """One row for each group: the largest value, on a tie the first by `tie`."""
    df = df if where is None else df.where(where)
    order = Window.partitionBy(*key).orderBy(F.col(value).desc(), *tie)
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def top_k(df: DataFrame, key: list[str], order: list, k: int, rank: str = "nth") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def first_rows(df: DataFrame, ordinal: str, k: int) -> DataFrame:
    """The first k rows by an explicit ordinal, not by whatever order rows arrive in."""
    return df.orderBy(ordinal).limit(k)


def at_least(df: DataFrame, key: list[str], more_than: int) -> DataFrame:
    """Rows of groups with more than so many rows."""
    big = df.groupBy(*key).count().where(F.col("count") > more_than).drop("count")
    return df.join(big, key, "left_semi")


def clip_sigma(df: DataFrame, value: str, key: list[str] = (), sigmas: float = 3.0) -> DataFrame:
    """Rows within so many population deviations of their group's mean; nulls and NaN go first. Sums meet before the rows are read again."""
    df = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    stats = df.groupBy(*key).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    both = df.join(stats, list(key)) if key else df.join(F.broadcast(stats))  # one row
    return both.where(F.abs(F.col(value) - F.col("_mean")) < sigmas * F.col("_sd")).drop("_mean", "_sd")


def sample(df: DataFrame, key: list[str], id: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group without replacement, by the order of a seeded hash of the id: the same rows on each run."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string")))
    return top_k(df, key, [order, id], k, "_nth").drop("_nth")


def sample_with_replacement(df: DataFrame, key: list[str], id: str, k: int, seed: int = 0) -> DataFrame:
    """k draws from each group: draw i takes the row whose rank is a seeded hash of the group and i, modulo the group's size."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(id)) - 1)
    draws = df.groupBy(*key).count().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k))))
    draws = draws.withColumn("_nth", F.pmod(F.xxhash64(F.lit(seed), *key, "draw"), F.col("count")).cast("int")).drop("count")
    return draws.join(ranked, [*key, "_nth"]).drop("_nth")


def isodata_threshold(df: DataFrame, value: str, bins: int = 256, lo: float | None = None, hi: float | None = None) -> float:
    """The threshold that lies midway between the means below and above it, from a histogram of fixed size made by Spark."""
    if lo is None or hi is None:
        lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None or lo == hi:
        return lo
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    counts = {int(r[0]): r[1] for r in df.where(F.col(value).isNotNull()).groupBy(at.alias("b")).count().collect()}
    middle = [lo + (k + 0.5) * (hi - lo) / bins for k in range(bins)]
    for k in range(bins - 1):
        low, high = sum(counts.get(j, 0) for j in range(k + 1)), sum(counts.get(j, 0) for j in range(k + 1, bins))
        if not low or not high:
            continue
        mean = (sum(counts.get(j, 0) * middle[j] for j in range(k + 1)) / low + sum(counts.get(j, 0) * middle[j] for j in range(k + 1, bins)) / high) / 2
        if middle[k] <= mean < middle[k + 1]:
            return middle[k]
    return middle[bins // 2]


def whole_batches(df: DataFrame, key: list[str], frame: str, batch: int) -> DataFrame:
    """Rows of the batches that a reader of fixed batches starts with range(0, n - batch, batch): the rest of a recording is left out."""
    counts = df.groupBy(*key).agg(F.count("*").alias("_n"))
    last = batch * F.ceil(F.greatest(F.col("_n") - batch, F.lit(0)) / F.lit(batch))
    return df.join(counts, key).where(F.col(frame) < last).drop("_n")


def widest_region(found: DataFrame, bound: int | None = None, key: tuple[str, ...] = ("filename", "frame_num")) -> DataFrame:
    """Of the regions (key, label, minrow, mincol, maxrow, maxcol, ...) of each frame the widest of those that are narrower than the
    bound; of equal ones the first label, of these the rightmost. A frame without such a region gives no row."""
    width = F.col("maxcol") - F.col("mincol")
    rows = found if bound is None else found.where(width < bound)
    best = F.max_by(F.struct(*found.columns), F.struct(width, -F.col("label"), "mincol"))
    return rows.groupBy(*key).agg(best.alias("_best")).select("_best.*")
