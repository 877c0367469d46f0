"""Series ordered by frame: derivatives, offsets, ranks, rolling statistics, smoothing and outliers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def _by(key: list[str], order: str):
    return Window.partitionBy(*key).orderBy(order)


def forward_derivative(df: DataFrame, key: list[str], x: str, y: str, out: str = "derivative") -> DataFrame:
    """Change to the next row over the step, on the earlier row; a series' last row has none and goes."""
    w = _by(key, x)
    return df.withColumn(out, (F.lead(y).over(w) - F.col(y)) / (F.lead(x).over(w) - F.col(x))).where(F.col(out).isNotNull())


def backward_derivative(df: DataFrame, key: list[str], x: str, y: str, out: str = "derivative") -> DataFrame:
    """The same on the later row; a series' first row goes."""
    w = _by(key, x)
    return df.withColumn(out, (F.col(y) - F.lag(y).over(w)) / (F.col(x) - F.lag(x).over(w))).where(F.col(out).isNotNull())


def rebase(df: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.min(value).over(Window.partitionBy(*key)))


def elapsed(df: DataFrame, key: list[str], frame: str, rate: Column, out: str = "elapsed_time") -> DataFrame:
    """Seconds since the series' first frame; null where the rate is null or 0."""
    return df.withColumn(out, F.try_divide((F.col(frame) - F.min(frame).over(Window.partitionBy(*key))).cast("double"), rate.cast("double")))


def numbered(df: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """df with each row's 0-based number in its key's rows, in ascending order. Rows are dealt into sorted ranges over keys and order,
    and written; a range numbers its own rows after those of the same key in the ranges before it. No key is sorted in one task."""
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*key, *order, "_tie").withColumn("_range", F.spark_partition_id())
    rows = written(rows, "ranges").withColumn("_key", F.to_json(F.struct(*key)) if key else F.lit(""))
    sizes = rows.groupBy("_key", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select("_key", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_key", "_range").orderBy(*order, "_tie")) - 1
    return rows.withColumn("_nth", nth).join(sizes, ["_key", "_range"]).withColumn(out, F.col("_before") + F.col("_nth")).drop("_key", "_range", "_nth", "_before", "_tie")


def factorize(df: DataFrame, value: str, out: str) -> DataFrame:
    """0-based numbers of the sorted distinct values; rows without a value go."""
    names = numbered(df.select(value).distinct().where(F.col(value).isNotNull()), [], [value], out)
    return df.join(names.withColumn(out, F.col(out).cast("int")), value)


def average_rank(df: DataFrame, value: str, out: str = "avg_rank", ranges: int = 200) -> DataFrame:
    """Ranks with the mean for ties, of a numeric column; nulls have none and go.

    Neither rows nor distinct values are sorted in one task: approximate quantiles, a fixed number of them, cut the values into
    ranges; a range's rows before it and the running count inside it give the rank. Where the cuts lie does not change the result.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    cuts = counts.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)])).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    counts = counts.withColumn("_range", at)
    sums = counts.groupBy("_range").agg(F.sum("_n").alias("_rows"))  # at most `ranges` rows
    sums = sums.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.withColumn("_upto", upto).join(sums, "_range")
    ranks = ranks.select(value, (F.col("_before") + F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, value)


def rolling_variance(df: DataFrame, key: list[str], order: str, value: str, before: int = 15, after: int = 14, out: str = "variance") -> DataFrame:
    return df.withColumn(out, F.var_pop(value).over(_by(key, order).rowsBetween(-before, after)))


def local_slope(df: DataFrame, key: list[str], x: str, y: str, half: int = 5, out: str = "slope") -> DataFrame:
    """The slope of a straight line through the rows around each row."""
    return df.withColumn(out, F.regr_slope(y, x).over(_by(key, x).rowsBetween(-half, half)))


def per_recording(df: DataFrame, key: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """kernel for each recording. A group is one task's, so this is for groups of bounded size."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), columns])

    def run(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = kernel(rows)
        for at, (k, v) in enumerate(zip(key, name, strict=True)):
            out.insert(at, k, v)
        return out

    return df.groupBy(*key).applyInPandas(run, schema)


def row_by_row(df: DataFrame, key: list[str], order: list[str], kernel: Callable[[pa.Table, np.ndarray], list], columns: str, many: int = 1 << 15) -> DataFrame:
    """df with the columns that kernel makes, a value for each row. It gets rows of whole recordings, each in ascending order, and the
    bounds of the recordings among them. Short recordings are one call, of about `many` rows; a recording is in memory whole, so theirs must
    be bounded."""
    rows = df.select((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1).alias("_first"), "*")
    names = [*df.columns, *(c.split()[0].strip("`") for c in columns.split(", "))]

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held).combine_chunks()
        bounds = np.append(np.flatnonzero(part.column(0).to_numpy()), len(part))
        own = part.drop_columns(["_first"])
        yield from pa.Table.from_arrays([*own.columns, *(pa.array(c) for c in kernel(own, bounds))], names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(0).to_numpy(zero_copy_only=False))
            last = starts[-1] if len(starts) else 0
            if last + sum(b.num_rows for b in held) >= many and len(starts):
                yield from made([*held, batch.slice(0, last)])
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield from made(held)

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), columns]))


#: A recording of more points is smoothed in blocks of so many.
WHOLE = 8192


def _same(key: list[str], other: DataFrame, prefix: str = "_k_") -> tuple[DataFrame, Column]:
    """other with its key columns renamed, and the condition that they equal the key's, nulls included."""
    condition = F.lit(True)
    for k in key:
        condition = condition & F.col(k).eqNullSafe(F.col(prefix + k))
    return other.withColumnsRenamed({k: prefix + k for k in key}), condition


def smoothed(df: DataFrame, key: list[str], x: str, y: str, fraction: float = 0.5, degree: int = 1, robust: int = 2, whole: int = WHOLE) -> DataFrame:
    """Key, x, y and `smooth`: the local regression of y on x for each recording, rows without x or y left out.

    A recording of up to `whole` points is one group. A longer one is cut into blocks of so many points in order of x, each with the
    neighbours that its points can have on both sides; the fits are the same, and so is the reweighting, whose medians come from
    numbered residuals.
    """
    from ..functions.kernels import loess

    rows = df.select(*key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(~(F.col(x).isNull() | F.isnan(x) | F.col(y).isNull() | F.isnan(y)))
    sizes = written(rows.groupBy(*key).agg(F.count("*").alias("_n")), "sizes")
    long, same = _same(key, sizes.where(F.col("_n") > whole))
    schema = f"`{x}` double, `{y}` double, smooth double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([x, y], kind="stable")
        return pd.DataFrame({x: part[x], y: part[y], "smooth": loess(part[x].to_numpy(float), part[y].to_numpy(float), fraction, degree, robust)})

    if long.isEmpty():
        return per_recording(rows, key, run, schema)
    short = per_recording(rows.join(long.drop("_n"), same, "left_anti"), key, run, schema)
    return short.unionByName(_smoothed_in_blocks(rows.join(long, same).select(*key, x, y, "_n"), key, x, y, fraction, degree, robust, whole))


def _smoothed_in_blocks(rows: DataFrame, key: list[str], x: str, y: str, fraction: float, degree: int, robust: int, block: int) -> DataFrame:
    from ..functions.kernels import local_fits, neighbours_of

    kinds = dict(rows.dtypes)
    now = written(numbered(rows, key, [x, y], "_at").withColumns({"_fit": F.col(y), "_trust": F.lit(1.0)}), "numbered")
    k = F.least(F.col("_n"), F.greatest(F.lit(degree + 1).cast("long"), F.ceil(F.lit(fraction) * F.col("_n"))))
    first, last = F.floor(F.greatest(F.lit(0), F.col("_at") - k) / F.lit(block)), F.floor(F.least(F.col("_n") - 1, F.col("_at") + k) / F.lit(block))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at", kind="stable")
        at = part["_at"].to_numpy()
        own = np.flatnonzero(at // block == part["_block"].iloc[0])
        fit = local_fits(part[x].to_numpy(), part[y].to_numpy(), part["_trust"].to_numpy(), own, neighbours_of(int(part["_n"].iloc[0]), fraction, degree), degree)
        out = part.iloc[own]
        return pd.DataFrame({x: out[x], y: out[y], "_n": out["_n"], "_at": out["_at"], "_fit": np.where(np.isnan(fit), out["_fit"], fit)})

    for turn in range(robust + 1):
        dealt = now.withColumn("_block", F.explode(F.sequence(first, last)))
        made = per_recording(dealt, [*key, "_block"], run, f"`{x}` double, `{y}` double, _n long, _at long, _fit double").drop("_block")
        made = written(made.select(*[F.col(c).cast(kinds[c]).alias(c) for c in key], x, y, "_n", "_at", "_fit"), "fits")
        if turn == robust:
            break
        residual = made.withColumn("_r", F.abs(F.col(y) - F.col("_fit")))
        ranked = numbered(residual.select(*key, "_n", "_r"), key, ["_r"], "_place")
        middle = (F.col("_place") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_place") == F.floor(F.col("_n") / 2))
        scale = ranked.where(middle).groupBy(*key).agg((6 * F.avg("_r")).alias("_scale"))
        tops = residual.groupBy(*key).agg(F.max(F.abs(F.col(y))).alias("_top"))
        tops, same = _same(key, tops, "_t_")
        scale = scale.join(tops, same).select(*key, "_scale", "_top")
        scale, same = _same(key, scale)
        kept = F.when(F.col("_scale") <= 1e-12 * (F.col("_top") + 1e-300), 1.0).otherwise(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.pow(F.try_divide(F.col("_r"), F.col("_scale")), 2))), 2))
        now = written(residual.join(scale, same).select(*key, x, y, "_n", "_at", "_fit", F.coalesce(kept, F.lit(1.0)).alias("_trust")), "trusted")
    return made.select(*key, x, y, F.col("_fit").alias("smooth"))


def support_fit(df: DataFrame, key: list[str], x: str, y: str, c: float = 0.9) -> DataFrame:
    """Key, x, y and `smooth` from a support vector regression with a radial kernel for each recording, rows without x or y left out. The
    fit goes through a recording's points again and again and can't be split; a recording is bounded by the length of one video. Many
    recordings are fitted side by side."""
    from ..functions.kernels import support_vectors

    rows = df.select(*key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(~(F.col(x).isNull() | F.isnan(x) | F.col(y).isNull() | F.isnan(y)))

    def run(part: pa.Table, bounds: np.ndarray) -> list:
        return [support_vectors(part.column(x).to_numpy(), part.column(y).to_numpy(), bounds, c)]

    return row_by_row(rows, key, [x], run, "smooth double")
