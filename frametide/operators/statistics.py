"""Group statistics and tests. Spark makes the sums; p-values come from them on the driver, one row for each test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import mann_whitney_p, slope_p
from .tracks import average_rank


def medians(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """The exact, interpolating median of every numeric column for each group."""
    numeric = [c for c, t in df.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") and c not in key]
    return df.groupBy(*key).agg(*[F.median(c).alias(c) for c in columns or numeric])


def ranges(df: DataFrame, key: list[str], value: str, factor: Column, out: str = "range") -> DataFrame:
    return df.groupBy(*key).agg((F.max(value) - F.min(value)).alias("_span"), F.first(factor, ignorenulls=True).alias("_f")).select(*key, (F.col("_span") * F.col("_f")).alias(out))


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds; rows where it is unknown count as not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def quartiles(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Quartiles, the ends of the whiskers at 1.5 interquartile ranges, and how many rows lie beyond them."""
    q = df.groupBy(*key).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*key, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q2"), F.col("_q")[2].alias("q3")).withColumn("_reach", 1.5 * (F.col("q3") - F.col("q1")))
    inside = F.col(value).between(F.col("q1") - F.col("_reach"), F.col("q3") + F.col("_reach"))
    return (
        df.join(q, key)
        .groupBy(*key, "q1", "q2", "q3")
        .agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("fliers"))
    )


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, key: list[str] = ()) -> DataFrame:
    """Rows in each of `bins` bins from lo to hi, the upper end included; bins without rows are absent."""
    at = F.least(F.floor((F.col(value) - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(*key, at.alias("bin")).agg(F.count("*").alias("n"))


def circular_histogram(df: DataFrame, key: list[str], angle: str, weight: str, bins: int = 36) -> DataFrame:
    """(key, bins): the weights summed by angle, an array of `bins` sums over one turn from 0; angles in radians of any size wrap around.
    Bins without rows are 0; rows without an angle or weight don't count, nor does a group of such rows only."""
    turn = F.col(angle) / F.lit(2 * math.pi)
    at = F.least(F.floor((turn - F.floor(turn)) * bins), F.lit(bins - 1)).cast("int")
    sums = df.where(F.col(angle).isNotNull() & F.col(weight).isNotNull()).groupBy(*key, at.alias("_bin")).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    each = sums.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_w"))).alias("_m"))  # `bins` entries at most
    return each.select(*key, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("bins"))


def circular_smooth(bins: Column, times: int = 6) -> Column:
    """An array as on a circle, each value the mean of itself and its two neighbours, so many times over: one weighting by the
    coefficients of (1 + x + x**2) ** times."""
    weights = [1.0]
    for _ in range(times):
        weights = [sum(weights[j] for j in range(max(0, k - 2), min(k, len(weights) - 1) + 1)) for k in range(len(weights) + 2)]
    total, n = 3.0**times, F.size(bins)
    offsets = F.array(*[F.struct(F.lit(k - times).alias("k"), F.lit(w / total).alias("w")) for k, w in enumerate(weights)])
    return F.transform(bins, lambda _, i: F.aggregate(offsets, F.lit(0.0), lambda acc, o: acc + o["w"] * F.get(bins, F.pmod(i + o["k"], n))))


def circular_peaks(bins: Column) -> Column:
    """The places of an array, as on a circle, whose value exceeds both neighbours'."""
    n = F.size(bins)
    around = lambda i, k: F.get(bins, F.pmod(i + k, n))
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(bins, i) > around(i, F.lit(-1))) & (F.get(bins, i) > around(i, F.lit(1))))


def poisson_steps(digits: int = 4) -> list[int]:
    """Of the numbers below 16 ** digits, the first that stand for weights 1, 2, ... of a Poisson variable of mean 1."""
    out, term, upto = [], math.exp(-1), 0.0
    for k in range(1, 12):
        upto += term
        term /= k
        step = math.floor(upto * 16**digits)
        if step < 16**digits:
            out.append(step)
    return out


def bootstrap_band(df: DataFrame, key: list[str], value: str, id: str, *, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(key, mean, low, high): each group's mean and the band that holds `level` of the means of its bootstrap replicates.

    A row's weight in a replicate is a Poisson variable of mean 1 from a hash of seed, id and replicate, so that replicates are made in
    the one pass that sums them, wherever the rows are, and reruns agree. Rows without a value don't count. A replicate without
    any weight has no mean; a group of one row has a band of no width. Rows that share an id share their weights.
    """
    steps, per = poisson_steps(), 8
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_x"), F.col(id).cast("string").alias("_id"))
    digest = lambda block: F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("_id", F.lit("")), block.cast("string")))
    hashed = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // per)))).withColumn("_h", digest(F.col("_block")))
    halves = [F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"_u{k}") for k in range(per // 2)]
    number = lambda k: F.shiftright(f"_u{k // 2}", 16) if k % 2 == 0 else F.col(f"_u{k // 2}").bitwiseAND(65535)
    weight = lambda k: sum(((number(k) >= s).cast("int") for s in steps[1:]), (number(k) >= steps[0]).cast("int"))
    # a block's replicates are summed side by side, so a row meets the aggregation once for all of them
    drawn = hashed.select(*key, "_x", "_block", *halves).select(*key, "_x", "_block", *[weight(k).alias(f"_w{k}") for k in range(per)])
    sums = drawn.groupBy(*key, "_block").agg(*[F.sum(f"_w{k}").alias(f"_n{k}") for k in range(per)], *[F.sum(F.col(f"_w{k}") * F.col("_x")).alias(f"_s{k}") for k in range(per)])
    each = F.array(*[F.struct((F.col("_block") * per + k).alias("_r"), F.try_divide(f"_s{k}", f"_n{k}").alias("_m")) for k in range(per)])
    means = sums.select(*key, F.inline(each)).where((F.col("_r") < replicates) & F.col("_m").isNotNull())
    tail = (1 - level) / 2
    band = means.groupBy(*key).agg(F.percentile("_m", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q")).select(*[F.col(k).alias(f"_{k}") for k in key], "_q")
    whole = rows.groupBy(*key).agg(F.avg("_x").alias("mean"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return whole.join(band, same, "left").select(*key, "mean", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"))


def biased_median(df: DataFrame, key: list[str], value: str, out: str = "median") -> DataFrame:
    """The histogram median of the frame averager: the least value with more than floor((n + 1) / 2) values at or below it; 255 for one row or none.

    It runs over distinct values and their counts, which partial aggregation makes small.
    """
    counts = df.groupBy(*key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*key)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    above = F.min(F.when((F.col("_upto") > F.floor((F.col("_n") + 1) / 2)) & (F.col("_n") > 1), F.col(value)))
    return counts.groupBy(*key).agg(F.coalesce(above, F.lit(255).cast(dict(df.dtypes)[value])).alias(out))


def regression(df: DataFrame, x: str, y: str, key: list[str] = ()) -> DataFrame:
    """n, slope, intercept, r, stderr and intercept_stderr of the line through (x, y)."""
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*key).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.avg(x).alias("_mean"),
    )
    left = F.greatest(F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"), F.lit(0.0))
    sums = sums.withColumn("stderr", F.sqrt(F.try_divide(left, (F.col("n") - 2) * F.col("_sxx"))))
    spread = F.sqrt(F.col("_sxx") / F.col("n") + F.col("_mean") * F.col("_mean"))
    return sums.withColumn("intercept_stderr", F.col("stderr") * spread).drop("_sxx", "_syy", "_mean")


def regression_test(df: DataFrame, x: str, y: str, alternative: str = "two-sided") -> dict:
    """One regression with its p-value."""
    row = regression(df, x, y).first().asDict()
    return row | {"p": slope_p(row["r"], row["n"], alternative)}


def residuals(df: DataFrame, x: str, y: str, out: str = "residual") -> DataFrame:
    """y less the line through all rows. The line is one row that is sent to all others."""
    line = df.agg(F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"))
    return df.join(F.broadcast(line)).withColumn(out, F.col(y) - (F.col("_b") + F.col("_a") * F.col(x))).drop("_a", "_b")


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """For two groups: n and U of each, and the tie term of the pooled values."""
    ranked = average_rank(df.where(F.col(group).isNotNull()).select(group, value), value)
    ties = ranked.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("avg_rank").alias("_sum"))
    return sums.select(group, "n", (F.col("_sum") - F.col("n") * (F.col("n") + 1) / 2.0).alias("u")).join(F.broadcast(ties))


def mann_whitney(df: DataFrame, group: str, value: str, greater: object, less: object) -> dict:
    """The one-sided test that values of one group exceed those of another."""
    rows = {r[group]: r for r in rank_sums(df.where(F.col(group).isin(greater, less)), group, value).collect()}
    a, b = rows.get(greater), rows.get(less)
    if a is None or b is None:
        return {"u": None, "p": None}
    return {"u": a["u"], "p": mann_whitney_p(a["u"], a["n"], b["n"], a["ties"])}
