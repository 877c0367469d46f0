"""Rigid motions between pairs of frames, robust against wrong matches.

Hypotheses are rows: each is fitted to a few matches that a seeded hash picks, and its consensus is a count by aggregation. All pairs of
frames and all hypotheses are worked out at once; nothing is fitted in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIALS, SAMPLES, RESIDUAL = 250, 4, 0.5


def _motion() -> list[Column]:
    """The rotation and translation that take (x, y) to (u, v) with the least squares, as aggregates; null where all points coincide."""
    a = F.covar_pop("x", "u") + F.covar_pop("y", "v")
    b = F.covar_pop("x", "v") - F.covar_pop("y", "u")
    size = F.nullif(F.sqrt(a * a + b * b), F.lit(0.0))
    cos, sin = a / size, b / size
    return [cos.alias("c"), sin.alias("s"), (F.avg("u") - (cos * F.avg("x") - sin * F.avg("y"))).alias("tx"), (F.avg("v") - (sin * F.avg("x") + cos * F.avg("y"))).alias("ty")]


def _error() -> Column:
    """The squared distance of a match's end from where the motion (c, s, tx, ty) takes its start."""
    du = F.col("c") * F.col("x") - F.col("s") * F.col("y") + F.col("tx") - F.col("u")
    dv = F.col("s") * F.col("x") + F.col("c") * F.col("y") + F.col("ty") - F.col("v")
    return du * du + dv * dv


def _draw(seed: int, *parts: Column) -> Column:
    """A number of [0, 1) from a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rigid_motions(matches: DataFrame, pair: str, id: str, *, trials: int = TRIALS, samples: int = SAMPLES, residual: float = RESIDUAL, seed: int = 0) -> DataFrame:
    """(pair, n, inliers, angle, tx, ty) for each pair of frames with matches (pair, id, x, y, u, v): the motion (x, y) -> (u, v).

    Each of `trials` hypotheses is fitted to `samples` different matches, one from each stratum of the pair's matches in an order shuffled by a hash of their ids.
    That with most matches nearer than `residual` wins, of equal ones that with the least sum of squares, then the first; the motion
    is fitted again to its inliers. A pair with fewer matches than `samples`, or whose hypotheses all coincide in a point or have no
    inlier, keeps its row with 0 inliers and no motion. Matches with a null in pair or a coordinate don't count; matches alike in id are
    in order of their coordinates. A pair's matches are bounded by what one frame holds.
    """
    rows = matches.select(F.col(pair).alias("pair"), F.col(id).alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")]).dropna(subset=["pair", "x", "y", "u", "v"])
    whole = Window.partitionBy("pair")
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pair").cast("string"), F.col("id").cast("string")))
    rows = rows.withColumn("nth", F.row_number().over(whole.orderBy(shuffled, "id", "x", "y", "u", "v")) - 1)
    sizes = rows.groupBy("pair").agg(F.count("*").alias("n"))

    asked = sizes.where(F.col("n") >= samples).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    place = F.floor((F.col("k") + _draw(seed, F.col("pair"), F.col("trial"), F.col("k"))) * F.col("n") / F.lit(samples)).cast("int")
    picked = asked.select("pair", "trial", F.least(place, (F.col("n") - 1).cast("int")).alias("nth")).join(rows, ["pair", "nth"])
    guesses = picked.groupBy("pair", "trial").agg(*_motion()).where("c is not null")
    guesses = guesses.groupBy("pair").agg(F.collect_list(F.struct("trial", "c", "s", "tx", "ty")).alias("guesses"))  # `trials` at most

    tried = rows.join(guesses, "pair").select("pair", "x", "y", "u", "v", F.inline("guesses"))
    near = _error() < residual * residual
    votes = tried.groupBy("pair", "trial").agg(F.count_if(near).alias("inliers"), F.sum(_error()).alias("sum"), *[F.first(c).alias(c) for c in ("c", "s", "tx", "ty")])
    best = votes.where("inliers > 0").groupBy("pair").agg(F.max_by(F.struct("inliers", "c", "s", "tx", "ty"), F.struct("inliers", -F.col("sum"), -F.col("trial"))).alias("best")).select("pair", "best.*")

    inside = rows.join(best, "pair").where(near).select("pair", "x", "y", "u", "v", "inliers")
    fitted = inside.groupBy("pair").agg(F.first("inliers").alias("inliers"), *_motion())
    out = sizes.join(fitted, "pair", "left")
    return out.select(F.col("pair").alias(pair), "n", F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"), F.atan2("s", "c").alias("angle"), "tx", "ty")


def moved(points: DataFrame, motions: DataFrame, pair: str, x: str, y: str) -> DataFrame:
    """points with their coordinates moved, and `aligned`: false where their pair has no motion, which leaves them where they are."""
    m = motions.select(F.col(pair).alias("_pair"), F.cos("angle").alias("_c"), F.sin("angle").alias("_s"), F.col("tx").alias("_tx"), F.col("ty").alias("_ty"))
    out = points.join(m, F.col(pair) == F.col("_pair"), "left").withColumn("aligned", F.col("_c").isNotNull())
    new_x = F.when(F.col("aligned"), F.col("_c") * F.col(x) - F.col("_s") * F.col(y) + F.col("_tx")).otherwise(F.col(x))
    new_y = F.when(F.col("aligned"), F.col("_s") * F.col(x) + F.col("_c") * F.col(y) + F.col("_ty")).otherwise(F.col(y))
    return out.withColumns({x: new_x, y: new_y}).drop("_pair", "_c", "_s", "_tx", "_ty")
