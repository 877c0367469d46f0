"""From measurements to statistics, as one plan keyed by recording and frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import selection, statistics, tracks


def track(meniscus: DataFrame, proboscis: DataFrame, sure: float = 0.5, smooth: bool = True) -> DataFrame:
    """Frames that both tracks have: of the proboscis the lowest sure regions, ties kept, with the meniscus' position and derivative."""
    lowest = selection.argmax_ties(proboscis, ["filename", "frame_num"], "maxrow", F.col("intensity_mean") > sure)
    if smooth:
        fitted = tracks.smoothed(meniscus, ["filename"], "frame_num", "centroid_row_m").select("filename", F.col("frame_num").cast("bigint").alias("frame_num"), "smooth")
        meniscus = meniscus.join(fitted, ["filename", "frame_num"]).withColumn("centroid_row_m", F.col("smooth")).drop("smooth")
    moving = tracks.forward_derivative(meniscus, ["filename"], "frame_num", "centroid_row_m")
    return lowest.join(moving, ["filename", "frame_num"])


def with_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Submergence in millimetres, rate in volume a second and elapsed time. units: filename, px, framerate; a missing px is the mean of the others' scales."""
    scales = units.select("filename", "framerate", scalars.lin_scale(F.col("px")).alias("lin"), scalars.vol_scale(F.col("px")).alias("vol"))
    mean = scales.agg(F.avg("lin").alias("_lin"), F.avg("vol").alias("_vol"))
    scales = scales.join(F.broadcast(mean)).select("filename", "framerate", F.coalesce("lin", "_lin").alias("lin"), F.coalesce("vol", "_vol").alias("vol"))
    out = rows.join(scales, "filename").withColumn("submergence_raw", F.col("maxrow") - F.col("centroid_row_m"))
    out = out.withColumn("submergence", F.col("submergence_raw") * F.col("lin")).withColumn("rate", F.col("derivative") * F.col("vol") * F.col("framerate"))
    return tracks.elapsed(out, ["filename"], "frame_num", F.col("framerate")).withColumn("mothname", scalars.animal_name(F.col("filename"))).withColumn("date", scalars.recording_date(F.col("filename")))


def usable(rows: DataFrame, all_living: bool = False) -> DataFrame:
    rows = rows.where(~F.col("filename").contains("delta") & ~F.col("filename").contains("Delta"))
    return rows.where(~F.col("filename").contains("dead" if all_living else "unsuitable"))


def nonnegative(rows: DataFrame) -> DataFrame:
    return rows.where("submergence >= 0 and rate >= 0")


def per_recording(rows: DataFrame, postures: DataFrame) -> DataFrame:
    """The medians of each recording with its posture; recordings without a posture have null categories."""
    middle = statistics.medians(nonnegative(usable(rows)), ["filename"])
    known = postures.select(F.concat(F.lit("data2/"), "filename").alias("filename"), F.col("isPerched").contains("yes").alias("perched"), (F.col("curled") == "yes").alias("curling"))
    out = middle.join(known, "filename", "left")
    return out.withColumn("category", scalars.category(F.col("curling"), F.col("perched"))).withColumn("flying", ~F.col("perched"))
