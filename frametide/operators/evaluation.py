"""How well detections agree with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(truth: DataFrame, found: DataFrame, image: list[str], member: str) -> DataFrame:
    """Intersection over union of two sets of members (pixels) for each image. An image with both sets empty has no rows, so no value."""
    both = truth.select(*image, member).distinct().withColumn("t", F.lit(1)).join(found.select(*image, member).distinct().withColumn("f", F.lit(1)), [*image, member], "full")
    return both.groupBy(*image).agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("common"), F.count("*").alias("either")).withColumn("iou", F.try_divide("common", "either"))


def outcomes(counts: DataFrame, true: str, found: str) -> DataFrame:
    """Images with as many regions as the truth, fewer (missed) and more (false)."""
    kind = F.when(F.col(true) == F.col(found), "correct").when(F.col(true) > F.col(found), "missed").otherwise("false")
    return counts.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def tip_error(truth: DataFrame, found: DataFrame, image: str, value: str, default: float = -10.0) -> DataFrame:
    """The largest true value less the largest found one, or less a default where nothing was found."""
    t = truth.groupBy(image).agg(F.max(value).alias("t"))
    return t.join(found.groupBy(image).agg(F.max(value).alias("f")), image, "left").select(image, (F.col("t") - F.coalesce("f", F.lit(default))).alias("error"))


def best_by_frame(net: DataFrame, cls: DataFrame, key: list[str], ordinal: str, frame: str, value: str, sure: float = 0.9) -> DataFrame:
    """Regions that the network is sure of and that are darker than the background; of each frame the largest value."""
    both = net.join(cls.select(*key, ordinal, F.col("intensity_mean").alias("difference")), [*key, ordinal])
    return both.where((F.col("intensity_mean") > sure) & (F.col("difference") < 0)).groupBy(*key, frame).agg(F.max(value).alias(value))
