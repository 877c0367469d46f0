"""Tables of recordings that share one layout: bucketed and sorted by recording, so that joining them or grouping by recording moves nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import tracks

BUCKETS = 64


def save(df: DataFrame, table: str, *, by: str = "filename", order: tuple[str, ...] = ("frame_num",), buckets: int = BUCKETS) -> None:
    """df as a table of `buckets` buckets by recording. Rows are dealt into the buckets first, so each bucket is one sorted file."""
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by, *order).mode("overwrite").saveAsTable(table)


def open_layout(spark: SparkSession) -> None:
    """Lets a join on recording and frame use the layout by recording alone, and its buckets as they are."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")


def paired(left: DataFrame, right: DataFrame, *, by: str = "filename", frame: str = "frame_num", buckets: int = BUCKETS) -> DataFrame:
    """The frames that both tracks have, from two tables of one layout that are made here. What follows, joins and groups by recording,
    finds the rows where they lie."""
    spark = left.sparkSession
    open_layout(spark)
    names = [f"track_{uuid.uuid4().hex}" for _ in range(2)]
    for df, name in zip((left, right), names, strict=True):
        save(df, name, by=by, order=(frame,), buckets=buckets)
    return tracks(spark.table(names[0]), spark.table(names[1]), [by, frame])
