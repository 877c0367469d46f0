"""Contiguous shards of near-equal bytes from global prefix sums.

The rows are range-sorted once, and the table with each row's range is written to the shared folder, so that every later step
sees the same ranges. The ranges' totals, a small table, give each range its offset; running sums inside the ranges complete the
global prefix sums; equal targets cut the sequence. The result follows from the order alone, not from where the ranges lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

SHARDS = 24
OVERHEAD = 8


def shard(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD, keep: bool = False) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard), and with keep=True
    `row`, a struct of all columns of docs.

    A row's size is its text's UTF-8 bytes (null: none) plus `overhead`. Rows are in order of id, null first; rows with one id
    follow by checksum and size, and rows alike in all three are interchangeable. A row goes where its middle byte falls, so a
    shard misses its target by less than the largest row. A null text has the checksum 0 of an empty one. With fewer bytes
    than shards some shards stay empty; an empty table gives an empty one. Other columns do not matter.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id).alias("doc_id"),
        (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),  # parts equal rows, so that no range holds them all
        *([F.struct(*docs.columns).alias("row")] if keep else []),
    )
    order = ["doc_id", "text_crc32", "size", "_tie"]
    ranges = max(16, partitions(docs.sparkSession))
    rows = written(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    sums = rows.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    sums = sums.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("size").over(inside)).withColumn("_nth", F.row_number().over(inside) - 1).join(sums, "_range")
    middle = 2 * (F.col("_bytes_before") + F.col("_end")) - F.col("size")
    rows = rows.withColumn("_middle", middle).withColumn("shard", F.expr(f"cast(least({shards} - 1, (_middle * {shards}) div (2 * _total)) as int)"))
    rows = rows.withColumn("_nth", F.col("_rows_before") + F.col("_nth"))
    first = rows.groupBy("shard").agg(F.min("_nth").alias("_first"))  # as many rows as shards
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.col("shard"), (F.col("_nth") - F.col("_first")).cast("long").alias("slot"), *(["row"] if keep else []))
