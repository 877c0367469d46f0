"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source the documents are ranged by that key: the key's leading bits name a
range, so ranges are even without sampling the data and the same on each run. The sums of the ranges, a small table, are
turned into the offset of each range; a running sum inside each range completes the distributed prefix sum. The source's exact
budget cuts that sequence, which is repeated in epochs when the budget is larger than the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, partitions, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also target. The weights repeat over the sources by code point, null last.

    No target is above max_epochs times its source; what is cut off is shared among the others by weight until none is above.
    Both come at once from one level t: target = min(max_epochs * source_size, weight * t). With the sources in order of
    max_epochs * source_size / weight, those before some point are at their limit, and t follows from the sums before it.
    The windows run over one row for each source, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # The first source that its limit does not bind sets the level for it and all after it.
    free = F.min(F.when(F.col("limit") >= F.col("weight") * F.col("level"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level"))))
    return out.withColumn("target", F.least("limit", F.col("weight") * F.coalesce(free.over(everything)["level"], F.lit(0.0)))).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    whole: bool = False,
    seed: int = 17,
    keep: bool = False,
) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, taken, and with keep=True `row`, a struct
    of all columns of docs.

    taken counts the words that the mix takes, repeats included: all epochs that end before the budget, and the leading words
    of the document at the cut, so that a source's sum is its target rounded to whole words. With whole=True the document at
    the cut is taken whole if at least half of it is inside, else not at all.
    Null and empty texts have size 0 and taken 0. A null source is a source like others. Repeated rows are separate rows; rows
    alike in id, text and source are interchangeable. An empty table gives an empty one. Other columns do not matter.
    """
    spark = docs.sparkSession
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    hashed = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")  # 60 bits
    ranges = max(64, partitions(spark))
    base = docs.select(
        F.col(id).alias("doc_id"),
        words(F.col(text)).alias("size"),
        F.col(source).alias("source"),
        hashed.alias("_key"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_source"),  # no nulls: windows and joins deal rows alike
        *([F.struct(*docs.columns).alias("row")] if keep else []),
    ).withColumn("_range", F.shiftright(F.shiftright("_key", 30) * F.lit(ranges), 30).cast("int"))
    base = written(base, "mix")  # texts are counted once; sums and windows read the sizes
    sums = base.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"), F.first("source").alias("source"))
    goal = targets(sums.groupBy("_source").agg(F.sum("_sum").alias("source_size"), F.first("source").alias("source")).drop("_source"), weights, max_epochs)
    goal = goal.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum", "source").join(goal, "_source")
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size")
    placed = base.withColumn("_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(offsets, ["_source", "_range"])
    start = F.col("_offset") + F.col("_end") - F.col("size")
    budget = F.rint("target").cast("long")
    taken = F.lit(0).cast("long")
    for epoch in range(max_epochs):
        left = budget - (start + F.lit(epoch) * F.col("source_size"))
        part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.least(left, F.col("size"))
        taken = taken + F.greatest(part, F.lit(0))
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if keep else []))


def repeated(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """The mix itself: rows of docs, as often as the mix takes them whole. Documents without words have nothing to give and go."""
    mixed = mix(docs, id=id, text=text, source=source, weights=weights, max_epochs=max_epochs, whole=True, seed=seed, keep=True)
    copies = mixed.where("taken > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("taken div size"))).alias("_copy"))
    return copies.select("row.*")
