"""Joins of tracks with each other and with recordings' attributes."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .neighbours import search


def tracks(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Frames that both tracks have. Rows that tie for a frame fan out."""
    return left.join(right, key)


def attributes(rows: DataFrame, table: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """Left join with a table of attributes; missing ones are null or a default."""
    out = rows.join(table, key, "left")
    return out.fillna(defaults) if defaults else out


def by_suffix(rows: DataFrame, path: str, table: DataFrame, name: str, ordinal: str) -> DataFrame:
    """Each path with the first entry (by ordinal) whose name it ends with.

    A name can match only at its own length, so the join is an equi-join on the path's last characters, once for each length of
    name that occurs. There are as many lengths as the longest name has characters at most.
    """
    lengths = table.select(F.length(name).alias("_l")).distinct()
    ends = rows.select(path).distinct().join(F.broadcast(lengths), F.length(path) >= F.col("_l")).withColumn("_end", F.right(F.col(path), F.col("_l")))
    found = ends.join(table, F.col("_end") == F.col(name))
    first = found.withColumn("_nth", F.row_number().over(Window.partitionBy(path).orderBy(ordinal))).where("_nth = 1")
    return rows.join(first.drop("_nth", "_l", "_end"), path)


def unmatched(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows without an attribute, for a report or an error."""
    return rows.join(table, key, "left_anti")


def looked_up(names: DataFrame, name: str, table: DataFrame, path: str, ordinal: str, attribute: str, out: str | None = None) -> DataFrame:
    """names with an attribute of the first row of table (by ordinal) whose path ends with the name; a null one becomes the mean of the
    others, with a warning. Raises LookupError if a name has no row. The join is an equi-join on the ends of paths, once for each length
    of name; one row of counts comes to the driver."""
    lengths = names.select(F.length(name).alias("_l")).where("_l > 0").distinct()
    asked = names.select(F.col(name).alias("_name")).where(F.col(name).isNotNull()).distinct()
    ends = table.select(path, F.col(ordinal).alias("_o"), F.col(attribute).cast("double").alias("_a")).join(F.broadcast(lengths), F.length(path) >= F.col("_l"))
    found = asked.join(ends.withColumn("_end", F.right(F.col(path), F.col("_l"))), F.col("_name") == F.col("_end"), "left")
    first = found.groupBy("_name").agg(F.min_by(F.struct("_a"), F.when(F.col("_end").isNotNull(), F.col("_o"))).alias("_f"), F.count("_end").alias("_n"))
    first = written(first, "looked_up")
    counts = first.agg(F.count_if(F.col("_n") == 0).alias("missing"), F.count_if((F.col("_n") > 0) & F.col("_f._a").isNull()).alias("filled"), F.min(F.when(F.col("_n") == 0, F.col("_name"))).alias("name")).first()
    if counts.missing:
        raise LookupError(f"{counts.missing} names are in no row of the table, {counts.name!r} among them")
    if counts.filled:
        warnings.warn(f"{counts.filled} names have no {attribute} of their own; they get its mean", stacklevel=2)
    values = _filled(first, table, attribute, out or attribute)
    return names.join(values, F.col(name) == F.col("_name"), "left").drop("_name")


def _filled(first: DataFrame, table: DataFrame, attribute: str, out: str) -> DataFrame:
    mean = table.agg(F.avg(F.col(attribute).cast("double")).alias("_mean"))
    return first.join(F.broadcast(mean)).select("_name", F.coalesce("_f._a", "_mean").alias(out))


def fill_with_mean(df: DataFrame, value: str, out: str) -> DataFrame:
    """Nulls become the mean of the others: one row, sent to all."""
    return df.join(F.broadcast(df.agg(F.avg(value).alias("_mean")))).withColumn(out, F.coalesce(F.col(value).cast("double"), F.col("_mean"))).drop("_mean")


def sums(left: DataFrame, right: DataFrame, key: list[str], a: Column, b: Column) -> DataFrame:
    """Two tables, summed by key first and then joined."""
    return left.groupBy(*key).agg(a).join(right.groupBy(*key).agg(b), key)


def zipped(left: DataFrame, right: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Rows paired by their place, as far as the shorter side goes. The place is explicit in both."""
    return left.join(right, [*key, ordinal])


def paired_distances(truth: DataFrame, found: DataFrame, frame: str) -> DataFrame:
    """The distance of every true point (tx, ty) from every found one (fx, fy) of the same frame."""
    return truth.join(found, frame).withColumn("distance", F.sqrt(F.pow(F.col("tx") - F.col("fx"), 2) + F.pow(F.col("ty") - F.col("fy"), 2)))


def mutual_nearest(left: DataFrame, right: DataFrame, frame: str, *, apart: bool = False) -> DataFrame:
    """(frame, a, b, d): descriptors (frame, id, v) that are each other's nearest; ties go to the smaller id. With apart=True a
    descriptor does not meet the one of its own id. The way back is made only for those that are someone's nearest."""
    forth = written(search(left, right, frame, 1, apart=apart).drop("nth"), "forth")
    chosen = right.join(forth.select(frame, F.col("b").alias("id")).distinct(), [frame, "id"], "left_semi")
    back = search(chosen, left, frame, 1, apart=apart).select(frame, F.col("a").alias("b"), F.col("b").alias("a"))
    return forth.join(back, [frame, "a", "b"])


def ratio_matches(left: DataFrame, right: DataFrame, frame: str, ratio: float = 0.6, *, apart: bool = False) -> DataFrame:
    """(frame, a, b, d1, d2): nearest neighbours that are nearer than `ratio` times the second nearest."""
    two = search(left, right, frame, 2, apart=apart).withColumn("d", F.sqrt("d"))
    pair = two.groupBy(frame, "a").agg(F.max(F.when(F.col("nth") == 1, F.col("b"))).alias("b"), F.min("d").alias("d1"), F.max("d").alias("d2"), F.count("*").alias("_n"))
    return pair.where((F.col("_n") == 2) & (F.col("d1") < ratio * F.col("d2"))).drop("_n")
