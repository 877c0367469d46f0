"""Measurement stores: JSON maps from a recording to positional rows, delimited text, spreadsheets, and their writers."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_to_null
from ..schemas import INTEGERS
from ..storage import written


def read_map(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """A JSON map {filename: [[number, ...], ...]} as a row for each measurement. Recordings without rows give none; NaN is null."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.from_json("value", "map<string, array<array<double>>>", {"allowNonNumericNumbers": "true"}).alias("m")).select(F.explode("m").alias("filename", "rows"))
    rows = found.select("filename", F.explode("rows").alias("r"))
    column = lambda k, n: F.get("r", F.lit(k)).cast("bigint" if n == "frame_num" else "int").alias(n) if n in INTEGERS else nan_to_null(F.get("r", F.lit(k))).alias(n)
    return rows.select("filename", *[column(k, n) for k, n in enumerate(names)])


def write_map(df: DataFrame, path: str, names: tuple[str, ...]) -> None:
    """A file of JSON maps, a line with one recording each: recordings are not gathered in one place."""
    rows = df.groupBy("filename").agg(F.sort_array(F.collect_list(F.array(*[F.col(n).cast("double") for n in names]))).alias("rows"))
    rows.select(F.to_json(F.map_from_arrays(F.array("filename"), F.array("rows"))).alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """What write_map wrote: a map on each line."""
    text = spark.read.text(path)
    found = text.select(F.explode(F.from_json("value", "map<string, array<array<double>>>")).alias("filename", "rows"))
    rows = found.select("filename", F.explode("rows").alias("r"))
    return rows.select("filename", *[F.get("r", F.lit(k)).cast("bigint" if n == "frame_num" else "int" if n in INTEGERS else "double").alias(n) for k, n in enumerate(names)])


def read_table(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, sep: str = ",") -> DataFrame:
    """Delimited text with a given schema; without a header, columns are named by it in order."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_tracks(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", glob: str | None = None) -> DataFrame:
    """Headerless text of many recordings, with `filename` taken from the path; folders are searched through."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.csv(path, schema=schema, sep=sep).withColumn("filename", F.input_file_name())


def write_by_recording(df: DataFrame, path: str, mode: str = "append", format: str = "parquet") -> None:
    df.repartition("filename").write.partitionBy("filename").mode(mode).format(format).save(path)


def with_rejects(df: DataFrame, valid: Column | dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with the reason in `_error`: of a dict of conditions by reason the first that does not hold, of
    a single condition "rejected". What is unknown does not hold."""
    rules = valid if isinstance(valid, dict) else {"rejected": valid}
    reason = F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()])
    tagged = df.withColumn("_error", reason)
    return tagged.where("_error is null").drop("_error"), tagged.where("_error is not null")


def split_rejects(tagged: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows tagged by `_error` as two tables, those without and those with a reason, and how many there are of each. What made the rows
    runs once: they are written to the shared folder.

    The counts read one column of what was written. An Observation would count on the way, but in Spark 4.1 a session that has used one
    can't run MLlib's column functions any more, as these take the session's observations with them.
    """
    rows = written(tagged, "tagged")
    counts = rows.agg(F.count_if(F.col("_error").isNull()).alias("good"), F.count_if(F.col("_error").isNotNull()).alias("rejected")).first()
    return rows.where("_error is null").drop("_error"), rows.where("_error is not null"), counts.asDict()


def skipped(rejects: DataFrame, name: str = "filename") -> DataFrame:
    """(filename, failures, first_error): each recording that has rejects, as a log of skipped ones has it."""
    return rejects.groupBy(name).agg(F.count("*").alias("failures"), F.min("_error").alias("first_error"))


_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def read_spreadsheet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The first table of an OpenDocument spreadsheet, its first row being names. Files are read through Spark, a file in a task."""

    def run(parts):
        import pandas as pd

        for files in parts:
            for raw in files.content:
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("content.xml"))
                rows = []
                for row in root.iter(f"{_TABLE}table-row"):
                    cells = []
                    for cell in row.iter(f"{_TABLE}table-cell"):
                        text = "\n".join("".join(p.itertext()) for p in cell.iter(f"{_TEXT}p")) or None
                        cells += [text] * (int(cell.get(f"{_TABLE}number-columns-repeated", 1)) if text else min(int(cell.get(f"{_TABLE}number-columns-repeated", 1)), 64))
                    if any(c is not None for c in cells):
                        rows.append(cells)
                if rows:
                    names = rows[0]
                    at = {n: k for k, n in enumerate(names) if n is not None}
                    yield pd.DataFrame({f.name: [r[at[f.name]] if at.get(f.name, len(r)) < len(r) else None for r in rows[1:]] for f in schema}, dtype=object)

    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    return out.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
