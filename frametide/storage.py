"""Tables that are read more than once, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def store_of(place: str):
    """The file system of a path or URI, and the path in it, for tasks that read or write files themselves."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", place):
        place = place.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/frametide-{uuid.uuid4().hex}/{name}"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. One is made only where none is set and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> str:
    """Writes df as a Parquet table in the shared folder and gives its place."""
    path = new_place(df.sparkSession, name)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps see the same rows, and a lost executor costs tasks only."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))
