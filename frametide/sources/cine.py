"""CINE high-speed video as a Spark data source: after register(spark), `spark.read.format("cine").load(path)` gives frames, with option kind=videos the headers.

A partition is a range of frames of one file, read by seeking; no file is read whole. Filters on frame_num skip partitions.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..schemas import FRAME

# Fixed places of the format, little-endian.
COUNT_AT, OFFSETS_AT, WIDTH_AT, HEIGHT_AT, SIZE_AT, RATE_AT = 20, 0x20, 0x30, 0x34, 0x40, 0x54

VIDEO = "filename string, image_count int, width int, height int, image_size int, framerate int"


def header(path: str) -> dict:
    """A framerate of 0 is unknown, hence null."""
    with open(path, "rb") as f:
        head = f.read(RATE_AT + 2)
    at = lambda kind, k: struct.unpack_from("<" + kind, head, k)[0]
    return {"image_count": at("I", COUNT_AT), "offsets": at("I", OFFSETS_AT), "width": at("i", WIDTH_AT), "height": at("i", HEIGHT_AT), "image_size": at("I", SIZE_AT), "framerate": at("H", RATE_AT) or None}


def frames(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Frames start to stop - 1, their rows top-down. A frame that the file ends inside is left out."""
    head = header(path)
    row = head["image_size"] // max(1, abs(head["height"]))
    with open(path, "rb") as f:
        f.seek(head["offsets"] + 8 * start)
        places = struct.unpack(f"<{stop - start}Q", f.read(8 * (stop - start)))
        for k, place in zip(range(start, stop), places, strict=True):
            f.seek(place)
            note = f.read(4)
            if len(note) < 4:
                continue
            f.seek(place + struct.unpack("<I", note)[0])
            raw = f.read(head["image_size"])
            if len(raw) == head["image_size"]:
                yield k, b"".join(raw[i : i + row] for i in range(len(raw) - row, -1, -row))


class FrameRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class CineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.videos = options.get("kind", "frames") == "videos"
        self.per_task = int(options.get("framesPerTask", "256"))
        self.paths = sorted(p for pattern in options["path"].split(",") for p in (glob.glob(os.path.join(pattern, "**", "*.cine"), recursive=True) if os.path.isdir(pattern) else glob.glob(pattern, recursive=True)))
        self.low, self.high = 0, 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on frame_num choose partitions; Spark still applies every filter."""
        for f in filters:
            if not self.videos and getattr(f, "attribute", None) == ("frame_num",):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.videos:
            return [FrameRange(p, 0, 0) for p in self.paths]
        out = []
        for p in self.paths:
            stop = min(self.high, header(p)["image_count"])
            out += [FrameRange(p, k, min(k + self.per_task, stop)) for k in range(self.low, stop, self.per_task)]
        return out

    def read(self, partition: FrameRange | None) -> Iterator[tuple]:
        if partition is None:  # no recording has the frames asked for
            return
        head = header(partition.path)
        if self.videos:
            yield partition.path, head["image_count"], head["width"], head["height"], head["image_size"], head["framerate"]
            return
        for k, pixels in frames(partition.path, partition.start, partition.stop):
            yield partition.path, k, head["height"], head["width"], pixels


class CineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cine"

    def schema(self) -> str:
        return VIDEO if self.options.get("kind", "frames") == "videos" else FRAME

    def reader(self, schema) -> DataSourceReader:
        return CineReader(self.options)


def register(spark) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CineSource)


def frame_at(df, i: int):
    """The rows of frame i; an index that a recording lacks gives no row for it."""
    from pyspark.sql import functions as F

    return df.where(F.col("frame_num") == i)


def frames_between(df, start: int, stop: int, step: int = 1):
    from pyspark.sql import functions as F

    return df.where((F.col("frame_num") >= start) & (F.col("frame_num") < stop) & ((F.col("frame_num") - start) % step == 0))
