"""Delimited text, one file for each recording, as a Spark data source writer that appends or replaces, all or nothing.

After register(spark), write_tracks(df, path) deals rows by recording, sorts them, and writes `path/<recording>.tsv`. A task writes whole new
files beside the old ones, in a folder of the job's own; commit moves those of the tasks that count into place, abort removes them. So
a failed or repeated attempt leaves no trace, and nothing passes through the driver but names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..storage import store_of


def file_name(recording: str, suffix: str) -> str:
    """A recording's file: its name without folders and ending, other characters than letters, digits, - and _ as %XX."""
    stem = recording.rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem[1:] else stem
    return "".join(c if c.isascii() and (c.isalnum() or c in "-_") else "".join(f"%{b:02X}" for b in c.encode()) for c in stem) + suffix


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (new file, its place)


class StagedWriter(DataSourceWriter):
    """Writes whole files into a folder of the job's own; commit moves those of the tasks that count into place, abort removes all."""

    suffix = ""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def attempt(self):
        """The file system, the folder of results, and a new folder for one attempt of one task."""
        store, root = store_of(self.path)
        folder = f"{root}/_job_{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        return store, root, folder

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_job_{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_job_{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        files = [f for m in messages if m for f in m.files]
        places = [place for _, place in files]
        if len(set(places)) < len(places):
            self._clear(store, root)
            raise ValueError("two recordings, or two tasks, have one file: deal rows by recording and give recordings names of their own")
        for new, place in files:
            store.move(new, place)
        if self.overwrite:
            kept = set(places)
            for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path.endswith(self.suffix) and info.path not in kept:
                    store.delete_file(info.path)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store_of(self.path))


class TracksWriter(StagedWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.sep, self.suffix = options.get("sep", "\t"), options.get("suffix", ".tsv")
        self.null = options.get("null", "")
        self.header = options.get("header", "false").lower() == "true"
        self.names = list(schema.names)
        self.by = self.names.index(options.get("by", "filename"))

    def _cell(self, x) -> str:
        text = self.null if x is None else repr(x) if isinstance(x, float) else str(x)
        if self.sep in text or "\n" in text or "\r" in text:
            raise ValueError(f"a value holds the separator or a line end: {text[:60]!r}")
        return text

    def write(self, rows: Iterator) -> Written:
        store, root, folder = self.attempt()
        done, out, now = [], None, None
        others = [k for k in range(len(self.names)) if k != self.by]
        seen = set()
        try:
            for row in rows:
                if row[self.by] is None:
                    raise ValueError("a row has no recording")
                if row[self.by] != now:
                    if out is not None:
                        out.close()
                    now, name = row[self.by], file_name(row[self.by], self.suffix)
                    if name in seen:
                        raise ValueError(f"rows are not sorted by recording, or two recordings have the file {name}")
                    seen.add(name)
                    place, new = f"{root}/{name}", f"{folder}/{name}"
                    out = store.open_output_stream(new)
                    if not self.overwrite and store.get_file_info(place).is_file:
                        with store.open_input_stream(place) as old:
                            while part := old.read(1 << 20):
                                out.write(part)
                    elif self.header:
                        out.write((self.sep.join(self.names[k] for k in others) + "\n").encode())
                    done.append((new, place))
                out.write((self.sep.join(self._cell(row[k]) for k in others) + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return Written(done)


class TracksSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracks"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TracksWriter(self.options, schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(TracksSink)


def write_tracks(df: DataFrame, path: str, *, by: str = "filename", order: tuple[str, ...] = ("frame_num",), mode: str = "append", sep: str = "\t", suffix: str = ".tsv", header: bool = False) -> None:
    """df as one text file for each recording, its rows in order; the recording's column becomes the file's name and is left out.

    mode append adds to the files that are there, overwrite replaces all files of that suffix. Nulls are empty. It fails, and leaves
    everything as it was, if a value holds the separator or two recordings share a file name. The rows of one recording are written by
    one task, as they are one file.
    """
    register(df.sparkSession)
    rows = df.withColumn("_file", F.regexp_replace(by, r"^.*/", "")).repartition("_file").sortWithinPartitions("_file", by, *order).drop("_file")
    rows.write.format("tracks").option("by", by).option("sep", sep).option("suffix", suffix).option("header", str(header).lower()).mode(mode).save(path)
