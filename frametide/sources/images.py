"""PNG images as a Spark data source: after register(spark), `spark.read.format("png").load(path)` gives a row for each image.

The folder is listed once; files are dealt over tasks by size, and each is decoded where it is read. Only zlib and numpy are needed.
Images of 1, 2, 4, 8 and 16 bits, grey or colour, with a palette or transparency are read; interlaced ones are rejected.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from ..storage import store_of
from .sinks import StagedWriter, Written, file_name

IMAGE = "filename string, height int, width int, channels int, bits int, pixels binary, error string"

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GREY, PALETTE = 0, 3


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise ValueError(f"damaged {kind.decode('latin-1')} chunk")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("the file ends early")


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filters of lines (each with its filter's number first); step is a pixel's bytes, 1 at least."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1 + step), np.uint8)  # a line of zeros above, a pixel of zeros before
    for k, line in enumerate(lines):
        kind, data, above, new = line[0], line[1:], out[k], out[k + 1]
        if kind == 0:
            new[step:] = data
        elif kind == 2:
            new[step:] = data + above[step:]
        elif kind == 1:
            whole = np.zeros(-(-len(data) // step) * step, np.uint8)
            whole[: len(data)] = data
            new[step:] = np.cumsum(whole.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(data)]
        elif kind in (3, 4):
            up, left = above.tolist(), new.tolist()
            for i, x in enumerate(data.tolist()):
                a, b, c = left[i], up[i + step], up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                left[i + step] = (x + guess) & 255
            new[:] = left
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:]


def decode(raw: bytes) -> np.ndarray:
    """A PNG file as an array (height, width, channels) of uint8, or uint16 for 16 bits. A palette becomes its colours."""
    head, data, palette, clear = None, [], None, None
    for kind, body in chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
    if head is None:
        raise ValueError("no header")
    width, height, bits, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced images are not read")
    if colour not in CHANNELS or bits not in (1, 2, 4, 8, 16):
        raise ValueError("unknown kind of pixels")
    n = CHANNELS[colour]
    line = (width * n * bits + 7) // 8
    flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(flat) < height * (line + 1):
        raise ValueError("too few pixels")
    rows = _unfiltered(flat[: height * (line + 1)].reshape(height, line + 1), max(1, n * bits // 8))
    if bits == 16:
        return np.ascontiguousarray(rows).view(">u2").astype(np.uint16).reshape(height, width, n)
    if bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        rows = np.packbits(each, axis=2, bitorder="big")[:, :, 0] >> (8 - bits)
        rows = rows[:, : width * n]
        if colour == GREY:
            rows = (rows.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    image = np.ascontiguousarray(rows).reshape(height, width, n)
    if colour != PALETTE:
        return image
    if palette is None or (image.size and image.max() >= len(palette)):
        raise ValueError("no such colour in the palette")
    colours = palette[image[:, :, 0]]
    if clear is None:
        return colours
    alpha = np.full(len(palette), 255, np.uint8)
    alpha[: len(clear)] = clear
    return np.concatenate([colours, alpha[image[:, :, 0]][:, :, None]], 2)


def encode(image: np.ndarray, filters: list[int] | int = 0) -> bytes:
    """An array (height, width[, channels]) of uint8 or uint16 as a PNG file; `filters` gives each line's, in turn."""
    image = image if image.ndim == 3 else image[:, :, None]
    height, width, n = image.shape
    bits = 16 if image.dtype == np.uint16 else 8
    raw = np.frombuffer(image.astype(">u2" if bits == 16 else np.uint8).tobytes(), np.uint8).reshape(height, -1).astype(int)
    step, kinds = n * bits // 8, [filters] if isinstance(filters, int) else filters
    lines, above = [], np.zeros(raw.shape[1], int)
    for k, line in enumerate(raw):
        left, corner = np.concatenate([np.zeros(step, int), line[:-step]]), np.concatenate([np.zeros(step, int), above[:-step]])
        kind = kinds[k % len(kinds)]
        if kind == 4:
            near = np.stack([abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)]).argmin(0)
            guess = np.choose(near, [left, above, corner])
        else:
            guess = [np.zeros_like(line), left, above, (left + above) // 2][kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    colour = {v: k for k, v in CHANNELS.items() if k != PALETTE}[n]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PngReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_task = int(options.get("bytesPerTask", str(32 << 20)))

    def partitions(self) -> list[InputPartition]:
        """The files in order of name, cut where a task has its bytes; an image counts at least 64 KB."""
        from pyarrow import fs

        store, root = store_of(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            found = [store.get_file_info(root)]
        else:
            found = store.get_file_info(fs.FileSelector(root, recursive=True))
        out, held, size = [], [], 0
        for info in sorted((i for i in found if i.type == fs.FileType.File and i.path.lower().endswith(".png")), key=lambda i: i.path):
            held.append(info.path)
            size += max(info.size, 1 << 16)
            if size >= self.per_task:
                out.append(Files(held))
                held, size = [], 0
        return [*out, *([Files(held)] if held else [])]

    def read(self, partition: Files | None) -> Iterator[tuple]:
        """A file that can't be decoded gives a row without pixels and with the reason."""
        store, _ = store_of(self.path)
        for path in partition.paths if partition else []:
            with store.open_input_stream(path) as f:
                raw = f.read()
            try:
                image = decode(raw)
            except (ValueError, zlib.error, struct.error) as e:
                yield path, None, None, None, None, None, str(e)
                continue
            yield path, image.shape[0], image.shape[1], image.shape[2], image.dtype.itemsize * 8, image.tobytes(), None


class PngWriter(StagedWriter):
    """Frames (filename, frame_num, height, width, pixels) as grey images, `<recording>_<frame>.png`."""

    suffix = ".png"

    def __init__(self, options: dict, schema, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.at = [schema.names.index(n) for n in ("filename", "frame_num", "height", "width", "pixels")]

    def write(self, rows: Iterator) -> Written:
        store, root, folder = self.attempt()
        done = []
        for row in rows:
            filename, number, height, width, pixels = (row[k] for k in self.at)
            name = f"{file_name(filename, '')}_{number}{self.suffix}"
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(encode(np.frombuffer(pixels, np.uint8).reshape(height, width), 2))
            done.append((f"{folder}/{name}", f"{root}/{name}"))
        return Written(done)


class PngSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> str:
        return IMAGE

    def reader(self, schema) -> DataSourceReader:
        return PngReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PngWriter(self.options, schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(PngSource)


def as_frames(images):
    """The grey value of each 8-bit image as (filename, frame_num, height, width, pixels), its first channel; files in error are left out.
    The frame number is the last run of digits in the name, else 0."""
    from pyspark.sql import functions as F

    ok = images.where(F.col("error").isNull() & (F.col("bits") == 8))
    digits = F.regexp_extract("filename", r"(\d+)[^\d/]*$", 1)
    first = F.when(F.col("channels") == 1, F.col("pixels")).otherwise(F.unhex(F.regexp_replace(F.hex("pixels"), F.concat(F.lit("(..)(?:..){"), (F.col("channels") - 1).cast("string"), F.lit("}")), F.lit("$1"))))
    return ok.select("filename", F.coalesce(digits.try_cast("int"), F.lit(0)).alias("frame_num"), "height", "width", first.alias("pixels"))
