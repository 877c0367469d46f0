"""WARC archives as a chunked record table.

A payload never travels whole: Spark cuts it into rows (record, chunk number, chunk) where it is read, and a task adds a running digest
to each as they stream by. Which records repeat is decided on the digests of last chunks alone; no payload is in a join. A writer then
streams each record's head and its chunks into archives, digesting again, and a reader streams archives back into the same kind of
rows, each with the digest of the payload so far. Archives lie in the shared folder. A task writes files of its own and names them in
its result, so that only the files of successful attempts are ever read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions, written

CHUNK = 1 << 16
FILE_BYTES = 1 << 30
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"  # the table has no time of capture

MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id string, chunk_no long, is_last boolean, record_type string, refers_to string, target_uri string, payload_bytes long, declared_digest string, digest_so_far string, data binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# ---------------------------------------------------------------- writing


def chunk_rows(pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """(record, id, url, chunk_no, is_last, data, bytes, sha1): a row for each chunk of each payload, bytes and sha1 of the payload
    through that chunk. A null payload is empty and has one empty chunk; each row of pages is a record with a number of its own.

    The table is written to the shared folder, which fixes the numbers.
    """
    names = ["record", "id", "url", "chunk_no", "is_last", "data", "bytes", "sha1"]
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / F.lit(chunk)) - 1)
    rows = rows.withColumn("last", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    cut = rows.select("record", "id", "url", "chunk_no", (F.col("chunk_no") == F.col("last")).alias("is_last"), F.substring("payload", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size = hashlib.sha1(), 0
        for batch in batches:
            sizes, digests = [], []
            for no, data in zip(batch.column(3).to_pylist(), batch.column(5), strict=True):
                if no == 0:
                    digest, size = hashlib.sha1(), 0
                digest.update(data.as_buffer())
                size += len(data.as_buffer())
                sizes.append(size)
                digests.append(digest.digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names)

    digested = cut.mapInArrow(run, "record long, id long, url string, chunk_no long, is_last boolean, data binary, bytes long, sha1 binary")
    return written(digested, "chunks", compression="zstd")


def records(chunks: DataFrame, *, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(record, chunk_no, id, url, bytes, sha1, refers_to, first_record, is_last, data): each record's head, numbered -1, and then its
    chunks, in one partition.

    Of records with equal payloads of at least min_bytes, that with the smallest id is the response and the others refer to it.
    Rows alike in id and payload are one capture seen again, and all are written as it is. A record without an id is a response
    only if no equal payload has an id.
    """
    whole = chunks.where("is_last").select("record", "id", "url", "bytes", "sha1")
    named = F.when(F.col("id").isNotNull(), F.struct("id", "record"))
    again = whole.where(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first.id"))
    heads = whole.join(again, "sha1", "left").select("record", F.lit(-1).cast("long").alias("chunk_no"), "id", "url", "bytes", "sha1", F.when(other, F.col("first.id")).alias("refers_to"), F.when(other, F.col("first.record")).alias("first_record"))
    rows = heads.unionByName(chunks.select("record", "chunk_no", "is_last", "data"), allowMissingColumns=True)
    return rows.repartition(partitions(chunks.sparkSession), "record").sortWithinPartitions("record", "chunk_no")


def _header(record, id, url, bytes_, sha1, refers_to, first_record) -> bytes:
    name = lambda x, n: f"<urn:page:{'' if x is None else x}:{n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {bytes_}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(id, record)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32(sha1)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (bytes_ if refers_to is None else 0)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to, first_record)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http


def _open(path: str, mode: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if mode == "w" else system.open_input_stream(inner)


def write(rows: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES, level: int = 1) -> DataFrame:
    """Writes records() as gzipped archives, one member a record, and returns the manifest of the files (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = out = path = digest = goal = None
        count = size = start = 0
        done: list[tuple[str, int, int]] = []

        def close():
            raw.close()
            done.append((path, count, size))

        for batch in batches:
            for record, chunk_no, id, url, bytes_, sha1, refers_to, first_record, is_last, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk_no < 0:
                    if raw is not None and size >= file_bytes:
                        close()
                        raw = None
                    if raw is None:
                        path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        raw = _open(path, "w")
                    start, digest, goal = raw.tell(), hashlib.sha1(), sha1
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=level, mtime=0)
                    out.write(_header(record, id, url, bytes_, sha1, refers_to, first_record))
                    is_last = refers_to is not None
                elif out is None:  # a revisit's payload
                    continue
                else:
                    digest.update(data)
                    out.write(data)
                    if is_last and digest.digest() != goal:
                        raise ValueError(f"record {record}: its chunks do not give its digest")
                if is_last:
                    out.write(b"\r\n\r\n")
                    out.close()
                    out = None
                    count += 1
                    size += raw.tell() - start
        if raw is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    _make(folder)
    return written(rows.select("record", "chunk_no", "id", "url", "bytes", "sha1", "refers_to", "first_record", "is_last", "data").mapInArrow(run, MANIFEST), "manifest")


def _make(folder: str) -> None:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)


# ---------------------------------------------------------------- reading


def _records(stream) -> Iterator[tuple[dict, dict, int]]:
    """Each record's WARC header, its HTTP header, and the bytes of payload that follow; the caller reads these."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head, http, used = _fields(stream)[0], {}, 0
        if head.get("content-type", "").startswith("application/http"):
            used = len(stream_line := stream.readline())
            http, n = _fields(stream) if stream_line.startswith(b"HTTP/") else ({}, 0)
            used += n
        yield head, http, int(head["content-length"]) - used


def _fields(stream) -> tuple[dict, int]:
    out, n = {}, 0
    while True:
        line = stream.readline()
        n += len(line)
        if line in (b"\r\n", b"\n", b""):
            return out, n
        key, _, value = line.partition(b":")
        out[key.decode().lower()] = value.strip().decode("utf-8", "replace")


def read(manifest: DataFrame, *, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The archives of a manifest as chunk rows. `digest_so_far` is the base32 SHA-1 of the payload through that chunk.

    A record's name is its page's id, a colon and its number. With data=False the payload is read and digested as well, but each record gives its last chunk's row only, without its bytes.
    """
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path, "r") as raw, gzip.GzipFile(fileobj=raw, mode="rb") as stream:
                    for head, http, left in _records(stream):
                        digest, no = hashlib.sha1(), 0
                        strip = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
                        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        while True:
                            part = stream.read(min(chunk, left)) if left else b""
                            if left and not part:
                                raise EOFError(f"{path} ends inside a record")
                            left -= len(part)
                            digest.update(part)
                            if data or not left:
                                rows.append((strip(head["warc-record-id"]), no, not left, head["warc-type"], strip(head.get("warc-refers-to")), head.get("warc-target-uri"), int(http.get("content-length", 0)), declared, base32(digest.digest()), part if data else None))
                                held += len(part) + 300
                                if held > 1 << 23:
                                    yield flush()
                                    rows, held = [], 0
                            no += 1
                            if not left:
                                break
        if rows:
            yield flush()

    return manifest.select("path").repartition(partitions(manifest.sparkSession), "path").mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes a record for each page, reads the archives back, and returns what they say of each page.

    Per row: page_id, payload_bytes, payload_digest, record_type (response or revisit), refers_to. A response whose payload does not
    give its declared digest raises an error. An empty table writes no archive and gives no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    manifest = write(records(chunk_rows(pages, id=id, url=url, payload=payload), min_bytes=min_bytes), folder)
    last = read(manifest, data=False).where("is_last")
    whole = F.when((F.col("record_type") != "response") | (F.col("declared_digest") == F.col("digest_so_far")), F.col("declared_digest"))
    as_id = lambda c: F.when(~F.startswith(c, F.lit(":")), F.split_part(c, F.lit(":"), F.lit(1))).cast("long")
    return last.select(
        as_id("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce(whole, F.raise_error(F.concat(F.lit("damaged record "), "record_id")).cast("string")).alias("payload_digest"),
        "record_type",
        as_id("refers_to").alias("refers_to"),
    )
