"""What the operators share: the shared folder, hashed words in slabs of text, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MAX_SLAB_DOCS = 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). One is made only where none is set and all runs on one
    machine, as in tests; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/frametide-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it survives the loss of executors, is compressed, and is read by column."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores before it as long as a column has it, whatever its case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text as bytes and hashed words

_powers = np.empty(0, np.uint64)
_inverse = np.empty(0, np.uint64)
_byte_hash = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
_no_letter = np.array([not (c >= 0x80 or chr(c).isalnum()) for c in range(256)])
_lower = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 20)
        fill = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
        _powers, _inverse = fill(np.uint64(_BASE)), fill(np.uint64(pow(_BASE, -1, 1 << 64)))
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which substring_hash takes the hash of any substring."""
    powers, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_hash[data] * powers[: len(data)], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _power_tables(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


class Slab:
    """Some rows of an Arrow batch: rows lo to hi, their texts' bytes one after another, and each text's bounds."""

    def __init__(self, lo: int, data: np.ndarray, bounds: np.ndarray):
        self.lo, self.data, self.bounds = lo, data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the index of each text's first word (one more entry: the number of words).

        Words are parted by white space; with plain=True, by whatever is no ASCII letter or digit and not beyond ASCII.
        """
        inside = ~(_no_letter if plain else _is_space)[self.data]
        starts, ends = np.zeros(len(inside) + 1, bool), np.zeros(len(inside) + 1, bool)
        starts[1:-1] = inside[1:] & ~inside[:-1]
        ends[1:-1] = inside[:-1] & ~inside[1:]
        if len(inside):
            full = self.bounds[:-1][self.bounds[1:] > self.bounds[:-1]]
            last = self.bounds[1:][self.bounds[1:] > self.bounds[:-1]]
            starts[full] = inside[full]
            ends[last] |= inside[last - 1]
        start = np.flatnonzero(starts)
        return start, np.flatnonzero(ends), np.searchsorted(start, self.bounds)

    def word_hashes(self, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each word and the index of each text's first word. With plain=True, A to Z count as a to z."""
        start, end, first = self.words(plain)
        return substring_hash(prefix_hash(_lower[self.data] if plain else self.data), start, end), first

    def lower(self) -> Slab:
        """The same texts with A to Z as a to z."""
        return Slab(self.lo, _lower[self.data], self.bounds)


def slabs(column: pa.Array, limit: int = 1 << 19) -> Iterator[Slab]:
    """A binary or string column in slabs of about `limit` bytes; a longer text is a slab of its own. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + MAX_SLAB_DOCS, n)
        yield Slab(lo, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


def shingles(slab: Slab, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of `width` words, and each text's first. A text of fewer words has one shingle, of none has none."""
    hashes, first = slab.word_hashes()
    return run_hashes(hashes, first, width)


def run_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, doc = len(hashes), np.diff(first)
    with np.errstate(over="ignore"):
        out = hashes.copy()
        for k in range(1, width):
            out *= np.uint64(_BASE)
            out[: max(0, n - k)] += hashes[k:]
    # A position starts a run unless fewer than `width` words are left in its text; a short text keeps its first position.
    keep = np.ones(n, bool)
    for k in range(1, width):
        at = first[1:] - k
        keep[at[at >= first[:-1]]] = False
    short = (doc > 0) & (doc < width)
    keep[first[:-1][short]] = True
    for d in np.flatnonzero(short):  # only that text's words
        h = np.uint64(0)
        for x in hashes[first[d] : first[d + 1]]:
            with np.errstate(over="ignore"):
                h = h * np.uint64(_BASE) + x
        out[first[d]] = h
    counts = np.where(doc >= width, doc - width + 1, (doc > 0).astype(doc.dtype))
    return mix(out[keep]), np.concatenate([[0], np.cumsum(counts)])


# ---------------------------------------------------------------- groups of a sorted partition


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows alike in the first `keys` columns of a partition that is sorted by them. One run is in memory at a time."""
    held: list[pa.RecordBatch] = []

    def key(batch, row):
        return [batch.column(k)[row].as_py() for k in range(keys)]

    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            changed |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each end of the edges (a, b) reaches.

    Alternates large-star and small-star steps on a table of edges; each step is two aggregations and two joins, each round is
    checkpointed in the shared folder, and only one sum a round comes to the driver. A star with very many leaves is
    pre-aggregated by min() and its join is split by adaptive skew handling. Null ends and loops are ignored; an empty
    table gives an empty one. A round in which nothing changes ends the loop; should max_rounds not be enough, it raises.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    pairs = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
    )
    last = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large-star: each larger neighbour of u goes to the least one around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = small.checkpoint()
        now = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.count_distinct("u")).first()
        if now[0] == now[2] and tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    stars = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
