"""Exact substring deduplication with a sparse, distributed suffix sort.

A byte goes if a `length`-byte string that also starts elsewhere covers it. Equal strings hold equal anchors: the least hash among
their `core`-byte substrings marks the same offset in both. So only anchors are sorted, not all suffixes. An anchor owns the
strings (windows) that it is the least of, and its context is what these cover. Anchors whose core occurs once own nothing that
repeats. Equal contexts are counted before anything is sent: the core's hash and a cryptographic digest of the context, 128 bits in
all, stand for its bytes, as a SHA-256 does for equal texts. One that occurs twice repeats as a whole. Contexts that share a core but
differ are sorted: each task sorts the suffixes that start at its anchors into runs and sends them front-coded (the length shared with
the previous suffix, and the rest); the receiver merges its runs with a loser tree that compares suffixes only beyond the prefixes it
knows to be equal. The merge yields the common prefixes of neighbours; with the same for the texts to the left, they say which
windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, mix, partitions, prefix_hash, shared_dir, slabs, substring_hash, written

LENGTH, CORE = 400, 128
#: Cores with more different contexts than this (30 MB of text) are not merged in one task; their windows are counted one by one.
HOT = 50_000
RUN = 20_000
#: So many contexts, about, are merged at a time; the number of buckets follows.
BUCKET = 20_000
_CHUNK = 1 << 19


# ---------------------------------------------------------------- anchors


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, ...]:
    """(at, first, last, core's hash, context's digest): each anchor, its first and last window's start."""
    raw = memoryview(np.ascontiguousarray(data))
    parts = [np.empty((0, 3), np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for lo in range(0, len(data) - length + 1, _CHUNK):
        piece = data[lo : lo + _CHUNK + length - 1]
        sums = prefix_hash(piece)
        at = np.arange(len(piece) - core + 1)
        hashes = substring_hash(sums, at, at + core)
        low = np.uint64((1 << 20) - 1)
        least = (_sliding_min((hashes & ~low) | at.astype(np.uint64), length - core + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], len(least)) - 1
        mark = least[first]
        shape = ((mark - first) * length + (last - first)).astype(np.uint64)
        parts[0].append(np.stack([mark, first, last], 1) + lo)
        parts[1].append(hashes[mark])
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip((first + lo).tolist(), (last + length + lo).tolist(), strict=True))
        parts[2].append(np.frombuffer(digests, np.uint64) ^ mix(shape))
    place, cores, contexts = (np.concatenate(p) for p in parts)
    return place[:, 0], place[:, 1], place[:, 2], cores, contexts


#: A place is one number: an anchor's first window, how many more it owns, and how far the anchor is from the first.
FIRST, LAST, AT = "place >> 24", "(place >> 24) + (place >> 12 & 4095)", "(place >> 24) + (place & 4095)"


def _scan(docs: DataFrame, id: str, text: str, length: int, core: int) -> DataFrame:
    """A row for each document, with a number of its own (doc), its anchors in lists."""
    names = ["doc", "doc_id", "n_bytes", "sha256", "h1", "h2", "place", "core", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(parts, kind):
            sizes = [len(p) for p in parts]
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(parts).astype(kind)))

        doc = TaskContext.get().partitionId() << 40
        for batch in batches:
            for slab in slabs(batch.column(1), 1 << 22):
                found, heads = [], []
                for k in range(len(slab)):
                    data = slab.data[slab.bounds[k] : slab.bounds[k + 1]]
                    digest = hashlib.sha256(data).digest()
                    heads.append((len(data), digest.hex(), *(int.from_bytes(digest[x : x + 8], "big", signed=True) for x in (0, 8))))
                    at, first, last, cores, contexts = anchors(data, length, core)
                    found.append((first << 24 | (last - first) << 12 | (at - first), cores, contexts))
                places, cores, contexts = ([f[k] for f in found] for k in range(3))
                signed = lambda parts: [p.view(np.int64) for p in parts]
                columns = [pa.array(c, t) for c, t in zip(zip(*heads, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc + np.arange(len(slab))), batch.column(0).slice(slab.lo, len(slab)), *columns, lists(places, np.int64), lists(signed(cores), np.int64), lists(signed(contexts), np.int64)], names)
                doc += len(slab)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    return rows.mapInArrow(run, "doc long, doc_id long, n_bytes long, sha256 string, h1 long, h2 long, place array<long>, core array<long>, context array<long>")


# ---------------------------------------------------------------- runs and their merge


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        end = min(n, known + step)
        if a[known:end] == b[known:end]:
            known, step = end, step * 2
            continue
        while end - known > 1:
            middle = (known + end) // 2
            if a[known:middle] == b[known:middle]:
                known = middle
            else:
                end = middle
        return known
    return n


def front_code(ordered: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared = [0, *(common_prefix(a, b) for a, b in zip(ordered[:-1], ordered[1:], strict=True))][: len(ordered)]
    return shared, [s[k:] for k, s in zip(shared, ordered, strict=True)]


def _decoded(shared, rests) -> Iterator[tuple[int, bytes]]:
    last = b""
    for k, rest in zip(shared, rests, strict=True):
        last = last[:k] + rest
        yield k, last


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Merges front-coded sorted runs: (run, index in it, suffix, length shared with the suffix before it in the merged order).

    A loser tree. Every contestant knows how long a prefix it shares with the last suffix put out. Who shares more is the smaller one,
    without a look at the bytes; only if both share as much are they compared, from there on, and the loser remembers what it
    shares with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    sources = [enumerate(_decoded(*r)) for r in runs]
    now: list = [None] * size  # (shared, suffix, index)

    def advance(k):
        for i, (shared, suffix) in sources[k] if k < len(sources) else ():
            now[k] = [shared, suffix, i]
            return
        now[k] = None

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of streams a and b."""
        x, y = now[a], now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        n = common_prefix(x[1], y[1], x[0])
        if (x[1][n : n + 1], a) <= (y[1][n : n + 1], b):
            y[0] = n
            return a, b
        x[0] = n
        return b, a

    for k in range(size):
        advance(k)
        if now[k] is not None:
            now[k][0] = 0
    loser = [0] * size
    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        games = [play(winners[2 * k], winners[2 * k + 1]) for k in range(level)]
        winners = [w for w, _ in games]
        loser[level : 2 * level] = [x for _, x in games]
    top = winners[0]
    while now[top] is not None:
        shared, suffix, i = now[top]
        yield top, i, suffix, shared
        advance(top)
        node = (top + size) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def repeated(rights: list[int], lefts: list[bytes], spans: list[tuple[int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For contexts in suffix order, which windows repeat, as ranges of d, the distance from the window's start to the anchor.

    rights: the length each suffix shares with the one before. lefts: the bytes before the anchors. A window at d repeats for two
    contexts if their left texts share d bytes before the anchor and their suffixes share length - d. What shares it is a class on
    either side; the classes change only at distances that follow from the shared lengths.
    """
    g = len(lefts)
    turned = [x[::-1] for x in lefts]
    if g == 2:
        r, l = rights[1], common_prefix(turned[0], turned[1])
        return [[(max(lo, length - r), min(hi, l))] if max(lo, length - r) <= min(hi, l) else [] for lo, hi in spans]
    order = sorted(range(g), key=turned.__getitem__)
    left = np.array([0, *(common_prefix(turned[a], turned[b]) for a, b in zip(order[:-1], order[1:], strict=True))])
    right = np.array([0, *rights[1:]])
    rank = np.empty(g, np.int64)
    rank[order] = np.arange(g)
    low, high = min(s[0] for s in spans), max(s[1] for s in spans)
    cuts = np.unique(np.clip(np.concatenate([[low], length - right[1:], left[1:] + 1]), low, high + 1))
    ends = np.append(cuts[1:], high + 1)
    cuts, ends = cuts[cuts < ends], ends[cuts < ends]
    again = np.zeros((len(cuts) + 2, g), bool)
    for n, lo in enumerate(cuts):
        key = np.cumsum(right < length - lo) * (g + 1) + np.cumsum(left < lo)[rank]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        again[n + 1] = count[which] > 1
    # a context's neighbouring ranges are one
    out: list[list[tuple[int, int]]] = [[] for _ in range(g)]
    starts, stops = (np.argwhere((again[1:] & ~again[:-1]).T), np.argwhere((again[:-1] & ~again[1:]).T))
    for (k, first), (_, stop) in zip(starts.tolist(), stops.tolist(), strict=True):
        lo, hi = max(int(cuts[first]), spans[k][0]), min(int(ends[stop - 1]) - 1, spans[k][1])
        if lo <= hi:
            out[k].append((lo, hi))
    return out


RUNS = "bucket int, shared array<int>, rest array<binary>, left array<binary>, doc array<long>, at array<long>, lo array<long>, hi array<long>, need array<boolean>, window array<long>, core array<long>"


def _runs(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """rows (text, marks: array of (core, doc, at, first, last, times, hot)) as sorted front-coded runs, one for each bucket of cores.

    Contexts of hot cores are not sorted: for them there are rows without a bucket with the hash of each window, `at` its start,
    `need` whether its context occurs once.
    """
    schema = pa.schema([("bucket", pa.int32()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("left", pa.list_(pa.binary())), *((x, pa.list_(pa.int64())) for x in ("doc", "at", "lo", "hi")), ("need", pa.list_(pa.bool_())), ("window", pa.list_(pa.int64())), ("core", pa.list_(pa.int64()))])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema.names)

    def sorted_runs(held):
        for bucket, entries in held.items():
            entries.sort(key=lambda e: e[0])
            shared, rests = front_code([e[0] for e in entries])
            yield (bucket, shared, rests, *([e[k] for e in entries] for k in range(1, 7)), None, None)

    def windows(text, marks):
        sums = prefix_hash(np.frombuffer(text, np.uint8))
        start = np.concatenate([np.arange(m["first"], m["last"] + 1) for m in marks])
        each = np.repeat(np.arange(len(marks)), [m["last"] + 1 - m["first"] for m in marks])
        column = lambda f: np.array([f(m) for m in marks])[each].tolist()
        return None, None, None, None, column(lambda m: m["doc"]), start.tolist(), None, None, column(lambda m: m["times"] == 1), substring_hash(sums, start, start + length).view(np.int64).tolist(), column(lambda m: m["core"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0
        for batch in batches:
            for text, marks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                hot = [m for m in marks if m["hot"]]
                if hot:
                    yield batch_of([windows(text, hot)])
                for m in marks:
                    if not m["hot"]:
                        at, first, last = m["at"], m["first"], m["last"]
                        held.setdefault(m["core"] % buckets, []).append((text[at : last + length], text[first:at], m["doc"], at, at - last, at - first, m["times"] == 1))
                        n += 1
                if n >= RUN:
                    yield batch_of(list(sorted_runs(held)))
                    held, n = {}, 0
        if n:
            yield batch_of(list(sorted_runs(held)))

    return rows.select("text", "marks").mapInArrow(run, RUNS)


def _merged(runs: DataFrame, length: int, core: int) -> DataFrame:
    """(doc, first, last): the ranges of windows that repeat, of the contexts that need them."""
    names = ["doc", "first", "last"]

    def solve(group: list) -> list[tuple]:
        if len(group) < 2 or not any(e[2][4] for e in group):
            return []
        found = repeated([e[0] for e in group], [e[1] for e in group], [(e[2][2], e[2][3]) for e in group], length)
        return [(e[2][0], e[2][1] - b, e[2][1] - a) for e, ranges in zip(group, found, strict=True) if e[2][4] for a, b in ranges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches, 1):
            columns = {name: bucket.column(name).to_pylist() for name in bucket.column_names[1:9]}
            out: list[tuple] = []
            group: list = []
            for run_, i, _, shared in merge(list(zip(columns["shared"], columns["rest"], strict=True))):
                if shared < core:
                    out += solve(group)
                    group = []
                group.append((shared, columns["left"][run_][i], [columns[c][run_][i] for c in ("doc", "at", "lo", "hi", "need")]))
            out += solve(group)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    dealt = runs.repartition(partitions(runs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc long, first long, last long")


# ---------------------------------------------------------------- the operator


def _cut(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    """rows (doc, text, ranges of windows) as what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                kept, end, spans = [], 0, 0
                for first, last in sorted((r["first"], r["last"] + length) for r in ranges or ()):
                    if first > end or not spans:
                        kept.append(text[end:first])
                        spans += 1
                    end = max(end, last)
                kept.append(text[end:])
                left = b"".join(kept)
                out.append((len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc", "text", "ranges").mapInArrow(run, "doc long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH, core: int = CORE, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with_text=True adds `kept`, the bytes left.

    Texts are taken as UTF-8 bytes, a null as empty; a text shorter than `length` keeps all. Strings are judged on the input. Rows
    are documents whatever their ids: a text that occurs twice loses all its bytes, in both rows. An empty table gives no rows.
    """
    if not core < length < 4096:
        raise ValueError("core < length < 4096 is needed")
    spark = docs.sparkSession
    shared_dir(spark)
    key = ["h1", "h2"]
    scanned = written(_scan(docs, id, text, length, core), "anchors")
    base = scanned.select("doc", "doc_id", "n_bytes", "sha256", *key)
    marks = scanned.select("doc", F.explode(F.arrays_zip("place", "core", "context")).alias("m")).select("doc", "m.*")

    # Contexts are counted first, so that a core in very many texts is a row for each of its contexts; then cores that occur again.
    contexts = marks.groupBy("core", "context").agg(F.count("*").alias("times"), F.min(F.struct("doc", "place")).alias("p"))
    again = contexts.groupBy("core").agg(F.sum("times").alias("n"), F.count("*").alias("crowd"), F.min("times").alias("least")).where("n > 1").drop("n")
    contexts = written(contexts.join(again, "core").select("core", "context", "times", "p.*", "crowd", "least"), "contexts")
    whole = written(marks.join(contexts.where("times > 1").select("core", "context"), ["core", "context"]).select("doc", "place"), "whole-contexts")

    # Texts to look into: those with contexts to sort, and those that go in part. A text with a copy goes as a whole.
    sort = contexts.where("crowd > 1 and least = 1").select("core", "times", "doc", "place", (F.col("crowd") > hot).alias("hot"))
    copied = base.where(F.col("n_bytes") >= length).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit(True).alias("copied"))
    covered = whole.groupBy("doc").agg(F.sum(F.expr("(place >> 12 & 4095) + 1")).alias("covered"))
    state = base.where(F.col("n_bytes") >= length).join(copied, key, "left").join(covered, "doc", "left").join(sort.select("doc").distinct().withColumn("sorted", F.lit(True)), "doc", "left")
    all_goes = F.coalesce("copied", F.lit(False)) | (F.coalesce("covered", F.lit(0)) == F.col("n_bytes") - F.lit(length - 1))
    state = written(state.where("copied or covered is not null or sorted").select("doc", "doc_id", *key, all_goes.alias("all"), F.coalesce("sorted", F.lit(False)).alias("sorted")), "state")

    # These texts are fetched in one shuffle. The joins with texts are merge joins at every size: both sides grow with the corpus.
    wanted = state.where("sorted or not all").select("doc", *key, F.col("doc_id").alias("row"))
    sha = F.sha2(F.col("text"), 256)
    half = lambda k: F.conv(F.substring(sha, k, 16), 16, -10).cast("long")
    sources = docs.select(F.col(id).cast("long").alias("row"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).where(F.octet_length("text") >= length).withColumn("h1", half(1)).withColumn("h2", half(17)).alias("s")
    same = F.expr("s.h1 = w.h1 and s.h2 = w.h2 and s.row <=> w.row")
    looked = written(sources.join(wanted.hint("merge").alias("w"), same).select("doc", "text").dropDuplicates(["doc"]), "texts")

    lists = sort.groupBy("doc").agg(F.collect_list(F.struct("core", "doc", F.expr(AT).alias("at"), F.expr(FIRST).alias("first"), F.expr(LAST).alias("last"), "times", "hot")).alias("marks"))
    buckets = max(partitions(spark), sort.where("not hot").count() // BUCKET)
    runs = written(_runs(lists.hint("merge").join(looked, "doc"), length, buckets), "runs")
    found = _merged(runs.where("bucket is not null"), length, core)
    windows = runs.where("bucket is null").select(F.explode(F.arrays_zip("core", "window", "doc", "at", "need")).alias("w")).select("w.*")
    twice = windows.groupBy("core", "window").agg(F.count("*").alias("n"), F.min("need").alias("once")).where("n > 1 or not once").select("core", "window")
    found = found.unionByName(windows.where("need").join(twice, ["core", "window"]).select("doc", F.col("at").alias("first"), F.col("at").alias("last")))
    found = written(found, "sorted-contexts")

    partly = state.where("not all").select("doc")
    ranges = whole.select("doc", F.expr(FIRST).alias("first"), F.expr(LAST).alias("last")).unionByName(found).join(partly, "doc", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    cut = written(_cut(ranges.hint("merge").join(looked, "doc"), length, with_text), "cut")

    results = cut.withColumn("all", F.lit(False)).unionByName(state.where("all").select("doc", F.lit(True).alias("all")), allowMissingColumns=True)
    out = base.join(results, "doc", "left")
    gone = F.coalesce("all", F.lit(False))
    columns = [
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    if not with_text:
        return out.select(*columns)
    # what is left of texts that were not cut is the text itself
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("own")).withColumn("sha256", F.sha2("own", 256)).dropDuplicates(["sha256"]).select("sha256", "own")
    return out.join(own, "sha256").select(*columns, F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "own")).alias("kept"))
