"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at each step a text writes the character it is at, and a random bit for that step and character says
whether it moves on. Texts that differ by few edits fall into step again after each, so their written sequences differ in few
places: edit distance becomes Hamming distance. A fingerprint samples the sequence at places that are shared too, uniform over the
length of the walk, and keeps four bits of what is written there. Bands of samples bring near texts together, and candidates are
verified by their edit distance.

A character's steps are walked at once: a table says for each class of characters and each step how long the walk stays. The texts of
a slab walk side by side, so numpy works on all of them at every character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, free_name, mix, partitions, written
from .minhash import Forest, _spanning, in_blocks

SAMPLES = 256
BANDS = 32
SIMILARITY = 0.95
#: Texts whose samples agree less are no candidates, whatever bands they share.
LEAST = 0.2
SEED = 12
#: Bits of the walk repeat after so many steps and are shared by classes of characters.
STEPS, CLASSES = 1 << 14, 64
#: What is written at a step: so many characters from the walk's place on.
GRAM = 4
SLAB_CHARS = 1 << 24
FAR = 1 << 40
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _holds() -> np.ndarray:
    """Steps that a character of a class stays when it is reached at a step: to the next bit that says go on."""
    go = np.random.default_rng(SEED).random((CLASSES, STEPS)) < 0.5
    go[:, ::64] = True  # bounds a stay, also where the walk's bits repeat
    holds, wait = np.zeros((CLASSES, STEPS), np.uint8), np.zeros(CLASSES, int)
    for step in [*range(STEPS - 1, -1, -1)] * 2:  # twice, so that the end knows the beginning
        wait = np.where(go[:, step], 1, wait + 1)
        holds[:, step] = wait
    return holds.ravel()


def _places(samples: int = SAMPLES) -> np.ndarray:
    """For each sample the steps at which a shared random order sets a new record: the last record before a walk's end is a uniform
    choice of its steps, and walks of like length choose alike."""
    rng, rows = np.random.default_rng(SEED + 1), []
    for _ in range(samples):
        row = [1]
        while row[-1] < FAR:
            row.append(int(row[-1] / (1.0 - rng.random())) + 1)
        rows.append([r - 1 for r in row])
    out = np.full((samples, max(map(len, rows))), np.iinfo(np.int64).max)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


_HOLDS, _PLACES = _holds(), _places()


def _walk(classes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character is reached, and each text's number of steps. Texts stand one after another in `classes`."""
    reached = np.zeros(len(classes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    place, step, left = first[order].copy(), np.zeros(len(order), np.int64), sizes[order]
    live = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")  # texts with so many characters
    for n in live.tolist():
        at, now = place[:n], step[:n]
        reached[at] = now
        now += _HOLDS[classes[at] * STEPS + (now & (STEPS - 1))]
        at += 1
    total = np.empty(len(order), np.int64)
    total[order] = step
    return reached, total


def fingerprints(texts: list[str]) -> np.ndarray:
    """The samples of each text: SAMPLES values of four bits. An empty text has zeros."""
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLAB_CHARS):
            size += len(texts[hi])
            hi += 1
        out[lo:hi] = _slab(texts[lo:hi])
        lo = hi
    return out


def _slab(texts: list[str]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(sizes) - sizes
    classes = ((chars * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int32)
    reached, total = _walk(classes, first, sizes)
    samples = np.arange(SAMPLES)
    at, where = np.zeros((len(texts), SAMPLES), np.int64), np.zeros((len(texts), SAMPLES), np.int64)
    for k in np.flatnonzero(sizes):
        at[k] = _PLACES[samples, (_PLACES < total[k]).sum(1) - 1]
        where[k] = np.searchsorted(reached[first[k] : first[k] + sizes[k]], at[k], side="right") - 1
    seen = at.astype(np.uint64) * _ODD
    for g in range(GRAM):
        inside = (where + g < sizes[:, None]) & (sizes[:, None] > 0)
        char = np.where(inside, chars[np.minimum(first[:, None] + where + g, max(len(chars) - 1, 0))] + np.uint64(1) if len(chars) else 0, 0).astype(np.uint64)
        seen = mix(seen * np.uint64(3) + char)
    return np.where(sizes[:, None] > 0, seen >> np.uint64(60), 0).astype(np.uint8)


def shown(samples: np.ndarray) -> str:
    return (samples[0::2] << 4 | samples[1::2]).tobytes().hex()


def samples_of(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([raw >> 4, raw & 15], 1).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of samples that agree, less what four bits agree by chance: an estimate of the share of equal places, 0 to 1."""
    return np.maximum(0.0, ((a == b).mean(-1) - 1 / 16) / (15 / 16))


def spliced(text: str, other: str) -> str:
    """text with its last third replaced by the first as many characters of other (or all it has)."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


# ---------------------------------------------------------------- rows

RESULT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprinted(docs: DataFrame, *, text: str = "text", as_: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints: 256 samples as hexadecimal digits. A null text is an empty one; equal texts have equal
    fingerprints. There is no shuffle."""
    as_ = free_name(as_, docs.columns)
    given = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.struct(*docs.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shown(s) for s in fingerprints(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(1)], ["f", "row"])

    out = given.mapInArrow(run, f"f string, row {given.schema['row'].dataType.simpleString()}")
    return out.select("row.*", F.col("f").alias(as_))


def _rows(ids: list, id_type, texts: list[str], prints: np.ndarray, nexts: list[str], next_prints: np.ndarray) -> list[pa.Array]:
    edited = [spliced(t, o) for t, o in zip(texts, nexts, strict=True)]
    edited_prints = fingerprints(edited)
    return [
        pa.array(ids, id_type),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
        pa.array([shown(p) for p in prints], pa.string()),
        pa.array([shown(p) for p in edited_prints], pa.string()),
        pa.array(likeness(prints, edited_prints), pa.float64()),
        pa.array(likeness(prints, next_prints), pa.float64()),
    ]


def edited(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text is the row's with its last third replaced by the beginning of the next row's, in descending order of id, null
    last, and of a hash of the text for rows with one id; after the last row comes the first, and a single row is its own next. A
    null text is an empty one; the fingerprints of two empty texts are alike. An empty table gives an empty one; other columns do
    not matter.

    Rows are dealt into ranges of that order, which is the one time that texts are shuffled, and stream through their range with
    one row held back. The last row of each range waits for the first of the next one; both are kept aside, two texts a range.
    """
    kind = docs.schema[id].dataType.simpleString()
    given = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.col("_tie")]
    given = given.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(max(16, partitions(docs.sparkSession)), *order).sortWithinPartitions(*order)
    given = given.select("doc_id", "text", F.spark_partition_id().alias("range"))
    names = [c.split()[0] for c in RESULT.split(", ")]
    schema = RESULT.replace("doc_id string", f"doc_id {kind}", 1)

    def edge(side: str, id, id_type, text: str, at: int) -> pa.RecordBatch:
        columns = [pa.nulls(1, t) for t in (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        columns[0] = pa.array([id], id_type)
        return pa.RecordBatch.from_arrays([*columns, pa.array([side]), pa.array([at], pa.int32()), pa.array([text])], [*names, "side", "range", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_type, at = batch.column(0).type, batch.column(2)[0].as_py()
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prints = fingerprints(texts)
            if held is None:
                yield edge("first", ids[0], id_type, texts[0], at)
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], prints])
            n = len(ids) - 1
            held = (ids[n], texts[n], prints[n])
            if n:
                done = _rows(ids[:n], id_type, texts[:n], prints[:n], texts[1:], prints[1:])
                yield pa.RecordBatch.from_arrays([*done, pa.nulls(n, pa.string()), pa.array([at] * n, pa.int32()), pa.nulls(n, pa.string())], [*names, "side", "range", "text"])
        if held is not None:
            yield edge("last", held[0], id_type, held[1], at)

    rows = written(given.mapInArrow(run, schema + ", side string, range int, text string"), "fingerprints")
    # A row for each range that has any: which one follows it.
    ranges = rows.where("side = 'first'").select("range", "text")
    whole = Window.orderBy("range")
    following = ranges.select("range", F.coalesce(F.lead("range").over(whole), F.min("range").over(Window.partitionBy())).alias("after"))
    nexts = ranges.select(F.col("range").alias("after"), F.col("text").alias("next"))
    waiting = rows.where("side = 'last'").select("doc_id", "text", "range").join(following, "range").join(nexts, "after").select("doc_id", "text", "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nexts_ = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(_rows(batch.column(0).to_pylist(), batch.column(0).type, texts, fingerprints(texts), nexts_, fingerprints(nexts_)), names)

    return rows.where("side is null").select(*names).unionByName(waiting.mapInArrow(finish, schema))


# ---------------------------------------------------------------- near duplicates


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two texts, a column of the table at a time as bits of whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        equal = at.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (full & ~(diagonal | more)), more & diagonal
    return score


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether the edit distance is at most 1 - similarity of the longer text."""
    most = max(len(a), len(b))
    return abs(len(a) - len(b)) <= (1 - similarity) * most + 1e-9 and edit_distance(a, b) <= (1 - similarity) * most + 1e-9


def _alike(prints: np.ndarray, a: int, right: np.ndarray) -> np.ndarray:
    return right[likeness(prints[right], prints[a]) >= LEAST]


def _suspects(block: pa.Table, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    prints = np.stack([samples_of(x.as_py()) for x in block.column("fingerprint")])
    forest = Forest(len(prints))
    for a in left.tolist():
        forest.join_all(a, _alike(prints, a, right))
    return forest.links


def _verified(similarity: float):
    def solve(block: pa.Table, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        texts = block.column("text").to_pylist()
        prints = np.stack([samples_of(x.as_py()) for x in block.column("fingerprint")])
        forest = Forest(len(texts))
        for a in left.tolist():
            for b in _alike(prints, a, right).tolist():
                if forest.root(a) != forest.root(b) and similar(texts[a], texts[b], similarity):
                    forest.join(a, b)
        return forest.links

    return solve


def classes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, component_id (the smallest id that its links reach) and kept (it has that id).

    Links join equal texts, and texts that share a band of samples if their edit distance is at most 1 - similarity of the longer one.
    The distance is exact; a pair within it is missed if no band agrees (README has figures). A row without an id is kept and has no
    component; a null text is an empty one; rows with one id are one document. Groups of any size are compared in blocks, which
    give spanning links, never pairs. An empty table gives an empty one; other columns do not matter.
    """
    given = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = written(fingerprinted(given).select("id", F.sha2("text", 256).alias("sha"), "fingerprint"), "prints")
    nodes = written(rows.where("id is not null").groupBy("sha").agg(F.min(F.struct("id", "fingerprint")).alias("x")).select("sha", "x.id", "x.fingerprint"), "nodes")

    size = SAMPLES // BANDS
    buckets = nodes.select("id", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("fingerprint", k * size + 1, size)) for k in range(BANDS)])).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("bucket", "size")
    met = in_blocks(buckets.join(shared, "bucket").join(nodes.select("id", "fingerprint"), "id"), "bucket", F.col("size"), "fingerprint")
    suspected = written(components(written(_spanning(met, _suspects), "suspects").distinct()), "groups")

    sizes = suspected.groupBy("component").agg(F.count("*").alias("size"))
    own = nodes.withColumnRenamed("id", "node").drop("fingerprint")
    whole = given.withColumn("sha", F.sha2("text", 256)).join(suspected.join(sizes, "component").hint("merge"), "id").dropDuplicates(["id", "sha"])
    whole = whole.join(nodes.select("sha", "fingerprint"), "sha")
    blocks = in_blocks(whole, "component", F.col("size"), "text", "fingerprint")
    found = components(written(_spanning(blocks, _verified(similarity)), "links").distinct())

    out = rows.select("id", "sha").join(own, "sha", "left").join(found.withColumnRenamed("id", "node"), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node"))
    return out.select(F.col("id").alias("doc_id"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
