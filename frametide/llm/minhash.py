"""Near-duplicate documents by ProbMinHash.

A document's shingles, weighted by how often they occur, are Poisson processes whose arrivals land in registers; a register keeps
the shingle that arrived first, and a shingle stops once it can come first nowhere. Two documents agree in a register with their
probability Jaccard. Registers are banded into buckets; members of a bucket that agree in enough registers are suspects, and each
group of suspects is verified on whole texts. Large buckets and groups are compared in blocks of bounded size, which give spanning
links, never pairs. Equal texts are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, Slab, components, free_name, groups, mix, partitions, shingles, slabs, written

SIMILARITY, WIDTH = 0.8, 5
REGISTERS, BANDS = 64, 16
#: Pairs whose registers agree less than this are no suspects; at a similarity of 0.8 that is four deviations away.
LEAST_AGREEMENT = 0.6
BLOCK = 256


def weighted(slab: Slab, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles (52 bits of hash, ascending), their counts, and the index of each text's first."""
    hashes, first = shingles(slab, width)
    text = np.repeat(np.arange(len(slab), dtype=np.uint64), np.diff(first))
    keys = np.sort((text << np.uint64(52)) | (hashes >> np.uint64(12)))
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    starts = np.searchsorted(keys >> np.uint64(52), np.arange(len(slab) + 1, dtype=np.uint64))
    return keys & np.uint64((1 << 52) - 1), counts, starts


def signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The registers of each text, as 16-bit values; zeros for a text without shingles."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    least = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint16)
    arrival, active, turn = np.zeros(len(elements)), np.arange(len(elements)), 0
    while len(active):
        turn += 1
        seed = np.uint64((turn * _BASE) & ((1 << 64) - 1))
        r = mix(elements[active] ^ seed)
        arrival[active] -= np.log(((r >> np.uint64(11)) + 0.5) * 2.0**-53) / weights[active]
        x, slot = arrival[active], text[active] * registers + (mix(r) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(x < least[slot])
        better = better[np.argsort(-x[better], kind="stable")]  # of several, the earliest is written last
        least[slot[better]] = x[better]
        winner[slot[better]] = mix(elements[active][better]).astype(np.uint16)
        active = active[x < least.reshape(n, registers).max(1)[text[active]]]
    return winner.reshape(n, registers)


def probability_jaccard(a: np.ndarray, v: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Sum over common elements i of 1 / sum over all j of max(v_j / v_i, w_j / w_i); elements ascend, weights are positive."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    v, w = v.astype(float), w.astype(float)
    only = v.sum() - v[i].sum(), w.sum() - w[j].sum()
    ratios, counts = np.unique(np.stack([v[i], w[j]]), axis=1, return_counts=True)
    return float(sum(c / (only[0] / p + only[1] / q + np.maximum(v[i] / p, w[j] / q).sum()) for (p, q), c in zip(ratios.T, counts, strict=True)))


def signed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, h1, h2, words, sig): a 128-bit hash of the whole text, whether it has words, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            digest = np.empty((batch.num_rows, 2), np.uint64)
            sigs, full = [], []
            for slab in slabs(column):
                sig = signatures(*weighted(slab))
                sigs += [row.tobytes() for row in sig]
                bounds = slab.bounds
                raw = memoryview(slab.data)
                for k in range(len(slab)):
                    h = xxhash.xxh3_128_intdigest(raw[bounds[k] : bounds[k + 1]])
                    digest[slab.lo + k] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
                full += (sig.any(1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), pa.array(full, pa.bool_()), pa.array(sigs, pa.binary())], ["doc_id", "h1", "h2", "words", "sig"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, h1 long, h2 long, words boolean, sig binary")


def in_blocks(members: DataFrame, key: str, size: Column, *columns: str) -> DataFrame:
    """members as (key, lo, hi, side, id, *columns): a group of `size` rows is dealt into blocks by the id's hash, and every pair of
    blocks is a task's work. side: 0 in the lower block, 1 in the higher, 2 where both are one."""
    out = members.withColumn("_blocks", F.ceil(size / F.lit(float(BLOCK))).cast("int")).withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") < F.col("_other"), 0).otherwise(1)
    out = out.select(key, F.least("_mine", "_other").alias("lo"), F.greatest("_mine", "_other").alias("hi"), side.alias("side"), "id", *columns)
    return out.repartition(partitions(members.sparkSession), key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "id")


class Forest:
    """Joins members of a block; its trees give the links that the block sends on."""

    def __init__(self, n: int):
        self.above = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, k: int) -> int:
        while self.above[k] != k:
            self.above[k] = self.above[self.above[k]]
            k = self.above[k]
        return k

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.above[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def join_all(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            self.join(a, b)


def _spanning(blocks: DataFrame, solve) -> DataFrame:
    """(a, b): the links that solve(block) finds, of one pair of blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for block in groups(batches, 3):
            ids = block.column("id").to_numpy()
            side = block.column("side").to_numpy()
            held += [(int(ids[a]), int(ids[b])) for a, b in solve(block, np.flatnonzero(side != 1), np.flatnonzero(side != 0))]
            if len(held) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], ["a", "b"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _suspects(block: pa.Table, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    sigs = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in block.column("sig")])
    forest = Forest(len(sigs))
    for a in left.tolist():
        forest.join_all(a, right[(sigs[right] == sigs[a]).mean(1) >= LEAST_AGREEMENT])
    return forest.links


def _verified(similarity: float):
    def solve(block: pa.Table, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        parts, plain, sigs = [], [], []
        for slab in slabs(block.column("text")):
            elements, counts, first = weighted(slab)
            for k in range(len(slab)):
                e, c = elements[first[k] : first[k + 1]], counts[first[k] : first[k + 1]]
                parts.append((e, c))
                plain.append(bool((c == 1).all()))
            sigs.append(signatures(elements, counts, first))
        sigs = np.concatenate(sigs)
        sizes, plain = np.array([len(e) for e, _ in parts]), np.array(plain)
        forest = Forest(len(parts))
        right = right[sizes[right] > 0]
        if not len(right):
            return []
        known, at = np.unique(np.concatenate([e for e, _ in parts]), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        there = np.concatenate([at[bounds[b] : bounds[b + 1]] for b in right])
        starts = np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
        mine = np.zeros(len(known), np.int64)
        for a in left.tolist():
            own = at[bounds[a] : bounds[a + 1]]
            mine[own] = 1
            common = np.add.reduceat(mine[there], starts)
            mine[own] = 0
            both = plain[right] & plain[a]  # all counts 1: the probability Jaccard is the Jaccard
            forest.join_all(a, right[both & (common >= (similarity - 1e-12) * (sizes[a] + sizes[right] - common))])
            for b in right[~both & (common > 0) & ((sigs[right] == sigs[a]).mean(1) >= LEAST_AGREEMENT)].tolist():
                if forest.root(a) != forest.root(b) and probability_jaccard(*parts[a], *parts[b]) >= similarity - 1e-12:
                    forest.join(a, b)
        return forest.links

    return solve


def classes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs: doc_id, component_id (the smallest id its links reach) and kept (it has that id).

    Links join texts whose probability Jaccard of five-word shingles, weighted by count, is at least `similarity`, and equal texts.
    A null text is an empty one. Texts without words link to equal texts only, shorter ones than a shingle have one shingle.
    Rows with one id are one document, reached through any of its texts. A row with a null id is kept and has no component.
    """
    rows = written(signed(docs, id, text), "signatures")
    texts = rows.where("doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sig", "words")).alias("x"))
    nodes = written(texts.select(F.col("x.doc_id").alias("id"), F.col("x.sig").alias("sig"), "x.words", "h1", "h2"), "nodes")

    size = 2 * REGISTERS // BANDS
    buckets = nodes.where("words").select("id", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * size + 1, size)) for k in range(BANDS)])).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("bucket", "size")
    met = in_blocks(buckets.join(shared, "bucket").join(nodes.select("id", "sig"), "id"), "bucket", F.col("size"), "sig")
    suspected = written(components(written(_spanning(met, _suspects), "suspects").distinct()), "groups")

    sizes = suspected.groupBy("component").agg(F.count("*").alias("size"))
    whole = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # A merge join at every size: the suspects grow with the corpus as the texts do.
    whole = whole.join(suspected.join(sizes, "component").hint("merge"), "id").dropDuplicates(["id", "text"])
    blocks = in_blocks(whole, "component", F.col("size"), "text")
    found = components(written(_spanning(blocks, _verified(similarity)), "links").distinct())

    by_text = nodes.select("h1", "h2", F.col("id").alias("node"))
    out = rows.select("doc_id", "h1", "h2").join(by_text, ["h1", "h2"], "left").join(found.withColumnRenamed("id", "node"), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return out.select("doc_id", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs with one document of each class left, and of rows with its id one: the first by text (null first) and then by
    the other columns that have an order. Rows without an id stay."""
    kept = classes(docs, id=id, text=text, similarity=similarity).where("kept and doc_id is not null").select(F.col("doc_id").alias(id)).distinct()
    plain = [c for c, t in docs.dtypes if c.lower() not in (id.lower(), text.lower()) and "map<" not in t and t not in ("variant", "interval")]
    first = F.row_number().over(Window.partitionBy(id).orderBy(text, *[F.col(f"`{c}`") for c in plain]))
    nth = free_name("_nth", docs.columns)
    chosen = docs.where(F.col(id).isNotNull()).join(kept, id, "left_semi").withColumn(nth, first).where(F.col(nth) == 1)
    return chosen.select(*docs.columns).unionByName(docs.where(F.col(id).isNull()))
