"""Token log-probabilities from a log-bilinear neural model trained by noise-contrastive estimation.

The vectors of the three words before, each through its position's matrix, add up to a prediction; its products with the output
vectors, plus biases, are the scores of the outputs, and a softmax over all outputs normalises them. The outputs are the most
frequent words, groups of the next ones by frequency, and classes by ending for all other words. Inside a group a second softmax,
from the same prediction and the group's own output vectors, parts its words; inside a class a word has its smoothed share. Counts
cover every training token. Training passes over every training token too: tasks train copies of the model on their own texts,
copies are averaged after each slice of the corpus, and only the averaged model, of fixed size, comes to the driver. Which copy learns
a text, and in what order, follows from hashes, so the model does not depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Slab, groups, mix, partitions, prefix_hash, shared_dir, slabs, substring_hash, written

ORDER, DIM = 3, 16
WORDS, GROUPS, CLASSES = 128, 128, 64  # outputs
SIZE = 192  # words of a group
INPUTS, ENDINGS = WORDS + GROUPS * SIZE, 1024  # input vectors: of words, and of the endings of all other words
LEADING = 19  # bits of a word's hash that look it up
HEAD = 1 << 18  # so many counts at most go to every task; rarer words get theirs in a join
NOISE, GROUP_NOISE, BATCH, RATE, START = 32, 4, 4096, 0.02, 0.3  # START: Adagrad's sum of squares before a slice's first batch; higher rates lose what earlier slices taught
STEPS = 1024  # of a group's words, from which a draw looks its word up
ROWS = 1024  # tokens scored in one product
SLICES, PASSES, WORKER_TOKENS, MOST_WORKERS = 4, 1, 2_000_000, 1024
END = np.uint64(0x454E44)  # stands for the end of a text among word hashes


def endings(slab: Slab, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number below ENDINGS from each word's last three bytes."""
    out = np.zeros(len(end), np.uint64)
    for k in range(1, 4):
        at = end - k
        out = out * np.uint64(257) + np.where(at >= start, slab.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(out) % np.uint64(ENDINGS)).astype(np.int64)


def tokens(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of each word of lower-cased texts, in order with an end after each text; first of each text; is it an end."""
    slab = slab.lower()
    start, end, first = slab.words()
    hashes = substring_hash(prefix_hash(slab.data), start, end)
    n = len(slab)
    at = first[1:] + np.arange(n)
    is_end = np.zeros(len(hashes) + n, bool)
    is_end[at] = True
    out, tail = np.full(len(is_end), END), np.zeros(len(is_end), np.int64)
    out[~is_end], tail[~is_end] = hashes, endings(slab, start, end)
    return out, tail, first + np.arange(n + 1), is_end


# ---------------------------------------------------------------- counts


def counted(docs: DataFrame) -> DataFrame:
    """(hash, ending, n) over all tokens of docs (one binary column). A task's counts are summed before they are sent."""
    names = ["hash", "ending", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def summed(parts):
            keys, tail, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, tail, n = keys[order], tail[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], tail[first], np.add.reduceat(n, first)

        def batch_of(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names)

        for batch in batches:
            for slab in slabs(batch.column(0), 1 << 21):
                hashes, tail, _, _ = tokens(slab)
                if len(hashes):
                    held.append(summed([(hashes, tail, np.ones(len(hashes), np.int64))]))
                    size += len(held[-1][0])
                if size > 2_000_000:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield batch_of(held[0])
                        held, size = [], 0
        if held:
            yield batch_of(summed(held))

    return docs.mapInArrow(run, "hash long, ending int, n long").groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    total: int  # N
    distinct: int  # V
    keys: np.ndarray  # hashes of the head, ascending
    counts: np.ndarray
    inputs: np.ndarray  # input vector of each word of the head
    outputs: np.ndarray  # output of each input
    class_tokens: np.ndarray
    class_words: np.ndarray
    frequency: np.ndarray  # share of each output among the training tokens
    inside: np.ndarray  # share of each word among its group's tokens, group after group; 0 where a group has no more words

    def __post_init__(self) -> None:
        steps = np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING)
        self.starts = np.minimum(np.searchsorted(self.keys, steps), max(0, len(self.keys) - 1)).astype(np.int32)

    def look_up(self, hashes: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The input of each token and its index in the head, or -1."""
        if not len(self.keys):
            return INPUTS + tail, np.full(len(hashes), -1)
        # from the first key with the same leading bits, of which hashed words have few, on to the first that is not below
        last = len(self.keys) - 1
        at = self.starts.take((hashes >> np.uint64(64 - LEADING)).astype(np.int64))
        below = np.flatnonzero((self.keys.take(at) < hashes) & (at < last))
        while len(below):
            at[below] += 1
            now = at[below]
            below = below[(self.keys.take(now) < hashes[below]) & (now < last)]
        known = self.keys.take(at) == hashes
        return np.where(known & (self.inputs[at] >= 0), self.inputs[at], INPUTS + tail), np.where(known, at, -1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head is what a level of counts leaves of at most HEAD words; sums over the other words are made where they are."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sums = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()  # at most 16 x 64 rows
    total, distinct = sum(r.tokens for r in sums), sum(r.words for r in sums)
    least, room = 1 << 30, HEAD
    for r in sorted(sums, key=lambda r: -r.level):
        if r.words > room:
            break
        room -= r.words
        least = r.level
    head = counts.where(level >= least).collect()
    head.sort(key=lambda r: (-r.n, r.hash))
    hashes = np.array([r.hash for r in head], np.int64).view(np.uint64)
    counts_ = np.array([r.n for r in head], np.int64)
    tails = np.array([r.ending for r in head], np.int64)
    # the end of a text is always output and input 0
    order = np.concatenate([np.flatnonzero(hashes == END), np.flatnonzero(hashes != END)]).astype(int)
    shift = 0 if (hashes == END).any() else 1
    hashes, counts_, tails = hashes[order], counts_[order], tails[order]
    rank = np.arange(len(hashes)) + shift
    inputs = np.where(rank < INPUTS, rank, -1)
    own = rank < INPUTS
    outputs = np.concatenate([np.arange(WORDS), WORDS + np.arange(GROUPS * SIZE) // SIZE, WORDS + GROUPS + np.arange(ENDINGS) % CLASSES])
    by_class = counts.groupBy(F.pmod("ending", F.lit(CLASSES)).alias("c")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class:
        class_tokens[r.c], class_words[r.c] = r.tokens, r.words
    np.subtract.at(class_tokens, tails[own] % CLASSES, counts_[own])
    np.subtract.at(class_words, tails[own] % CLASSES, 1)
    frequency = np.concatenate([np.zeros(WORDS + GROUPS), class_tokens]) + 0.5
    np.add.at(frequency, outputs[rank[own]], counts_[own])
    inside = np.zeros(GROUPS * SIZE)
    middle = own & (rank >= WORDS)
    inside[rank[middle] - WORDS] = counts_[middle]
    inside = (inside.reshape(GROUPS, SIZE) / np.maximum(1, inside.reshape(GROUPS, SIZE).sum(1))[:, None]).ravel()
    ascending = np.argsort(hashes)
    return Vocabulary(total, distinct, hashes[ascending], counts_[ascending], inputs[ascending], outputs, class_tokens, class_words, frequency / frequency.sum(), inside)


# ---------------------------------------------------------------- the model


def _log_share(scores: np.ndarray, own: np.ndarray, hidden: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The logarithm of each row's own share in the softmax of its scores (hidden @ weights), which are overwritten."""
    out = scores[np.arange(len(own)), own].astype(float)
    with np.errstate(over="ignore"):
        np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], np.float32)
    far = ~((total > 1e-30) & (total < 1e30))
    out -= np.log(np.where(far, 1, total).astype(float))
    for k in np.flatnonzero(far):  # beyond single precision
        z = hidden[k].astype(float) @ weights
        out[k] = z[own[k]] - z.max() - np.log(np.exp(z - z.max()).sum())
    return out


@dataclass
class Model:
    vectors: np.ndarray  # inputs x DIM
    matrices: np.ndarray  # ORDER x DIM x DIM
    outputs: np.ndarray  # outputs x DIM
    bias: np.ndarray
    members: np.ndarray  # words in groups x DIM
    member_bias: np.ndarray

    @staticmethod
    def initial(frequency: np.ndarray, inside: np.ndarray) -> Model:
        rng = np.random.default_rng(7)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        share = np.where(inside > 0, np.log(np.maximum(inside, 1e-300)), -1e4).astype(np.float32)
        return Model(small(INPUTS + ENDINGS, DIM), np.stack([np.eye(DIM, dtype=np.float32) * 0.5**k for k in range(ORDER)]), small(len(frequency), DIM), np.log(frequency).astype(np.float32), np.zeros((len(inside), DIM), np.float32), share)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.vectors, self.matrices, self.outputs, self.bias, self.members, self.member_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def filled(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)

    def prepared(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Vectors through each position's matrix, and the weights of outputs and of words in groups with their biases, made once for many texts."""
        top = float(self.bias.max())  # taken off all scores, which then seldom are far from 0
        weights = np.concatenate([self.outputs, (self.bias - top)[:, None]], 1).T.copy()
        return [self.vectors @ m for m in self.matrices], weights, np.concatenate([self.members, self.member_bias[:, None]], 1)

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray, outputs: np.ndarray, prepared: tuple | None = None) -> np.ndarray:
        """The natural logarithm of each target's probability after its context (nearest word first), in batches of products.

        Targets are inputs, and `outputs` says which output stands for each; for an ending it is the probability of its class.
        """
        tables, weights, members = prepared or self.prepared()
        out = np.empty(len(targets))
        hidden, scores = np.ones((ROWS, DIM + 1), np.float32), np.empty((ROWS, len(self.bias)), np.float32)
        to = outputs[targets]
        member = (targets >= WORDS) & (targets < INPUTS)
        kept = [np.empty((0, DIM + 1), np.float32)]
        for lo in range(0, len(targets), ROWS):
            c, t = contexts[lo : lo + ROWS], to[lo : lo + ROWS]
            h, s = hidden[: len(t)], scores[: len(t)]
            h[:, :DIM] = tables[0].take(c[:, 0], 0)
            for k in range(1, ORDER):
                h[:, :DIM] += tables[k].take(c[:, k], 0)
            kept.append(h[member[lo : lo + ROWS]])
            np.matmul(h, weights, out=s)
            out[lo : lo + ROWS] = _log_share(s, t, h, weights)
        at = np.flatnonzero(member)
        if len(at):
            out[at] += self._inside(np.concatenate(kept), targets[at] - WORDS, members)
        return out

    @staticmethod
    def _inside(hidden: np.ndarray, member: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The logarithm of each member's share of its group, one product for each group."""
        order = np.argsort(member // SIZE, kind="stable")
        group = member[order] // SIZE
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out = np.empty(len(member))
        scores = np.empty((ROWS, SIZE), np.float32)
        for start, end in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            own = weights[int(group[start]) * SIZE : (int(group[start]) + 1) * SIZE].T
            for lo in range(start, end, ROWS):
                rows = order[lo : min(end, lo + ROWS)]
                h, s = hidden[rows], scores[: len(rows)]
                np.matmul(h, own, out=s)
                out[rows] = _log_share(s, member[rows] % SIZE, h, own)
        return out

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], words: Vocabulary, seed: list[int]) -> None:
        """Noise-contrastive estimation with Adagrad. Each batch shares its noise among the outputs, drawn by frequency; a word in a
        group also has noise of its own, drawn by frequency from the group. Gradients are sums over a batch, so a rare word's step does
        not shrink with the batch."""
        rng = np.random.default_rng(seed)
        frequency, outputs = words.frequency, words.outputs
        log_noise = np.log(NOISE * frequency).astype(np.float32)
        log_inside = np.log(GROUP_NOISE * np.maximum(words.inside, 1e-30)).astype(np.float32)
        cumulative = np.cumsum(frequency)
        within = np.cumsum(words.inside.reshape(GROUPS, SIZE), axis=1)
        within = (within / np.maximum(within[:, -1:], 1e-30) + np.arange(GROUPS)[:, None]).ravel()  # group g from g to g + 1
        starts = np.searchsorted(within, np.arange(GROUPS * STEPS + 1) / STEPS, side="right")
        # vectors of outputs and of words in groups with their biases, and a last column that stays 0, as columns are summed two by two
        wide = lambda vectors, bias: np.concatenate([vectors, bias[:, None], np.zeros((len(bias), 1), np.float32)], 1)
        parts = self.vectors, self.matrices.reshape(ORDER * DIM, DIM), wide(self.outputs, self.bias), wide(self.members, self.member_bias)
        vectors, matrices, outs, members = parts
        seen = [np.full(x.shape, START, np.float32) for x in parts]
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

        def step(k, rows, gradient):
            squares = seen[k].take(rows, 0)
            squares += gradient * gradient
            seen[k][rows] = squares
            np.sqrt(squares, out=squares)
            moved = RATE * gradient
            moved /= squares
            now = parts[k].take(rows, 0)
            now -= moved
            parts[k][rows] = now

        def by_row(rows, gradient):
            order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort
            rows = rows[order]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            # two columns as one complex number: half as many runs of additions
            return rows[first], np.add.reduceat(gradient.take(order, 0).view(np.complex64), first, axis=0).view(np.float32)

        def drawn(at):
            """The first places in `within` that are beyond `at`, from a table of steps on."""
            out = starts.take((at * STEPS).astype(np.int64))
            below = np.flatnonzero((within.take(out, mode="clip") <= at) & (out < len(within)))
            while len(below):
                out[below] += 1
                now = out[below]
                below = below[(within.take(now, mode="clip") <= at[below]) & (now < len(within))]
            return out

        for contexts, tokens_ in batches:
            n = len(tokens_)
            targets = outputs[tokens_]
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), len(frequency) - 1)
            inputs = vectors.take(contexts, 0).reshape(n, ORDER * DIM)
            hidden = np.zeros((n, DIM + 2), np.float32)
            hidden[:, :DIM], hidden[:, DIM] = inputs @ matrices, 1
            to, others = outs.take(targets, 0), outs.take(noise, 0)
            own = np.einsum("ij,ij->i", hidden, to) - log_noise[targets]
            other = hidden @ others.T - log_noise[noise]
            d_own, d_other = (sigmoid(own) - 1).astype(np.float32), sigmoid(other).astype(np.float32)
            to *= d_own[:, None]
            d_hidden = to + d_other @ others
            rows, g = by_row(np.concatenate([targets, noise]), np.concatenate([d_own[:, None] * hidden, d_other.T @ hidden]))
            at = np.flatnonzero((tokens_ >= WORDS) & (tokens_ < INPUTS))
            if len(at):
                member, h = tokens_[at] - WORDS, hidden[at]
                group = member // SIZE
                both = np.empty((len(at), 1 + GROUP_NOISE), np.int64)
                both[:, 0] = member
                both[:, 1:] = np.minimum(drawn((group[:, None] + rng.random((len(at), GROUP_NOISE))).ravel()).reshape(-1, GROUP_NOISE), (group[:, None] + 1) * SIZE - 1)
                known = members.take(both, 0)
                d = sigmoid(np.einsum("ij,ikj->ik", h, known) - log_inside[both])
                d[:, 0] -= 1
                d = d.astype(np.float32)
                d_hidden[at] += np.einsum("ik,ikj->ij", d, known)
                step(3, *by_row(both.ravel(), (d[:, :, None] * h[:, None, :]).reshape(-1, DIM + 2)))
            d_hidden = np.ascontiguousarray(d_hidden[:, :DIM])
            d_vectors = d_hidden @ matrices.T
            d_matrices = inputs.T @ d_hidden
            step(2, rows, g)
            step(1, np.arange(ORDER * DIM), d_matrices)
            step(0, *by_row(contexts.ravel(), d_vectors.reshape(-1, DIM)))
        self.outputs[:], self.bias[:], self.members[:], self.member_bias[:] = outs[:, :DIM], outs[:, DIM], members[:, :DIM], members[:, DIM]


def contexts(inputs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The inputs of the ORDER tokens before each token, nearest first; before a text's start stands the end."""
    out = np.zeros((len(inputs), ORDER), np.int64)
    for k in range(1, ORDER + 1):
        out[k:, k - 1] = inputs[:-k]
        for j in range(k):
            at = first[:-1] + j
            out[at[at < first[1:]], k - 1] = 0
    return out


def _trained(sequences: DataFrame, model: Model, words: Vocabulary) -> Model:
    """sequences (slice, worker, key, ids: 16-bit inputs of a text's tokens). A slice's copies are averaged in blocks by Spark."""
    spark = sequences.sparkSession
    width = 1 << 14

    for turn in range(SLICES):
        known = spark.sparkContext.broadcast((model, words))

        def run(batches: Iterator[pa.RecordBatch], known=known, turn=turn) -> Iterator[pa.RecordBatch]:
            start, words = known.value
            worker = copy = None
            seen = pieces = size = 0
            rows: list[np.ndarray] = []

            def examples():
                ids = np.concatenate(rows).astype(np.int64)
                before = contexts(ids, np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
                for p in range(PASSES):
                    order = np.random.default_rng([turn, worker, pieces, p]).permutation(len(ids))
                    for lo in range(0, len(order), BATCH):
                        yield before[order[lo : lo + BATCH]], ids[order[lo : lo + BATCH]]

            def learn():
                nonlocal seen, pieces, size, rows
                if rows:
                    copy.train(examples(), words, [turn, worker, pieces])
                    seen, pieces, size, rows = seen + size, pieces + 1, 0, []

            def result():
                flat = copy.flat()
                blocks = [flat[k : k + width] for k in range(0, len(flat), width)]
                return pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([worker] * len(blocks), pa.int32()), pa.array([float(seen)] * len(blocks)), pa.array(blocks, pa.list_(pa.float32()))], ["block", "worker", "weight", "values"])

            for batch in batches:
                for w, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if w != worker:
                        if worker is not None:
                            learn()
                            yield result()
                        worker, copy, seen, pieces = w, start.filled(start.flat()), 0, 0
                    rows.append(np.frombuffer(x.as_buffer(), np.uint16))
                    size += len(rows[-1])
                    if size >= WORKER_TOKENS:
                        learn()
            if worker is not None:
                learn()
                yield result()

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in groups(batches, 1):
                total, weight = 0.0, 0.0
                for values, w in zip(block.column("values"), block.column("weight").to_pylist(), strict=True):
                    total = total + w * values.values.to_numpy().astype(float)
                    weight += w
                yield pa.RecordBatch.from_arrays([block.column("block").combine_chunks()[:1], pa.array([(total / weight).astype(np.float32)], pa.list_(pa.float32()))], ["block", "values"])

        part = sequences.where(F.col("slice") == turn).repartition(partitions(spark), "worker").sortWithinPartitions("worker", "key", "ids").select("worker", "ids")
        copies = part.mapInArrow(run, "block int, worker int, weight double, values array<float>")
        averaged = copies.repartition(partitions(spark), "block").sortWithinPartitions("block", "worker").mapInArrow(mean, "block int, values array<float>").collect()
        if averaged:
            model = model.filled(np.concatenate([r["values"] for r in sorted(averaged, key=lambda r: r.block)]))
        known.unpersist()
    return model


# ---------------------------------------------------------------- the operator


def fold(id: str | Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fit(rows: DataFrame) -> tuple[DataFrame, Vocabulary, Model]:
    """Counts of all words, the head of the vocabulary and the model, from the texts of rows (doc_id, t: binary)."""
    spark = rows.sparkSession
    shared_dir(spark)
    counts = written(counted(rows.select("t")), "counts")
    words = vocabulary(counts)
    model = Model.initial(words.frequency, words.inside)
    if not words.total:
        return counts, words, model
    known = spark.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(0)):
                hashes, tail, first, is_end = tokens(slab)
                ids = known.value.look_up(hashes, tail)[0]
                ids[is_end] = 0
                ids = ids.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(slab.lo, len(slab)) for k in (1, 2, 3)), pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["slice", "worker", "key", "ids"])

    workers = int(min(MOST_WORKERS, max(1, words.total // SLICES // WORKER_TOKENS)))
    key = F.xxhash64("doc_id", "t")  # copies of a text have keys of their own
    dealt = rows.select("t", key.alias("key")).select("t", F.pmod("key", F.lit(SLICES)).cast("int"), F.pmod(F.shiftright("key", 8), F.lit(workers)).cast("int"), "key")
    sequences = written(dealt.mapInArrow(encode, "slice int, worker int, key long, ids binary"), "sequences")
    return counts, words, _trained(sequences, model, words)


def score(docs: DataFrame, *, id: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (5, 1)) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose id's checksum leaves held_out[1] modulo held_out[0] are scored but not learnt from. base_score is the smoothed
    unigram's and score the model's base-10 logarithm of the whole text's probability. A null or empty text is one end. Without any
    training token every token is unknown. Rows are scored one by one, repeated ones alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n, rest = held_out
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), (fold(id, n) == rest).alias("held_out"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    counts, words, model = fit(rows.where("not held_out").select("doc_id", "t"))
    known = spark.sparkContext.broadcast(words)
    trained = spark.sparkContext.broadcast(model)
    base_below = math.log10(words.total + 0.5 * (words.distinct + 1))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = known.value, trained.value
        prepared = model.prepared()
        row = TaskContext.get().partitionId() << 40
        class_below = np.log10(words.class_tokens + 0.5 * (words.class_words + 1))
        counts = np.log10(words.counts + 0.5)
        for batch in batches:
            for slab in slabs(batch.column(2)):
                hashes, tail, first, is_end = tokens(slab)
                inputs, at = words.look_up(hashes, tail)
                inputs[is_end] = 0
                own = model.log_probabilities(contexts(inputs, first), inputs, words.outputs, prepared) / math.log(10)
                inside = inputs >= INPUTS
                shared = np.where(at >= 0, counts[at] if len(counts) else 0.0, 0.0)  # log10(c + 0.5), for rare words added later
                rare = at < 0
                if len(words.keys) == 0 or not (words.keys == END).any():  # no end was counted
                    rare = rare & ~is_end
                    shared[is_end & (at < 0)] = math.log10(0.5)
                own += np.where(inside, shared - class_below[np.where(inside, (inputs - INPUTS) % CLASSES, 0)], 0.0)
                sums = lambda x: np.add.reduceat(x, first[:-1])
                lengths = np.diff(first)
                rare_first = np.concatenate([[0], np.cumsum(rare)])[first].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(slab))),
                        batch.column(0).slice(slab.lo, len(slab)),
                        batch.column(1).slice(slab.lo, len(slab)),
                        pa.array(lengths),
                        pa.array(sums((at >= 0).astype(np.int64))),
                        pa.array(sums(shared - base_below)),
                        pa.array(sums(own)),
                        pa.ListArray.from_arrays(pa.array(rare_first), pa.array(hashes[rare].view(np.int64))),
                    ],
                    names,
                )
                row += len(slab)

    scored = written(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("hash")).join(counts.select("hash", "n"), "hash", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.count("n").alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return (
        scored.drop("rare")
        .join(rare, "row", "left")
        .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
    )
