"""A quality classifier by compression.

Zstandard dictionaries are built from labelled good text and from bad text, a few pairs of them from different texts. A text is
compressed in blocks with each; the difference of the two kinds' sizes, divided by the text's size, says which kind it resembles,
and a logistic curve fitted on labelled texts that the dictionaries have not seen turns it into a probability of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: What the fit reads: so many labelled texts of each class, and of each at most so many blocks of BLOCK bytes, spread over the whole text.
SAMPLE_TEXTS, SAMPLE_BLOCKS = 2400, 16
PAIRS, DICTIONARY_BYTES, BLOCK, LEVEL = 3, 112640, 1 << 11, 3
THRESHOLD = 0.7


@dataclass
class Model:
    pairs: list[tuple[bytes, bytes]]
    slope: float
    intercept: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.by = [tuple(self._compressor(x) for x in pair) for pair in model.pairs]

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(data)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(self, text: bytes) -> float:
        """(size with a bad dictionary - size with a good one) / size, the mean over the pairs; 0 for an empty text."""
        if not text or not self.by:
            return 0.0
        blocks = [memoryview(text)[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
        return sum(len(bad.compress(x)) - len(good.compress(x)) for good, bad in self.by for x in blocks) / len(text) / len(self.by)

    def score(self, text: bytes) -> float:
        z = self.model.slope * self.difference(text) + self.model.intercept
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[k : k + BLOCK] for t in texts for k in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def train(good: list[bytes], bad: list[bytes], share: tuple[int, int] | None = None) -> Model:
    """Of PAIRS + 1 texts of a class one fits the curve and each other goes into one of the dictionaries.

    share: how many texts of each class there are outside the sample, which sets the curve's height. With a class missing, the
    score is the smoothed share for every text.
    """
    n, m = share or (len(good), len(bad))
    prior = math.log((n + 1) / (m + 1))
    if min(len(good), len(bad)) <= PAIRS:
        return Model([], 0.0, prior)
    model = Model([(_dictionary(good[k :: PAIRS + 1]), _dictionary(bad[k :: PAIRS + 1])) for k in range(PAIRS)], 0.0, prior)
    scorer = model.scorer()
    held = [(scorer.difference(t), y) for y, texts in ((1.0, good), (0.0, bad)) for t in texts[PAIRS :: PAIRS + 1]]
    x, y = np.array(held).T
    here = math.log((y.sum() + 1) / ((1 - y).sum() + 1))
    # Platt's targets, then Newton's steps on the logistic loss with a slight ridge.
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale, ridge = x.std() + 1e-9, np.array([1e-3, 1e-6])
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.intercept = float(w[0] / scale), float(w[1]) + prior - here
    return model


def fold(id: str | Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def spread(text: str) -> Column:
    """A text's bytes, or of a longer one SAMPLE_BLOCKS blocks at equal distances from its start to its end."""
    raw = F.col(text).cast("binary")
    room = F.octet_length(raw) - F.lit(BLOCK)
    blocks = [F.substring(raw, (F.floor(room * F.lit(k) / F.lit(SAMPLE_BLOCKS - 1)) + 1).cast("int"), F.lit(BLOCK)) for k in range(SAMPLE_BLOCKS)]
    return F.when(F.octet_length(raw) <= SAMPLE_BLOCKS * BLOCK, raw).otherwise(F.concat(*blocks))


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", held_out: tuple[int, int] | None = (4, 2)) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out.

    The ids are chosen first, by the order of a hash, at most SAMPLE_TEXTS of each class; only these texts are fetched, and of each
    SAMPLE_BLOCKS blocks from all over it at most. Both bounds hold at any size of the tables. Labels other than 0 and 1 are ignored,
    as are nulls. With PAIRS texts of a class or fewer there is no dictionary and every text's score is the smoothed share of label 1;
    where a class has too little text to train a dictionary on (a few KB), its text itself, or the last 110 KB of it, is the dictionary.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label"))
    if held_out:
        known = known.where(fold("_id", held_out[0]) != held_out[1])
    count = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    order = F.md5(F.col("_id").cast("string"))
    chosen = [r for k in (0, 1) for r in known.where(F.col("_label") == k).select("_id", "_label").distinct().orderBy(order, "_id").limit(SAMPLE_TEXTS).collect()]
    if not chosen:
        return train([], [])
    ids = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in chosen], known.schema)
    found = docs.select(F.col(id).alias("_id"), spread(text).alias("_text")).where(F.col("_text").isNotNull()).join(F.broadcast(ids), "_id").groupBy("_id", "_label").agg(F.min("_text")).collect()
    found = sorted(found, key=lambda r: (str(r[0]), r[1]))
    return train([bytes(r[2]) for r in found if r[1] == 1], [bytes(r[2]) for r in found if r[1] == 0], (count.get(1, 0), count.get(0, 0)))


def score(docs: DataFrame, model: Model, *, text: str = "text", as_: str = "score") -> DataFrame:
    """docs with a column `score`: each whole text's probability of label 1. Null and empty texts get the curve's value at 0.

    A column of docs that is called as_, in whatever case, is replaced; the other columns stay whatever they are called.
    """
    columns = [c for c in docs.columns if c.lower() != as_.lower()]
    out = docs.select(*columns, F.lit(0.0).alias(as_)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            scores = pa.array([scorer.score(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in raw], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*columns, as_])

    return docs.select(*columns, F.col(text).cast("binary").alias(free_name("_raw", columns))).mapInArrow(run, out)
