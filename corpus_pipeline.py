"""From raw documents to shards of training data: five stages, each a table of its own.

Every stage takes what its predecessor kept and returns the columns of `documents`; the last adds the shard and the slot. A stage's
result is written to the shared folder as Parquet and read again, so that the loss of an executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm import decontaminate, minhash, mixing, quality, sharding
from frametide.llm.common import free_name, written


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the rest are rejected."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name("_score", docs.columns)
    return quality.score(docs, model, as_=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.dedup(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return mixing.repeated(docs)


def _sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.shard(docs, keep=True).select("row.*", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", _quality),
    ("MinHash near-dedup", _near_duplicates),
    ("benchmark decontamination", _decontamination),
    ("mixing sources", _mixing),
    ("sharding", _sharding),
]

#: SQL can't express the compression classifier and what follows from it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k + 1}")
    return docs
