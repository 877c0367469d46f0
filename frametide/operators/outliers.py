"""Outliers in each recording: local outlier factors, isolation forests, and the principal components that they may look at.

Recordings of a bounded number of rows are taken whole, many at a time. A longer one's rows are never gathered: neighbours come from the
table of cells, densities and factors from joins and means; forests grow on a bounded sample of a recording and score its rows in blocks;
components come from covariances that Spark aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import isolation_forest, local_outlier_factor
from ..storage import written
from .neighbours import search
from .tracks import _same, row_by_row

#: Rows of a recording from which its trees draw their samples, those with the least hashes; and rows scored at once.
POOL, BLOCK = 4096, 8192
#: A recording of more points has its neighbours from cells and its factors from joins.
WHOLE = 4096


def _whole(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose columns are all finite numbers."""
    kept = F.lit(True)
    for c in columns:
        kept = kept & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < F.lit(float("inf")))
    return df.where(kept)


def local_outliers(df: DataFrame, key: list[str], features: list[str], id: str, *, neighbours: int = 30, share: float = 0.1, whole: int = WHOLE) -> DataFrame:
    """Key, id, `anomaly` and `inlier`: the local outlier factor of each row among its recording's, and whether it is not beyond the
    quantile that puts `share` of them out.

    Neighbours are exact, ties go to the smaller id; a recording of fewer rows uses all others. A single row has the factor 1. Ids
    are unique in a recording; rows that share one get one factor. Rows with a feature that is no finite number go. A recording of up to
    `whole` rows is compared in one array, and no list of neighbours leaves its task.
    """
    rows = _whole(df, features).select(*key, F.col(id).alias("_id"), F.array(*[F.col(f).cast("double") for f in features]).alias("_v"))
    rows = written(rows, "points")
    sizes = written(rows.groupBy(*key).agg(F.count("*").alias("_n")), "sizes")
    long, same = _same(key, sizes.where(F.col("_n") > whole).drop("_n"))

    def run(part: pa.Table, bounds: np.ndarray) -> list:
        v = part.column("_v").combine_chunks().flatten().to_numpy().reshape(len(part), len(features))
        known, ids = part.column("_id").is_valid().to_numpy(), part.column("_id").combine_chunks().dictionary_encode().indices
        ids, factor, inlier = ids.fill_null(-1).to_numpy(zero_copy_only=False), np.ones(len(part)), np.ones(len(part), bool)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.flatnonzero(known[lo:hi]) + lo  # a row without an id has no neighbours
            factor[own] = local_outlier_factor(v[own], ids[own], neighbours)
            # Factors that are equal but for rounding are on one side of the bound.
            inlier[lo:hi] = factor[lo:hi] <= np.quantile(factor[lo:hi], 1 - share) * (1 + 1e-9)
        return [factor, inlier]

    made = lambda rows: row_by_row(rows, key, ["_id"], run, "anomaly double, inlier boolean").select(*key, F.col("_id").alias(id), "anomaly", "inlier")
    if long.isEmpty():
        return made(rows)
    return made(rows.join(long, same, "left_anti")).unionByName(_joined_outliers(rows.join(long, same, "left_semi"), key, id, neighbours, share))


def _joined_outliers(rows: DataFrame, key: list[str], id: str, neighbours: int, share: float) -> DataFrame:
    """local_outliers() of rows (key, _id, _v) of recordings of any size."""
    rows = rows.select(*key, F.col("_id").alias("id"), F.to_json(F.struct(*key)).alias("frame"), F.col("_v").alias("v"))
    near = written(search(rows, rows, "frame", neighbours, apart=True).withColumn("d", F.sqrt("d")), "near")
    radius = near.groupBy("frame", F.col("a").alias("b")).agg(F.max("d").alias("radius"))
    density = near.join(radius, ["frame", "b"]).groupBy("frame", "a").agg((1 / (F.avg(F.greatest("d", "radius")) + 1e-10)).alias("density"))
    density = written(density, "density")
    around = near.join(density.select("frame", F.col("a").alias("b"), F.col("density").alias("other")), ["frame", "b"]).groupBy("frame", "a").agg(F.avg("other").alias("mean"))
    factor = around.join(density, ["frame", "a"]).select("frame", F.col("a").alias("id"), (F.col("mean") / F.col("density")).alias("anomaly"))
    scored = rows.drop("v").join(factor, ["frame", "id"], "left").withColumn("anomaly", F.coalesce("anomaly", F.lit(1.0)))
    bound = scored.groupBy("frame").agg(F.percentile("anomaly", 1 - share).alias("_bound"))
    return scored.join(bound, "frame").select(*key, F.col("id").alias(id), "anomaly", (F.col("anomaly") <= F.col("_bound") * (1 + 1e-9)).alias("inlier"))


def principal(df: DataFrame, key: list[str], features: list[str], components: int) -> tuple[DataFrame, list[str]]:
    """df with each row's first principal components among its recording's rows, of centred and unscaled features, and their names.

    Means and covariances are aggregates; only the small matrix of each recording meets numpy. A component's largest loading is
    positive. Rows with a feature that is no finite number go.
    """
    rows, d = _whole(df, features), len(features)
    components = min(components, d)
    x = [F.col(f).cast("double") for f in features]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy(*key).agg(F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("cov"))
    kinds = dict(df.dtypes)

    def run(parts):
        for part in parts:
            loadings = []
            for cov in part["cov"]:
                full = np.zeros((d, d))
                for (i, j), c in zip(pairs, cov, strict=True):
                    full[i, j] = full[j, i] = c
                turned = np.linalg.eigh(full)[1][:, ::-1][:, :components].T
                largest = np.abs(turned).argmax(1)
                loadings.append((turned * np.where(turned[np.arange(components), largest] < 0, -1, 1)[:, None]).ravel().tolist())
            yield part[[*key, "mean"]].assign(_load=loadings)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "mean array<double>, _load array<double>"])
    turned, same = _same(key, sums.mapInPandas(run, schema).withColumnRenamed("mean", "_mean"))
    out = rows.join(turned, same)
    names = [f"component{k + 1}" for k in range(components)]
    for k, name in enumerate(names):
        dot = F.lit(0.0)
        for i in range(d):
            dot = dot + (x[i] - F.get("_mean", F.lit(i))) * F.get("_load", F.lit(k * d + i))
        out = out.withColumn(name, dot)
    return out.select(*df.columns, *names), names


def isolated(df: DataFrame, key: list[str], features: list[str], id: str, *, components: int | None = None, seed: int = 0, pool: int = POOL, block: int = BLOCK) -> DataFrame:
    """Key, id, `anomaly` (an isolation score, above 1/2 odd) and `inlier` of each row among its recording's, on at most `components`
    principal components.

    Trees draw their samples of 256 from the recording's `pool` rows with the least hashes of seed and id, all rows of a shorter one;
    every row is scored. Short recordings, of as many rows at most as are drawn, are scored many at a time. A longer one's rows are scored
    in blocks that are dealt by hash, and each block's task grows the same seeded trees. A single row has the score 0.
    Rows with a feature that is no finite number go.
    """
    rows, names = (principal(df, key, features, components) if components else (_whole(df, features), features))
    rows = rows.select(*key, F.col(id).alias("_id"), F.array(*[F.col(n).cast("double") for n in names]).alias("_v"))
    rows = written(rows.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_id").cast("string"))), "points")
    sizes = written(rows.groupBy(*key).agg(F.count("*").alias("_n")), "sizes")
    long, same = _same(key, sizes.where(F.col("_n") > min(pool, block)).select(*key, F.ceil(F.col("_n") / F.lit(block)).alias("_blocks")))

    def short(part: pa.Table, bounds: np.ndarray) -> list:
        v = part.column("_v").combine_chunks().flatten().to_numpy().reshape(len(part), len(names))
        found = [isolation_forest(v[lo:hi], seed=seed) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        return [np.concatenate([f[k] for f in found]) if found else np.empty(0, kind) for k, kind in enumerate((float, bool))]

    score = lambda rows: row_by_row(rows, key, ["_hash", "_id"], short, "anomaly double, inlier boolean").select(*key, F.col("_id").alias(id), "anomaly", "inlier")
    if long.isEmpty():
        return score(rows)
    apart, rows = score(rows.join(long, same, "left_anti")), rows.join(long, same).select(*rows.columns, "_blocks")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("_hash", "_id"))
    drawn = rows.withColumn("_nth", nth).where(F.col("_nth") <= pool)
    dealt = rows.select(*key, F.pmod("_hash", "_blocks").alias("_block"), "_id", "_v")
    drawn = drawn.select(*[F.col(k).alias(f"_p_{k}") for k in key], F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_p_block"), F.col("_hash").alias("_p_hash"), F.col("_id").alias("_p_id"), F.col("_v").alias("_p_v"))
    kinds = dict(df.dtypes)

    def run(name: tuple, part: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({c: np.empty(0, object) for c in [*key, id, "anomaly", "inlier"]})
        sample = sample.sort_values(["_p_hash", "_p_id"], kind="stable")
        score, keep = isolation_forest(np.stack([*sample["_p_v"], *part["_v"]]), seed=seed, among=len(sample))
        out = pd.DataFrame({k: part[k] for k in key} | {id: part["_id"]})
        return out.assign(anomaly=score[len(sample) :], inlier=keep[len(sample) :])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), f"`{id}` {kinds[id]}, anomaly double, inlier boolean"])
    return apart.unionByName(dealt.groupBy(*key, "_block").cogroup(drawn.groupBy(*[f"_p_{k}" for k in key], "_p_block")).applyInPandas(run, schema))
