"""A random forest that marks pixels by features of their neighbourhood, as one MLlib pipeline; features are column expressions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RADII = (1, 2, 4)


def features(pixels: DataFrame, key: list[str], radii: tuple[int, ...] = RADII) -> tuple[DataFrame, list[str]]:
    """pixels (key, row, col, value) with features, and their names: the value, and for each radius the mean, the spread and the two
    gradients of the square around. Sums along rows and then along columns, as window frames; at borders the square is cut."""
    rows = pixels.withColumn("f_value", F.col("value").cast("double"))
    names = ["f_value"]
    for r in radii:
        along, across = Window.partitionBy(*key, "row").orderBy("col"), Window.partitionBy(*key, "col").orderBy("row")
        wide, tall = along.rowsBetween(-r, r), across.rowsBetween(-r, r)
        rows = rows.withColumns({"_s": F.sum("f_value").over(wide), "_q": F.sum(F.col("f_value") * F.col("f_value")).over(wide), "_n": F.count("f_value").over(wide), f"f_dx{r}": F.coalesce(F.lead("f_value", r).over(along) - F.lag("f_value", r).over(along), F.lit(0.0))})
        rows = rows.withColumns({"_s": F.sum("_s").over(tall), "_q": F.sum("_q").over(tall), "_n": F.sum("_n").over(tall), f"f_dy{r}": F.coalesce(F.lead("f_value", r).over(across) - F.lag("f_value", r).over(across), F.lit(0.0))})
        rows = rows.withColumns({f"f_mean{r}": F.col("_s") / F.col("_n"), f"f_var{r}": F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), 2))})
        names += [f"f_mean{r}", f"f_var{r}", f"f_dx{r}", f"f_dy{r}"]
    return rows.drop("_s", "_q", "_n"), names


def fit(pixels: DataFrame, key: list[str], label: str, *, trees: int = 50, depth: int = 8, seed: int = 0, radii: tuple[int, ...] = RADII) -> PipelineModel:
    """The forest of labelled pixels; label is 0 or 1, pixels where it is null lend their values to neighbours only. Rows are ordered
    by key and place first, so that the seed fixes the forest."""
    rows, names = features(pixels, key, radii)
    rows = rows.where(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("double")).repartitionByRange(*key, "row", "col").sortWithinPartitions(*key, "row", "col")
    stages = [VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="skip"), RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.5)]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, pixels: DataFrame, key: list[str], *, radii: tuple[int, ...] = RADII) -> DataFrame:
    """pixels with `probability` of label 1 and `marked`."""
    from pyspark.ml.functions import vector_to_array

    rows, names = features(pixels, key, radii)
    out = model.transform(rows)
    return out.select(*pixels.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"), (F.col("prediction") == 1.0).alias("marked"))
