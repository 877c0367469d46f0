"""Image annotations in XML and COCO JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import points
from ..schemas import ANNOTATION_IMAGE, COCO


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each image. The schema is explicit: a lone shape would else be taken for a struct."""
    return spark.read.format("xml").options(rowTag="image").schema(ANNOTATION_IMAGE).load(path)


def shapes(images: DataFrame, kind: str) -> DataFrame:
    """(image, label, points) of each `points` or `polyline`; images without any give no rows."""
    return images.select(F.col("_name").alias("image"), F.explode(kind).alias("s")).select("image", F.col("s._label").alias("label"), points(F.col("s._points")).alias("points"))


def boxes(images: DataFrame) -> DataFrame:
    return images.select(F.col("_name").alias("image"), F.explode("box").alias("b")).select("image", F.col("b._label").alias("label"), F.col("b._xtl").alias("x0"), F.col("b._ytl").alias("y0"), F.col("b._xbr").alias("x1"), F.col("b._ybr").alias("y1"))


def line_pixels(lines: DataFrame, height: int, width: int, reach: int = 0) -> DataFrame:
    """(image, row, col): the pixels of each polyline, `reach` pixels around, inside the image. Ends beyond it are moved to its edge."""
    clamp = lambda x, top: F.greatest(F.lit(0.0), F.least(x, F.lit(float(top - 1))))
    ends = lines.select("image", F.explode(F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda k: F.struct(F.get("points", k - 1).alias("a"), F.get("points", k).alias("b")))).alias("s")).where("s.a is not null and s.b is not null")
    ends = ends.select("image", clamp(F.col("s.a.x"), width).alias("x0"), clamp(F.col("s.a.y"), height).alias("y0"), clamp(F.col("s.b.x"), width).alias("x1"), clamp(F.col("s.b.y"), height).alias("y1"))
    steps = F.greatest(F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))), F.lit(1))
    at = ends.withColumn("n", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).withColumn("t", F.col("k") / F.col("n"))
    at = at.select("image", F.bround(F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))).cast("int").alias("r"), F.bround(F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0"))).cast("int").alias("c"))
    around = F.sequence(F.lit(-reach), F.lit(reach))
    wide = at.withColumn("dr", F.explode(around)).withColumn("dc", F.explode(around)).select("image", (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"))
    return wide.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations with the box in four columns, categories."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    notes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    notes = notes.select("*", *[F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate(("x", "y", "w", "h"))]).drop("bbox")
    return doc.select(F.inline("images")), notes, doc.select(F.inline("categories"))
