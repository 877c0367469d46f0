"""Schemas of the inputs. Column order is part of the contract: measurement rows are positional arrays."""

from pyspark.sql import types as T


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


# Fixed names; the spellings of two of them are those of the measurement files.
MENISCUS = ("frame_num", "centroid_row_m", "centroid_col_m", "intensity_mean_m", "intensity_max_m", "intensity_min_m", "area_m", "axis_major_length_m", "axis_minor_length_m", "equivalent_diamter_area_m", "feret_diameter_max_m", "orientation_m", "perimiter_m", "eccentricity_m")
PROBOSCIS = ("frame_num", "centroid_row_p", "centroid_col_p", "eccentricity", "orientation", "intensity_mean", "intensity_max", "intensity_min", "minrow", "mincol", "maxrow", "maxcol", "major_axis_length", "area")
INTEGERS = {"frame_num", "minrow", "mincol", "maxrow", "maxcol"}

UNITS = T.StructType([T.StructField("filename", T.StringType()), *_doubles("px", "mm", "error", "ratio")])
POSTURES = T.StructType([T.StructField(n, T.StringType()) for n in ("filename", "isPerched", "curled")])
INTAKE = T.StructType([T.StructField("filename", T.StringType()), *_doubles("intake_vol")])

POINT = T.StructType([T.StructField("_label", T.StringType()), T.StructField("_points", T.StringType())])
BOX = T.StructType([T.StructField("_label", T.StringType()), *_doubles("_xtl", "_ytl", "_xbr", "_ybr")])
ANNOTATION_IMAGE = T.StructType(
    [
        T.StructField("_name", T.StringType()),
        T.StructField("_width", T.IntegerType()),
        T.StructField("_height", T.IntegerType()),
        T.StructField("box", T.ArrayType(BOX)),
        T.StructField("points", T.ArrayType(POINT)),
        T.StructField("polyline", T.ArrayType(POINT)),
    ]
)

COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("area", T.DoubleType()), T.StructField("iscrowd", T.IntegerType())]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
    ]
)

FRAME = "filename string, frame_num int, height int, width int, pixels binary"
REGION = "filename string, frame_num int, label int, centroid_row double, centroid_col double, minrow int, mincol int, maxrow int, maxcol int, area double, major_axis double, minor_axis double, orientation double, eccentricity double, intensity_mean double, intensity_max double, intensity_min double, equivalent_diameter double, feret_max double, perimeter double, extent double"
