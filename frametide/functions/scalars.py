"""Column expressions: units, names and dates from file names, geometry, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TUBE_MM, TUBE_VOLUME = 5.5, 0.1

# The patterns of names and dates in recordings' file names.
DATE = r"\d{4}.\d{2}.\d{2}"
DATE_DASHES = r"\d{4}-\d{2}-\d{2}"
DATE_UNDERSCORES = r"\d{4}_\d{2}_\d{2}"
ANIMAL_CODE = r"moth\d{2}|mothM\d|mothDelta\d"


def lin_scale(px: Column) -> Column:
    """Millimetres a pixel; null where the distance is null or 0."""
    return F.try_divide(F.lit(TUBE_MM), px)


def vol_scale(px: Column) -> Column:
    """Volume a pixel; null where the distance is null or 0."""
    return F.try_divide(F.lit(TUBE_VOLUME), px)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def animal_name(filename: Column) -> Column:
    """From 'moth' up to the next '_', null where there is none."""
    return _or_null(F.regexp_extract(filename, r"(moth[^_]*)_", 1))


def animal_id(filename: Column) -> Column:
    """What follows 'moth' in any case, up to the next '_'."""
    return _or_null(F.regexp_extract(filename, r"(?i)moth([^_]*)_", 1))


def animal_code(filename: Column) -> Column:
    return _or_null(F.regexp_extract(filename, ANIMAL_CODE, 0))


def recording_date(filename: Column) -> Column:
    """The first date with any separators, as a date; null where it is none."""
    return F.try_to_date(F.translate(F.regexp_extract(filename, DATE, 0), "_", "-"))


def recording_date_strict(filename: Column) -> Column:
    """A date with dashes if there is one, else one with underscores."""
    dashes = _or_null(F.regexp_extract(filename, DATE_DASHES, 0))
    return F.coalesce(dashes, F.translate(_or_null(F.regexp_extract(filename, DATE_UNDERSCORES, 0)), "_", "-"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def pixel_shares(pixels: Column) -> Column:
    """The bytes of an image as numbers from 0 to 1."""
    digits = F.hex(pixels)
    byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("double")
    return F.when(F.octet_length(pixels) == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.octet_length(pixels) - 1), lambda k: byte(k) / 255.0))


def words_but_last(path: Column) -> Column:
    """A file name's parts at '_', '-' and '.', without the last, joined by spaces."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), r"[_\-.]")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")


def percent(share: Column) -> Column:
    """Rounded half to even to one digit."""
    return F.bround(share * 100.0, 1)


def points(packed: Column) -> Column:
    """'x,y;x,y' as an array of structs of doubles; null for null, no points for an empty text."""
    pairs = F.filter(F.split(packed, ";"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("x"), F.split(p, ",")[1].try_cast("double").alias("y")))


def box_around(row: Column, col: Column, height: int, width: int, rows: int = 5, cols: int = 20) -> Column:
    """A box of +-rows and +-cols around a rounded point, cut to the image."""
    r, c = F.bround(row).cast("int"), F.bround(col).cast("int")
    clamp = lambda x, top: F.greatest(F.lit(0), F.least(x, F.lit(top)))
    return F.struct(clamp(r - rows, height).alias("minrow"), clamp(c - cols, width).alias("mincol"), clamp(r + rows, height).alias("maxrow"), clamp(c + cols, width).alias("maxcol"))


def axis_ratio(major: Column, minor: Column) -> Column:
    return F.try_divide(major, minor)


def reach(orientation: Column, major: Column) -> Column:
    return F.cos(orientation) * major


def category(curling: Column, perched: Column) -> Column:
    """0 flying, 1 perched or curling, 2 both; null where a posture is missing."""
    return curling.cast("int") + perched.cast("int")
