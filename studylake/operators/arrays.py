"""Pixel and point arrays in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rescale(a: Column, slope: float, intercept: float) -> Column:
    return F.transform(a, lambda x: x * slope + intercept)


def window(a: Column, center: float, width: float, inverted: bool = False) -> Column:
    """Linear between the window's ends, clamped to 0..255 and cut to an integer; a width of 0 or less leaves minmax()."""
    if width <= 0:
        return minmax(a)
    level = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - (center - width / 2)) / width * 255))
    return F.transform(a, lambda x: ((F.lit(255.0) - level(x)) if inverted else level(x)).cast("int"))


def minmax(a: Column) -> Column:
    """Linear to 0..255; equal samples become 128."""
    return F.when(F.array_max(a) == F.array_min(a), F.transform(a, lambda x: F.lit(128))).otherwise(F.transform(a, lambda x: ((x - F.array_min(a)) / (F.array_max(a) - F.array_min(a)) * 255).cast("int")))


def threshold(rows: DataFrame, key: str, a: Column, level: float) -> DataFrame:
    """key, above (count), share, mask."""
    mask = F.transform(a, lambda x: (x > level).cast("int"))
    return rows.select(key, mask.alias("mask")).select(key, F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("above"), "mask").select(key, "above", F.when(F.size("mask") > 0, F.col("above") / F.size("mask")).alias("share"), "mask")


def downsample(a: Column, n: int) -> Column:
    """Means of n cells, (sum + size / 2) / size in whole numbers; cells by integer division, one sample at least."""
    size = F.size(a)

    def cell(i: Column) -> Column:
        low = F.floor(i * size / n).cast("int")
        high = F.greatest(low + 1, F.floor((i + 1) * size / n).cast("int"))
        part = F.slice(a, low + 1, high - low)
        return F.floor((F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")) + F.floor((high - low) / 2)) / (high - low)).cast("long")

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)


def downsample_2d(a: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Area means of a row-major image of width x height samples (not negative), row-major as well: cells by integer division in both directions, one row and column at least, rounded half up.

    In a smaller image each sample is added once; in a larger one cells repeat samples. An image without samples gives zeros.
    """
    edge = lambda i, size, n: F.floor(i * size / n).cast("int")
    far = lambda i, size, n: F.least(F.greatest(edge(i + 1, size, n), edge(i, size, n) + 1), size)

    def cell(y: Column, x: Column) -> Column:
        top, low, left, right = edge(y, height, to_height), far(y, height, to_height), edge(x, width, to_width), far(x, width, to_width)
        rows = F.transform(F.sequence(top, low - 1), lambda r: F.aggregate(F.slice(a, r * width + left + 1, right - left), F.lit(0).cast("long"), lambda s, v: s + v.cast("long")))
        n = (low - top) * (right - left)
        return F.floor((F.aggregate(rows, F.lit(0).cast("long"), lambda s, v: s + v) + F.floor(n / 2)) / n).cast("long")

    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(to_height - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(to_width - 1)), lambda x: cell(y, x))))
    return F.when((width > 0) & (height > 0), cells).otherwise(F.array_repeat(F.lit(0).cast("long"), to_width * to_height))


def to_patient(column: Column, row: Column, position: Column, orientation: Column, spacing: Column) -> Column:
    """(x, y, z) of a pixel: position + column * column spacing * row cosines + row * row spacing * column cosines; spacing is (row, column)."""
    g = lambda c, i: F.get(c, F.lit(i))
    return F.array(*(g(position, i) + column * g(spacing, 1) * g(orientation, i) + row * g(spacing, 0) * g(orientation, i + 3) for i in range(3)))


def contours(rows: DataFrame) -> DataFrame:
    """roi, contour, points, then one row a point: x, y, z. rows: roi, contours array<array<array<double>>>."""
    each = rows.select("roi", F.posexplode("contours").alias("contour", "p")).withColumn("points", F.size("p"))
    return each.select("roi", "contour", "points", F.posexplode("p").alias("n", "q")).select("roi", "contour", "points", "n", *(F.get("q", F.lit(i)).alias(c) for i, c in enumerate("xyz")))
