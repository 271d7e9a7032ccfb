"""Raster operators on the pixel relation (img, x, y, v): one row per pixel.

The relational forms state what the array kernels compute, and SQL can check them. Neighbourhoods are
windows along rows and columns, never joins of pixels with pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.options import DEFAULTS, Options

V = F.col


def row(*key: str) -> Window:
    return Window.partitionBy("img", "y").orderBy("x")


def column() -> Window:
    return Window.partitionBy("img", "x").orderBy("y")


def grey(b: Column, g: Column, r: Column) -> Column:
    """Weighted grey of a pixel, rounded half up."""
    return F.floor((b * 114 + g * 587 + r * 299 + 500) / 1000).cast("int")


def fixed_inverse(v: Column, level: int = DEFAULTS.blank_level) -> Column:
    """0 above the level, else 255."""
    return F.when(v > level, 0).otherwise(255)


def above_zero(v: Column) -> Column:
    return F.when(v > 0, 255).otherwise(0)


def inverted(v: Column) -> Column:
    return F.lit(255) - v


def blank(pixels: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """img, blank: fewer than the fraction of the pixels are at or below the level."""
    return pixels.groupBy("img").agg((F.count_if(V("v") <= options.blank_level) < F.count(F.lit(1)) * options.blank_fraction).alias("blank"))


def otsu_level(pixels: DataFrame) -> DataFrame:
    """img, level: the threshold of the largest between-class variance, the lowest of equals; 0 for an
    image of one value. A histogram has 256 bins, so its windows are small; pixels leave a scan as counts."""
    bins = pixels.groupBy("img", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img")
    sums = (
        bins.withColumn("w", F.sum("n").over(upto))
        .withColumn("s", F.sum(V("n") * V("v")).over(upto))
        .withColumn("tw", F.sum("n").over(whole))
        .withColumn("ts", F.sum(V("n") * V("v")).over(whole))
    )
    apart = V("ts") * V("w") - V("tw") * V("s")
    between = F.when(V("w") < V("tw"), apart.cast("double") * apart.cast("double") / (V("w") * (V("tw") - V("w"))).cast("double"))
    return sums.withColumn("q", between).groupBy("img").agg(F.coalesce(F.max_by("v", F.when(V("q").isNotNull(), F.struct("q", (-V("v")).alias("o")))), F.lit(0)).alias("level"))


def otsu(pixels: DataFrame) -> DataFrame:
    """Pixels above their image's level 255, others 0."""
    return pixels.join(otsu_level(pixels), "img").select("img", "x", "y", F.when(V("v") > V("level"), 255).otherwise(0).alias("v"))


def sharpen(pixels: DataFrame) -> DataFrame:
    """Nine times the pixel less its eight neighbours, mirrored at the border without the edge, clipped."""

    def three(c: str, w: Window) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce(before, after, V(c)) + V(c) + F.coalesce(after, before, V(c))

    sums = pixels.withColumn("h", three("v", row())).withColumn("s", three("h", column()))
    return sums.select("img", "x", "y", F.least(F.lit(255), F.greatest(F.lit(0), 10 * V("v") - V("s"))).cast("int").alias("v"))


def dilate_two(pixels: DataFrame) -> DataFrame:
    """The largest of a pixel, the ones left and above, and the one between these."""
    wide = pixels.withColumn("v", F.max("v").over(row().rowsBetween(-1, 0)))
    return wide.select("img", "x", "y", F.max("v").over(column().rowsBetween(-1, 0)).alias("v"))


def _opened(pixels: DataFrame, to: str, length: int, iterations: int, along: str) -> DataFrame:
    window = row() if along == "row" else column()
    reach = window.rowsBetween(-(length // 2) * iterations, (length - 1 - length // 2) * iterations)
    return pixels.withColumn(to, F.min("v").over(reach)).withColumn(to, F.max(to).over(reach))


def opened(pixels: DataFrame, length: int = DEFAULTS.line_length, iterations: int = DEFAULTS.line_iterations, along: str = "row") -> DataFrame:
    """Opening with a line: `iterations` erosions, then as many dilations; outside counts for neither."""
    return _opened(pixels.select("img", "x", "y", "v"), "v", length, iterations, along)


def lines(pixels: DataFrame, length: int = DEFAULTS.line_length, iterations: int = DEFAULTS.line_iterations) -> DataFrame:
    """255 where an opening along rows or one along columns leaves something. Both masks ride on the
    pixels, so these are read once and nothing is joined."""
    both = _opened(_opened(pixels, "_rows", length, iterations, "row"), "_columns", length, iterations, "column")
    return both.select("img", "x", "y", F.when(F.greatest("_rows", "_columns") > 0, 255).otherwise(0).alias("v"))


def crop(pixels: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """The pixels of a half-open box, counted from its corner."""
    inside = pixels.where(V("x").between(x1, x2 - 1) & V("y").between(y1, y2 - 1))
    return inside.select("img", (V("x") - x1).alias("x"), (V("y") - y1).alias("y"), "v")


def polygon_area(points: DataFrame) -> DataFrame:
    """points (img, i, x, y): img, area enclosed by the closed polygon, signless."""
    turn = Window.partitionBy("img").orderBy("i")
    first = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {c: F.coalesce(F.lead(c).over(turn), F.first(c).over(first)) for c in ("x", "y")}
    crossed = points.withColumn("k", V("x") * nxt["y"] - nxt["x"] * V("y"))
    return crossed.groupBy("img").agg((F.abs(F.sum("k")) / 2.0).alias("area"))


def bounds(points: DataFrame) -> DataFrame:
    """points (img, x, y): the box around them, half open."""
    least = {c: F.min(c) for c in ("x", "y")}
    return points.groupBy("img").agg(
        least["x"].alias("x1"), least["y"].alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"),
        (F.max("x") - least["x"] + 1).alias("width"), (F.max("y") - least["y"] + 1).alias("height"),
    )
