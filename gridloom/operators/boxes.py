"""Operators on boxes: rows with x1, y1, x2, y2 (half open), grouped by a document key.

The greedy steps depend on order, so they aren't joins: a document's boxes are one sorted array and
the step is a fold over it, inside the JVM. A document has at most as many boxes as its page has
contours; documents with more than FOLD_LIMIT candidates take the same step in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.options import DEFAULTS, Options

FOLD_LIMIT = 2000


def area() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def is_valid(least: int = DEFAULTS.min_side) -> Column:
    """Positive extent and both sides at least `least`."""
    return (F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))


def overlap(a: str, b: str) -> str:
    """SQL for the intersection over the smaller area of two struct expressions; 0.0 if either is empty
    or they only touch."""
    wide = f"least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)"
    high = f"least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)"
    one, two = (f"({k}.x2 - {k}.x1) * ({k}.y2 - {k}.y1)" for k in (a, b))
    return (
        f"CASE WHEN ({one}) <= 0 OR ({two}) <= 0 OR ({wide}) <= 0 OR ({high}) <= 0 THEN 0.0D "
        f"ELSE CAST(({wide}) * ({high}) AS DOUBLE) / least({one}, {two}) END"
    )


def line_filter(box_area: Column, table_area: Column, width: Column, height: Column, options: Options = DEFAULTS) -> Column:
    """Which contours of the line method are cells; bounds are inclusive."""
    return (
        box_area.between(options.line_min_area, table_area * options.line_max_fraction)
        & (width >= options.line_min_side)
        & (height >= options.line_min_side)
    )


def contour_filter(box_area: Column, table_area: Column, options: Options = DEFAULTS) -> Column:
    """Which contours of the contour method are cells; bounds are inclusive."""
    return box_area.between(table_area * options.contour_min_fraction, table_area * options.contour_max_fraction)


def largest(boxes: DataFrame, key: str, size: Column, order: str = "ord") -> DataFrame:
    """The box of the largest size per document, the first of equals."""
    box = F.struct(order, "x1", "y1", "x2", "y2")
    return boxes.groupBy(key).agg(F.max_by(box, F.struct(size, -F.col(order))).alias("box")).select(key, "box.*")


def candidates(boxes: DataFrame, line: Column, contour: Column) -> DataFrame:
    """Both methods' cells in one order: all of the line method (0) before all of the contour method (1).
    A box that both take is two rows; boxes are read once."""
    methods = F.filter(F.array(F.when(line, 0), F.when(contour, 1)), lambda m: m.isNotNull())
    return boxes.withColumn("method", F.explode(methods)).withColumn("rank", F.struct("method", "ord"))


def _fold(options: Options) -> str:
    return (
        "aggregate(boxes, cast(array() as array<struct<area:int,ord:int,x1:int,y1:int,x2:int,y2:int>>), "
        f"(kept, c) -> IF(exists(kept, k -> ({overlap('c', 'k')}) > {options.overlap_limit}D), kept, array_append(kept, c)))"
    )


def _in_numpy(limit: float):
    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pages:
            rows = []
            for row in frame.itertuples(index=False):
                b = np.array([(c["x1"], c["y1"], c["x2"], c["y2"]) for c in row.boxes], np.int64)
                size = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
                kept = np.zeros(len(b), bool)
                for i in range(len(b)):
                    k = np.flatnonzero(kept[:i])
                    wide = np.minimum(b[i, 2], b[k, 2]) - np.maximum(b[i, 0], b[k, 0])
                    high = np.minimum(b[i, 3], b[k, 3]) - np.maximum(b[i, 1], b[k, 1])
                    both = np.where((wide > 0) & (high > 0), wide * high, 0)
                    kept[i] = not (both / np.minimum(size[i], size[k]) > limit).any()
                rows.append([c for c, keep in zip(row.boxes, kept) if keep])
            yield pd.DataFrame({"page": frame["page"], "kept": rows})

    return run


def suppress(boxes: DataFrame, key: str, options: Options = DEFAULTS, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Greedy overlap suppression: of the valid boxes by descending area (ties in `ord` order), each is
    kept unless a kept one overlaps it by more than the limit. Adds `id`, its position in that order
    among the kept."""
    sized = boxes.where(is_valid(options.min_side)).select(key, (-area()).cast("int").alias("area"), "ord", "x1", "y1", "x2", "y2")
    pages = sized.groupBy(F.col(key).alias("page")).agg(F.array_sort(F.collect_list(F.struct("area", "ord", "x1", "y1", "x2", "y2"))).alias("boxes"))
    small = pages.where(F.size("boxes") <= fold_limit).select("page", F.expr(_fold(options)).alias("kept"))
    kind = "array<struct<area:int,ord:int,x1:int,y1:int,x2:int,y2:int>>"
    large = pages.where(F.size("boxes") > fold_limit).mapInPandas(_in_numpy(options.overlap_limit), f"page {dict(pages.dtypes)['page']}, kept {kind}")
    # The outer form: before the other, the optimizer puts a filter that would run the fold once more.
    kept = small.unionByName(large).select(F.col("page").alias(key), F.posexplode_outer("kept").alias("id", "c"))
    return kept.where(F.col("c").isNotNull()).select(key, "id", "c.ord", "c.x1", "c.y1", "c.x2", "c.y2")


def numbered(cells: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds `id`, the position of a cell in its document, from 0."""
    from pyspark.sql import Window

    return cells.withColumn("id", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("int"))


def padded(width: Column, height: Column, options: Options = DEFAULTS) -> dict[str, Column]:
    """The crop around a cell, inside an image, and whether it is too small to read."""
    p = options.crop_padding
    x1, y1 = F.greatest(F.lit(0), F.col("x1") - p), F.greatest(F.lit(0), F.col("y1") - p)
    x2, y2 = F.least(width, F.col("x2") + p), F.least(height, F.col("y2") + p)
    return {"cx1": x1, "cy1": y1, "cx2": x2, "cy2": y2, "too_small": (x2 - x1 < options.min_crop) | (y2 - y1 < options.min_crop)}


def label(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """`Cell[x1,y1-x2,y2]`."""
    return F.format_string("Cell[%d,%d-%d,%d]", x1, y1, x2, y2)


def debug_color(index: Column) -> Column:
    """The debug colour of the index-th cell."""
    return F.struct(*[(index * k % 255).cast("int").alias(c) for c, k in (("b", 37), ("g", 67), ("r", 97))])
