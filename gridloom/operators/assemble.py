"""The response document of a file, from its cells and grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import grid as G
from gridloom.options import DEFAULTS, Options

NO_TABLE = "No table detected in the image"
NO_CELLS = "No cells were detected in the table"
ONE_CELL = "Only one cell detected - this might be the entire table"
# What the console report says of a file without a grid.
EMPTY = "No cells were detected."
PDF_HINTS = ("", "Ensure the following for PDFs:", "1. Poppler is installed", "2. The PDF is not corrupted", "3. The file is accessible")


def cell_error(n: Column) -> Column:
    return F.when(n == 0, NO_CELLS)


def cell_warning(n: Column) -> Column:
    return F.when(n == 1, ONE_CELL)


def respond(files: DataFrame, cells: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """files (path, width, height, x1, y1, x2, y2, error) and recognised cells (path, id, x1, y1, x2, y2,
    width, height, text): one row per file, metadata, table and visualization, error and warning. Without
    cells the table is null."""
    bounds = F.struct("x1", "y1", "x2", "y2")
    dimensions = F.struct("width", "height")
    listed = cells.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", bounds.alias("bounds"), dimensions.alias("dimensions"), "text"))).alias("cells"))
    rows, columns = G.dimensions(F.col("grid"))
    grids = G.build(cells, "path", options).select("path", G.entries(F.col("grid")).alias("grid"), rows.alias("n_rows"), columns.alias("n_columns"))
    joined = files.join(listed, "path", "left").join(grids, "path", "left")
    n = F.when(F.col("error").isNull(), F.coalesce(F.size("cells"), F.lit(0)))
    path = F.col("path")
    metadata = F.struct(
        T.basename(path).alias("file_name"),
        T.file_type(path).alias("file_type"),
        dimensions.alias("image_size"),
        F.current_timestamp().cast("string").alias("processing_timestamp"),
    )
    table = F.struct(bounds.alias("bounds"), F.struct(F.col("n_rows").alias("rows"), F.col("n_columns").alias("columns")).alias("dimensions"), "grid", "cells")
    return joined.select(
        "path",
        metadata.alias("metadata"),
        F.when(F.col("cells").isNotNull(), table).alias("table"),
        F.struct(T.visual_name(path).alias("output_file")).alias("visualization"),
        F.coalesce("error", cell_error(F.greatest(n, F.lit(0)))).alias("error"),
        cell_warning(n).alias("warning"),
        F.format_string("Detected Table and Cells (%dx%d grid)", F.coalesce("n_rows", F.lit(0)), F.coalesce("n_columns", F.lit(0))).alias("title"),
    )


def report(responses: DataFrame) -> DataFrame:
    """path, the lines of a console report, and failed: the file had no error, but gave no grid either.
    Errors that speak of PDFs are followed by hints."""
    size, dims = F.col("metadata.image_size"), F.col("table.dimensions")
    head = F.array(
        F.lit(""),
        F.lit("Extracted Table Data:"),
        F.concat(F.lit("File: "), F.col("metadata.file_name")),
        F.format_string("Image size: %dx%d", size["width"], size["height"]),
        F.format_string("Table dimensions: %dx%d", dims["rows"], dims["columns"]),
        F.lit(""),
        F.lit("Table structure:"),
    )
    lines = F.concat(head, F.transform("table.grid", lambda row: F.to_json(row)))
    error, hints = F.col("error"), F.array(*map(F.lit, PDF_HINTS))
    told = F.concat(F.array(F.concat(F.lit("Error: "), error)), F.when(F.lower(error).contains("pdf"), hints).otherwise(F.array().cast("array<string>")))
    empty = F.coalesce(F.size("table.grid"), F.lit(0)) <= 0
    shown = F.when(error.isNotNull(), told).when(empty, F.array(F.lit(EMPTY))).otherwise(lines)
    return responses.select("path", shown.alias("lines"), (error.isNull() & empty).alias("failed"))
