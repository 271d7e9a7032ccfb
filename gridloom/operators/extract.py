"""The whole way from files to response documents.

A file's raster is read once to find its table and cell candidates; only boxes are shuffled. The cells
that overlap suppression keeps come back to the rasters for recognition, dealt out by file; repair of
texts, grids and responses are DataFrame operations again. What is found, and what is read, is kept as a
table, as several later steps need it and both are costly. Results leave a worker page by page.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.functions.timing import log_level, timed
from gridloom.operators import assemble, boxes, raster
from gridloom.options import DEFAULTS, Options
from gridloom.schemas import BOX, CELL_FIELDS
from gridloom.sources.files import array_of
from gridloom.storage import kept

DETECTED = f"path string, width int, height int, table {BOX}, candidates array<struct<{CELL_FIELDS.replace(' int', ':int')}>>, error string"
_INTS = {"width": "Int32", "height": "Int32"}


def detect(rasters: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Per raster its table, the candidates in it, or an error."""

    @timed("File processing", options.slow_seconds)
    def search(row: object) -> tuple[dict, list[dict]]:
        page = raster.preprocess(array_of(row), options)
        box = raster.table_bounds(page, options)
        return dict(zip(("x1", "y1", "x2", "y2"), box)), raster.candidates(page, box, options)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                table, found, error = None, None, row.error
                if pd.isna(error):
                    error = None
                    try:
                        table, found = search(row)
                    except Exception as e:
                        error = str(e)
                one = [(row.path, row.width, row.height, table, found, error)]
                yield pd.DataFrame(one, columns=["path", "width", "height", "table", "candidates", "error"]).astype(_INTS)

    return rasters.mapInPandas(run, DETECTED)


def kept_cells(detected: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """path, id, ord, x1, y1, x2, y2 of the cells that are left after overlap suppression."""
    every = detected.select("path", F.explode("candidates").alias("c")).select("path", "c.ord", "c.x1", "c.y1", "c.x2", "c.y2")
    return boxes.suppress(every, "path", options)


def recognise(rasters: DataFrame, cells: DataFrame, recognizer: raster.Recognizer, options: Options = DEFAULTS, reader: Callable[..., str] = raster.read_cell) -> DataFrame:
    """cells with width, height and text. A cell whose reader raises is logged and left out, and the ids of
    the others stay; `read_cell` itself gives an empty text where recognition fails."""
    own = cells.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "x1", "y1", "x2", "y2"))).alias("cells"))

    read = timed("Cell OCR extraction", options.slow_seconds)(reader)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                image, out = array_of(row), []
                for c in row.cells:
                    try:
                        with log_level(raster.__name__, logging.DEBUG if options.verbose else logging.WARNING):
                            text = read(recognizer, image, c, options)
                    except Exception as e:
                        logging.getLogger(__name__).error("Error processing cell %s: %s", c["id"], e)
                        continue
                    out.append((row.path, c["id"], c["x1"], c["y1"], c["x2"], c["y2"], c["x2"] - c["x1"], c["y2"] - c["y1"], text))
                if out:
                    yield pd.DataFrame(out, columns=["path", "id", "x1", "y1", "x2", "y2", "width", "height", "text"])

    schema = "path string, id int, x1 int, y1 int, x2 int, y2 int, width int, height int, text string"
    found = rasters.where(F.col("error").isNull()).join(own, "path").mapInPandas(run, schema)
    return found.withColumn("text", F.trim(T.post_process(F.col("text"))))


def extract_tables(rasters: DataFrame, recognizer: raster.Recognizer, options: Options = DEFAULTS) -> DataFrame:
    """One response per raster row of sources.files.read; see assemble.respond. Every page is searched once,
    and every cell read once."""
    detected = kept(detect(rasters, options), "detected")
    cells = kept(recognise(rasters, kept_cells(detected, options), recognizer, options), "cells")
    files = detected.select("path", "width", "height", "table.*", "error")
    responses = assemble.respond(files, cells, options)
    if options.mode == "FAILFAST":
        responses = responses.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("string"))
    return responses


def visualise(rasters: DataFrame, responses: DataFrame) -> DataFrame:
    """path, output_file and png of each page that has a table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                b = row.bounds
                cells = [c["bounds"] for c in row.cells]
                png = raster.painted(array_of(row), (b["x1"], b["y1"], b["x2"], b["y2"]), cells)
                yield pd.DataFrame([(row.path, row.output_file, png)], columns=["path", "output_file", "png"])

    shown = responses.where(F.col("table").isNotNull()).select("path", "table.bounds", "table.cells", "visualization.output_file")
    return rasters.where(F.col("error").isNull()).join(shown, "path").mapInPandas(run, "path string, output_file string, png binary")


def debug_steps(rasters: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """path, step and png of the intermediate images of every page with a table."""
    detected = kept(detect(rasters, options), "detected")
    own = kept_cells(detected, options).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "x1", "y1", "x2", "y2"))).alias("cells"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                page, t = raster.binarised(array_of(row), options), row.table
                steps = raster.debug_images(page, (t["x1"], t["y1"], t["x2"], t["y2"]), list(row.cells), options)
                yield pd.DataFrame([(row.path, step, data) for step, data in steps.items()], columns=["path", "step", "png"])

    pages = rasters.where(F.col("error").isNull()).join(detected.where("table is not null").select("path", "table"), "path").join(own, "path")
    return pages.mapInPandas(run, "path string, step string, png binary")
