"""Image and PDF files as rows (path, width, height, channels, data, error)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.options import DEFAULTS, Options

RASTER = "path string, width int, height int, channels int, data binary, error string"
# The error messages here and below.
UNREADABLE = "Error preprocessing file: Failed to load image."


class PdfRasterizer(Protocol):
    """Renders one page of a PDF as a BGR array; raises if there is none."""

    def page(self, content: bytes, number: int, dpi: int) -> np.ndarray: ...


class Poppler:
    """The rasterizer by pdf2image, where that and its programs are installed."""

    def page(self, content: bytes, number: int, dpi: int) -> np.ndarray:
        import pdf2image

        images = pdf2image.convert_from_bytes(content, dpi=dpi, first_page=number, last_page=number)
        if not images:
            raise ValueError("No pages found in PDF.")
        return np.asarray(images[0].convert("RGB"))[..., ::-1].copy()


class Tesseract:
    """The recognizer by pytesseract, where that and its program are installed."""

    def recognize(self, image: np.ndarray, config: str) -> tuple[list[str], list[float]]:
        import pytesseract

        found = pytesseract.image_to_data(image, output_type=pytesseract.Output.DICT, config=config)
        return found["text"], found["conf"]


def array_of(row: object) -> np.ndarray:
    """The pixels of a raster row."""
    shape = (row.height, row.width) if row.channels == 1 else (row.height, row.width, row.channels)
    image = np.frombuffer(row.data, np.uint8).reshape(shape)
    return image[..., :3] if row.channels == 4 else image


def split_missing(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Paths and globs that match something, and those that don't, asked of their own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there, missing = [], []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        hits = path.getFileSystem(conf).globStatus(path)
        (there if hits is not None and len(hits) else missing).append(p)
    return there, missing


def images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Image files; a file that can't be decoded has an error instead of pixels."""
    found = spark.read.format("image").option("dropInvalid", False).load(paths)
    bad = F.col("image.width") < 0
    null = F.lit(None)
    return found.where(T.file_type(F.col("image.origin")) != "pdf").select(
        F.col("image.origin").alias("path"),
        F.when(~bad, F.col("image.width")).alias("width"),
        F.when(~bad, F.col("image.height")).alias("height"),
        F.when(~bad, F.col("image.nChannels")).alias("channels"),
        F.when(~bad, F.col("image.data")).alias("data"),
        F.when(bad, UNREADABLE).otherwise(null.cast("string")).alias("error"),
    )


def pdfs(spark: SparkSession, paths: list[str], rasterizer: PdfRasterizer, options: Options = DEFAULTS) -> DataFrame:
    """The first page of PDF files; a failure is an error of its row."""

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    page = rasterizer.page(content, 1, options.dpi)
                    one = (path, page.shape[1], page.shape[0], 3, page.tobytes(), None)
                except Exception as e:
                    one = (path, None, None, None, None, f"Error converting PDF to image: {e}")
                # A page is tens of megabytes: each leaves on its own.
                yield pd.DataFrame([one], columns=["path", "width", "height", "channels", "data", "error"]).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})

    found = spark.read.format("binaryFile").load(paths).where(T.file_type(F.col("path")) == "pdf")
    return found.select("path", "content").mapInPandas(render, RASTER)


def read(spark: SparkSession, paths: list[str], rasterizer: PdfRasterizer | None = None, options: Options = DEFAULTS) -> DataFrame:
    """Rasters of files, folders and globs; paths without a file are rows with an error."""
    there, missing = split_missing(spark, paths)
    if missing and options.mode == "FAILFAST":
        raise ValueError(f"File not found: {missing[0]}")
    lost = [(p, None, None, None, None, f"File not found: {p}") for p in missing]
    out = spark.createDataFrame(lost, RASTER)
    if there:
        listed = spark.read.format("binaryFile").load(there).select("path")
        has_pdf = bool(listed.where(T.file_type(F.col("path")) == "pdf").limit(1).count())
        out = out.unionByName(images(spark, there))
        if has_pdf:
            out = out.unionByName(pdfs(spark, there, rasterizer or Poppler(), options))
    return out
