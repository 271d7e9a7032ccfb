"""Command line: `python -m gridloom.cli --file PATH` prints the tables of the files that match."""

from __future__ import annotations

import argparse
import datetime
import logging
import os
import sys

from pyspark.sql import SparkSession

from gridloom.operators.assemble import report
from gridloom.operators.extract import extract_tables
from gridloom.options import Options
from gridloom.sources.files import Tesseract, read


# The form of a log line, and the folder and name of a log file.
LINE = "%(asctime)s - %(name)s - %(levelname)s - %(funcName)s:%(lineno)d - %(message)s"
FOLDER, NAME = "logs", "table_detector_%Y%m%d_%H%M%S.log"


def log_to(level: str, debug: bool) -> None:
    """Sends the driver's records to the standard output, and in debug mode to a file of their own too."""
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    handlers[0].setLevel(level)
    if debug:
        os.makedirs(FOLDER, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(FOLDER, datetime.datetime.now().strftime(NAME))))
    logging.basicConfig(level=level, format=LINE, handlers=handlers, force=True)


def options_for(debug: bool) -> Options:
    """Debug runs try everything on a cell and hold no log records back."""
    return Options(verbose=True, log_batch=1) if debug else Options()


def main(args: list[str] | None = None) -> int:
    """0, or 1 if a file without an error gave no grid; files with an error are told."""
    parser = argparse.ArgumentParser(description="Tables of images and PDFs")
    parser.add_argument("--debug", action="store_true", help="more variants and configurations per cell")
    parser.add_argument("--log-level", choices=["DEBUG", "INFO", "WARNING", "ERROR"], default="INFO")
    parser.add_argument("--file", default="i_a.pdf", help="file, folder or glob")
    given = parser.parse_args(args)
    log_to(given.log_level, given.debug)
    spark = SparkSession.builder.getOrCreate()
    options = options_for(given.debug)
    responses = extract_tables(read(spark, [given.file], options=options), Tesseract(), options)
    failed = False
    for row in report(responses).toLocalIterator():
        failed |= row["failed"]
        print("\n".join(row["lines"]))
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
