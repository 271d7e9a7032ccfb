"""Registry of the queries over the library's own operators, each next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import grid_queries, kernel_queries, log_queries, pixel_queries, relation_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (relation_queries, grid_queries, pixel_queries, kernel_queries, log_queries)

QUERIES: dict[str, Query] = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
