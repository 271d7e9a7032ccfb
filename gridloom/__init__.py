"""gridloom: tables in scanned pages, and the relations behind them, as Spark DataFrames."""

__version__ = "0.1.0"
