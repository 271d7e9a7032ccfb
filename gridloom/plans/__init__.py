"""The query catalogue: Spark callables next to their SQL twins."""
