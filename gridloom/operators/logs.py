"""Sampling, batching and combining of log records, in batch form.

Positions within a pattern or a level count over the whole log. A window over so few keys would end in
as few tasks, so positions are counted in two steps: within a time bucket, and by what the buckets
before hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import batch_pattern, message_pattern
from gridloom.options import DEFAULTS, Options

WARNING = 30


def numbered(rows: DataFrame, key: str, ts: str, order: list[str], out: str, bucket: str = "hour") -> DataFrame:
    """Adds the position, from 1, of a row among those with its key, ordered by `order` (ts first)."""
    cut = rows.withColumn("_b", F.date_trunc(bucket, F.col(ts)))
    counts = cut.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)))
    joined = own.join(before, own[key].eqNullSafe(before["_k"]) & own["_b"].eqNullSafe(before["_t"]))
    return joined.withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_b", "_own", "_k", "_t", "_n", "_before")


def sampled(logs: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """logs (event_id, ts, level, msg): adds pattern, n (position in its pattern; null from WARNING on,
    which doesn't count) and immediate."""
    marked = logs.withColumn("pattern", message_pattern(F.col("msg")))
    low = numbered(marked.where(F.col("level") < WARNING), "pattern", "ts", ["ts", "event_id"], "n")
    high = marked.where(F.col("level") >= WARNING).withColumn("n", F.lit(None).cast("long"))
    return low.unionByName(high).withColumn("immediate", (F.col("level") >= WARNING) | (F.col("n") == 1) | (F.col("n") % options.log_sample == 0))


def route(immediate: Column) -> Column:
    return F.when(immediate, "immediate").otherwise("batched")


def batches(logs: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The batched records with batch_no: every `log_batch` records of a level are one batch."""
    held = sampled(logs, options).where(~F.col("immediate"))
    placed = numbered(held, "level", "ts", ["ts", "event_id"], "place")
    return placed.withColumn("batch_no", F.floor((F.col("place") - 1) / options.log_batch).cast("long"))


def combined(batched: DataFrame) -> DataFrame:
    """What flushing the batches emits: batches of up to five records as they are; in larger ones, more
    than three records of a pattern become one."""
    marked = batched.withColumn("group", batch_pattern(F.col("msg")))
    by_batch = Window.partitionBy("level", "batch_no")
    by_group = Window.partitionBy("level", "batch_no", "group")
    sized = (
        marked.withColumn("in_batch", F.count(F.lit(1)).over(by_batch))
        .withColumn("in_group", F.count(F.lit(1)).over(by_group))
        .withColumn("nth", F.row_number().over(by_group.orderBy("ts", "event_id")))
    )
    merged = (F.col("in_batch") > 5) & (F.col("in_group") > 3)
    said = F.when(merged, F.concat("group", F.lit(" (repeated "), F.col("in_group").cast("string"), F.lit(" times with different values)"))).otherwise(F.col("msg"))
    return sized.where(~merged | (F.col("nth") == 1)).select("level", "batch_no", "event_id", said.alias("msg"), F.when(merged, F.col("in_group")).otherwise(1).cast("long").alias("records"))
