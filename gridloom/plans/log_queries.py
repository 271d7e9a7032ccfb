"""Queries of the log-record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import logs as L
from gridloom.plans import derived as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str):
    def keep(query):
        QUERIES[name], ORACLES[name] = query, f"WITH {D.LOGS_SQL}{sql}"
        return query

    return keep


_PATTERN = "CASE WHEN contains(msg, ':') THEN split_part(msg, ':', 1) ELSE substr(msg, 1, 50) END"
_GROUP = "trim(CASE WHEN contains(msg, '[') THEN split_part(msg, '[', 1) ELSE split_part(msg, '(', 1) END)"
SAMPLED = f""", low AS (SELECT *, {_PATTERN} AS pattern, row_number() OVER (PARTITION BY {_PATTERN} ORDER BY ts, event_id) AS n FROM logs WHERE level < 30),
sampled AS (SELECT *, n = 1 OR n % 10 = 0 AS immediate FROM low UNION ALL SELECT *, {_PATTERN}, NULL, true FROM logs WHERE level >= 30)"""
BATCHED = f"""{SAMPLED}, batched AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY level ORDER BY ts, event_id) - 1) / 100.0) AS BIGINT) AS batch_no FROM sampled WHERE NOT immediate)"""


@register("log_pattern", f" SELECT event_id, {_PATTERN} AS pattern, {_GROUP} AS grp FROM logs")
def log_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.logs(spark, sf_dir).select("event_id", T.message_pattern(F.col("msg")).alias("pattern"), T.batch_pattern(F.col("msg")).alias("grp"))


@register("log_sample", f"{SAMPLED} SELECT event_id, pattern, n, immediate FROM sampled")
def log_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sampled(D.logs(spark, sf_dir)).select("event_id", "pattern", "n", "immediate")


@register("log_route", f"{SAMPLED} SELECT event_id, CASE WHEN immediate THEN 'immediate' ELSE 'batched' END AS route FROM sampled")
def log_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sampled(D.logs(spark, sf_dir)).select("event_id", L.route(F.col("immediate")).alias("route"))


@register("log_batches", f"{BATCHED} SELECT event_id, level, batch_no FROM batched")
def log_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.batches(D.logs(spark, sf_dir)).select("event_id", "level", "batch_no")


@register("log_combine", f"""{BATCHED}, sized AS (SELECT *, {_GROUP} AS grp, count(*) OVER (PARTITION BY level, batch_no) AS nb,
  count(*) OVER (PARTITION BY level, batch_no, {_GROUP}) AS ng, row_number() OVER (PARTITION BY level, batch_no, {_GROUP} ORDER BY ts, event_id) AS nth FROM batched)
SELECT level, batch_no, event_id, CASE WHEN nb > 5 AND ng > 3 THEN concat(grp, ' (repeated ', ng, ' times with different values)') ELSE msg END AS msg,
  CASE WHEN nb > 5 AND ng > 3 THEN ng ELSE 1 END AS records FROM sized WHERE NOT (nb > 5 AND ng > 3) OR nth = 1""")
def log_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.combined(L.batches(D.logs(spark, sf_dir)))


@register("slow_ops", " SELECT event_id, value / 1000 AS elapsed FROM events WHERE value / 1000 > 0.1")
def slow_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    elapsed = F.col("value") / 1000
    return D.read(spark, sf_dir, "events").where(elapsed > 0.1).select("event_id", elapsed.alias("elapsed"))


@register("event_windows", " SELECT event_type, date_trunc('hour', ts) AS started, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and hour; the streaming module has the same over a stream."""
    from gridloom.streaming.logs import hourly

    return hourly(D.read(spark, sf_dir, "events").select("ts", "event_type"))
