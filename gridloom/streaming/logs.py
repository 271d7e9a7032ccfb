"""Log-record operators on streams.

Sampling needs one counter per message pattern; batching needs the records held per level. Both are
keyed state. Two rules of a single-process handler have no keyed form and differ: its flush timer is one
for all levels, here each level has its own; and it resets large counters once there are over a thousand
patterns, here a counter goes when its pattern has been silent for the time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.functions.text import batch_pattern, message_pattern
from gridloom.operators.logs import WARNING
from gridloom.options import DEFAULTS, Options

OUT = "event_id long, ts timestamp, level int, msg string, pattern string, n long, immediate boolean"


def hourly(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Events per type and hour of event time; late events count up to the watermark."""
    held = events.withWatermark("ts", watermark) if watermark else events
    counted = held.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("event_type", F.col("w.start").alias("started"), "n")


def sampled(logs: DataFrame, options: Options = DEFAULTS, idle_ms: int = 3_600_000) -> DataFrame:
    """A stream (event_id, ts, level, msg) with pattern, n and immediate, as the batch form has them."""
    every = options.log_sample

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        for rows in frames:  # one after the other: a micro-batch of a pattern may be large
            rows = rows.sort_values(["ts", "event_id"], kind="stable")
            low = rows["level"] < WARNING
            place = n + low.cumsum()
            rows["n"] = place.where(low).astype("Int64")
            rows["immediate"] = ~low | (place == 1) | (place % every == 0)
            n += int(low.sum())
            yield rows[["event_id", "ts", "level", "msg", "pattern", "n", "immediate"]]
        state.update((n,))
        state.setTimeoutDuration(idle_ms)

    keyed = logs.select("event_id", "ts", F.col("level").cast("int").alias("level"), "msg", message_pattern(F.col("msg")).alias("pattern"))
    return keyed.groupBy("pattern").applyInPandasWithState(step, OUT, "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


FLUSHED = "level int, batch_no long, reason string, msg string, records long"


# Fixed value below: the message of a repeated group.
def combine(messages: list[str], groups: list[str]) -> list[tuple[str, int]]:
    """What a flush emits for a batch, in order of the groups' first records."""
    if len(messages) <= 5:
        return [(m, 1) for m in messages]
    members: dict[str, list[str]] = {}
    for message, group in zip(messages, groups):
        members.setdefault(group, []).append(message)
    out: list[tuple[str, int]] = []
    for group, own in members.items():
        if len(own) > 3:
            out.append((f"{group} (repeated {len(own)} times with different values)", len(own)))
        else:
            out += [(m, 1) for m in own]
    return out


def flushed(batched: DataFrame, options: Options = DEFAULTS, timeout_ms: int = 1000, max_age_ms: int = 10_000, end: bool = False) -> DataFrame:
    """A stream of batched records (event_id, ts, level, msg): what is emitted when a level's batch is full,
    has waited for the timeout, or has records older than the age limit, however often others came in between.

    end: for runs that drain an input and stop; what is left of a level after a micro-batch is emitted at once
    (reason `end`), and nothing waits. Without it the query waits for timeouts, so it doesn't stop by itself."""
    size = options.log_batch
    waits = GroupStateTimeout.NoTimeout if end else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, now = int(key[0]), state.getCurrentProcessingTimeMs()
        batch_no, created, messages, groups = (state.get[0], state.get[1], list(state.get[2]), list(state.get[3])) if state.exists else (0, now, [], [])

        def flush(reason: str, n: int) -> pd.DataFrame:
            nonlocal batch_no, created, messages, groups
            out = [(level, batch_no, reason, m, k) for m, k in combine(messages[:n], groups[:n])]
            messages, groups, batch_no, created = messages[n:], groups[n:], batch_no + 1, now
            return pd.DataFrame(out, columns=["level", "batch_no", "reason", "msg", "records"])

        for rows in () if state.hasTimedOut else frames:
            rows = rows.sort_values(["ts", "event_id"], kind="stable")
            if not messages:
                created = now
            messages += rows["msg"].tolist()
            groups += rows["grp"].tolist()
            while len(messages) >= size:
                yield flush("full", size)
        if messages and state.hasTimedOut:
            yield flush("age" if now - created > max_age_ms else "timeout", len(messages))
        elif messages and now - created > max_age_ms:
            yield flush("age", len(messages))
        elif messages and end:
            yield flush("end", len(messages))
        state.update((batch_no, created, messages, groups))
        if messages and not end:
            state.setTimeoutDuration(max(1, min(timeout_ms, max_age_ms - (now - created))))

    keyed = batched.select("event_id", "ts", F.col("level").cast("int").alias("level"), "msg", batch_pattern(F.col("msg")).alias("grp"))
    held = "batch_no long, created long, messages array<string>, groups array<string>"
    return keyed.groupBy("level").applyInPandasWithState(step, FLUSHED, held, "append", waits)
