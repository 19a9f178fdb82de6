"""Streaming operators over events (key, ts, ...).

Each has a batch form for tables; ``*_stream`` forms take a streaming
DataFrame and declare their watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Trailing-edge debounce: one row for each run of a key's events less than ``gap`` apart."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    out = events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return out.select("key", F.col("w.start").alias("first"), "last", F.col("w.end").alias("fires"), "events")


def changed(events: DataFrame) -> DataFrame:
    """Events whose hash differs from the key's last one."""
    before = F.lag("hash").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    return events.withColumn("before", before).filter(~F.col("hash").eqNullSafe(F.col("before")))


def changed_stream(events: DataFrame) -> DataFrame:
    """The same over a stream in order, with the last hash of each key as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = rows["hash"].shift(1)
        before.iloc[0] = last
        keep = rows["hash"].ne(before)
        state.update((rows["hash"].iloc[-1],))
        yield rows.loc[keep, ["event_id", "hash"]].assign(key=key[0])

    return events.groupBy("key").applyInPandasWithState(step, "event_id long, hash string, key long", "hash string", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(events: DataFrame, failures: int, reset_seconds: int) -> DataFrame:
    """Failures of a key at which its circuit opens: the ``failures``-th within ``reset_seconds``."""
    w = Window.partitionBy("key").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-reset_seconds * 1_000_000, 0)
    bad = events.filter("failed").withColumn("recent", F.count("*").over(w))
    return bad.withColumn("open", F.col("recent") >= failures)


def rate_windows(events: DataFrame, width: str, most: int) -> DataFrame:
    """Tumbling windows of a key, and whether they pass its rate limit."""
    out = events.groupBy("key", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("limited"))


def single_flight(events: DataFrame, ids: list[str], watermark: str) -> DataFrame:
    """Of identical requests on a stream within the watermark only the first."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(ids)


def retry_delays(base_ms: int = 1000, most_ms: int = 30_000, retries: int = 5) -> list[int]:
    """Exponential backoff."""
    return [min(base_ms * 2**n, most_ms) for n in range(retries)]
