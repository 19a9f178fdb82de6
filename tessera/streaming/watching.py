"""Watching folders, breaking circuits, slowing down: state that follows event time.

The same step functions run over tables (a key's rows in order) and over
streams (with the key's state); a stream's rows have to come in order of time
within a key, as a replay of a log does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.storage import newer_than_stored, replace_files, stale_against_disk

_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, glob: str = "*", largest: int = 5_000_000, per_trigger: int = 1000) -> DataFrame:
    """A stream of (key, ts, length, hash) for files that appear under a folder, whatever its depth."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(root)
    kept = files.filter(F.col("length") <= largest)
    return kept.select(F.col("path").alias("key"), F.col("modificationTime").alias("ts"), "length", F.sha2("content", 256).alias("hash"))


def project_changes(events: DataFrame, project: str, gap: str = "1500 milliseconds", watermark: str | None = None) -> DataFrame:
    """One row for each run of changes anywhere in a project less than ``gap`` apart; when it fires, the project is synchronised."""
    from tessera.streaming.changes import debounce

    return debounce(events.withColumn("key", F.lit(project)), gap, watermark)


# The circuit breaker: (failures counted, when it opened or -1).
BREAKER = "failures int, opened long"


def breaker_step(rows: pd.DataFrame, state: tuple[int, int], failures: int, reset_us: int) -> tuple[pd.DataFrame, tuple[int, int]]:
    """Rows (event_id, us, failed) in order with counted and open: the state after each. A circuit closes ``reset_us`` after it opened; a success while closed starts the count anew."""
    n, opened = state
    counted, open_ = [], []
    for us, failed in zip(rows["us"].tolist(), rows["failed"].tolist(), strict=True):
        if opened >= 0 and us - opened >= reset_us:
            n, opened = 0, -1
        if opened < 0:
            n = n + 1 if failed else 0
            if n >= failures:
                opened = us
        counted.append(n)
        open_.append(opened >= 0)
    return rows.assign(counted=counted, open=open_), (n, opened)


_BROKEN = "key long, event_id long, counted int, open boolean"


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["us", "event_id"], kind="stable")


def breaker(events: DataFrame, failures: int = 3, reset_seconds: int = 3600) -> DataFrame:
    """key, event_id, counted, open of events (key, ts, event_id, failed)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = breaker_step(_ordered(rows), (0, -1), failures, reset_seconds * 1_000_000)
        return out[["key", "event_id", "counted", "open"]]

    rows = events.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "failed")
    return rows.groupBy("key").applyInPandas(run, _BROKEN)


def breaker_stream(events: DataFrame, failures: int = 3, reset_seconds: int = 3600) -> DataFrame:
    """The same over a stream, with the count and the opening of each key as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(pd.concat(list(batches)))
        out, now = breaker_step(rows, state.get if state.exists else (0, -1), failures, reset_seconds * 1_000_000)
        state.update(now)
        yield out.assign(key=key[0])[["key", "event_id", "counted", "open"]]

    rows = events.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "failed")
    return rows.groupBy("key").applyInPandasWithState(step, _BROKEN, BREAKER, "append", GroupStateTimeout.NoTimeout)


def concurrency(hits: DataFrame, start: int, window_seconds: int = 60, most: int = 3) -> DataFrame:
    """Rate limit hits (key, ts, event_id) with their number since the last pause of ``window_seconds``, and the concurrency left: halved at the ``most``-th and every further one, never under 1."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("key").orderBy("us_", "event_id")
    rows = hits.withColumn("us_", us).withColumn("fresh_", F.coalesce((F.col("us_") - F.lag("us_").over(w) > window_seconds * 1_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("run_", F.sum("fresh_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("key", "run_").orderBy("us_", "event_id"))
    rows = rows.withColumn("hits", n)
    left = F.greatest(F.lit(1), F.floor(F.lit(start) / F.pow(F.lit(2.0), F.col("hits") - (most - 1)))).cast("int")
    return rows.withColumn("concurrency", F.when(F.col("hits") >= most, left).otherwise(start)).drop("us_", "fresh_", "run_")


def stale_loop(ticks: DataFrame, stored: Callable[[], DataFrame], disk: Callable[[], DataFrame], refresh: Callable[[DataFrame], None], checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    """At every trigger compares what is stored with what is on disk and hands missing and stale files to ``refresh``.

    ``ticks`` is any stream (a rate source); only that a batch comes matters.
    """

    def check(_: DataFrame, __: int) -> None:
        stale = stale_against_disk(stored(), disk())
        if not stale.isEmpty():
            refresh(stale)

    return ticks.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def refresher(spark: SparkSession, path: str, chunked: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over changed files (file, mtime, ...): files not modified since their last chunk are skipped, the chunks of the others replaced.

    A new version of the table is written beside the old one and named in
    ``_current``; readers see one or the other. A batch that is run again does
    no harm.
    """

    def run(batch: DataFrame, number: int) -> None:
        current = read_current(spark, path)
        last = current.groupBy("file").agg(F.max("created_at").alias("last_update"))
        newer = newer_than_stored(batch, last)
        if newer.isEmpty():
            return
        target = f"{path}/version-{number}"
        replace_files(current, chunked(newer)).write.mode("overwrite").parquet(target)
        spark.createDataFrame([(target,)], "path string").coalesce(1).write.mode("overwrite").text(f"{path}/_current")

    return run


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{path}/_current").first()[0])


def progress(query: StreamingQuery) -> dict[str, object]:
    """How far a stream has come: its state, the number of its last batch and its rows."""
    last = query.lastProgress
    return {"active": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0, "message": query.status["message"]}
