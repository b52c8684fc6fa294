"""Streams of files, samples and metrics. Each ends in a table that equals the batch result."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cubespark.functions.dates import stack_time
from cubespark.functions.grid import CELL
from cubespark.functions.values import invert_units
from cubespark.operators.logs import early_stop_step
from cubespark.sources.files import exists, finished, ingest, remove, stored_months
from cubespark.sources.scratch import new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files at a path."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _run(writer, state: str) -> None:
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def stream_ingest(stream: DataFrame, variable: str, path: str, order: str | None = None, state: str | None = None) -> str:
    """Arriving hourly rows (cell, ts, value) fill their months, in parts, in any order, over any number of runs.

    The months that a trigger touches are read, merged with its rows and overwritten; a value that comes again replaces
    the one before, so a rerun changes nothing. Of rows of one cell and hour in one trigger, the one with the largest
    ``order`` (a column, or else the value) counts. The stream's progress is kept at ``state``, by default beside the
    table, so a later run on the same source takes up what is new; another source needs a state of its own.

    Merged months are staged beside the state under the trigger's number before the table is touched. A trigger that is
    repeated, as its driver was lost while months were overwritten, takes what it has staged and doesn't read the table.
    """
    spark, target = stream.sparkSession, f"{path}/hourly"
    state = state or f"{path}/_state/{variable}"
    keys = [*CELL, "ts"]

    def fill(batch: DataFrame, version: int) -> None:
        merged = f"{state}-staged/{version}"
        if not finished(spark, merged):
            fresh = batch.groupBy(*keys).agg(F.max_by("value", F.struct(order or "value", "value")).alias("value"))
            if fresh.isEmpty():
                return
            months = fresh.select(F.year("ts").alias("year"), F.month("ts").alias("month")).distinct()
            old = stored_months(spark, target, variable, months, "lat_idx int, lon_idx int, value float, date date, hour int")
            old = stack_time(old).select(*keys, invert_units(variable, F.col("value").cast("double")).alias("value"))
            old.join(fresh, keys, "left_anti").unionByName(fresh.select(*keys, "value")).write.mode("overwrite").parquet(merged)
        ingest(spark.read.parquet(merged), variable, path, layout="hourly")
        remove(spark, f"{state}-staged/{version - 1}")  # its trigger is done

    _run(stream.writeStream.foreachBatch(fill), state)
    return target


class Counted(StatefulProcessor):
    """Counts the samples of a chunk; emits it once: when the expected number is reached, at a flush, or when it has been quiet for long."""

    def __init__(self, quiet_ms: int | None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "n bigint, expected bigint, ended boolean, last bigint")

    def _now(self) -> tuple[int, int | None, bool, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, None, False, 0)

    def _row(self, key, n, complete):
        return pd.DataFrame({"chunk_lat": [key[0]], "chunk_lon": [key[1]], "saved": [n], "complete": [complete]})

    def handleInputRows(self, key, rows, timerValues):
        n, expected, ended, last = self._now()
        flush = False
        for pdf in rows:
            flush = flush or bool(pdf["flush"].any())
            n += int(pdf["sample"].notna().sum())
            if pdf["samples"].notna().any():
                expected = int(pdf["samples"].max())
            if self.quiet_ms is not None:
                last = max(last, int(pdf["ms"].max()))
        complete = expected is not None and n >= expected
        ends = not ended and (complete or flush)
        self.state.update((n, expected, ended or ends, last))
        if self.quiet_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not (ended or ends):
                self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), last) + self.quiet_ms)
        if ends:
            yield self._row(key, n, complete)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, expected, ended, last = self._now()
        if not ended:
            self.state.update((n, expected, True, last))
            yield self._row(key, n, False)

    def close(self) -> None:
        pass


def chunk_complete_stream(samples: DataFrame, path: str, state: str | None = None, at: str | None = None, delay: str = "1 hour", quiet_seconds: int | None = None) -> str:
    """Rows (chunk_lat, chunk_lon, sample, samples, flush) of saved samples; writes each chunk once, when it ends.

    ``sample`` names a sample of its chunk, so that one delivered again counts once: Spark drops it before it is counted.
    ``samples`` is how many there will be. A chunk ends when that number has come, or at a row with ``flush`` (its sample may
    be null): if it is short, it is written as incomplete. Whatever comes after its end, further flushes too, changes nothing.

    With an event time ``at`` (a timestamp column), samples are remembered for ``delay`` only, so state is bounded: one that
    comes again later counts anew, and rows older than that are dropped. With ``quiet_seconds`` too, a chunk ends (incomplete)
    when the watermark has passed the time of its last row by so long. A trigger costs one state call for each chunk.
    """
    spark = samples.sparkSession
    # A flush stands in a row of its own, so that it isn't lost with a sample that comes again.
    flush = F.coalesce("flush", F.lit(False))
    parts = F.filter(F.array(F.struct("sample", F.lit(False).alias("flush")), F.struct(F.lit(None).cast("bigint").alias("sample"), flush.alias("flush"))), lambda x: x["sample"].isNotNull() | x["flush"])
    samples = samples.select("chunk_lat", "chunk_lon", "samples", *([at, F.unix_millis(at).alias("ms")] if at else []), F.inline(parts))
    keys = ["chunk_lat", "chunk_lon", "sample", "flush"]
    once = samples.dropDuplicates(keys) if at is None else samples.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
    timers = "None" if quiet_seconds is None else "EventTime"
    processor = Counted(None if quiet_seconds is None else 1000 * quiet_seconds)
    out = once.groupBy("chunk_lat", "chunk_lon").transformWithStateInPandas(processor, "chunk_lat int, chunk_lon int, saved bigint, complete boolean", "Append", timers)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)  # read when the query starts
    try:
        _run(out.writeStream.format("parquet").outputMode("append").option("path", path), state or f"{path}/_state")
    finally:
        spark.conf.set(provider, before)
    return path


def stream_metrics(log: DataFrame, path: str, order: list[str], patience: int = 20, min_delta: float = 0.0, state: str | None = None) -> str:
    """Best value and early-stop status (W7) of arriving checks (trial, name, value), over any number of runs.

    ``order`` orders the checks of a trial and metric and tells them apart, so one delivered again counts once. Each trigger
    merges its checks into those of the trials that it touches and writes their status anew; ``latest`` reads it.
    """
    spark = log.sparkSession
    checks, keys = f"{path}/checks", ["trial", "name"]

    def put(batch: DataFrame, version: int) -> None:
        fresh = batch.select(*keys, *order, "value")
        if fresh.isEmpty():
            return
        if exists(spark, checks):
            old = spark.read.schema(fresh.schema).parquet(checks).alias("o")
            old = old.join(F.broadcast(fresh.select("trial").distinct().alias("f")), F.col("o.trial").eqNullSafe(F.col("f.trial")), "left_semi").select("o.*")
            fresh = fresh.unionByName(old)
        merged = new_path(spark, "checks")
        fresh.groupBy(*keys, *order).agg(F.min("value").alias("value")).write.parquet(merged)
        rows = spark.read.parquet(merged)
        ever = rows.groupBy(*keys).agg(F.min("value").alias("best"), F.count("*").alias("checks"))
        stop = early_stop_step(rows, keys, order, "value", patience, min_delta).select(F.col("trial").alias("_t"), F.col("name").alias("_n"), "best_check", "stop_check")
        both = ever.join(stop, F.col("trial").eqNullSafe(F.col("_t")) & F.col("name").eqNullSafe(F.col("_n"))).drop("_t", "_n")
        for frame, at in ((rows, checks), (both, f"{path}/status")):
            frame.repartition("trial").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("trial").parquet(at)

    _run(log.writeStream.foreachBatch(put), state or f"{path}/_state")
    return path


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The status that ``stream_metrics`` has written."""
    return spark.read.parquet(f"{path}/status")
