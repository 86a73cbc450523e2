"""The same work on readings as they arrive.

Progress is kept by the query's checkpoint. Late rows count until the watermark passes them; windows of a device go on
across micro-batches, as the samples of an unfinished one stay in state. decoding.py does the same for the decoder, and
gives out days once they are complete.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import times


def clamp_future(df: DataFrame, ts: str, now_ms: Column, most_ahead_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, rows whose clock is ahead)."""
    ahead = F.col(ts) > now_ms + most_ahead_ms
    return df.where(~ahead), df.where(ahead)


def first_events(events: DataFrame, keys: tuple[str, ...] = ("device_id", "ts_start"), at: str = "event_time", late: str = "1 hour") -> DataFrame:
    """Each event once, the first that came, as long as its repeats are not later than `late`."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def daily_counts(events: DataFrame, at: str = "event_time", late: str = "1 hour", key: str = "device_id", zone: Column | None = None) -> DataFrame:
    """Events and their time for each device, day and behaviour; a day is given out when the watermark has passed its end.

    With zone (a resolved one) days are the device's local ones: the clock of events is moved to the local one, and late
    has to cover the spread of zones beside the lateness.
    """
    if zone is not None:
        events = events.withColumn("_zone", zone).withColumn(at, F.from_utc_timestamp(at, F.col("_zone")))
        day = F.window(at, "1 day")
        grouped = events.withWatermark(at, late).groupBy(key, "_zone", day, "behavior")
        out = grouped.agg(F.count("*").alias("n"), F.sum(F.col("ts_end") - F.col("ts_start")).alias("spent_ms"))
        return out.select(key, F.unix_millis(F.to_utc_timestamp("window.start", F.col("_zone"))).alias("day_ts"), "behavior", "n", "spent_ms")
    day = F.window(at, "1 day")
    grouped = events.withWatermark(at, late).groupBy(key, day, "behavior")
    out = grouped.agg(F.count("*").alias("n"), F.sum(F.col("ts_end") - F.col("ts_start")).alias("spent_ms"))
    return out.select(key, F.unix_millis("window.start").alias("day_ts"), "behavior", "n", "spent_ms")


def gap_sessions(events: DataFrame, gap: str, at: str = "event_time", late: str = "1 hour", key: str = "device_id") -> DataFrame:
    """Stretches without a pause of more than gap."""
    session = F.session_window(at, gap)
    out = events.withWatermark(at, late).groupBy(key, session).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return out.select(key, F.unix_millis("first").alias("start_ms"), F.unix_millis("last").alias("last_ms"), "n")


def count_windows(samples: DataFrame, size: int, step: int, key: str = "device_id", ts: str = "ts_ms", value: str = "value") -> DataFrame:
    """Full windows of `size` samples every `step`: key, window_idx, start_ms, mean. The tail of a batch waits for the next.

    Samples of one micro-batch are put in order; a sample older than what a device's earlier batches had goes in where it arrives.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held_ts, held = state.get if state.exists else (0, [], [])
        new = pd.concat(list(batches), ignore_index=True).sort_values(ts, kind="stable")
        held_ts, held = [*held_ts, *new[ts].tolist()], [*held, *new[value].tolist()]
        n = max(0, (len(held) - size) // step + 1)
        total = np.append(0.0, np.cumsum(held))
        at = np.arange(n) * step
        state.update((number + n, held_ts[n * step :], held[n * step :]))
        yield pd.DataFrame({key: k[0], "window_idx": number + np.arange(n), "start_ms": np.array(held_ts)[at] if n else at, "mean": (total[at + size] - total[at]) / size})

    kind = dict(samples.dtypes)[key]
    return samples.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, window_idx long, start_ms long, mean double", "number long, held_ts array<long>, held array<double>", "append", GroupStateTimeout.NoTimeout)


def latest(spark: SparkSession, path: str, partition: str, before: int | None = None) -> DataFrame | None:
    """The table that upsert_each_batch() keeps under path: each partition as its last version has it, None if there is none yet."""
    try:
        every = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if before is not None:
        every = every.where(F.col("v") < before)
    newest = every.groupBy(partition).agg(F.max("v").alias("v"))  # a row a partition
    return every.join(newest, [partition, "v"]).drop("v")


def upsert_each_batch(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], partition: str = "day_ts") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the partitions of a table that a batch has rows for become what merge(rows before, batch) gives.

    They are written to path/v=<batch>; other partitions are not touched, so a batch costs what its days hold and not the
    table. Versions may be missing. A batch that runs again after a failure starts from the versions before its own and
    writes its own again, so the result is the same. partition is a column without nulls, such as the day.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, path, partition, number)
        if before is not None:
            before = before.join(batch.select(partition).distinct(), partition, "left_semi")
        merge(before, batch).write.mode("overwrite").partitionBy(partition).parquet(f"{path}/v={number}")

    return write


def drop_old_versions(spark: SparkSession, path: str, partition: str, keep: int = 2) -> int:
    """Delete versions of partitions that newer ones replace, but for the last `keep` batches, which may run again; how many."""
    seen = spark.read.option("basePath", path).parquet(path).select(partition, "v").distinct()
    newest = Window.partitionBy(partition)
    old = seen.withColumn("last", F.max("v").over(newest)).where(F.col("v") < F.col("last"))
    limit = seen.agg(F.max("v")).first()[0] - keep
    files = spark._jvm.org.apache.hadoop.fs
    gone = 0
    for r in old.where(F.col("v") <= limit).toLocalIterator():  # a row a partition and version
        where = files.Path(f"{path}/v={r['v']}/{partition}={r[partition]}")
        gone += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def poll(samples: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, ts: str = "ts_ms", quarantine: str | None = None, interval: str = "15 seconds", available_now: bool = False, most_ahead_ms: int = 0, clock: Callable[[], int] = lambda: int(time.time() * 1000)) -> StreamingQuery:
    """handle(rows, number) for each micro-batch of samples, every interval, or once over all that is there.

    Rows whose time is ahead of the clock wait in quarantine (a folder) and are handled with the first later batch that comes when
    the clock has passed them; without quarantine they are left out. What waits after a batch is written before the batch is
    handled, under its number, so a batch that runs again starts from the same rows. How far the stream has been read is in
    the checkpoint and advances also where a batch gives nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, F.lit(clock())
        waiting = _waiting(spark, quarantine, number) if quarantine else None
        rows = (batch if waiting is None else batch.unionByName(waiting.select(*batch.columns))).persist()
        try:
            good, ahead = clamp_future(rows, ts, now, most_ahead_ms)
            if quarantine:
                ahead.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
            handle(good, number)
        finally:
            rows.unpersist()

    writer = samples.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def _waiting(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What the batch before `number` left waiting; what earlier ones left is deleted."""
    files = spark._jvm.org.apache.hadoop.fs
    root = files.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None
    found = {int(s.getPath().getName().removeprefix("batch=")): s.getPath() for s in system.listStatus(root) if s.getPath().getName().startswith("batch=")}
    before = max((k for k in found if k < number), default=None)
    for k, where in found.items():
        if before is not None and k < before:
            system.delete(where, True)
    return spark.read.parquet(f"{path}/batch={before}") if before is not None else None


def with_errors(run: Callable[[pd.DataFrame], pd.DataFrame], keys: tuple[str, ...], columns: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A group function whose failures are rows with error set and other columns null, so one device's day stops no other."""

    def guarded(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(pdf).assign(error=None)
        except Exception as e:  # noqa: BLE001  the error is what is reported
            return pd.DataFrame([{**dict.fromkeys(columns), **{k: pdf[k].iloc[0] for k in keys}, "error": f"{type(e).__name__}: {e}"}])

    return guarded


def retry_table(errors: DataFrame, before: DataFrame, most: int = 3) -> DataFrame:
    """The days to run again, with how often they failed: pending, and abandoned after `most` times.

    errors: device_id, day_ts, error (null where the day went well) of the days that were run; before: device_id, day_ts,
    retry_count and, if it has one, error. A day that went well goes, one that was not run stays as it was.
    """
    last = F.col("error") if "error" in before.columns else F.lit(None).cast("string")
    held = before.select("device_id", "day_ts", F.col("retry_count").alias("_n"), last.alias("_error"))
    joined = errors.withColumn("_run", F.lit(True)).join(held, ["device_id", "day_ts"], "full")
    stays = F.col("_run").isNull()
    n = F.coalesce("_n", F.lit(0)) + F.when(stays, 0).otherwise(1)
    kept = joined.where(stays | F.col("error").isNotNull())
    return kept.select("device_id", "day_ts", F.when(stays, F.col("_error")).otherwise(F.col("error")).alias("error"), n.cast("int").alias("retry_count"), F.when(n >= most, "abandoned").otherwise("pending").alias("status"))


def complete_days(max_ts: DataFrame, zone: Column, now_ms: Column, ts: str = "last_ts") -> DataFrame:
    """Devices whose stream has passed into a later local day than the one that is due (day_ts), which is before today."""
    reached = times.local_midnight(F.col(ts), zone)
    today = times.local_midnight(now_ms, zone)
    return max_ts.where((reached > F.col("day_ts")) & (F.col("day_ts") < today))
