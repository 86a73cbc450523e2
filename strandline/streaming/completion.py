"""Days that are complete, as a stream tells them, and their assessment with retries.

A device's local day is complete once the watermark has passed the midnight that ends it; a timer for that midnight waits
in state, so a day is given out although the device falls silent, as long as others report. Days of 23 and 25 hours end
where their zone's clock says.

The days that failed are a small table beside the results. With each batch of complete days those that wait are run
again; a day is given up after its third failure. Both tables are written by the number of the batch, so a batch that runs
again after a failure of the driver starts from the same rows and gives the same.

Defined results: rows of a day that come later than the watermark are left out, as in any stream, and do not make it due again;
rows without a device or a time are left out; a zone that nothing matches is the default one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import times
from .incremental import latest, retry_table, upsert_each_batch


class DayTimers(StatefulProcessor):
    """A timer for the end of each day of a device that has rows."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day_end long", "day_ts long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        every = pd.concat(list(rows), ignore_index=True)
        for (day, end), n in every.groupby(["day_ts", "day_end"]).size().items():
            if self.days.containsKey((int(end),)):
                n += self.days.getValue((int(end),))[1]
            else:
                self.handle.registerTimer(int(end))
            self.days.updateValue((int(end),), (int(day), int(n)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        day, n = self.days.getValue((end,))
        self.days.removeKey((end,))
        yield pd.DataFrame({self.key: [key[0]], "day_ts": [day], "n_rows": [n]})


def completed_days(rows: DataFrame, zone: Column, key: str = "device_id", ts: str = "ts_ms", late: str = "1 hour") -> DataFrame:
    """key, day_ts, n_rows of each local day of a stream, once, when the watermark has passed its end. zone: a resolved one."""
    kind = dict(rows.dtypes)[key]
    day = times.local_date(F.col(ts), F.col("_zone"))
    begin, end = times.day_range(day, F.col("_zone"))
    timed = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_zone", zone)
    timed = timed.select(key, begin.alias("day_ts"), end.alias("day_end"), F.timestamp_millis(ts).alias("event_time")).withWatermark("event_time", late)
    return timed.groupBy(key).transformWithStateInPandas(DayTimers(key), f"`{key}` {kind}, day_ts long, n_rows long", "append", "eventTime")


def assess_each_batch(path: str, assess: Callable[[DataFrame], DataFrame], key: str = "device_id", most: int = 3) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on completed_days(): keeps results under path/results and the days that failed under path/errors.

    assess(days) gives a row for each day (key, day_ts) with error null, or a row with error set and all else null, as
    incremental.with_errors() does. errors holds key, day_ts, error, retry_count, status (pending, abandoned).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, f"{path}/errors", "slot", number)
        if before is None:
            before = spark.createDataFrame([], f"`{key}` {dict(batch.dtypes)[key]}, day_ts long, error string, retry_count int, status string, slot int")
        before = before.where("status <> 'mark'")
        due = batch.select(key, "day_ts").unionByName(before.where("status = 'pending'").select(key, "day_ts")).distinct()
        done = assess(due).persist()
        try:
            upsert_each_batch(f"{path}/results", lambda old, new: _newest(old, new, key))(done.where("error is null").drop("error"), number)
            said = done.select(F.col(key).alias("device_id"), "day_ts", "error")
            errors = retry_table(said, before.withColumnRenamed(key, "device_id"), most).withColumnRenamed("device_id", key)
            # One version holds all days that wait: they are few. An empty one as well, so that days that went well are gone.
            errors.withColumn("slot", F.lit(0)).unionByName(_mark(spark, errors.schema, key)).write.mode("overwrite").partitionBy("slot").parquet(f"{path}/errors/v={number}")
        finally:
            done.unpersist()

    return write


def _newest(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    return new if old is None else old.select(*new.columns).join(new, [key, "day_ts"], "left_anti").unionByName(new)


def _mark(spark, schema, key: str) -> DataFrame:  # noqa: ANN001
    """A row that tells that a version is there, though no day waits."""
    nothing = spark.range(1).select(*[F.lit("mark" if f.name == "status" else None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return nothing.withColumn("slot", F.lit(0))


def waiting_days(spark, path: str) -> DataFrame | None:  # noqa: ANN001
    """The days that failed and wait or were given up, None where none ever failed."""
    found = latest(spark, f"{path}/errors", "slot")
    return None if found is None else found.where("status <> 'mark'").drop("slot")
