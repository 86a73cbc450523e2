"""Daily aggregates of behaviour intervals (device_id, day_ts, ts_start, ts_end, behavior, confidence).

All are plain grouped aggregates, so tasks combine their own rows first and a device with most of them is no burden.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.labels import MOVE, NOT_WORN, SCRATCH, SLEEP

KEYS = ("device_id", "day_ts")
NIGHT_BEFORE_MS, NIGHT_AFTER_MS = 2 * 3_600_000, 6 * 3_600_000


def _spent():
    return F.col("ts_end") - F.col("ts_start")


def _of(code: int):
    return F.col("behavior") == code


def _sum_ms(condition):
    return F.coalesce(F.sum(F.when(condition, _spent())), F.lit(0))


def night(ts: str = "ts_start", day: str = "day_ts"):
    """From two hours before midnight to six after."""
    return (F.col(ts) >= F.col(day) - NIGHT_BEFORE_MS) & (F.col(ts) < F.col(day) + NIGHT_AFTER_MS)


def daily(behavior: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scratch counts and times, night counts, weighted bout score, and minutes by behaviour for each device and day."""
    scratch, seconds = _of(SCRATCH), _spent() / 1000.0
    minutes = lambda condition: F.expr("x div 60000") if condition is None else (F.floor(_sum_ms(condition) / 60000)).cast("int")
    n = F.count(F.when(scratch, 1))
    total = _sum_ms(scratch)
    return behavior.groupBy(*keys).agg(
        n.alias("scratch_count"),
        total.alias("scratch_ms"),
        F.when(n > 0, F.floor(F.try_divide(total, n))).otherwise(0).cast("long").alias("scratch_avg_ms"),
        F.coalesce(F.max(F.when(scratch, _spent())), F.lit(0)).alias("scratch_max_ms"),
        F.count(F.when(scratch & night(), 1)).alias("night_scratch_count"),
        F.count(F.when(_of(SLEEP) & night(), 1)).alias("night_sleep_segments"),
        F.coalesce(F.sum(F.when(scratch, scores.bout_weight(F.col("confidence")) * scores.duration_weight(seconds))), F.lit(0.0)).alias("wpeb_score"),
        minutes(F.col("behavior") != NOT_WORN).alias("wear_minutes"),
        minutes(_of(SLEEP)).alias("sleep_min"),
        minutes(_of(MOVE)).alias("move_min"),
        minutes(scratch).alias("scratch_min"),
    )


def wear_minutes(behavior: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Minutes with the device on; an unknown behaviour counts as worn. Days without a worn interval have 0."""
    return behavior.groupBy(*keys).agg(F.floor(_sum_ms(F.col("behavior") != NOT_WORN) / 60000).cast("long").alias("wear_minutes"))


def summary(daily_rows: DataFrame, alert_level: str = "alert_level", loose: str = "loose_min") -> DataFrame:
    """Shares of worn time and their traffic lights; shares are null on days without worn time."""
    wear = F.col("wear_minutes")
    share = lambda c: F.when(wear > 0, scores.round_even(F.try_divide(F.col(c), wear), 3))
    out = daily_rows.withColumn("sleep_ratio", share("sleep_min")).withColumn("active_ratio", share("move_min"))
    out = out.withColumn("off_min", F.greatest(F.lit(0), 1440 - wear - F.coalesce(F.col(loose), F.lit(0))))
    return (
        out.withColumn("sleep_status", scores.sleep_status(F.coalesce("sleep_ratio", F.lit(0.0)), wear))
        .withColumn("move_status", scores.move_status(F.coalesce("active_ratio", F.lit(0.0)), wear))
        .withColumn("scratch_status", scores.scratch_status(F.col(alert_level)))
    )


def environment(readings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Means of the readings of a whole day, of those that are there: 2, 1 and 2 places."""
    mean = lambda c, places: scores.round_even(F.avg(c), places).alias(c)
    return readings.groupBy(*keys).agg(mean("env_temp", 2), mean("env_humidity", 1), mean("neck_temp", 2))


def profile(behavior: DataFrame) -> DataFrame:
    """How often each behaviour is there, and the limits of its confidence and duration in seconds."""
    seconds = _spent() / 1000.0
    return behavior.groupBy("behavior").agg(
        F.count("*").alias("n"),
        F.min("confidence").alias("min_conf"),
        F.max("confidence").alias("max_conf"),
        F.min(seconds).alias("min_sec"),
        F.max(seconds).alias("max_sec"),
        F.sum(seconds).alias("total_sec"),
    )


def night_report(behavior: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return daily(behavior, keys).select(*keys, "night_scratch_count", "night_sleep_segments")
