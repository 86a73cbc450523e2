"""Sleep, its rhythm, trends over days, and faults of sensors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY_MS

#: A variance under which an axis stands still, and an acceleration beyond a sensor's range, in g.
STILL, RANGE_G = 0.001, 15.5
HOUR_MS = DAY_MS // 24


def main_sleep(sleep: DataFrame, key: str, offset: Column, start: str = "ts_start", end: str = "ts_end", nap_ms: int = 2 * HOUR_MS) -> DataFrame:
    """key, night (number of the local day whose noon it began after), onset, wake, n_runs, nap_ms of each night: its longest run of sleep, the first on ties, and the time of the runs shorter than nap_ms besides.

    sleep: intervals of sleep, joined where they touch; offset: milliseconds to add for local time. A run belongs to the
    night in which it begins, from noon to noon, so runs across midnight are whole.
    """
    night = F.floor((F.col(start) + offset - DAY_MS // 2) / DAY_MS)
    length = F.col(end) - F.col(start)
    runs = sleep.withColumn("night", night).withColumn("_length", length)
    nights = runs.groupBy(key, "night").agg(F.max(F.struct("_length", (-F.col(start)).alias("_start"))).alias("_m"), F.count("*").alias("n_runs"), F.coalesce(F.sum(F.when(F.col("_length") < nap_ms, F.col("_length"))), F.lit(0)).alias("_naps"))
    onset = -F.col("_m._start")
    naps = F.col("_naps") - F.when(F.col("_m._length") < nap_ms, F.col("_m._length")).otherwise(0)
    return nights.select(key, "night", onset.alias("onset"), (onset + F.col("_m._length")).alias("wake"), "n_runs", naps.alias("nap_ms"))


def circular_mean(time_of_day: Column, window) -> Column:  # noqa: ANN001
    """The mean time of day (milliseconds) over a window, as a direction: times on both sides of midnight meet there."""
    angle = time_of_day * (2 * math.pi / DAY_MS)
    return F.atan2(F.sum(F.sin(angle)).over(window), F.sum(F.cos(angle)).over(window)) * (DAY_MS / (2 * math.pi))


def circadian(nights: DataFrame, key: str, offset: Column, days: int = 7) -> DataFrame:
    """nights with onset_mean and wake_mean: local times of day in hours, 0 to 24, over the last `days` nights with this one; missing nights count nothing."""
    w = Window.partitionBy(key).orderBy("night").rangeBetween(-(days - 1), 0)
    out = nights
    for c in ("onset", "wake"):
        local = F.pmod(F.col(c) + offset, F.lit(DAY_MS))
        out = out.withColumn(f"{c}_mean", F.pmod(circular_mean(local, w) / HOUR_MS, F.lit(24.0)))
    return out


def slope(y: Column, day: Column, window) -> Column:  # noqa: ANN001
    """The least-squares slope of y by day over a window, from running sums; null under two days with a value."""
    x = F.when(y.isNotNull(), day.cast("double"))
    n, sx, sy = F.count(y).over(window), F.sum(x).over(window), F.sum(y.cast("double")).over(window)
    sxx, sxy = F.sum(x * x).over(window), F.sum(x * y).over(window)
    return F.when(n > 1, F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx))


def trends(daily: DataFrame, key: str, day: str, value: str, spans: Sequence[int] = (7, 30), normal: Column | None = None) -> DataFrame:
    """daily with trend_<span>d, mean_<span>d, std_<span>d (population) of the days up to this one, and, with normal (a condition), days_since_normal. Missing days count nothing.

    Days are counted from the first one of a device, so that sums of squares stay small.
    """
    every = Window.partitionBy(key)
    out = daily.withColumn("_x", F.col(day) - F.min(day).over(every))
    for span in spans:
        w = every.orderBy("_x").rangeBetween(-(span - 1), 0)
        out = out.withColumn(f"trend_{span}d", slope(F.col(value), F.col("_x"), w)).withColumn(f"mean_{span}d", F.avg(value).over(w)).withColumn(f"std_{span}d", F.stddev_pop(value).over(w))
    if normal is not None:
        last = F.last(F.when(normal, F.col("_x")), ignorenulls=True).over(every.orderBy("_x").rangeBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("days_since_normal", F.col("_x") - last)
    return out.drop("_x")


def second_moments(readings: DataFrame, keys: Sequence[str], ts: str, channels: Sequence[str]) -> DataFrame:
    """keys, second, n, and of each channel the sum and the sum of squares: what sliding variances are put together from. Channels are moved by their value at 1, so flat ones lose no digits."""
    second = F.floor(F.col(ts) / 1000).alias("second")
    moved = lambda c: F.col(c).cast("double") - 1.0
    return readings.groupBy(*keys, second).agg(F.count("*").alias("n"), *[x for c in channels for x in (F.sum(moved(c)).alias(f"{c}_sum"), F.sum(moved(c) * moved(c)).alias(f"{c}_squares"))])


def sliding_variance(moments: DataFrame, keys: Sequence[str], channels: Sequence[str], seconds: int) -> DataFrame:
    """moments with <channel>_var over the last `seconds` seconds, and covered: in how many of them there are readings."""
    w = Window.partitionBy(*keys).orderBy("second").rangeBetween(-(seconds - 1), 0)
    n = F.sum("n").over(w)
    out = moments.withColumn("covered", F.count("*").over(w))
    for c in channels:
        total, squares = F.sum(f"{c}_sum").over(w), F.sum(f"{c}_squares").over(w)
        out = out.withColumn(f"{c}_var", F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n)))
    return out


def faults(readings: DataFrame, keys: Sequence[str], ts: str, acc: Sequence[str], gyro: Sequence[str], flat_s: int = 300, silent_s: int = 600, still: float = STILL, range_g: float = RANGE_G) -> DataFrame:
    """keys, n_seconds, n_flat_<axis> (seconds that end flat_s of readings with a variance under `still`), n_silent (that end silent_s of gyroscope readings that are all 0), n_saturated (readings beyond the range).

    Readings are summed up by the second before anything is ordered.
    """
    quiet = F.min(F.when(F.greatest(*[F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in gyro]) == 0, 1).otherwise(0)).alias("_silent")
    beyond = F.count(F.when(F.greatest(*[F.abs(c) for c in acc]) > range_g, 1)).alias("_beyond")
    second = F.floor(F.col(ts) / 1000).alias("second")
    moved = lambda c: F.col(c).cast("double") - 1.0
    moments = readings.groupBy(*keys, second).agg(F.count("*").alias("n"), quiet, beyond, *[x for c in acc for x in (F.sum(moved(c)).alias(f"{c}_sum"), F.sum(moved(c) * moved(c)).alias(f"{c}_squares"))])
    out = sliding_variance(moments, keys, acc, flat_s)
    w = Window.partitionBy(*keys).orderBy("second").rangeBetween(-(silent_s - 1), 0)
    out = out.withColumn("_quiet", (F.min("_silent").over(w) == 1) & (F.count("*").over(w) == silent_s))
    flat = [F.count(F.when((F.col("covered") == flat_s) & (F.col(f"{c}_var") < still), 1)).alias(f"n_flat_{c}") for c in acc]
    return out.groupBy(*keys).agg(F.count("*").alias("n_seconds"), *flat, F.count(F.when(F.col("_quiet"), 1)).alias("n_silent"), F.sum("_beyond").alias("n_saturated"))


def inversions(rows: DataFrame, keys: Sequence[str], arrival: str, ts: str) -> DataFrame:
    """keys, n_inversions: rows whose time is before that of the row that arrived just before."""
    earlier = F.col(ts) < F.lag(ts).over(Window.partitionBy(*keys).orderBy(arrival))
    return rows.withColumn("_earlier", earlier).groupBy(*keys).agg(F.count(F.when(F.col("_earlier"), 1)).alias("n_inversions"))
