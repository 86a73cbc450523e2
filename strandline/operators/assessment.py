"""The daily assessment of all devices at once, and the baseline that it is held against.

Daily rows are few a device (one a day), so windows by device are short whatever the stream's rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.scores import DEFAULT, Thresholds


def with_zscore(days: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """days (scratch_count, wear_minutes, neck_temp, baseline_mean, baseline_std, temp_coef, valid_days) with quality, phase, z and whether that is abnormal.

    A device without a baseline is in phase 0. z is there on days worn long enough from phase 1 on.
    """
    out = days.withColumn("data_quality", F.when(F.col("wear_minutes") < limits.min_wear_minutes, 1).otherwise(0))
    out = out.withColumn("eval_phase", F.when(F.col("baseline_mean").isNull(), 0).otherwise(scores.phase(F.col("valid_days"), limits)))
    effect = F.when(F.col("neck_temp").isNotNull(), scores.round_even(F.col("temp_coef") * (F.col("neck_temp") - limits.reference_temperature), 2)).otherwise(0.0)
    out = out.withColumn("temp_effect", effect)
    std = F.greatest(F.col("baseline_std"), F.lit(limits.std_floor))
    z = scores.round_even((F.col("scratch_count") - F.col("baseline_mean") - F.col("temp_effect")) / std, 3)
    usable = (F.col("data_quality") == 0) & (F.col("eval_phase") >= 1)
    out = out.withColumn("zscore", F.when(usable, z)).withColumn("threshold_z", scores.by_phase(F.col("eval_phase"), limits.z))
    return out.withColumn("is_abnormal", F.coalesce(F.col("zscore") > F.col("threshold_z"), F.lit(False)))


def with_streak(days: DataFrame, limits: Thresholds = DEFAULT, device: str = "device_id", day: str = "day_ts") -> DataFrame:
    """days with the trailing mean of z and the count of abnormal days in a row; days without a z carry the count before."""
    w = Window.partitionBy(device).orderBy(day)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("zscore").isNotNull()
    out = days.withColumn("_valid", F.sum(has.cast("int")).over(upto))
    # Rows before within the last N - 1 that have a z, whatever lies between: numbered by _valid.
    out = out.withColumn("_group", F.sum((has & ~F.col("is_abnormal")).cast("int")).over(upto))
    run = Window.partitionBy(device, "_group").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_streak", F.when(has, F.sum((has & F.col("is_abnormal")).cast("int")).over(run)))
    out = out.withColumn("consec_abnormal", F.coalesce(F.col("_streak"), F.last("_streak", ignorenulls=True).over(before), F.lit(0)))
    stored = F.col("zscore").cast("decimal(6,2)")  # whole hundredths, so that sums don't depend on their order
    by_number = Window.partitionBy(device).orderBy("_number")

    def mean_of(n: int) -> Column:
        earlier = by_number.rangeBetween(-(n - 1), -1)
        total, count = F.coalesce(F.sum(stored).over(earlier).cast("double"), F.lit(0.0)), F.count(stored).over(earlier)
        return scores.round_decimal((total + F.col("zscore")) / (count + 1), 3)

    # Rows without a z are set apart from the numbers that the range looks back to.
    out = out.withColumn("_number", F.when(has, F.col("_valid")).otherwise(F.lit(-1000) - F.col("_valid")))
    mean = scores.by_phase(F.col("eval_phase"), (0, 0, 0))
    mean = F.when(F.col("eval_phase") == 1, mean_of(limits.consecutive[0])).when(F.col("eval_phase") == 2, mean_of(limits.consecutive[1])).when(F.col("eval_phase") == 3, mean_of(limits.consecutive[2]))
    out = out.withColumn("avg_zscore", F.when(has, mean))
    out = out.withColumn("alert_level", F.when(F.col("is_abnormal"), scores.alert(F.col("consec_abnormal"))).otherwise(0))
    return out.drop("_valid", "_group", "_streak", "_number")


def with_scores(days: DataFrame) -> DataFrame:
    """days with the six part scores, their total and the level. s5 is given from outside and kept as it is."""
    loose = F.coalesce(F.col("worn_loose_minutes"), F.lit(0.0))
    out = (
        days.withColumn("s1_score", F.when(F.col("zscore").isNull(), 0.0).otherwise(scores.count_score(F.col("zscore"))))
        .withColumn("s2_score", scores.bout_score(F.col("wpeb_score"), F.coalesce(F.col("wpeb_mean"), F.col("wpeb_score")), F.coalesce(F.col("wpeb_std"), F.lit(1.0))))
        .withColumn("s3_score", scores.night_score(F.col("night_scratch_count"), F.col("night_sleep_segments")))
        .withColumn("s4_score", scores.temperature_score(F.col("neck_temp"), loose))
        .withColumn("s6_score", scores.climate_score(F.col("env_temp"), F.col("env_humidity")))
    )
    parts = [F.col(f"s{k}_score") for k in range(1, 7)]
    out = out.withColumn("total_score", scores.total(*parts))
    return out.withColumn("health_level", scores.level(F.col("total_score")))


def alert_reason(days: DataFrame) -> Column:
    """Why a day has an alert: how many days in a row are over which limit of z, and their mean z."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.col(c)), "0+$", ""), "\\.$", ".0")
    said = F.format_string("%d days in a row with z > %s, mean z %s", F.col("consec_abnormal"), plain("threshold_z"), plain("avg_zscore"))
    return F.when(F.col("alert_level") > 0, said)


def assess(daily: DataFrame, baseline: DataFrame | None, environment: DataFrame, scores_given: DataFrame | None = None, limits: Thresholds = DEFAULT) -> DataFrame:
    """One pass over all devices and days: daily rows, left-joined to baseline (by device; None where daily has its columns) and environment (by device and day)."""
    days = daily if baseline is None else daily.join(baseline, "device_id", "left")
    days = days.join(environment, ["device_id", "day_ts"], "left")
    if scores_given is None:
        days = days.withColumn("s5_score", F.lit(None).cast("double"))
    else:
        days = days.join(scores_given.select("device_id", "day_ts", "s5_score"), ["device_id", "day_ts"], "left")
    days = days.withColumn("worn_loose_minutes", F.lit(0.0))
    return with_scores(with_streak(with_zscore(days, limits), limits))


def last_valid(assessed: DataFrame, days: int = 30) -> DataFrame:
    """The last days of each device that count."""
    rank = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("day_ts")))
    return assessed.where("data_quality = 0").withColumn("_rank", rank).where(F.col("_rank") <= days).drop("_rank")


#: How much a day moves the baseline, by how far off it is.
LEARNING = ((1.0, 0.10), (2.0, 0.03))


def ewma(rows: DataFrame, state: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """The baseline after folding each device's valid days, oldest first, into its state. Far-off days do not move it.

    rows: device_id, day_ts, scratch_count, zscore, wpeb_score, at most 30 a device (last_valid()); a null z counts as 0.
    state: device_id, baseline_mean, wpeb_mean, valid_days.
    """
    day = F.struct("day_ts", F.col("scratch_count").cast("double").alias("c"), F.coalesce(F.col("zscore"), F.lit(0.0)).alias("z"), F.col("wpeb_score").cast("double").alias("w"))
    folded = state.join(rows.groupBy("device_id").agg(F.array_sort(F.collect_list(day)).alias("_days")), "device_id", "left")
    start = F.struct(F.col("baseline_mean").cast("double").alias("m"), F.col("wpeb_mean").cast("double").alias("w"), F.col("valid_days").cast("int").alias("n"))

    def fold(s: Column, x: Column) -> Column:
        (near, fast), (far, slow) = LEARNING
        off = F.abs(x["z"])
        a = F.when(off < near, fast).when(off < far, slow).otherwise(0.0)
        return F.struct(((1 - a) * s["m"] + a * x["c"]).alias("m"), ((1 - a) * s["w"] + a * x["w"]).alias("w"), (s["n"] + F.when(a > 0, 1).otherwise(0)).alias("n"))

    empty = F.expr("array()").cast("array<struct<day_ts: bigint, c: double, z: double, w: double>>")
    out = folded.withColumn("_s", F.aggregate(F.coalesce("_days", empty), start, fold))
    days = F.col("_s.n")
    return out.select("device_id", F.col("_s.m").alias("baseline_mean"), F.col("_s.w").alias("wpeb_mean"), days.alias("valid_days"), F.least(days / 30.0, F.lit(1.0)).alias("confidence"), scores.phase(days, limits).alias("eval_phase"))


def spread(rows: DataFrame, limits: Thresholds = DEFAULT, least_rows: int = 3) -> DataFrame:
    """Population deviation of counts and bout scores over ordinary days (|z| < 2), with floors; null under least_rows days."""
    usual = rows.where(F.abs(F.coalesce("zscore", F.lit(0.0))) < 2.0)
    std = lambda c, floor: F.when(F.count("*") >= least_rows, F.greatest(F.stddev_pop(c), F.lit(floor)))
    return usual.groupBy("device_id").agg(std("scratch_count", limits.std_floor).alias("baseline_std"), std("wpeb_score", limits.wpeb_std_floor).alias("wpeb_std"))


def temperature_slope(rows: DataFrame, least_pairs: int = 20, most: float = 0.4) -> DataFrame:
    """Least-squares slope of counts on temperature within [0, most]; null under least_pairs days, 0 for temperatures that never change."""
    known = rows.where("neck_temp is not null")
    x, y = F.col("neck_temp"), F.col("scratch_count").cast("double")
    slope = F.when(F.min(x) == F.max(x), 0.0).otherwise(F.regr_slope(y, x))
    return known.groupBy("device_id").agg(F.when(F.count("*") >= least_pairs, F.greatest(F.lit(0.0), F.least(F.lit(most), slope))).alias("temp_coef"), F.count("*").alias("n_pairs"))


def prior_values(rows: DataFrame, value: str, valid: Column, device: str = "device_id", day: str = "day_ts") -> DataFrame:
    """What the day before has, whatever its quality, and what the last valid day before has."""
    w = Window.partitionBy(device).orderBy(day)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("prior_any", F.lag(value).over(w)).withColumn("prior_valid", F.last(F.when(valid, F.col(value)), ignorenulls=True).over(before))
