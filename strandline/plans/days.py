"""Queries on days: rollups, the assessment, baselines, keyed writes, lookups, metrics and signals; and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, labels, scores, times, units
from ..operators import assessment, islands, lookups, metrics, rollup, upserts
from ..sources import readers
from . import domain
from .domain import BEHAVIOR_SQL, EV_SQL, READINGS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = ("device_id", "day_ts")
SPLIT = 1_704_931_200_000  # 2024-01-11: the days before teach the baseline, the others are assessed
R6 = lambda c: F.round(c, 6).alias(c)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Sources


@query(f"with {EV_SQL} select device_id, min(ts_ms) as first_ts, max(ts_ms) as last_ts, count(*) as n_rows from ev group by 1")
def device_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last reading of each device."""
    return readers.span(domain.events(spark, sf_dir), "device_id", "ts_ms")


@query(f"with {EV_SQL} select distinct device_id from ev")
def device_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.devices(domain.events(spark, sf_dir), "device_id")


@query(f"with {EV_SQL} select event_id, device_id, ts_ms from ev where ts_ms > case when device_id % 3 = 0 then {SPLIT} else 0 end")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after each device's mark; a third of the devices has one."""
    raw = domain.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("device_id"), "ts")
    every = domain.devices(spark, sf_dir).select("device_id")
    marks = every.where("device_id % 3 = 0").withColumn("last_processed_ts", F.timestamp_millis(F.lit(SPLIT)).cast(raw.schema["ts"].dataType))
    found = readers.after(raw, marks, "device_id", "ts", devices=every)
    return found.select("event_id", "device_id", times.millis(F.col("ts")).alias("ts_ms"))


@query("select event_id, user_id as device_id, value from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09'")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of some days; the limits reach the scan."""
    raw = domain.table(spark, sf_dir, "events")
    return readers.between(raw, "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz")).select("event_id", F.col("user_id").alias("device_id"), "value")


@query(f"with {EV_SQL} select device_id, arg_max(event_type, ts_ms * 1000000 + event_id) = 'purchase' as charging from ev group by 1")
def latest_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a device's last event was of one kind."""
    e = domain.events(spark, sf_dir)
    return lookups.latest(e.withColumn("charging", F.col("event_type") == "purchase"), "device_id", "ts_ms", "charging", "event_id").select("device_id", "charging")


@query("select s_suppkey, replace(replace(s_name, '#', ':'), ':', '_') as serial, upper(s_name) as upper_name from supplier")
def serial_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", readers.serial(F.replace("s_name", F.lit("#"), F.lit(":"))).alias("serial"), F.upper("s_name").alias("upper_name"))


@query(f"with {EV_SQL} select event_id, cast(json_extract(props, '$.k') as bigint) as k from ev")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.events(spark, sf_dir).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(f"""with {EV_SQL} select device_id, day_ts, ts_ms, case event_type when 'error' then 3 when 'click' then 1 else 2 end as behavior, value as confidence from ev where event_type in ('error', 'click', 'view')""")
def json_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows inside JSON documents, one a device and day; labels that nothing maps are left out."""
    e = domain.events(spark, sf_dir).withColumn("label", F.coalesce(F.try_element_at(labels.literal_map({"error": "scratch", "click": "active", "view": "sleep"}), "event_type"), F.col("event_type")))
    day = e.groupBy(*KEYS).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("ts_ms").cast("string").alias("ts"), "label", F.col("value").alias("conf"))).alias("windows"))).alias("body"))
    parsed = day.select(*KEYS, F.explode(F.from_json("body", "windows array<struct<ts: string, label: string, conf: double>>")["windows"]).alias("w"))
    return readers.windows_of(parsed)


# Times


@query(f"""with {EV_SQL}, l as (select *, timezone(zone, timezone('UTC', make_timestamp(ts_ms * 1000))) as local from ev)
select event_id, strftime(local, '%Y-%m-%d') as local_day, strftime(local, '%Y-%m-%d %H:%M:%S') as local_text, epoch_ms(timezone('UTC', timezone(zone, date_trunc('day', local)))) as midnight_ms from l""")
def timezone_day_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local day, clock and midnight of each event in its device's zone."""
    e = domain.events(spark, sf_dir).withColumn("zone", times.resolve_zone(domain.zone_of(F.col("device_id"))))
    ts, zone = F.col("ts_ms"), F.col("zone")
    return e.select("event_id", times.local_date(ts, zone).cast("string").alias("local_day"), times.local_text(ts, zone).alias("local_text"), times.local_midnight(ts, zone).alias("midnight_ms"))


@query(f"with {EV_SQL} select event_id, ts_ms as from_digits, ts_ms // 1000 * 1000 as from_clock, ts_ms // 1000 * 1000 - 28800000 as from_zone from ev")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of three kinds back to milliseconds."""
    e = domain.events(spark, sf_dir)
    clock = times.local_text(F.col("ts_ms"), F.lit("UTC"))
    offset = F.concat(F.replace(clock, F.lit(" "), F.lit("T")), F.lit("+00:00"))
    return e.select("event_id", times.parse_time(F.col("ts_ms").cast("string"), F.lit("UTC")).alias("from_digits"), times.parse_time(offset, F.lit("Asia/Shanghai")).alias("from_clock"), times.parse_time(clock, F.lit("Asia/Shanghai")).alias("from_zone"))


# Rollups

_DAILY = f"""{BEHAVIOR_SQL}, b as (
  select *, ts_end - ts_start as ms, (ts_start >= day_ts - 7200000 and ts_start < day_ts + 21600000) as night,
    case when confidence < 0.65 then 1.0 when confidence < 0.85 then 1.5 else 2.5 end
    * case when ts_end - ts_start < 3000 then 0.0 when ts_end - ts_start < 10000 then 1.0 when ts_end - ts_start < 30000 then 1.5 else 2.0 end as weight from behavior
), daily as (
  select device_id, day_ts, count(*) filter (where behavior = 3) as scratch_count, cast(coalesce(sum(ms) filter (where behavior = 3), 0) as bigint) as scratch_ms,
    coalesce(cast(floor(sum(ms) filter (where behavior = 3) / count(*) filter (where behavior = 3)) as bigint), 0) as scratch_avg_ms,
    coalesce(max(ms) filter (where behavior = 3), 0) as scratch_max_ms, count(*) filter (where behavior = 3 and night) as night_scratch_count,
    count(*) filter (where behavior = 2 and night) as night_sleep_segments, coalesce(sum(weight) filter (where behavior = 3), 0.0) as wpeb_score,
    cast(floor(coalesce(sum(ms) filter (where behavior <> 4), 0) / 60000) as integer) as wear_minutes, cast(floor(coalesce(sum(ms) filter (where behavior = 2), 0) / 60000) as integer) as sleep_min,
    cast(floor(coalesce(sum(ms) filter (where behavior = 1), 0) / 60000) as integer) as move_min, cast(floor(coalesce(sum(ms) filter (where behavior = 3), 0) / 60000) as integer) as scratch_min
  from b group by 1, 2)"""


@query(f"with {_DAILY} select * replace (cast(wpeb_score as double) as wpeb_score) from daily")
def day_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a day of a device comes to."""
    return rollup.daily(domain.behavior(spark, sf_dir))


@query(f"with {_DAILY} select device_id, day_ts, cast(wear_minutes as bigint) as wear_minutes from daily")
def wear_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.wear_minutes(domain.behavior(spark, sf_dir))


@query(f"with {_DAILY} select device_id, day_ts, night_scratch_count, night_sleep_segments from daily")
def night_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.night_report(domain.behavior(spark, sf_dir))


@query(f"""with {_DAILY}, r as (
  select *, case when wear_minutes > 0 then round_even(sleep_min / wear_minutes, 3) end as sleep_ratio, case when wear_minutes > 0 then round_even(move_min / wear_minutes, 3) end as active_ratio from daily)
select device_id, day_ts, sleep_ratio, active_ratio, greatest(0, 1440 - wear_minutes) as off_min,
  case when wear_minutes < 120 or coalesce(sleep_ratio, 0) >= 0.25 then 0 when coalesce(sleep_ratio, 0) >= 0.10 then 1 else 2 end as sleep_status,
  case when wear_minutes < 120 or coalesce(active_ratio, 0) between 0.15 and 0.65 then 0 when (coalesce(active_ratio, 0) >= 0.05 and coalesce(active_ratio, 0) < 0.15) or (active_ratio > 0.65 and active_ratio <= 0.80) then 1 else 2 end as move_status,
  case when scratch_count = 0 then 0 when scratch_count = 1 then 1 else 2 end as scratch_status from r""")
def daily_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of worn time and traffic lights; the count stands in for the alert level."""
    d = rollup.daily(domain.behavior(spark, sf_dir)).withColumn("loose_min", F.lit(0))
    return rollup.summary(d, "scratch_count").select(*KEYS, "sleep_ratio", "active_ratio", "off_min", "sleep_status", "move_status", "scratch_status")


@query(f"with {READINGS_SQL} select device_id, day_ts, round_even(avg(env_temp), 2) as env_temp, round_even(avg(env_humidity), 1) as env_humidity, round_even(avg(neck_temp), 2) as neck_temp from readings group by 1, 2")
def env_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.environment(domain.readings(spark, sf_dir))


@query(f"with {BEHAVIOR_SQL} select behavior, count(*) as n, min(confidence) as min_conf, max(confidence) as max_conf, min((ts_end - ts_start) / 1000.0) as min_sec, max((ts_end - ts_start) / 1000.0) as max_sec, round(sum(ts_end - ts_start) / 1000.0, 3) as total_sec from behavior group by 1")
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.profile(domain.behavior(spark, sf_dir)).withColumn("total_sec", F.round("total_sec", 3))


@query("select c_mktsegment, count(distinct c_nationkey) as n_nations, string_agg(distinct cast(c_nationkey as varchar), ',' order by cast(c_nationkey as varchar)) as nations, min(c_acctbal) as low, max(c_acctbal) as high from customer group by 1")
def distinct_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.table(spark, sf_dir, "customer")
    nations = F.array_join(F.sort_array(F.collect_set(F.col("c_nationkey").cast("string"))), ",")
    return c.groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("n_nations"), nations.alias("nations"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("select coalesce(nullif(o_orderpriority, '5-LOW'), '(NULL)') as status, count(*) as n from orders group by 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.table(spark, sf_dir, "orders")
    return o.groupBy(F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("(NULL)")).alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(f"""with {EV_SQL}, q as (
  select event_type, quantile_cont(value, 0.5) as acc_median, quantile_cont(value, 0.05) as acc_p5, quantile_cont(value, 0.95) as acc_p95, quantile_cont(value * 2, 0.5) as gyro_median, quantile_cont(value * 2, 0.95) as gyro_p95, max(value * 2) as gyro_max from ev group by 1)
select event_type, round(acc_median, 6) as acc_median, round(acc_p5, 6) as acc_p5, round(acc_p95, 6) as acc_p95, round(gyro_median, 6) as gyro_median, round(gyro_p95, 6) as gyro_p95, gyro_max,
  case when acc_median between 7.0 and 12.5 then 'ms2' when acc_median between 0.7 and 1.3 then 'g' end as unit,
  case when acc_median between 7.0 and 12.5 then 'agrees' when acc_median between 0.7 and 1.3 then 'differs' else 'unknown' end as verdict from q""")
def magnitude_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = units.diagnosis(domain.events(spark, sf_dir), "event_type", F.col("value"), F.col("value") * 2)
    return d.select("event_type", *map(R6, ("acc_median", "acc_p5", "acc_p95", "gyro_median", "gyro_p95")), "gyro_max", "unit", "verdict")


# Assessment


def _baseline(daily: DataFrame) -> DataFrame:
    """From the days before SPLIT, three at least."""
    taught = daily.where(F.col("day_ts") < SPLIT).groupBy("device_id").agg(F.round(F.avg("scratch_count"), 2).alias("baseline_mean"), F.round(F.stddev_pop("scratch_count"), 2).alias("baseline_std"), F.round(F.avg("wpeb_score"), 4).alias("wpeb_mean"), F.round(F.stddev_pop("wpeb_score"), 4).alias("wpeb_std"), (F.count("*") * 4).alias("valid_days"))
    return taught.where("valid_days >= 3").withColumn("temp_coef", F.lit(1.0))


#: The test stream is thin: a day that has been worn for an hour counts here.
LIMITS = scores.Thresholds(z=(0.5, 0.4, 0.3), min_wear_minutes=60, std_floor=0.5, reference_temperature=38.0)


def _with_baseline(daily: DataFrame) -> DataFrame:
    """The days from SPLIT on with the columns that _baseline() has, of one pass over daily: windows by device, of a row a day."""
    device = Window.partitionBy("device_id")
    early = lambda c: F.when(F.col("day_ts") < SPLIT, F.col(c))
    days = F.count(early("day_ts")).over(device) * 4
    known = {"baseline_mean": F.round(F.avg(early("scratch_count")).over(device), 2), "baseline_std": F.round(F.stddev_pop(early("scratch_count")).over(device), 2), "wpeb_mean": F.round(F.avg(early("wpeb_score")).over(device), 4), "wpeb_std": F.round(F.stddev_pop(early("wpeb_score")).over(device), 4), "valid_days": days, "temp_coef": F.lit(1.0)}
    return daily.withColumns({c: F.when(days >= 3, x) for c, x in known.items()}).where(F.col("day_ts") >= SPLIT)


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = rollup.daily(domain.behavior(spark, sf_dir))
    environment = rollup.environment(domain.readings(spark, sf_dir))
    return assessment.assess(_with_baseline(daily), None, environment, limits=LIMITS)


_TAUGHT = f"""{_DAILY}, base as (
  select device_id, round(avg(scratch_count), 2) as baseline_mean, round(stddev_pop(scratch_count), 2) as baseline_std, round(avg(wpeb_score), 4) as wpeb_mean, round(stddev_pop(wpeb_score), 4) as wpeb_std, count(*) * 4 as valid_days, cast(1.0 as double) as temp_coef
  from daily where day_ts < {SPLIT} group by 1 having count(*) * 4 >= 3
), {READINGS_SQL.replace(EV_SQL + ", ", "")}, env as (select device_id, day_ts, round_even(avg(env_temp), 2) as env_temp, round_even(avg(env_humidity), 1) as env_humidity, round_even(avg(neck_temp), 2) as neck_temp from readings group by 1, 2)"""
_Z = f"""{_TAUGHT}, q as (
  select d.*, b.* exclude (device_id), e.* exclude (device_id, day_ts), case when wear_minutes < 60 then 1 else 0 end as data_quality,
    case when baseline_mean is null then 0 when valid_days < 3 then 0 when valid_days < 14 then 1 when valid_days < 30 then 2 else 3 end as eval_phase,
    case when neck_temp is null then 0.0 else round_even(temp_coef * (neck_temp - 38.0), 2) end as temp_effect
  from daily d left join base b using (device_id) left join env e using (device_id, day_ts) where d.day_ts >= {SPLIT}
), z as (
  select *, case when data_quality = 0 and eval_phase >= 1 then round_even((scratch_count - baseline_mean - temp_effect) / greatest(baseline_std, 0.5), 3) + 0.0 end as zscore,
    case eval_phase when 1 then 0.5 when 2 then 0.4 when 3 then 0.3 end as threshold_z from q
), y as (
  select *, coalesce(zscore > threshold_z, false) as is_abnormal, cast(sign(zscore) as bigint) * ((abs(cast(round(zscore * 1000) as bigint)) + 5) // 10) as kept_z from z
), x as (
  select *, sum(case when zscore is not null and not is_abnormal then 1 else 0 end) over (partition by device_id order by day_ts) as grp from y
), s as (
  select *, case when zscore is not null then sum(case when zscore is not null and is_abnormal then 1 else 0 end) over (partition by device_id, grp order by day_ts) end as streak from x
), t as (
  select *, coalesce(streak, last_value(streak ignore nulls) over (partition by device_id order by day_ts rows between unbounded preceding and 1 preceding), 0) as consec_abnormal from s
), v as (
  select device_id, day_ts, zscore, eval_phase, sum(kept_z) over a as s4, count(*) over a as n4, sum(kept_z) over b as s3, count(*) over b as n3, sum(kept_z) over c as s2, count(*) over c as n2 from y where zscore is not null
  window a as (partition by device_id order by day_ts rows between 4 preceding and 1 preceding), b as (partition by device_id order by day_ts rows between 3 preceding and 1 preceding), c as (partition by device_id order by day_ts rows between 2 preceding and 1 preceding)
), m as (
  -- half to even on the decimal that the number is written as
  select device_id, day_ts, cast(case when t - floor(t) > 0.5 or t - floor(t) = 0.5 and floor(t) % 2 <> 0 then floor(t) + 1 else floor(t) end as double) / 1000 + 0.0 as avg_zscore from (
    select device_id, day_ts, cast(cast(case eval_phase when 1 then (coalesce(s4, 0) / 100.0 + zscore) / (n4 + 1) when 2 then (coalesce(s3, 0) / 100.0 + zscore) / (n3 + 1) when 3 then (coalesce(s2, 0) / 100.0 + zscore) / (n2 + 1) end as varchar) as decimal(30,18)) * 1000 as t from v)
), alerts as (
  select t.*, avg_zscore, case when is_abnormal then case when consec_abnormal >= 5 then 3 when consec_abnormal >= 3 then 2 when consec_abnormal >= 2 then 1 else 0 end else 0 end as alert_level from t left join m using (device_id, day_ts))"""


@query(f"with {_Z} select device_id, day_ts, data_quality, eval_phase, temp_effect, zscore, is_abnormal from z join (select device_id, day_ts, is_abnormal from y) using (device_id, day_ts)")
def zscore_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select(*KEYS, "data_quality", "eval_phase", "temp_effect", "zscore", "is_abnormal")


@query(f"with {_Z} select device_id, day_ts, consec_abnormal, alert_level from alerts")
def streak_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select(*KEYS, "consec_abnormal", "alert_level")


@query(f"with {_Z} select device_id, day_ts, avg_zscore from m")
def trailing_avg_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).where("zscore is not null").select(*KEYS, "avg_zscore")


_SCORED = f"""{_Z}, p as (
  select *, case when zscore is null or zscore <= 0 then 0.0 else least(zscore / 4 * 25, 25.0) end as s1_score,
    case when (wpeb_score - coalesce(wpeb_mean, wpeb_score)) / greatest(coalesce(wpeb_std, 1.0), 1.0) <= 0 then 0.0 else least((wpeb_score - coalesce(wpeb_mean, wpeb_score)) / greatest(coalesce(wpeb_std, 1.0), 1.0) / 4 * 25, 25.0) end as s2_score,
    case when night_scratch_count = 0 then 0 when night_scratch_count <= 2 then 5 when night_scratch_count <= 5 then 9 else 12 end + case when night_sleep_segments <= 1 then 0 when night_sleep_segments <= 3 then 3 else 8 end as s3_score,
    case when neck_temp is null or neck_temp < 38 then 0 when neck_temp < 39.2 then 2 when neck_temp <= 39.7 then 6 else 10 end as s4_score,
    greatest(-5, least(5, case when env_temp > 30 then -2 when env_temp < 10 then 1 else 0 end + case when env_humidity < 40 then 2 when env_humidity > 80 then -1 else 0 end)) as s6_score from alerts
), tot as (select *, greatest(0.0, least(100.0, s1_score + s2_score + s3_score + s4_score + s6_score)) as total_score from p)"""


@query(f"with {_SCORED} select device_id, day_ts, round(s1_score, 6) as s1_score, round(s2_score, 6) as s2_score, cast(s3_score as double) as s3_score, cast(s4_score as double) as s4_score, cast(s6_score as double) as s6_score, round(total_score, 6) as total_score, cast(least(floor(total_score / 10), 10) as integer) as health_level from tot")
def score_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assessed(spark, sf_dir)
    return a.select(*KEYS, R6("s1_score"), R6("s2_score"), "s3_score", "s4_score", "s6_score", R6("total_score"), "health_level")


@query(f"with {_SCORED} select device_id, day_ts, scratch_count, wear_minutes, data_quality, eval_phase, zscore, consec_abnormal, alert_level, round(total_score, 6) as total_score, cast(least(floor(total_score / 10), 10) as integer) as health_level from tot")
def daily_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to intervals, days, z-scores, streaks, alerts and scores, all devices in one plan."""
    a = _assessed(spark, sf_dir)
    return a.select(*KEYS, "scratch_count", "wear_minutes", "data_quality", "eval_phase", "zscore", "consec_abnormal", "alert_level", R6("total_score"), "health_level")


@query(f"with {_SCORED} select device_id, max(day_ts) as day_ts, arg_max(health_level, day_ts) as health_level, arg_max(baseline_mean, day_ts) as baseline_mean from (select *, cast(least(floor(total_score / 10), 10) as integer) as health_level from tot) group by 1")
def report_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last assessed day of each device with its baseline."""
    a = _assessed(spark, sf_dir)
    return a.groupBy("device_id").agg(F.max("day_ts").alias("day_ts"), F.max_by("health_level", "day_ts").alias("health_level"), F.max_by("baseline_mean", "day_ts").alias("baseline_mean"))


@query(f"""with {_DAILY} select device_id, day_ts, lag(scratch_count) over w as prior_any, last_value(case when wear_minutes >= 60 then scratch_count end ignore nulls) over (partition by device_id order by day_ts rows between unbounded preceding and 1 preceding) as prior_valid
from daily window w as (partition by device_id order by day_ts)""")
def prior_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rollup.daily(domain.behavior(spark, sf_dir))
    return assessment.prior_values(d, "scratch_count", F.col("wear_minutes") >= 60).select(*KEYS, "prior_any", "prior_valid")


# Baselines


@query(f"""with recursive {_Z}, r as (
  select device_id, scratch_count, coalesce(zscore, 0) as z, wpeb_score, row_number() over (partition by device_id order by day_ts) as k, row_number() over (partition by device_id order by day_ts desc) as back from z where data_quality = 0
), l as (select device_id, scratch_count, z, wpeb_score, row_number() over (partition by device_id order by k) as k from r where back <= 30
), f as (
  select device_id, cast(baseline_mean as double) as m, cast(wpeb_mean as double) as w, cast(valid_days as bigint) as n, 0 as k from base
  union all
  select f.device_id, (1 - a) * m + a * scratch_count, (1 - a) * w + a * wpeb_score, n + case when a > 0 then 1 else 0 end, f.k + 1
  from f join (select *, case when abs(z) < 1 then 0.10 when abs(z) < 2 then 0.03 else 0.0 end as a from l) l on l.device_id = f.device_id and l.k = f.k + 1
) select device_id, round(arg_max(m, k), 6) as baseline_mean, round(arg_max(w, k), 6) as wpeb_mean, arg_max(n, k) as valid_days, round(least(arg_max(n, k) / 30.0, 1.0), 6) as confidence from f group by 1""")
def ewma_soft_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines after the assessed days have been learnt."""
    state = _baseline(rollup.daily(domain.behavior(spark, sf_dir))).select("device_id", "baseline_mean", "wpeb_mean", "valid_days")
    learnt = assessment.ewma(assessment.last_valid(_assessed(spark, sf_dir)), state, LIMITS)
    return learnt.select("device_id", R6("baseline_mean"), R6("wpeb_mean"), F.col("valid_days").cast("long").alias("valid_days"), R6("confidence"))


@query(f"""with {_Z} select device_id, case when count(*) >= 3 then round(greatest(stddev_pop(scratch_count), 0.5), 6) end as baseline_std, case when count(*) >= 3 then round(greatest(stddev_pop(wpeb_score), 1.0), 6) end as wpeb_std from z where data_quality = 0 and abs(coalesce(zscore, 0)) < 2 group by 1""")
def normal_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.spread(_assessed(spark, sf_dir).where("data_quality = 0"), LIMITS).select("device_id", R6("baseline_std"), R6("wpeb_std"))


@query(f"""with {_Z} select device_id, count(*) as n_pairs, case when count(*) >= 5 then round(greatest(0.0, least(0.4, case when min(neck_temp) = max(neck_temp) then 0.0 else regr_slope(scratch_count, neck_temp) end)), 6) end as temp_coef from z where neck_temp is not null group by 1""")
def temp_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.temperature_slope(_assessed(spark, sf_dir), 5).select("device_id", "n_pairs", R6("temp_coef"))


@query(f"with {_DAILY} select device_id, day_ts from (select *, row_number() over (partition by device_id order by day_ts desc) as k from daily where wear_minutes >= 60) where k <= 5")
def last_valid_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rollup.daily(domain.behavior(spark, sf_dir)).withColumn("data_quality", F.when(F.col("wear_minutes") >= 60, 0).otherwise(1))
    return assessment.last_valid(d, 5).select(*KEYS)


# Keyed writes: orders of even keys are the table, the others and a part of the table's keys the batch.


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = domain.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device_id"), "o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("created"))
    rank = F.row_number().over(Window.partitionBy("device_id").orderBy("o_orderkey"))
    table = o.where("o_orderkey % 2 = 0").withColumn("_k", rank).where("_k = 1").drop("_k")
    return table, o.where("o_orderkey % 2 = 1")


_TABLES = """o as (select o_custkey as device_id, o_orderkey, o_totalprice as price, case when o_orderstatus <> 'F' then o_orderstatus end as status, o_orderpriority as created from orders),
tab as (select * exclude (k) from (select *, row_number() over (partition by device_id order by o_orderkey) as k from o where o_orderkey % 2 = 0) where k = 1), batch as (select * from o where o_orderkey % 2 = 1),
first as (select * exclude (k) from (select *, row_number() over (partition by device_id order by o_orderkey) as k from batch) where k = 1),
last as (select * exclude (k) from (select *, row_number() over (partition by device_id order by o_orderkey desc) as k from batch) where k = 1)"""


@query(f"with {_TABLES} select * from tab union all select * from first where device_id not in (select device_id from tab)")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, batch = _tables(spark, sf_dir)
    return upserts.first_wins(table, batch, ("device_id",), [F.col("o_orderkey")])


@query(f"with {_TABLES} select coalesce(l.device_id, t.device_id) as device_id, case when l.device_id is not null then l.o_orderkey else t.o_orderkey end as o_orderkey, case when l.device_id is not null then l.price else t.price end as price, case when l.device_id is not null then l.status else t.status end as status, case when t.device_id is not null then t.created else l.created end as created from tab t full join last l on t.device_id = l.device_id")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, batch = _tables(spark, sf_dir)
    return upserts.upsert(table, batch, ("device_id",), [F.desc("o_orderkey")], keep=("created",))


@query(f"with {_TABLES} select coalesce(l.device_id, t.device_id) as device_id, case when l.device_id is not null then l.o_orderkey else t.o_orderkey end as o_orderkey, case when l.device_id is not null then l.price else t.price end as price, coalesce(l.status, t.status) as status, case when l.device_id is not null then l.created else t.created end as created from tab t full join last l on t.device_id = l.device_id")
def coalesce_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, batch = _tables(spark, sf_dir)
    return upserts.upsert(table, batch, ("device_id",), [F.desc("o_orderkey")], coalesce=("status",))


# Lookups


@query("""select o_orderkey as bind_id, c_custkey as device_id, c_name as device_sn, coalesce(nullif(case when n_nationkey % 3 = 0 then '' else n_name end, ''), 'UTC') as timezone
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'O'""")
def active_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: domain.table(spark, sf_dir, name)
    devices = t("customer").select(F.col("c_custkey").alias("device_id"), F.col("c_name").alias("device_sn"), F.col("c_nationkey").alias("user_id"))
    bindings = t("orders").select(F.col("o_orderkey").alias("bind_id"), F.col("o_custkey").alias("device_id"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("bind_status"))
    users = lookups.bounded(t("nation").select(F.col("n_nationkey").alias("user_id"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("timezone")))
    return lookups.active_bindings(bindings, devices, users).select("bind_id", "device_id", "device_sn", "timezone")


@query("""select event_id, c_custkey as device_id, coalesce(case when event_id % 4 = 0 then 'given' end, o_orderpriority) as priority, coalesce(case when event_id % 4 = 0 then -1 end, o_orderkey) as bind_id
from (select event_id, user_id as c_custkey from events) e left join (select * from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) where k = 1) o on e.c_custkey = o.o_custkey""")
def enrich_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields from the first binding of a device."""
    given = F.col("event_id") % 4 == 0
    rows = domain.events(spark, sf_dir).select("event_id", "device_id", F.when(given, "given").alias("priority"), F.when(given, F.lit(-1)).cast("long").alias("bind_id"))
    o = domain.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("bind_id"))
    return lookups.enrich(rows, o, "device_id", [F.col("bind_id")], ("priority", "bind_id"))


_RULES = (("RED", 1), ("small ring", 2), ("ring", 3), ("widget", 4), ("g", 5), ("WIDGET", 6), ("ed wid", 7))


@query("select p_partkey, p_name, rule_no from (select p_partkey, p_name, rule_no, row_number() over (partition by p_partkey order by length(m) desc, rule_no) as k from part join (values " + ", ".join(f"('{m}', {n})" for m, n in _RULES) + ") r(m, rule_no) on contains(lower(p_name), lower(m))) where k = 1")
def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(_RULES), "match string, rule_no int")
    return lookups.longest_match(domain.table(spark, sf_dir, "part").select("p_partkey", "p_name"), rules, "p_name", ("p_partkey",)).select("p_partkey", "p_name", "rule_no")


# Metrics


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = domain.table(spark, sf_dir, "labels").join(domain.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.confusion(joined.select(F.col("quality").alias("true_class"), (F.col("n_chars") > 600).cast("int").alias("pred_class")))


_COUNTS = "c as (select quality as true_class, case when n_chars > 600 then 1 else 0 end as pred_class, count(*) as n from labels join documents using (doc_id) group by 1, 2)"
_PRF = """m as (select class, coalesce(sum(n) filter (where true_class = pred_class and true_class = class), 0) as hit, coalesce(sum(n) filter (where true_class = class), 0) as support, coalesce(sum(n) filter (where pred_class = class), 0) as predicted
  from c, (select true_class as class from c union select pred_class from c) group by class
), pr as (select class, case when predicted > 0 then hit / predicted else 0 end as precision, case when support > 0 then hit / support else 0 end as recall, support from m)"""


@query(f"with {_COUNTS} select * from c")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"with {_COUNTS}, {_PRF} select class, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1, cast(support as bigint) as support from pr")
def prf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_class(_counts(spark, sf_dir)).select("class", R6("precision"), R6("recall"), R6("f1"), "support")


@query("select p_brand as feature, round(sum(p_retailprice), 2) as importance from part group by 1 order by 2 desc, 1 limit 10")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance = domain.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.sum("p_retailprice"), 2).alias("importance"))
    return metrics.top_features(importance, 10)


# Signals: an embedding of 64 numbers is a window of one channel, its parts are axes.


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return domain.table(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("x"), F.slice(x, 1, 22).alias("a"), F.slice(x, 22, 22).alias("b"), F.slice(x, 43, 22).alias("c"))


_VEC = "e as (select vec_id, label, i, cast(embedding[i] as double) as x from (select *, unnest(range(1, 65)) as i from embeddings))"


@query(f"""with {_VEC}, m as (select vec_id, avg(x) as m, stddev_pop(x) as s from e group by 1), g as (
  select *, sign(x - m) as sg from e join m using (vec_id)), c as (
  select vec_id, sum(case when sg <> p then 1 else 0 end) as crossings, sum(case when i > 1 and i < 64 and x > bx and x > ax then 1 else 0 end) as peaks from (select *, lag(sg) over w as p, lag(x) over w as bx, lead(x) over w as ax from g window w as (partition by vec_id order by i)) group by 1)
select vec_id, round(any_value(m), 6) as mean, round(any_value(s), 6) as std, min(x) as low, max(x) as high, round(sqrt(avg(x * x)), 6) as rms, round(avg(pow(x - m, 3)) / pow(any_value(s), 3), 5) as skew,
  round(avg(pow(x - m, 4)) / pow(any_value(s), 4) - 3, 5) as kurtosis, cast(any_value(crossings) as integer) as crossings, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) as iqr, cast(any_value(peaks) as integer) as peaks
from g join c using (vec_id) group by 1""")
def time_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each signal over time."""
    s = arrays.time_stats(F.col("x"))
    r = lambda k, n=6: F.round(s[k], n).alias(k)
    return _vectors(spark, sf_dir).select("vec_id", r("mean"), r("std"), s["min"].alias("low"), s["max"].alias("high"), r("rms"), r("skew", 5), r("kurtosis", 5), s["crossings"].alias("crossings"), r("iqr"), s["peaks"].alias("peaks"))


@query(f"""with {_VEC}, p as (select a.vec_id, a.x as a, b.x as b, c.x as c from e a join e b on a.vec_id = b.vec_id and b.i = a.i + 21 join e c on a.vec_id = c.vec_id and c.i = a.i + 42 where a.i <= 22)
select vec_id, round(coalesce(corr(a, b), 0), 6) as corr_ab, round(coalesce(corr(b, c), 0), 6) as corr_bc, round(avg(abs(a) + abs(b) + abs(c)), 6) as sma, round(avg(sqrt(a * a + b * b + c * c)), 6) as mean_size from p group by 1""")
def cross_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations between axes, signal area and size."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = lambda x, name: F.round(x, 6).alias(name)
    return _vectors(spark, sf_dir).select("vec_id", r(arrays.pearson(a, b), "corr_ab"), r(arrays.pearson(b, c), "corr_bc"), r(arrays.signal_area(a, b, c), "sma"), r(arrays.mean(arrays.magnitude(a, b, c)), "mean_size"))


@query(f"""with {_VEC}, j as (select vec_id, (x - lag(x) over (partition by vec_id order by i)) * 16 as j from e) select vec_id, round(avg(j), 6) as mean, round(stddev_pop(j), 6) as std, round(max(j), 6) as high from j where j is not null group by 1""")
def jerk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = arrays.jerk(F.col("x"), 16.0)
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.mean(j), 6).alias("mean"), F.round(arrays.std(j), 6).alias("std"), F.round(F.array_max(j), 6).alias("high"))


@query(f"""with {_VEC}, t as (select vec_id, i, x, lead(x) over w as y, lead(x, 2) over w as z from e window w as (partition by vec_id order by i)) select vec_id, i as sample, round(atan2(-x, sqrt(y * y + z * z)), 6) as pitch, round(atan2(y, z), 6) as roll from t where z is not null""")
def raw_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch and roll of every three numbers in a row."""
    each = _vectors(spark, sf_dir).select("vec_id", "x", F.explode(F.sequence(F.lit(1), F.size("x") - 2)).alias("sample"))
    x, y, z = (F.element_at("x", F.col("sample") + k) for k in range(3))
    return each.select("vec_id", "sample", F.round(arrays.pitch(x, y, z), 6).alias("pitch"), F.round(arrays.roll(y, z), 6).alias("roll"))


@query(f"with {_VEC} select a.vec_id, a.i as place, round(a.x * 9.80665, 6) as ax, round(a.x * 57.29577951308232, 5) as gx, b.x as mirrored from e a join e b on b.vec_id = a.vec_id and b.i = 65 - a.i")
def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers in other units, and beside them chosen ones: all of them, from the last on."""
    chosen = arrays.choose(F.col("x"), list(range(63, -1, -1)), 64)
    v = _vectors(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(F.col("x"), chosen.alias("f"))).alias("k", "v")).select("vec_id", (F.col("k") + 1).alias("place"), F.col("v.x").alias("ax"), F.col("v.x").alias("gx"), F.col("v.f").alias("mirrored"))
    scaled = units.scale(v, "g", "rads", ("ax",), ("gx",))
    return scaled.select("vec_id", "place", R6("ax"), F.round("gx", 5).alias("gx"), "mirrored")


@query(f"""with {domain.WINDOWS_SQL} select device_id, stretch, label, count(*) as n from win group by 1, 2, 3 union all select device_id, stretch, 'all', count(*) from win group by 1, 2""")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by label, and of all labels: two lists joined to one."""
    w = domain.windows(spark, sf_dir)
    each = w.groupBy(*domain.SEQ, "label").agg(F.count("*").alias("n"))
    return each.unionByName(w.groupBy(*domain.SEQ).agg(F.count("*").alias("n")).withColumn("label", F.lit("all")))
