"""The test tables as sensor data: users are devices, event types behaviours, values confidences and temperatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, times
from ..operators import islands

HOUR_MS = 3_600_000
#: Sequences of windows are a device's ten days here, as a day has few events.
STRETCH_MS = 10 * times.DAY_MS
CODES = {"signup": 0, "click": 1, "view": 2, "error": 3, "purchase": 4}
CLASSES = ("scratch", "active", "sleep", "shake")
CLASS_OF = {"error": "scratch", "click": "active", "purchase": "active", "view": "sleep", "signup": "shake"}
SEQ = ("device_id", "stretch")
#: Zones as users write them, and what they mean in names that any database knows.
ZONES = {
    "UTC": "UTC", "EST": "America/New_York", "CST": "America/New_York", "Asia/Shanghai": "Asia/Shanghai", "+05:30": "Asia/Kolkata", "PDT": "America/Los_Angeles", "nonsense": "UTC", "": "UTC",
    "Foo/Bar": "UTC", "America/NewYork": "UTC", "america/new_york": "UTC", "ASIA/CHONGQING": "Asia/Shanghai", "PRC": "Asia/Shanghai", "China": "Asia/Shanghai", "beijing": "Asia/Shanghai",
    "Japan": "Asia/Tokyo", "Singapore": "Asia/Singapore", "EST5EDT": "America/New_York", "CST-8": "Etc/GMT+8", "UTC + 8": "Etc/GMT-8", " gmt+5:45 ": "Asia/Kathmandu", "+15:00": "UTC", "MDT": "America/Denver", "Etc/GMT-3": "Etc/GMT-3",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with their zones, resolved once each: customers are their owners, by the same numbers."""
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"))
    return d.withColumn("zone", times.resolve_zone(zone_of(F.col("device_id"))))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by device; day_ts is the midnight at which the day of the device's zone began. Spark broadcasts the devices as long as their size allows."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "device_id").join(devices(spark, sf_dir), "device_id", "left")
    ts = times.millis(F.col("ts"))
    zone = F.coalesce("zone", F.lit(times.DEFAULT_ZONE))
    return e.select("event_id", "device_id", ts.alias("ts_ms"), times.local_midnight(ts, zone).alias("day_ts"), (ts - F.pmod(ts, F.lit(STRETCH_MS))).alias("stretch"), "event_type", "value", "props")


def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from each event to the next one of the day, an hour at most."""
    e = events(spark, sf_dir)
    following = F.lead("ts_ms").over(islands.ordered(("device_id", "day_ts"), ("ts_ms", "event_id")))
    cap = F.col("ts_ms") + HOUR_MS
    code = labels.code_of(F.col("event_type"), CODES)
    return e.select("device_id", "day_ts", "event_id", F.col("ts_ms").alias("ts_start"), F.least(F.coalesce(following, cap), cap).alias("ts_end"), code.alias("behavior"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))


def windows(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Windows a second apart, in the order of events: idx, ts_ms, label, probs by CLASSES. tasks: how many share the sequences."""
    e = events(spark, sf_dir)
    e = e.repartition(tasks, *SEQ) if tasks else e
    idx = F.row_number().over(islands.ordered(SEQ, ("ts_ms", "event_id"))) - 1
    label = F.try_element_at(labels.literal_map(CLASS_OF), F.col("event_type"))
    sure = 0.25 + 0.75 * (F.col("value") - F.floor("value"))
    rest = (1 - sure) / (len(CLASSES) - 1)
    probs = F.array(*[F.when(label == c, sure).otherwise(rest) for c in CLASSES])
    missing = F.when(F.col("value") < 10, F.lit(0.75)).otherwise(0.0)
    return e.select(*SEQ, "event_id", idx.alias("idx"), (F.col("stretch") + idx * 1000).alias("ts_ms"), label.alias("label"), labels.code_of(F.col("event_type"), CODES).alias("code"), probs.alias("probs"), F.col("value"), missing.alias("missing"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment readings, a part of them null."""
    e = events(spark, sf_dir)
    # Whole numbers, so that sums are exact in whatever order.
    value = lambda kinds, part, base: F.when(F.col("event_type").isin(*kinds), base + F.floor(F.col("value") / part))
    return e.select("device_id", "day_ts", "ts_ms", value(("click", "view"), 8, 10.0).alias("env_temp"), value(("view", "error"), 4, 30.0).alias("env_humidity"), value(("error", "purchase"), 64, 37.0).alias("neck_temp"))


def zone_of(device: Column) -> Column:
    """A zone name for each device, some in need of resolving."""
    return F.element_at(F.array(*map(F.lit, ZONES)), (F.pmod(device, F.lit(len(ZONES))) + 1).cast("int"))


ZONE_SQL = "case device_id % " + str(len(ZONES)) + " " + " ".join(f"when {k} then '{zone}'" for k, zone in enumerate(ZONES.values())) + " end"
EV_SQL = f"""ev as (
  select *, epoch_ms(timezone('UTC', timezone(zone, date_trunc('day', timezone(zone, timezone('UTC', make_timestamp(ts_ms * 1000))))))) as day_ts from (
    select *, {ZONE_SQL} as zone from (
      select event_id, user_id as device_id, epoch_us(ts) // 1000 as ts_ms, epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % {STRETCH_MS} as stretch, event_type, value, props,
        case event_type when 'click' then 1 when 'view' then 2 when 'error' then 3 when 'purchase' then 4 else 0 end as code
      from events)))"""
BEHAVIOR_SQL = f"""{EV_SQL}, behavior as (
  select device_id, day_ts, event_id, ts_ms as ts_start, code as behavior, least(value / 100, 1.0) as confidence,
    least(coalesce(lead(ts_ms) over (partition by device_id, day_ts order by ts_ms, event_id), ts_ms + {HOUR_MS}), ts_ms + {HOUR_MS}) as ts_end
  from ev)"""
WINDOWS_SQL = f"""{EV_SQL}, w0 as (
  select device_id, stretch, event_id, code, value, row_number() over (partition by device_id, stretch order by ts_ms, event_id) - 1 as idx,
    case event_type when 'error' then 'scratch' when 'view' then 'sleep' when 'signup' then 'shake' else 'active' end as label,
    0.25 + 0.75 * (value - floor(value)) as sure, case when value < 10 then 0.75 else 0.0 end as missing
  from ev), win as (
  select device_id, stretch, event_id, code, value, idx, stretch + idx * 1000 as ts_ms, label, missing,
    case when label = 'scratch' then sure else (1 - sure) / 3 end as p_scratch, case when label = 'active' then sure else (1 - sure) / 3 end as p_active,
    case when label = 'sleep' then sure else (1 - sure) / 3 end as p_sleep, case when label = 'shake' then sure else (1 - sure) / 3 end as p_shake
  from w0)"""
READINGS_SQL = f"""{EV_SQL}, readings as (
  select device_id, day_ts, ts_ms, case when event_type in ('click', 'view') then cast(10.0 as double) + floor(value / 8) end as env_temp,
    case when event_type in ('view', 'error') then cast(30.0 as double) + floor(value / 4) end as env_humidity,
    case when event_type in ('error', 'purchase') then cast(37.0 as double) + floor(value / 64) end as neck_temp
  from ev)"""
