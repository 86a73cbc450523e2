"""Sources of sensor readings and of windows that other tools have classified.

Filters are on the columns as they are stored, so they reach the scan, and only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from . import imports

IMU = ("device_sn", "ts_ms", "ax", "ay", "az", "gx", "gy", "gz")


def serial(column: Column) -> Column:
    return F.replace(column, F.lit(":"), F.lit("_"))


def after(df: DataFrame, marks: DataFrame, key: str, ts: str, mark: str = "last_processed_ts", devices: DataFrame | None = None) -> DataFrame:
    """Rows later than their device's mark; devices without a mark give all. Marks are a row a device, and are joined as their size allows.

    With devices (a row each of all that there are) the scan for devices with a mark begins at the earliest mark, which
    reaches the files' statistics and partitions; everything is scanned only where there are devices without one, for those.
    """
    marks = marks.select(key, mark).where(F.col(mark).isNotNull())
    if devices is None:
        joined = df.join(marks, key, "left")
        return joined.where(F.col(mark).isNull() | (F.col(ts) > F.col(mark))).drop(mark)
    new = devices.select(key).join(marks, key, "left_anti")
    low = marks.agg(F.min(mark)).first()[0]
    if low is None:
        return df.join(new, key, "left_semi")
    later = df.where(F.col(ts) > F.lit(low)).join(marks, key).where(F.col(ts) > F.col(mark)).select(*df.columns)
    return later if new.isEmpty() else later.unionByName(df.join(new, key, "left_semi").select(*df.columns))


def between(df: DataFrame, ts: str, begin: object, end: object) -> DataFrame:
    """Rows from begin on and before end."""
    return df.where((F.col(ts) >= F.lit(begin)) & (F.col(ts) < F.lit(end)))


def environment_after(df: DataFrame, marks: DataFrame, key: str = "device_sn", ts: str = "ts_ms") -> DataFrame:
    """Readings later than their device's mark as numbers; what is no number is null, and rows without any go."""
    names = ("env_temp", "env_humidity", "neck_temp")
    out = after(df, marks, key, ts, "last_env_ts").withColumns({c: F.col(c).try_cast("double") for c in names})
    return out.dropna("all", subset=list(names))


def devices(df: DataFrame, key: str = "device_sn") -> DataFrame:
    return df.select(key).distinct()


def span(df: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last time and number of rows of each device."""
    return df.groupBy(key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_rows"))


def charging(battery: DataFrame, key: str = "device_sn", ts: str = "ts_ms") -> DataFrame:
    """Whether each device charged when it last said so."""
    return battery.groupBy(key).agg((F.max_by("charging", ts) == 1).alias("charging"))


def inference_json(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Windows of all *_infer.json files under path: file, ts_ms, behavior, confidence.

    Unknown labels are left out, a missing confidence is 0. Files that are no JSON or have times that can't be read give
    no rows; imports.read_folder() tells which.
    """
    return imports.read_folder(spark, path, zone, csv=False).windows.drop("device_sn")


def windows_of(rows: DataFrame, zone: str = "UTC", errors: bool = False) -> DataFrame:
    """Rows with a struct w (ts, label, conf) as windows with codes; unknown labels are left out, a missing confidence is 0.

    A time that can't be read is an error: with errors it stays as a row with ts_ms null, else the job fails.
    """
    others = [c for c in rows.columns if c != "w"]
    at = times.parse_time(F.col("w.ts"), F.lit(zone))
    if not errors:
        at = F.when(at.isNull(), F.raise_error(F.concat(F.lit("no time: "), F.coalesce(F.col("w.ts"), F.lit("null")))).cast("long")).otherwise(at)
    out = rows.select(*others, "w", imports.imported_code(F.col("w.label")).alias("behavior")).where("behavior is not null")
    return out.select(*others, at.alias("ts_ms"), "behavior", F.coalesce(F.col("w.conf"), F.lit(0.0)).alias("confidence"))


def inference_csv(spark: SparkSession, path: str, zone: str = "UTC") -> tuple[str, DataFrame]:
    """("events" or "windows", rows) of CSV files of one kind. Folders with both kinds, or with files that can't be taken, are an error; imports.read_folder() takes those.

    Rows with an unknown label are left out; a missing confidence is 0, a missing serial is empty. Files without rows are windows, none.
    """
    found = imports.read_files(imports.csv_rows(spark, path, zone))
    problem = found.problems.first()
    if problem:
        raise ValueError(f"{problem['file']}: {problem['error']}")
    kinds = [k for k, df in (("events", found.events), ("windows", found.windows)) if not df.isEmpty()]
    if len(kinds) > 1:
        raise ValueError("both events and windows")
    kind = kinds[0] if kinds else "windows"
    return kind, getattr(found, kind).drop("file")


def kinds_of_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind) of the CSV files under path by their header: events, windows, or unknown."""
    names = F.transform(F.split("header", ","), F.trim)
    has = lambda *columns: F.size(F.array_intersect(names, F.array(*map(F.lit, columns)))) == len(columns)
    kind = F.when(has("start_ts", "end_ts"), "events").when(has("ts"), "windows").otherwise("unknown")
    return imports.csv_headers(spark, path).select(F.explode("files").alias("file"), kind.alias("kind"))


def feature_pool(spark: SparkSession, path: str) -> DataFrame:
    """label, label_int and features of CSV files with a column for each feature (feat_000 and so on, taken in the order of their names)."""
    raw = spark.read.option("header", "true").csv(path)
    names = sorted(c for c in raw.columns if c.startswith("feat_"))
    return raw.select("label", F.col("label_int").try_cast("int").alias("label_int"), F.array(*[F.col(c).try_cast("double") for c in names]).alias("features"))


def write_feature_pool(pool: DataFrame, path: str, length: int) -> None:
    """The same back to CSV files."""
    each = [F.col("features")[k].alias(f"feat_{k:03d}") for k in range(length)]
    pool.select("label", "label_int", *each).write.mode("overwrite").option("header", "true").csv(path)


def device_map(spark: SparkSession, path: str) -> DataFrame:
    """Rules match, device_sn, device_id, bind_id, timezone of a CSV file, with their number in it."""
    rules = spark.read.option("header", "true").csv(path)
    rules = rules.toDF(*[c.lstrip("﻿").strip() for c in rules.columns])
    return rules.withColumn("rule_no", F.monotonically_increasing_id())


def request(rows: DataFrame, payload: str) -> DataFrame:
    """Samples of JSON request bodies, numbered in order of time within each; bodies without samples are left out."""
    schema = "samples array<struct<ts: long, ax: float, ay: float, az: float, gx: float, gy: float, gz: float>>"
    body = F.from_json(F.col(payload), schema)["samples"]
    others = [c for c in rows.columns if c != payload]
    each = rows.select(*others, F.posexplode(F.array_sort(body)).alias("sample", "_s"))
    return each.select(*others, "sample", F.col("_s.ts").alias("ts_ms"), *[f"_s.{c}" for c in IMU[2:]])


def imu_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Readings as they arrive under path as Parquet."""
    schema = "device_sn string, ts_ms long, ax float, ay float, az float, gx float, gy float, gz float"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
