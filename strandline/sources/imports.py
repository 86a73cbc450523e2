"""Import of a folder of classified windows and events, file by file: what one file holds stops no other.

A file's kind follows from its own header. CSV files are read together by equal headers, so columns may come in any order.
A file is taken as a whole or not at all: one that is no JSON, whose header is unknown, or that has a time or confidence
that can't be read in a row with a known label, gives no rows but a row of problems.

Defined results: rows with an unknown label are left out, whatever else they hold; a missing confidence is 0, a missing serial empty; a byte order mark
is no part of a name; files without rows have none and no problem; statistics beside results (NOT_RESULTS) are no inputs.
"""

from __future__ import annotations

from csv import reader as csv_lines
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, times

#: Statistics that tools leave beside their results.
NOT_RESULTS = "daily_scratch_stats"
_ROWS = "file string, device_sn string, ts_start long, ts_end long, behavior int, confidence double, error string"


@dataclass(frozen=True)
class Imported:
    """windows: file, device_sn, ts_ms, behavior, confidence; events: ts_start and ts_end for ts_ms; problems: file, error."""

    windows: DataFrame
    events: DataFrame
    problems: DataFrame


def imported_code(label: Column) -> Column:
    """The code of a label that may be imported, else null."""
    return F.try_element_at(labels.literal_map(labels.IMPORT_CODES), F.trim(label))


def _results(file: Column) -> Column:
    return ~F.element_at(F.split(file, "/"), -1).contains(NOT_RESULTS)


def _row(device: Column, start: Column, end: Column | None, label: Column, conf: Column, zone: Column) -> list[Column]:
    """The columns of _ROWS beside file. end: null for windows."""
    at = [times.parse_time(t, zone) for t in (start, end) if t is not None]
    given = F.nullif(F.trim(conf.cast("string")), F.lit(""))
    number = given.try_cast("double")
    wrong = F.when(at[0].isNull(), F.concat(F.lit("no time: "), F.coalesce(start, F.lit("")))).when(given.isNotNull() & number.isNull(), F.concat(F.lit("no number: "), given))
    if end is not None:
        wrong = F.coalesce(wrong, F.when(at[1].isNull(), F.concat(F.lit("no time: "), F.coalesce(end, F.lit("")))))
    last = at[1] if end is not None else F.lit(None).cast("long")
    return [F.trim(F.coalesce(device, F.lit(""))).alias("device_sn"), at[0].alias("ts_start"), last.alias("ts_end"), imported_code(label).alias("behavior"), F.coalesce(number, F.lit(0.0)).alias("confidence"), wrong.alias("error")]


def json_rows(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """_ROWS of all *_infer.json files under path; behavior is null in a row that only tells a file's error."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_infer.json").text(path, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), "value").where(_results(F.col("file")))
    parsed = raw.select("file", F.from_json("value", "windows array<struct<ts: string, label: string, conf: string>>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    none = F.lit(None).cast("string")
    broken = parsed.where("d is null or d._corrupt is not null").select("file", none.alias("device_sn"), *(F.lit(None).cast("long").alias(c) for c in ("ts_start", "ts_end")), F.lit(None).cast("int").alias("behavior"), F.lit(0.0).alias("confidence"), F.lit("no JSON").alias("error"))
    each = parsed.where("d._corrupt is null").select("file", F.explode("d.windows").alias("w"))
    return broken.unionByName(each.select("file", *_row(F.lit(""), F.col("w.ts"), None, F.col("w.label"), F.col("w.conf"), F.lit(zone))).where("behavior is not null"))


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, files) of the CSV files under path; the header is the first line without a byte order mark.

    Only the first line of each file leaves its task, so files may be of any size.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    first = lines.where((F.col("at") == 0) & _results(F.col("file"))).groupBy("file").agg(F.min_by("value", "id").alias("header"))
    return first.groupBy(F.replace("header", F.lit("﻿"), F.lit("")).alias("header")).agg(F.collect_list("file").alias("files"))


def kind_of(columns: list[str]) -> str:
    """events, windows or unknown."""
    return "events" if {"start_ts", "end_ts"} <= set(columns) else "windows" if "ts" in columns else "unknown"


def csv_rows(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """_ROWS of all CSV files under path; files are read together with those of the same header."""
    out, unknown = spark.createDataFrame([], _ROWS), []
    for header, files in csv_headers(spark, path).toLocalIterator():  # a row a header
        names = [c.strip() for c in next(csv_lines([header]))]
        kind = kind_of(names)
        if kind == "unknown":
            unknown += [(f, f"neither start_ts and end_ts nor ts among {sorted(names)}") for f in files]
            continue
        fields = ", ".join(f"_c{k} string" for k in range(len(names)))
        raw = spark.read.schema(fields).option("header", "true").option("enforceSchema", "true").csv(files)
        cell = lambda c: F.col(f"_c{names.index(c)}") if c in names else F.lit("")  # noqa: B023, E731
        start, end = (cell("start_ts"), cell("end_ts")) if kind == "events" else (cell("ts"), None)
        rows = raw.select(F.col("_metadata.file_path").alias("file"), *_row(cell("device_sn"), start, end, cell("label"), cell("conf"), F.lit(zone)))
        out = out.unionByName(rows.where("behavior is not null"))
    problems = spark.createDataFrame([(f, None, None, None, None, 0.0, e) for f, e in unknown], _ROWS)
    return out.unionByName(problems)


def read_folder(spark: SparkSession, path: str, zone: str = "UTC", csv: bool = True) -> Imported:
    """All windows and events under path; with csv also those of CSV files."""
    rows = json_rows(spark, path, zone)
    if csv:
        rows = rows.unionByName(csv_rows(spark, path, zone))
    return read_files(rows)


def read_files(rows: DataFrame) -> Imported:
    """_ROWS told apart; files with an error give none."""
    problems = rows.where("error is not null").groupBy("file").agg(F.min("error").alias("error"))
    good = rows.join(problems.select("file"), "file", "left_anti")
    own = ["behavior", "confidence"]
    windows = good.where("ts_end is null").select("file", "device_sn", F.col("ts_start").alias("ts_ms"), *own)
    return Imported(windows, good.where("ts_end is not null").select("file", "device_sn", "ts_start", "ts_end", *own), problems)
