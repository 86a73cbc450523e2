"""Joins with dimensions, and rules that names match."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions that Spark expects to be larger than this are joined without a broadcast.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if Spark expects it to have at most `most` bytes, else as it is. No job is run for that."""
    return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most else df


def active_bindings(bindings: DataFrame, devices: DataFrame, users: DataFrame) -> DataFrame:
    """Bindings in force with serial and zone; a user without a zone, or with an empty one, is in UTC."""
    joined = bindings.where("bind_status = 1").join(devices, "device_id").join(users, "user_id")
    return joined.withColumn("timezone", F.coalesce(F.nullif(F.trim("timezone"), F.lit("")), F.lit("UTC")))


def enrich(rows: DataFrame, lookup: DataFrame, key: str, order: Sequence[Column], fill: Sequence[str]) -> DataFrame:
    """rows with the columns in fill taken from the first match in lookup where they are null."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = lookup.withColumn("_rank", rank).where("_rank = 1").select(key, *[F.col(c).alias(f"_{c}") for c in fill])
    joined = rows.join(first, key, "left")
    for c in fill:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}"))).drop(f"_{c}")
    return joined


def longest_match(rows: DataFrame, rules: DataFrame, name: str, row_id: Sequence[str], match: str = "match", rule_no: str = "rule_no") -> DataFrame:
    """rows with the rule whose match is contained in name whatever the case: the longest, then the first. Rows that no rule matches go.

    Containment is no equality, so rules are joined by their first three letters against those of every place in the name;
    rules of under three letters, which have no such key, are compared with every distinct name.
    """
    width = 3
    lower_rules = rules.withColumn("_m", F.lower(match)).where(F.length("_m") > 0)
    names = rows.select(name).distinct().withColumn("_n", F.lower(name))
    places = F.sequence(F.lit(1), F.greatest(F.length("_n") - width + 1, F.lit(1)))
    keyed = names.withColumn("_k", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(F.col("_n"), i, F.lit(width))))))
    long_rules = lower_rules.where(F.length("_m") >= width).withColumn("_k", F.substring("_m", 1, width))
    hits = keyed.join(long_rules, "_k").where(F.contains("_n", "_m")).drop("_k")
    short_rules = lower_rules.where(F.length("_m") < width)
    short = names.withColumn("_k", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("_n")), lambda i: F.array(F.substr(F.col("_n"), i, F.lit(1)), F.substr(F.col("_n"), i, F.lit(2))))))))
    hits = hits.unionByName(short.join(short_rules.withColumn("_k", F.col("_m")), "_k").drop("_k"))
    best = Window.partitionBy(name).orderBy(F.desc(F.length("_m")), rule_no)
    chosen = hits.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_n", "_m")
    return rows.join(chosen, name)


def latest(rows: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """The value of the last row of each key, the greatest tie among those of one time."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias(ts))


def with_fallback(read_first, read_second) -> DataFrame:
    """What read_first() gives, or read_second() if its source cannot be read: a path or table that is not there, or a connection that fails."""
    try:
        df = read_first()
        df.schema  # noqa: B018  a missing source fails here
        return df
    except (AnalysisException, Py4JJavaError, OSError):
        return read_second()
