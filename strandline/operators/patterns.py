"""Ordered patterns and nearest earlier rows, by windows over one sort: no ranges are exploded and no history is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_pattern(rows: DataFrame, keys: Sequence[str], ts: str, steps: Sequence[tuple[Column, int]]) -> DataFrame:
    """keys, times (one for each step): rows that follow each other as the steps say.

    steps: (condition, most time since the step before). A row that fulfils the last step ends a match if the latest match of the
    steps before is recent enough; that match has the latest rows as well, so each ending row gives one match at most. A
    row is one step of a match only. What a window carries on is the latest match of each length, like the states of an automaton.
    Rows of one time are in no order, and are not taken to follow each other.
    """
    before = Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, -1)
    out = rows
    for k, (holds, most) in enumerate(steps):
        if k == 0:
            match = F.when(holds, F.array(ts))
        else:
            latest = F.last(f"_m{k - 1}", ignorenulls=True).over(before)
            match = F.when(holds & (F.col(ts) - F.element_at(latest, -1) <= most), F.concat(latest, F.array(ts)))
        out = out.withColumn(f"_m{k}", match)
    last = f"_m{len(steps) - 1}"
    return out.where(F.col(last).isNotNull()).select(*keys, F.col(last).alias("times"))


def nearest_before(rows: DataFrame, others: DataFrame, keys: Sequence[str], ts: str, most: int, value: str, name: str | None = None) -> DataFrame:
    """rows with the value of the latest of others at the same time or up to `most` before, and its time (value_ts); null without.

    Both tables are put into one, sorted once, and the last value is carried on. So that a device with most of the rows is
    many groups, time is cut into blocks of `most`, and others also go into the block after theirs. Of several at one time
    the greatest value counts.
    """
    name = name or value
    block = lambda c: F.floor(F.col(c) / most)
    kept = [c for c in rows.columns if c not in (name, f"{name}_ts")]
    left = rows.select(*keys, F.col(ts).alias("_ts"), F.struct(*kept).alias("_row"), F.lit(None).cast(others.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    right = others.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*keys, F.col(ts).alias("_ts"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    left, right = left.withColumn("_block", block("_ts")), right.withColumn("_block", F.explode(F.array(block("_ts"), block("_ts") + 1)))
    w = Window.partitionBy(*keys, "_block").orderBy("_ts", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.struct("_value", "_ts")), ignorenulls=True).over(w)
    joined = left.unionByName(right).withColumn("_found", found).where("_side = 1")
    near = F.col("_ts") - F.col("_found._ts") <= most
    return joined.select("_row.*", F.when(near, F.col("_found._value")).alias(name), F.when(near, F.col("_found._ts")).alias(f"{name}_ts"))


def persistent(days: DataFrame, keys: Sequence[str], day: str, z: Column, limit: Column, least: Column) -> DataFrame:
    """days with streak (days in a row, up to this one, on which |z| is over limit; a day without z ends it) and persistent (streak >= least)."""
    w = Window.partitionBy(*keys).orderBy(day)
    over = F.coalesce(F.abs(z) > limit, F.lit(False))
    out = days.withColumn("_over", over).withColumn("_run", F.sum(F.when(~F.col("_over"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col("_over").cast("int")).over(Window.partitionBy(*keys, "_run").orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("streak", streak.cast("int")).withColumn("persistent", F.coalesce(F.col("streak") >= least, F.lit(False))).drop("_over", "_run")
