"""Groups of devices: baselines with a fallback to coarser groups, blends with a device's own, ranks within a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days after which a device's own baseline stands alone; peak rates between the classes of bouts where a device has too few, and the weights of the classes.
OWN_DAYS, PEAKS, CLASS_WEIGHTS = 30, (80.0, 150.0), (1.0, 1.5, 2.5)


def group_baseline(members: DataFrame, value: str, levels: Sequence[tuple[Sequence[str], int]]) -> DataFrame:
    """The columns of the finest level, level, n_members, group_mean, group_std: for each finest group the first level that has members enough.

    members: a row a device. levels: (columns, least members) from the finest on, each with a part of the columns before; the
    last one is taken however few it has. All levels come from one aggregation over grouping sets; the joins are between
    groups, of which there are few, not members.
    """
    finest = list(levels[0][0])
    sets = [[F.col(c) for c in columns] for columns, _ in levels]
    number = {sum(1 << (len(finest) - 1 - k) for k, c in enumerate(finest) if c not in columns): at for at, (columns, _) in enumerate(levels)}
    grouped = members.groupingSets(sets, *finest).agg(F.grouping_id().alias("_set"), F.count(value).alias("n_members"), F.avg(value).alias("group_mean"), F.stddev_pop(value).alias("group_std"))
    out = grouped.where(F.col("_set") == 0).select(*finest)
    found = []
    for key, at in sorted(number.items(), key=lambda x: x[1]):
        columns, least = levels[at]
        enough = F.col("n_members") >= (least if at < len(levels) - 1 else 0)
        level = grouped.where((F.col("_set") == key) & enough).select(*[F.col(c).alias(f"_{c}") for c in columns], F.struct(F.lit(at).alias("level"), "n_members", "group_mean", "group_std").alias(f"_level{at}"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
        out = out.join(level, reduce(Column.__and__, same) if same else F.lit(True), "left").drop(*[f"_{c}" for c in columns])
        found.append(F.col(f"_level{at}"))
    return out.select(*finest, F.coalesce(*found).alias("_chosen")).select(*finest, "_chosen.*")


def blended(own: Column, group: Column, days: Column) -> Column:
    """A device's own value and its group's, the own one by the share of OWN_DAYS that it has; either alone where the other is missing."""
    share = F.least(days / OWN_DAYS, F.lit(1.0))
    return F.coalesce(own * share + group * (1 - share), own, group)


def rank_within(df: DataFrame, group: Sequence[str], value: str, name: str = "percentile") -> DataFrame:
    """df with the share of the other rows of its group that have a smaller value, 0 for a single one.

    Values are counted first, so what is ordered are a group's distinct values and not its rows: a group of a third of all
    devices is summed up by all tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_below", below).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    share = F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1)).otherwise(0.0)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, value)]
    placed = placed.withColumn(name, share)
    return df.alias("a").join(placed.alias("b"), reduce(Column.__and__, same), "left").select("a.*", F.col(f"b.{name}").alias(name))


def intensity(bouts: DataFrame, key: str, peak: str, least: int = 5) -> DataFrame:
    """bouts with intensity 0, 1, 2 (light, medium, heavy) and its weight: by the thirds of the device's own peaks, exactly, or by PEAKS where it has under `least`."""
    own = bouts.groupBy(key).agg(F.percentile(peak, F.lit(0.33)).alias("_a"), F.percentile(peak, F.lit(0.67)).alias("_b"), F.count(peak).alias("_n"))
    cut = lambda c, fixed: F.when(F.col("_n") >= least, F.col(c)).otherwise(F.lit(fixed))
    kind = F.when(F.col(peak) < cut("_a", PEAKS[0]), 0).when(F.col(peak) < cut("_b", PEAKS[1]), 1).otherwise(2)
    out = bouts.join(own, key).withColumn("intensity", kind)
    return out.withColumn("weight", F.element_at(F.array(*map(F.lit, CLASS_WEIGHTS)), F.col("intensity") + 1)).drop("_a", "_b", "_n")


def quantile_sketches(rows: DataFrame, keys: Sequence[str], value: str, k: int = 200) -> DataFrame:
    """keys and sketch: a mergeable sketch of the values of each group, to be kept in a table and merged with later ones by merge_sketches()."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(value, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch of each group from those of its parts."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
