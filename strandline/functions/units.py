"""Units of sensor readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a unit is in m/s^2 or degrees a second.
ACCELERATION = {"ms2": 1.0, "m/s2": 1.0, "m/s^2": 1.0, "g": 9.80665}
ROTATION = {"dps": 1.0, "deg/s": 1.0, "rads": 57.29577951308232, "rad/s": 57.29577951308232}
#: How units are written for people.
LABELS = {"ms2": "m/s²", "g": "g", "dps": "deg/s", "rads": "rad/s"}


def factor(unit: str, known: dict[str, float]) -> float:
    try:
        return known[unit.strip().lower()]
    except KeyError:
        raise ValueError(f"unit {unit!r}; known: {sorted(known)}") from None


def scale(df: DataFrame, acc_unit: str = "ms2", gyro_unit: str = "dps", acc: tuple[str, ...] = ("ax", "ay", "az"), gyro: tuple[str, ...] = ("gx", "gy", "gz"), model_acc_unit: str = "ms2", model_gyro_unit: str = "dps") -> DataFrame:
    """Readings of a device in the units that a model was trained in; columns that are so already are not touched."""
    for columns, unit, wanted, known in ((acc, acc_unit, model_acc_unit, ACCELERATION), (gyro, gyro_unit, model_gyro_unit, ROTATION)):
        by = factor(unit, known) / factor(wanted, known)
        if by != 1.0:
            df = df.withColumns({c: F.col(c) * by for c in columns})
    return df


def guess(median_acc: Column) -> Column:
    """The unit that a median size of acceleration at rest speaks for, null if none."""
    return F.when(median_acc.between(7.0, 12.5), "ms2").when(median_acc.between(0.7, 1.3), "g")


def diagnosis(df: DataFrame, by: str, acc: Column, gyro: Column, acc_unit: str = "ms2") -> DataFrame:
    """Quantiles of the sizes of acceleration and rotation for each `by`, the unit that they speak for, and whether that is acc_unit.

    verdict: unknown (no unit fits, the readings are to be looked at), differs, agrees. Rotation has no size at rest to go by.
    """
    q = lambda c, p: F.percentile(c, F.lit(p))
    out = df.groupBy(by).agg(q(acc, 0.5).alias("acc_median"), q(acc, 0.05).alias("acc_p5"), q(acc, 0.95).alias("acc_p95"), q(gyro, 0.5).alias("gyro_median"), q(gyro, 0.95).alias("gyro_p95"), F.max(gyro).alias("gyro_max"))
    out = out.withColumn("unit", guess(F.col("acc_median")))
    verdict = F.when(F.col("unit").isNull(), "unknown").when(F.col("unit") != acc_unit, "differs").otherwise("agrees")
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    text = F.when(F.col("unit").isNull(), F.format_string("median |acc| %.3f fits neither m/s² nor g", F.col("acc_median"))).otherwise(F.format_string("median |acc| %.3f looks like %s, %s", F.col("acc_median"), labels[F.col("unit")], F.when(F.col("unit") != acc_unit, F.lit(f"set is {LABELS.get(acc_unit, acc_unit)}")).otherwise(F.lit("as set"))))
    return out.withColumn("verdict", verdict).withColumn("text", text)
