"""Business rules of the daily assessment as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Limits of the assessment by phase of the baseline (1 to 3)."""

    z: tuple[float, float, float] = (4.0, 3.5, 2.5)
    consecutive: tuple[int, int, int] = (5, 4, 3)
    mean_z: tuple[float, float, float] = (5.0, 4.0, 3.5)
    phase_days: tuple[int, int, int] = (3, 14, 30)
    min_wear_minutes: int = 480
    std_floor: float = 2.0
    wpeb_std_floor: float = 1.0
    reference_temperature: float = 20.0


DEFAULT = Thresholds()


def round_even(c: Column, places: int) -> Column:
    """A double rounded half to even after it is multiplied by its power of ten, as SQL's round_even does; bround() looks at its decimal digits instead. No zero has a sign."""
    return F.rint(c * 10.0**places) / 10.0**places + 0.0


def round_half(c: Column, places: int) -> Column:
    """A double rounded half away from zero after it is multiplied by its power of ten, as SQL's round does; round() with places looks at its decimal digits instead."""
    return F.round(c * 10.0**places) / 10.0**places


def round_decimal(c: Column, places: int) -> Column:
    """A double rounded half to even on the decimal that it is written as, to 18 places: what is beyond them is left by sums of doubles, and half stays half."""
    return F.bround(c.cast("decimal(30,18)"), places).cast("double")


def phase(valid_days: Column, limits: Thresholds = DEFAULT) -> Column:
    a, b, c = limits.phase_days
    return F.when(valid_days < a, 0).when(valid_days < b, 1).when(valid_days < c, 2).otherwise(3)


def by_phase(phase_col: Column, values: tuple) -> Column:
    """The value for phases 1 to 3, null for phase 0."""
    one, two, three = values
    return F.when(phase_col == 1, F.lit(one)).when(phase_col == 2, F.lit(two)).when(phase_col == 3, F.lit(three))


def bout_weight(confidence: Column) -> Column:
    known = F.coalesce(confidence, F.lit(0.5))
    return F.when(known < 0.65, 1.0).when(known < 0.85, 1.5).otherwise(2.5)


def duration_weight(seconds: Column) -> Column:
    return F.when(seconds < 3, 0.0).when(seconds < 10, 1.0).when(seconds < 30, 1.5).otherwise(2.0)


def count_score(z: Column) -> Column:
    """0 to 25 in proportion to z up to 4."""
    return F.when(z <= 0, 0.0).otherwise(F.least(z / 4.0 * 25.0, F.lit(25.0)))


def bout_score(wpeb: Column, mean: Column, std: Column, floor: float = DEFAULT.wpeb_std_floor) -> Column:
    return count_score((wpeb - mean) / F.greatest(std, F.lit(floor)))


def night_score(night_scratches: Column, sleep_segments: Column) -> Column:
    bouts = F.when(night_scratches <= 0, 0.0).when(night_scratches <= 2, 5.0).when(night_scratches <= 5, 9.0).otherwise(12.0)
    broken = F.when(sleep_segments <= 1, 0.0).when(sleep_segments <= 3, 3.0).otherwise(8.0)
    return bouts + broken


def temperature_score(neck: Column, loose_minutes: Column) -> Column:
    return F.when(neck.isNull() | (loose_minutes > 240), 0.0).when(neck < 38.0, 0.0).when(neck < 39.2, 2.0).when(neck <= 39.7, 6.0).otherwise(10.0)


def climate_score(temperature: Column, humidity: Column) -> Column:
    warm = F.when(temperature > 30, -2.0).when(temperature < 10, 1.0).otherwise(0.0)
    dry = F.when(humidity < 40, 2.0).when(humidity > 80, -1.0).otherwise(0.0)
    return F.greatest(F.lit(-5.0), F.least(F.lit(5.0), warm + dry))


def total(*scores: Column) -> Column:
    out = F.lit(0.0)
    for s in scores:
        out = out + F.coalesce(s, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), out))


def level(score: Column) -> Column:
    return F.least(F.floor(score / 10), F.lit(10)).cast("int")


def alert(streak: Column) -> Column:
    return F.when(streak >= 5, 3).when(streak >= 3, 2).when(streak >= 1 + 1, 1).otherwise(0)


def sleep_status(sleep_ratio: Column, wear_minutes: Column) -> Column:
    return F.when((wear_minutes < 120) | (sleep_ratio >= 0.25), 0).when(sleep_ratio >= 0.10, 1).otherwise(2)


def move_status(active_ratio: Column, wear_minutes: Column) -> Column:
    usual = active_ratio.between(0.15, 0.65)
    near = ((active_ratio >= 0.05) & (active_ratio < 0.15)) | ((active_ratio > 0.65) & (active_ratio <= 0.80))
    return F.when((wear_minutes < 120) | usual, 0).when(near, 1).otherwise(2)


def scratch_status(alert_level: Column) -> Column:
    return F.when(alert_level <= 0, 0).when(alert_level == 1, 1).otherwise(2)
