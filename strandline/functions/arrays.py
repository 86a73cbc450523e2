"""Statistics of signals held as arrays, as column expressions.

Moments are of the population; skewness and excess kurtosis are 0 where a signal is (nearly) constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT = 1e-8


def _sum(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v).cast("double"))


def mean(x: Column) -> Column:
    return F.try_divide(_sum(x), F.size(x))


def _central(x: Column, power: int) -> Column:
    """Mean of a power of the distance from the mean; the mean is computed once."""
    held = F.transform(F.array(mean(x)), lambda m: F.try_divide(_sum(x, lambda v: F.pow(v - m, F.lit(power)) if power > 2 else (v - m) * (v - m)), F.size(x)))
    return held[0]


def std(x: Column) -> Column:
    return F.sqrt(_central(x, 2))


def rms(x: Column) -> Column:
    return F.sqrt(F.try_divide(_sum(x, lambda v: v.cast("double") * v.cast("double")), F.size(x)))


def skewness(x: Column) -> Column:
    return F.when(std(x) <= FLAT, 0.0).otherwise(F.try_divide(_central(x, 3), F.pow(_central(x, 2), F.lit(1.5))))


def kurtosis(x: Column) -> Column:
    return F.when(std(x) <= FLAT, 0.0).otherwise(F.try_divide(_central(x, 4), F.pow(_central(x, 2), F.lit(2))) - 3.0)


def quantile(x: Column, q: float) -> Column:
    """Linear between the neighbouring values."""
    ordered = F.array_sort(x)
    place = (F.size(x) - 1) * q
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    a, b = F.get(ordered, low).cast("double"), F.get(ordered, high).cast("double")
    return a + (b - a) * (place - low)


def mean_crossings(x: Column) -> Column:
    """How often the sign of x - mean changes; a value at the mean has a sign of its own."""
    signs = F.transform(F.array(mean(x)), lambda m: F.transform(x, lambda v: F.signum(v - m)))[0]
    return changes(signs)


def changes(x: Column) -> Column:
    """How often neighbours differ."""
    ahead, behind = F.slice(x, 2, F.size(x)), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
    return F.size(F.filter(F.zip_with(ahead, behind, lambda a, b: a != b), lambda d: d))


def peaks(x: Column) -> Column:
    """How many strict local maxima there are; a flat top counts once, the ends never."""
    flat = F.aggregate(x, F.expr("cast(array() as array<double>)"), lambda a, v: F.when((F.size(a) > 0) & (F.element_at(a, -1) == v), a).otherwise(F.concat(a, F.array(v.cast("double")))))
    return F.transform(F.array(flat), lambda d: F.size(F.filter(F.transform(d, lambda v, i: (i > 0) & (i < F.size(d) - 1) & (v > F.coalesce(F.get(d, i - 1), v)) & (v > F.coalesce(F.get(d, i + 1), v))), lambda p: p)))[0]


def time_stats(x: Column) -> dict[str, Column]:
    """The eleven statistics over time of one signal, by name."""
    return {
        "mean": mean(x),
        "std": std(x),
        "min": F.array_min(x).cast("double"),
        "max": F.array_max(x).cast("double"),
        "range": F.array_max(x).cast("double") - F.array_min(x).cast("double"),
        "rms": rms(x),
        "skew": skewness(x),
        "kurtosis": kurtosis(x),
        "crossings": mean_crossings(x),
        "iqr": quantile(x, 0.75) - quantile(x, 0.25),
        "peaks": peaks(x),
    }


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two arrays of one length, 0 where either is (nearly) constant."""
    product = F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    means = F.array(F.struct(mean(x).alias("mx"), mean(y).alias("my")))
    covariance = F.transform(means, lambda m: F.try_divide(F.aggregate(product, F.lit(0.0), lambda s, p: s + (p["a"] - m["mx"]) * (p["b"] - m["my"])), F.size(x)))[0]
    return F.when((std(x) <= FLAT) | (std(y) <= FLAT), 0.0).otherwise(F.coalesce(F.try_divide(covariance, std(x) * std(y)), F.lit(0.0)))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    squares = F.zip_with(F.zip_with(x, y, lambda a, b: a.cast("double") * a + b.cast("double") * b), z, lambda s, c: s + c.cast("double") * c)
    return F.transform(squares, F.sqrt)


def jerk(x: Column, hz: float) -> Column:
    ahead, behind = F.slice(x, 2, F.size(x)), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
    return F.zip_with(ahead, behind, lambda a, b: (a - b) * hz)


def signal_area(x: Column, y: Column, z: Column) -> Column:
    """Mean of the sum of the three axes' sizes."""
    return mean(F.zip_with(F.zip_with(x, y, lambda a, b: F.abs(a.cast("double")) + F.abs(b.cast("double"))), z, lambda s, c: s + F.abs(c.cast("double"))))


def pitch(ax: Column, ay: Column, az: Column) -> Column:
    return F.atan2(-ax, F.sqrt(ay * ay + az * az))


def roll(ay: Column, az: Column) -> Column:
    return F.atan2(ay, az)


def choose(x: Column, places: list[int], of: int | None = None) -> Column:
    """The values at some places; an array of another length than `of`, or places outside it, raise an error."""
    if not places or min(places) < 0 or of is not None and max(places) >= of:
        raise ValueError("places must be within the array, and there must be some")
    picked = F.transform(F.array(*map(F.lit, places)), lambda i: F.get(x, i))
    if of is None:
        return picked
    return F.when(F.size(x) == of, picked).otherwise(F.raise_error(F.format_string("an array of %d, not of " + str(of), F.size(x))))
