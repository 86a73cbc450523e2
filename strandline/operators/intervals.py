"""Joins and subtraction of time intervals.

Overlap is no equality, so both sides are spread over buckets of time and joined on (keys, bucket). An interval has a row
for each bucket that it touches; a pair is kept in the bucket in which the later of its starts lies, so it comes once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def _bucketed(df: DataFrame, start: str, end: str, bucket_ms: int) -> DataFrame:
    low, high = F.expr(f"{start} div {bucket_ms}"), F.expr(f"greatest({start}, {end} - 1) div {bucket_ms}")
    return df.withColumn("_bucket", F.explode(F.sequence(low, high)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket_ms: int = HOUR_MS) -> DataFrame:
    """Pairs of half-open intervals that overlap. Names of the two sides' columns, keys aside, must differ."""
    (a, b), (c, d) = left_span, right_span
    joined = _bucketed(left, a, b, bucket_ms).join(_bucketed(right, c, d, bucket_ms), [*keys, "_bucket"])
    later = F.expr(f"greatest({a}, {c}) div {bucket_ms}")
    return joined.where((F.col(a) < F.col(d)) & (F.col(b) > F.col(c)) & (F.col("_bucket") == later)).drop("_bucket")


def mark_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], name: str = "taken") -> DataFrame:
    """left with whether any of right overlaps the row. left_id tells the rows of left apart within keys."""
    hit = overlap_join(left.select(*keys, *left_id, *left_span), right.select(*keys, *right_span), keys, left_span, right_span)
    hit = hit.select(*keys, *left_id).distinct().withColumn(name, F.lit(True))
    return left.join(hit, [*keys, *left_id], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def subtract(segments: DataFrame, holes: DataFrame, keys: Sequence[str], segment_id: Sequence[str], span: tuple[str, str] = ("start_ms", "end_ms"), hole: tuple[str, str] = ("hole_start", "hole_end"), least_ms: int = 1000) -> DataFrame:
    """segments without what holes (disjoint) cover: each is split around them, and pieces of under least_ms go.

    The pieces lie between the neighbouring holes of a segment, so they come from one window over the overlapping pairs.
    """
    (a, b), (c, d) = span, hole
    pairs = overlap_join(segments, holes.select(*keys, c, d), keys, span, hole)
    per_segment = [*keys, *segment_id]
    cuts = pairs.groupBy(*per_segment).agg(F.array_sort(F.collect_list(F.struct(F.col(c).alias("s"), F.col(d).alias("e")))).alias("_holes"))
    joined = segments.join(cuts, per_segment, "left").withColumn("_holes", F.coalesce("_holes", F.expr("array()").cast("array<struct<s: bigint, e: bigint>>")))
    starts = F.concat(F.array(a), F.transform("_holes", lambda h: h["e"]))
    ends = F.concat(F.transform("_holes", lambda h: h["s"]), F.array(b))
    pieces = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda p: p["e"] - p["s"] >= least_ms)
    out = joined.withColumn("_piece", F.explode(pieces))
    return out.withColumn(a, F.col("_piece.s")).withColumn(b, F.col("_piece.e")).drop("_piece", "_holes")
