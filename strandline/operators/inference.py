"""From raw readings to behaviour: units, resampling, windows, features, classes, decoding, segments.

A sequence is a stretch of a device's local day without a pause, so no sequence grows without a bound, and no window or
interval reaches over a pause. Times follow from the number of a sample within its stretch and the model's rate, beginning
with the first reading of the stretch. Readings are read once: the pauses are marked by the sort that resampling needs anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, scores, times, units
from . import decode, islands, signal


def by_local_day(readings: DataFrame, zone: Column, ts: str = "ts_ms") -> DataFrame:
    """readings with day_ts, the midnight at which their local day began."""
    return readings.withColumn("day_ts", times.local_midnight(F.col(ts), zone))


def classified_windows(readings: DataFrame, model, classes: Sequence[str], meta: dict, device_hz: float, keys: Sequence[str] = ("device_id", "day_ts"), ts: str = "ts_ms", acc_unit: str = "ms2", gyro_unit: str = "dps", layout: int | None = None, chosen: Sequence[int] | None = None, minimum: float = 0.0, pause_ms: int = 2000) -> DataFrame:
    """keys, part_ms, idx, ts_ms, probs by classes, label and confidence of each full window of readings (keys, ts, the channels).

    part_ms is the time of the first reading after a pause of over pause_ms; idx begins anew with each.

    meta says the model's rate and windows (see signal.geometry) and its units acc_unit and gyro_unit, by default m/s² and
    degrees a second. model is an object with predict_proba, or a fitted pipeline of models.py, which has all steps from
    windows to classes. Which features it takes follows from the model and meta (see signal.layout_of) unless layout and
    chosen say so.
    """
    shape = signal.geometry(meta, device_hz)
    scaled = units.scale(readings, acc_unit, gyro_unit, model_acc_unit=meta.get("acc_unit", "ms2"), model_gyro_unit=meta.get("gyro_unit", "dps"))
    scaled, keys = islands.with_part(scaled, keys, ts, pause_ms), (*keys, "part_ms")
    if shape["resample"]:
        samples = signal.resample(scaled, keys, ts, device_hz, shape["hz"])
    else:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1
        samples = scaled.select(*keys, number.alias("sample"), *signal.CHANNELS)
    if isinstance(model, Transformer):
        found = model.transform(signal.strided_windows(samples, keys, ["sample"], shape["window"], shape["step"]))
    else:
        if layout is None:
            layout, chosen = signal.layout_of(model, meta)
        found = signal.classified_windows(samples, keys, ["sample"], shape["window"], shape["step"], shape["hz"], model, classes, layout, chosen, minimum)
    found = found.withColumnRenamed("window_idx", "idx")
    return found.withColumn("ts_ms", F.col("part_ms") + F.floor(F.col("idx") * shape["step"] * 1000.0 / shape["hz"]).cast("long"))


def behaviour(windows: DataFrame, classes: Sequence[str], window_ms: int, stride_ms: int, keys: Sequence[str] = ("device_id", "day_ts"), params: decode.StableParams = decode.StableParams(), algo: str = "viterbi", codes: dict[str, int] = labels.CODES) -> DataFrame:
    """Intervals of behaviour: keys, ts_start, ts_end, behavior, behavior_label, confidence, n_windows.

    Each stretch (part_ms) is decoded by itself. A class without a code makes no interval. Several classes may have one code,
    so neighbouring intervals of one code that touch are joined; their confidences are averaged by duration.
    """
    parts = (*keys, "part_ms")
    stable = decode.stabilise(windows, parts, ["idx"], classes, window_ms, stride_ms, params, algo)
    found = decode.segments(stable, parts, ["idx"], classes)
    found = found.withColumn("behavior", F.try_element_at(labels.literal_map(codes), F.col("final"))).where("behavior is not null")
    found = found.select(*keys, F.col("start_ms").alias("ts_start"), F.col("end_ms").alias("ts_end"), "behavior", scores.round_even(F.col("conf_mean"), 4).alias("confidence"), "n_windows")
    joined = islands.coalesce_events(found, keys, totals=("n_windows",)).drop("n_events")
    return joined.withColumn("behavior_label", labels.name_of(F.col("behavior")))
