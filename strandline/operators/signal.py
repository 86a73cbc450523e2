"""Signal kernels: resampling, alignment with gravity, spectra, and the feature vector of a window.

Resampling is window expressions; features are numpy on a whole Arrow batch of windows at once, and Spark deals the
windows out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import islands

CHANNELS = ("ax", "ay", "az", "gx", "gy", "gz")
FLAT = 1e-8
#: What models call channels and features, in the order of the vector.
_AXES = ("acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z", "pitch", "roll")
_STATS = ("mean", "std", "min", "max", "range", "rms", "skew", "kurtosis", "mcr", "iqr", "peak_count")
_SPECTRAL = ("spec_mean", "spec_std", "peak_freq", "spec_entropy", "band_energy_0", "band_energy_1", "band_energy_2", "band_energy_3")
_GLOBAL = ("sma_acc", "sma_gyro", "corr_acc_xy", "corr_acc_yz", "corr_acc_xz", "corr_gyro_xy", "corr_gyro_yz", "corr_gyro_xz")
#: Where the four bands begin and end, in shares of half the rate; the end is not in a band.
BANDS = ((0.0, 0.125), (0.125, 0.375), (0.375, 0.75), (0.75, 1.0))


def resample(df: DataFrame, keys: Sequence[str], ts: str, source_hz: float, target_hz: float, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Each sequence at target_hz: keys, sample, channels. Samples are taken to follow each other at source_hz.

    A box filter as long as the ratio of the rates (rounded), zeros beyond the ends, then linear interpolation at the
    multiples of the new step before the last sample's time, in milliseconds; so the last point is left out, at equal
    rates as well. A sequence of one sample gives none. All of it is windows over one sort, nothing leaves the JVM.
    """
    step, dt = 1000.0 / target_hz, 1000.0 / source_hz
    width = max(1, round(step / dt))
    after = (width - 1) // 2
    w = Window.partitionBy(*keys).orderBy(ts)
    box = w.rowsBetween(after + 1 - width, after)
    at = F.row_number().over(w) - 1
    smooth = [(F.sum(F.col(c).cast("double")).over(box) / width if width > 1 else F.col(c).cast("double")).alias(c) for c in channels]
    own = df.select(*keys, ts, at.alias("_i"), *smooth)
    own = own.withColumns({f"_next_{c}": F.lead(c).over(w) for c in channels}).withColumn("_last", F.lead(ts).over(w).isNull())
    time = lambda i: i / F.lit(float(source_hz)) * 1000.0
    first = lambda i: F.ceil(time(i) / step).cast("long")
    low, high = first(F.col("_i")), first(F.col("_i") + 1) - 1
    new = own.where(~F.col("_last") & (low <= high)).withColumn("sample", F.explode(F.sequence(low, high)))
    share = (F.col("sample") * step - time(F.col("_i"))) / dt
    return new.select(*keys, "sample", *[(F.col(c) + (F.col(f"_next_{c}") - F.col(c)) * share).alias(c) for c in channels])


def align(x: np.ndarray) -> np.ndarray:
    """Windows (n, T, 6 or more) turned so that each one's mean acceleration points along +z; rotation rates turn as well."""
    g = x[:, :, :3].mean(axis=1)
    size = np.linalg.norm(g, axis=1)
    unit = g / np.where(size < 1e-6, 1.0, size)[:, None]
    cos = unit[:, 2]
    axis = np.cross(unit, np.array([0.0, 0.0, 1.0]))
    k = np.zeros((len(x), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -axis[:, 2], axis[:, 1], -axis[:, 0]
    k -= np.transpose(k, (0, 2, 1))
    turn = np.eye(3) + k + k @ k / np.where(cos > -0.9999, 1.0 + cos, 1.0)[:, None, None]
    turn[cos < -0.9999] = np.diag([1.0, -1.0, -1.0])
    turn[(size < 1e-6) | (cos > 0.9999)] = np.eye(3)
    out = x.copy()
    for a in (0, 3):
        out[:, :, a : a + 3] = np.einsum("nij,ntj->nti", turn, x[:, :, a : a + 3])
    return out


def tilt(x: np.ndarray) -> np.ndarray:
    """Pitch and roll (n, T, 2) of the accelerations as they came."""
    ax, ay, az = np.moveaxis(x[:, :, :3], 2, 0)
    return np.stack([np.arctan2(-ax, np.sqrt(ay**2 + az**2)), np.arctan2(ay, az)], axis=2)


def _crossings(x: np.ndarray) -> np.ndarray:
    s = np.sign(x)
    return (s[:, 1:] != s[:, :-1]).sum(axis=1)


def peak_counts(x: np.ndarray) -> np.ndarray:
    """Strict local maxima of each row; a flat top counts once, the ends never."""
    step = np.sign(np.diff(x, axis=1))
    if not step.size:
        return np.zeros(len(x))
    place = np.where(step != 0, np.arange(step.shape[1]), -1)
    last = np.maximum.accumulate(place, axis=1)
    filled = np.where(last >= 0, np.take_along_axis(step, np.maximum(last, 0), axis=1), 0)
    return ((filled[:, :-1] > 0) & (step[:, 1:] < 0)).sum(axis=1)


def time_features(x: np.ndarray) -> np.ndarray:
    """(n, 11) of rows (n, T)."""
    m, s = x.mean(axis=1), x.std(axis=1)
    d = x - m[:, None]
    flat = s <= FLAT
    safe = np.where(flat, 1.0, s)
    skew = np.where(flat, 0.0, (d**3).mean(axis=1) / safe**3)
    kurtosis = np.where(flat, 0.0, (d**4).mean(axis=1) / safe**4 - 3)
    low, high = x.min(axis=1), x.max(axis=1)
    q = np.quantile(x, [0.25, 0.75], axis=1)
    return np.column_stack([m, s, low, high, high - low, np.sqrt((x**2).mean(axis=1)), skew, kurtosis, _crossings(d), q[1] - q[0], peak_counts(x)])


def welch(x: np.ndarray, hz: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power densities by Welch's method (1967): Hann windows of at most 32 samples, half overlapping, means removed."""
    n = x.shape[1]
    size = min(n, 32)
    step = size - size // 2
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.stack([x[:, a : a + size] for a in range(0, n - size + 1, step)], axis=1)
    spectrum = np.abs(np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * hann, axis=2)) ** 2 / (hz * (hann**2).sum())
    last = -1 if size % 2 == 0 else None
    spectrum[:, :, 1:last] *= 2
    return np.fft.rfftfreq(size, 1 / hz), spectrum.mean(axis=1)


def spectral_features(x: np.ndarray, hz: float) -> np.ndarray:
    """(n, 8) of rows (n, T): centroid and spread of the frequencies by power, the strongest one, entropy, the shares of BANDS."""
    freq, power = welch(x, hz)
    share = power / (power.sum(axis=1, keepdims=True) + 1e-8)
    centre = share @ freq
    spread = np.sqrt((share * (freq - centre[:, None]) ** 2).sum(axis=1))
    entropy = -(share * np.log(share + 1e-8)).sum(axis=1)
    bands = [share[:, (freq >= a * hz / 2) & (freq < b * hz / 2)].sum(axis=1) for a, b in BANDS]
    return np.column_stack([centre, spread, freq[power.argmax(axis=1)], entropy, *bands])


def _pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sa, sb = a.std(axis=1), b.std(axis=1)
    flat = (sa <= FLAT) | (sb <= FLAT)
    covariance = ((a - a.mean(axis=1, keepdims=True)) * (b - b.mean(axis=1, keepdims=True))).mean(axis=1)
    return np.where(flat, 0.0, covariance / np.where(flat, 1.0, sa * sb))


def feature_names(tilted: bool) -> list[str]:
    """Names in the order of window_features(): 193 with pitch and roll, 171 without."""
    out = [f"{c}_{s}" for c in _AXES[: 8 if tilted else 6] for s in _STATS] + [f"{c}_{s}" for c in _AXES[:6] for s in _SPECTRAL]
    out += [*_GLOBAL, *(f"{g}_mag_{s}" for g in ("acc", "gyro") for s in (*_STATS, *_SPECTRAL))]
    return out + [f"acc_jerk_mag_{s}" for s in _STATS]


def window_features(x: np.ndarray, hz: float, tilted: bool = True) -> np.ndarray:
    """(n, 193 or 171) of windows (n, T, 6). Tilt is taken before the alignment with gravity."""
    raw, x = x, align(x)
    channels = np.concatenate([x, tilt(raw)], axis=2) if tilted else x
    blocks = [time_features(channels[:, :, c]) for c in range(channels.shape[2])]
    blocks += [spectral_features(x[:, :, c], hz) for c in range(6)]
    parts = x[:, :, :3], x[:, :, 3:6]
    blocks += [np.abs(part).sum(axis=2).mean(axis=1)[:, None] for part in parts]
    blocks += [_pearson(part[:, :, i], part[:, :, j])[:, None] for part in parts for i, j in ((0, 1), (1, 2), (0, 2))]
    for part in parts:
        size = np.linalg.norm(part, axis=2)
        blocks += [time_features(size), spectral_features(size, hz)]
    jerk = np.linalg.norm(np.diff(parts[0], axis=1) * hz, axis=2)
    blocks.append(time_features(jerk))
    return np.concatenate(blocks, axis=1)


def legacy_features(x: np.ndarray, hz: float) -> np.ndarray:
    """(n, 78) of windows (n, T, 6), aligned with gravity: nine statistics over time a channel, with crossings of zero, then four of the spectrum a channel.

    Skewness and kurtosis of a flat channel are NaN.
    """
    x, over_time = align(x), []
    for v in np.moveaxis(x, 2, 0):
        m, s = v.mean(axis=1), v.std(axis=1)
        d = v - m[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            skew, kurtosis = (d**3).mean(axis=1) / s**3, (d**4).mean(axis=1) / s**4 - 3
        over_time.append(np.column_stack([m, s, v.min(axis=1), v.max(axis=1), np.ptp(v, axis=1), np.sqrt((v**2).mean(axis=1)), skew, kurtosis, _crossings(v)]))
    return np.concatenate(over_time + [spectral_features(v, hz)[:, :4] for v in np.moveaxis(x, 2, 0)], axis=1)


#: Windows that are worked on and handed on at once, so that a task's Python holds no more of them however large the batches are.
_WINDOWS = 1000
#: Kinds of feature vectors by how long they are.
LAYOUTS = {193: lambda x, hz: window_features(x, hz, True), 171: lambda x, hz: window_features(x, hz, False), 78: legacy_features}


def _vectors(hz: float, length: int, chosen: Sequence[int] | None) -> Callable[[np.ndarray], np.ndarray]:
    """From windows (n, T, channels) to their vectors."""
    if length not in LAYOUTS:
        raise ValueError(f"no feature vector of {length}; known: {sorted(LAYOUTS)}")
    if chosen is not None and (not chosen or min(chosen) < 0 or max(chosen) >= length):
        raise ValueError("chosen must be places within the vector")
    kind, places = LAYOUTS[length], None if chosen is None else list(chosen)
    return lambda x: kind(x, hz) if places is None else kind(x, hz)[:, places]


def features(windows: DataFrame, hz: float, length: int = 193, channels: Sequence[str] = CHANNELS, chosen: Sequence[int] | None = None) -> DataFrame:
    """windows (an array column a channel, all of one length) with the arrays replaced by features, an array of doubles.

    length picks the kind of vector; chosen keeps the values at some places of it. Other lengths raise ValueError.
    """
    vectors, others = _vectors(hz, length, chosen), [c for c in windows.columns if c not in channels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), _WINDOWS):
                pdf = whole.iloc[a : a + _WINDOWS]
                x = np.stack([np.stack(pdf[c].to_numpy()) for c in channels], axis=2).astype(np.float64)
                yield pdf[others].assign(features=list(vectors(x)))

    types = dict(windows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), "features array<double>"])
    return windows.mapInPandas(run, schema)


def layout_of(model: object, meta: dict | None = None) -> tuple[int, list[int] | None]:
    """Which vector a model takes, and which places of it: from its own number of features (n_features_in_ or numFeatures) and the feature_select of its metadata.

    feature_select (indices, from_dim) is of models that were trained on some values of a longer vector: then from_dim
    tells the vector. A model that doesn't say takes the longest one. What fits no layout, or not together, raises ValueError.
    """
    expected = getattr(model, "n_features_in_", getattr(model, "numFeatures", None))
    said = (meta or {}).get("feature_select")
    if not said:
        length, chosen = max(LAYOUTS) if expected is None else int(expected), None
    else:
        try:
            chosen, length = [int(k) for k in said["indices"]], int(said["from_dim"])
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"feature_select needs indices and from_dim: {e}") from e
        if not chosen or min(chosen) < 0 or max(chosen) >= length:
            raise ValueError("feature_select has places outside of its vector, or none")
        if expected is not None and int(expected) != len(chosen):
            raise ValueError(f"the model takes {expected} values, and feature_select gives {len(chosen)}")
    if length not in LAYOUTS:
        raise ValueError(f"no feature vector of {length}; known: {sorted(LAYOUTS)}")
    return length, chosen



def strided_windows(samples: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, step: int, index: str = "window_idx", channels: Sequence[str] = CHANNELS) -> DataFrame:
    """keys, window_idx and an array a channel of each full window of `size` samples, one every `step`: what sliding_windows() and window_arrays() give.

    Sequences are cut by places within arrays as they come, so samples are sorted once and neither multiplied nor shuffled again, and a task's Python holds a batch and a window of them however long sequences are.
    """

    def arrays(found: list[np.ndarray]) -> list[pa.Array]:
        offsets = pa.array(np.arange(0, len(found[0]) + 1, size), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in found]

    return _cut(samples, keys, order, size, step, index, channels, channels, arrays)


def classified_windows(samples: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, step: int, hz: float, model, classes: Sequence[str], length: int = 193, chosen: Sequence[int] | None = None, minimum: float = 0.0, index: str = "window_idx") -> DataFrame:
    """What strided_windows(), features() and classify() give one after another, in one pass: neither windows nor vectors leave the task's one Python process."""
    vectors, probs_of = _vectors(hz, length, chosen), _probabilities(model, classes)

    def probs(found: list[np.ndarray]) -> list[pa.Array]:
        p = probs_of(vectors(np.stack([v.reshape(-1, size) for v in found], axis=2)))
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))]

    return _labelled(_cut(samples, keys, order, size, step, index, CHANNELS, ["probs"], probs), classes, minimum)


def _cut(samples: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, step: int, index: str, channels: Sequence[str], names: Sequence[str], arrays: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """keys, index and what `arrays` makes (names) of the channels of some windows at a time, a flat array each."""
    first = F.row_number().over(islands.ordered(keys, order)) == 1
    rows = samples.withColumn("_first", first).select(*keys, *[F.col(c).cast("double").alias(c) for c in channels], "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the sequence that goes on in the next batch: its rows from the next window's start on, that window's number, and how many rows are to come before that start.
        rest, number, ahead = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            held = rest.num_rows if rest is not None else 0
            begins = np.flatnonzero(table["_first"].to_numpy())
            begins = begins[begins >= held]
            goes_on = not len(begins) or begins[0] > 0
            if goes_on:
                begins = np.append(0, begins)
            base, skip = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
            if goes_on:
                base[0], skip[0] = number, ahead
            length = np.diff(np.append(begins, table.num_rows)) - skip
            count = np.maximum(0, (length - size) // step + 1)
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(begins + skip, count) + place * step
            place = place + np.repeat(base, count)
            values = [table[c].to_numpy() for c in channels]
            for a in range(0, len(place), _WINDOWS):
                k, r = place[a : a + _WINDOWS], row[a : a + _WINDOWS]
                at = (r[:, None] + np.arange(size)).ravel()
                own = table.select(list(keys)).take(pa.array(r)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(k, pa.int64()), *arrays([v[at] for v in values])], [*keys, index, *names])
            following = int(begins[-1] + skip[-1] + count[-1] * step)
            number, ahead = int(base[-1] + count[-1]), max(0, following - table.num_rows)
            left = table.slice(min(following, table.num_rows))
            rest = left.combine_chunks().to_batches()[0] if left.num_rows else None

    types = dict(samples.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{index}` long", *(f"`{c}` array<double>" for c in names)]))


def window_arrays(samples: DataFrame, keys: Sequence[str], index: str = "window_idx", position: str = "position", channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Rows of sliding_windows() as one row a window with an array a channel."""
    each = F.array_sort(F.collect_list(F.struct(position, *channels)))
    grouped = samples.groupBy(*keys, index).agg(each.alias("_s"))
    return grouped.select(*keys, index, *[F.col("_s")[c].cast("array<double>").alias(c) for c in channels])


def classify(vectors: DataFrame, model, classes: Sequence[str], minimum: float = 0.0) -> DataFrame:
    """vectors with probs in the order of classes, label and confidence. model has predict_proba(X) and classes_, in any order.

    A label of less confidence than minimum is null. The model goes to the tasks with the function.
    """
    probs_of = _probabilities(model, classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), _WINDOWS):
                pdf = whole.iloc[a : a + _WINDOWS]
                yield pdf.drop(columns="features").assign(probs=list(probs_of(np.stack(pdf["features"].to_numpy()))))

    types = dict(vectors.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in vectors.columns if c != "features"), "probs array<double>"])
    return _labelled(vectors.mapInPandas(run, schema), classes, minimum)


def _probabilities(model, classes: Sequence[str]) -> Callable[[np.ndarray], np.ndarray]:
    """From vectors to probabilities in the order of classes."""
    missing = set(classes) - {str(c) for c in model.classes_}
    if missing:
        raise ValueError(f"the model lacks {sorted(missing)}")
    order = [[str(c) for c in model.classes_].index(c) for c in classes]
    return lambda x: np.asarray(model.predict_proba(x))[:, order].astype(np.float64)


def _labelled(out: DataFrame, classes: Sequence[str], minimum: float) -> DataFrame:
    out = out.withColumn("confidence", F.array_max("probs"))
    label = F.element_at(F.array(*map(F.lit, classes)), F.array_position("probs", F.col("confidence")).cast("int"))
    return out.withColumn("label", F.when(F.col("confidence") >= minimum, label))


def _whole(value: object) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def geometry(meta: dict | None, device_hz: object, window_s: float = 2.0, overlap: float = 0.5) -> dict:
    """Rate, window and step in samples, and whether to resample.

    What the model's metadata says (hz, window_s or window_size, stride_s or stride) comes first; what they lack follows
    from the device's rate, window_s and overlap. Rates are whole numbers of hertz; a device whose rate can't be read is
    not resampled. Without any rate ValueError is raised.
    """
    said, own = dict(meta or {}), _whole(device_hz)
    hz = _whole(said.get("hz")) or own
    if not hz:
        raise ValueError(f"neither the model nor the device has a rate: {device_hz!r}")
    samples = lambda count, seconds: max(1, int(said.get(count) or round(seconds * hz)))
    window = samples("window_size", float(said.get("window_s") or window_s))
    step = samples("stride", float(said.get("stride_s") or window_s * (1.0 - overlap)))
    return {"hz": hz, "device_hz": own, "window": window, "step": step, "resample": own is not None and own != hz}
