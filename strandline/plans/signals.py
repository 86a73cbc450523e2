"""Queries from samples to features and on to behaviour; and SQL that gives the same numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, times
from ..operators import inference, signal
from . import domain, sequences

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HZ = 16.0
#: An embedding of 64 numbers is a window: each channel begins at another place of it, in units that suit the sensor.
_CHANNELS = {"ax": (0, 3.0, 1.0), "ay": (16, 3.0, 0.0), "az": (32, 3.0, 9.0), "gx": (8, 40.0, 0.0), "gy": (24, 40.0, 0.0), "gz": (40, 40.0, 0.0)}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and six channels of 64 samples."""
    turned = lambda shift, by, more: F.transform(F.concat(F.slice("embedding", 1 + shift, 64 - shift), F.slice("embedding", 1, shift)), lambda v: v.cast("double") * by + more)
    return domain.table(spark, sf_dir, "embeddings").select("vec_id", *[turned(*how).alias(c) for c, how in _CHANNELS.items()])


def _long(vectors: DataFrame, names: list[str]) -> DataFrame:
    """A row for each feature, to six places; adding zero takes the sign off a zero."""
    each = vectors.select("vec_id", F.posexplode("features").alias("place", "value"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("place") + 1)
    return each.select("vec_id", "place", name.alias("name"), (F.round("value", 5) + 0.0).alias("value"))


# The SQL: windows, turned so that gravity is along z, then a series for each channel, angle and size, in long form.
_RAW = "w as (select vec_id, i, " + ", ".join(f"cast(embedding[(i + {shift}) % 64 + 1] as double) * {by} + {more} as {c}" for c, (shift, by, more) in _CHANNELS.items()) + " from (select vec_id, embedding, unnest(range(0, 64)) as i from embeddings))"
_TURN = "{x} - {z} * ux - (ux * ux * {x} + ux * uy * {y}) / d as {x}2, {y} - {z} * uy - (ux * uy * {x} + uy * uy * {y}) / d as {y}2, {z} + ux * {x} + uy * {y} - (ux * ux + uy * uy) * {z} / d as {z}2"
_ALIGNED = f"""{_RAW}, m as (select vec_id, avg(ax) as mx, avg(ay) as my, avg(az) as mz from w group by 1
), u as (select vec_id, mx / s as ux, my / s as uy, mz / s as uz, 1 + mz / s as d from (select *, sqrt(mx * mx + my * my + mz * mz) as s from m)
), t as (select vec_id, i, ax, ay, az, {_TURN.format(x="ax", y="ay", z="az")}, {_TURN.format(x="gx", y="gy", z="gz")} from w join u using (vec_id)
), al as (select *, (ax2 - lag(ax2) over n) * {HZ} as jx, (ay2 - lag(ay2) over n) * {HZ} as jy, (az2 - lag(az2) over n) * {HZ} as jz from t window n as (partition by vec_id order by i))"""
_SERIES = _ALIGNED + ", s as (" + " union all ".join(
    f"select vec_id, {k} as c, i, {x} as x from al"
    for k, x in enumerate(["ax2", "ay2", "az2", "gx2", "gy2", "gz2", "atan2(-ax, sqrt(ay * ay + az * az))", "atan2(ay, az)", "sqrt(ax2 * ax2 + ay2 * ay2 + az2 * az2)", "sqrt(gx2 * gx2 + gy2 * gy2 + gz2 * gz2)"])
) + " union all select vec_id, 10, i, sqrt(jx * jx + jy * jy + jz * jz) from al where i > 0)"
_TIME = """o as (select vec_id, c, avg(x) as m, stddev_pop(x) as sd, min(x) as lo, max(x) as hi, sqrt(avg(x * x)) as rms, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr from s group by 1, 2
), h as (select vec_id, c, avg(pow(x - m, 3)) / pow(any_value(sd), 3) as sk, avg(pow(x - m, 4)) / pow(any_value(sd), 4) - 3 as ku from s join o using (vec_id, c) group by 1, 2
), nb as (select vec_id, c, x, sign(x - {level}) as g, lag(sign(x - {level})) over n as pg, lag(x) over n as px, lead(x) over n as nx from s join o using (vec_id, c) window n as (partition by vec_id, c order by i)
), k as (select vec_id, c, count(*) filter (where g <> pg) as crossings, count(*) filter (where x > px and x > nx) as peaks from nb group by 1, 2
), ts as (select * from o join h using (vec_id, c) join k using (vec_id, c))"""
_SPECTRUM = f"""part as (select vec_id, c, seg, i - seg * 16 as j, x from s, range(0, 3) r(seg) where c in (0, 1, 2, 3, 4, 5, 8, 9) and i >= seg * 16 and i < seg * 16 + 32
), hann as (select vec_id, c, seg, j, (x - avg(x) over (partition by vec_id, c, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / 32)) as v from part
), dft as (select vec_id, c, seg, f, sum(v * cos(2 * pi() * f * j / 32)) as re, sum(v * sin(2 * pi() * f * j / 32)) as im from hann, range(0, 17) q(f) group by 1, 2, 3, 4
), psd as (select vec_id, c, f, avg((re * re + im * im) * case when f in (0, 16) then 1 else 2 end / ({HZ} * 12)) as p from dft group by 1, 2, 3
), share as (select vec_id, c, f * {HZ} / 32 as hz, f / 16.0 as part, p, p / (sum(p) over (partition by vec_id, c) + 1e-8) as q from psd
), mid as (select vec_id, c, sum(hz * q) as centre from share group by 1, 2
), fs as (select vec_id, c, any_value(centre) as centre, sqrt(sum(q * pow(hz - centre, 2))) as spread, arg_max(hz, p) as peak, -sum(q * ln(q + 1e-8)) as entropy, sum(q) filter (where part < 0.125) as b0,
  sum(q) filter (where part >= 0.125 and part < 0.375) as b1, sum(q) filter (where part >= 0.375 and part < 0.75) as b2, sum(q) filter (where part >= 0.75 and part < 1) as b3 from share join mid using (vec_id, c) group by 1, 2)"""
_STATS = ["m", "sd", "lo", "hi", "hi - lo", "rms", "sk", "ku", "crossings", "iqr", "peaks"]
_FREQ = ["centre", "spread", "peak", "entropy", "b0", "b1", "b2", "b3"]
_GLOBALS = [f"avg(abs({a}x2) + abs({a}y2) + abs({a}z2))" for a in "ag"] + [f"coalesce(corr({a}{x}2, {a}{y}2), 0)" for a in "ag" for x, y in ("xy", "yz", "xz")]


def _places(table: str, values: list[str], first: str, condition: str) -> str:
    """Rows vec_id, place, value out of one row a series."""
    return f"select vec_id, {first} + k as place, [{', '.join(f'cast({v} as double)' for v in values)}][k + 1] as value from (select *, unnest(range(0, {len(values)})) as k from {table} where {condition})"


def _vector_sql(tilted: bool) -> str:
    names, n = signal.feature_names(tilted), 8 if tilted else 6
    rows = [
        _places("ts", _STATS, "c * 11", f"c < {n}"), _places("fs", _FREQ, f"{11 * n} + c * 8", "c < 6"),
        _places(f"(select vec_id, {', '.join(f'{g} as g{k}' for k, g in enumerate(_GLOBALS))} from al group by 1)", [f"g{k}" for k in range(8)], str(11 * n + 48), "true"),
        _places("ts", _STATS, f"{11 * n + 56} + (c - 8) * 19", "c in (8, 9)"), _places("fs", _FREQ, f"{11 * n + 67} + (c - 8) * 19", "c in (8, 9)"), _places("ts", _STATS, str(11 * n + 94), "c = 10"),
    ]
    listed = ", ".join(f"'{x}'" for x in names)
    return f"with {_SERIES}, {_TIME.format(level='m')}, {_SPECTRUM} select vec_id, cast(place as integer) as place, [{listed}][place + 1] as name, round(value, 5) + 0.0 as value from ({' union all '.join(rows)})"


@query(_vector_sql(True))
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 193 features of each window, by place and name."""
    return _long(signal.features(windows(spark, sf_dir), HZ, 193), signal.feature_names(True))


@query(_vector_sql(False))
def window_features_untilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 171 features of windows without pitch and roll."""
    return _long(signal.features(windows(spark, sf_dir), HZ, 171), signal.feature_names(False))


_LEGACY = [x for x in _STATS if x not in ("iqr", "peaks")]


@query(f"""with {_SERIES}, {_TIME.format(level="0")}, {_SPECTRUM} select vec_id, cast(place as integer) as place, 'f' || place as name, round(value, 5) + 0.0 as value from (
{_places("ts", _LEGACY, "c * 9", "c < 6")} union all {_places("fs", _FREQ[:4], "54 + c * 4", "c < 6")})""")
def legacy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 78 features that older models take."""
    return _long(signal.features(windows(spark, sf_dir), HZ, 78), [f"f{k}" for k in range(78)])


_BOX = """b as (select device_id, stretch, idx, (value + lag(value, 1, 0) over n) / 2 as v, count(*) over (partition by device_id, stretch) as n from win window n as (partition by device_id, stretch order by idx)
), p as (select device_id, stretch, k as sample, k * 62.5 / 40 as pos from (select device_id, stretch, any_value(n) as n from b group by 1, 2), range(0, 100000) r(k) where k * 62.5 < (n - 1) * 40)"""


@query(f"""with {domain.WINDOWS_SQL}, {_BOX} select p.device_id, p.stretch, p.sample, round(x.v + (y.v - x.v) * (pos - floor(pos)), 9) as v
from p join b x on x.device_id = p.device_id and x.stretch = p.stretch and x.idx = floor(pos) join b y on y.device_id = p.device_id and y.stretch = p.stretch and y.idx = floor(pos) + 1""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as a signal of 25 Hz a sequence, at 16 Hz."""
    w = domain.windows(spark, sf_dir).withColumn("v", F.col("value"))
    return signal.resample(w, domain.SEQ, "idx", 25.0, 16.0, ("v",)).withColumn("v", F.round("v", 9))


# Readings: the embeddings of every twentieth number follow each other as a device's samples at 25 Hz, in g and radians a second; a pause comes after every few.
PARTS, PAUSE_MS = 7, 600_000
DEVICES, BASE_MS, CLASSES = 20, 1_704_067_200_000, domain.CLASSES
MODEL = {"hz": 16, "window_s": 1.0, "stride_s": 0.5}
#: Weights of 1, spread of the size of acceleration, and mean size of rotation, by class.
WEIGHTS = ((-21.24, 36.0, 2.4), (-13.9, 0.0, 2.7), (16.47, -30.0, -1.8), (2.05, 45.0, -2.7))


class LinearModel:
    """Stands in for a trained classifier: probabilities are a softmax of weighed features."""

    classes_ = list(CLASSES)

    def __init__(self) -> None:
        names = signal.feature_names(True)
        self.places = [names.index("acc_mag_std"), names.index("gyro_mag_mean")]

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        w = np.array(WEIGHTS)
        e = np.exp(w[:, 0] + x[:, self.places] @ w[:, 1:].T)
        return e / e.sum(axis=1, keepdims=True)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device_id, ts_ms, day_ts (of the device's zone), six channels."""
    w = windows(spark, sf_dir).withColumn("device_id", F.pmod("vec_id", F.lit(DEVICES)))
    zipped = F.arrays_zip(*signal.CHANNELS)
    each = w.select("device_id", F.floor(F.col("vec_id") / DEVICES).alias("part"), F.posexplode(zipped).alias("i", "s"))
    ts = (BASE_MS + F.col("device_id") * 3_600_000 + (F.col("part") * 64 + F.col("i")) * 40 + F.floor(F.col("part") / PARTS) * PAUSE_MS).cast("long")
    scale = {c: F.col(f"s.{c}") / (9.80665 if c[0] == "a" else 57.29577951308232) for c in signal.CHANNELS}
    flat = each.select("device_id", ts.alias("ts_ms"), *[x.alias(c) for c, x in scale.items()])
    return inference.by_local_day(flat, times.resolve_zone(domain.zone_of(F.col("device_id"))))


_LOCAL = "epoch_ms(timezone('UTC', timezone(zone, date_trunc('day', timezone(zone, timezone('UTC', make_timestamp({0} * 1000)))))))"
_SAMPLES = f"""{_RAW}, s0 as (
  select *, {_LOCAL.format("ts")} as day_ts from (select *, {domain.ZONE_SQL} as zone from (
    select vec_id % {DEVICES} as device_id, {BASE_MS} + vec_id % {DEVICES} * 3600000 + (vec_id // {DEVICES} * 64 + i) * 40 + vec_id // {DEVICES} // {PARTS} * {PAUSE_MS} as ts, ax, ay, az, gx, gy, gz from w))
), sm as (select *, max(case when before is null or ts - before > 2000 then ts end) over (partition by device_id, day_ts order by ts) as t0 from (select *, lag(ts) over (partition by device_id, day_ts order by ts) as before from s0)
), nu as (select *, row_number() over n - 1 as k, """ + ", ".join(f"({c} + lag({c}, 1, 0) over n) / 2 as f{c}" for c in _CHANNELS) + f""" from sm window n as (partition by device_id, t0 order by ts)
), st as (select device_id, t0, day_ts, count(*) as n from sm group by 1, 2, 3
), rs as (select device_id, day_ts, t0, j, j * 62.5 / 40 as pos from st, range(0, 100000) r(j) where j * 62.5 < (n - 1) * 40
), re as (select rs.device_id, rs.day_ts, rs.t0, j, """ + ", ".join(f"x.f{c} + (y.f{c} - x.f{c}) * (pos - floor(pos)) as {c}" for c in _CHANNELS) + f""" from rs
  join nu x on x.device_id = rs.device_id and x.t0 = rs.t0 and x.k = floor(pos) join nu y on y.device_id = rs.device_id and y.t0 = rs.t0 and y.k = floor(pos) + 1
), wi as (select device_id, day_ts, t0, k as idx, stddev_pop(sqrt(ax * ax + ay * ay + az * az)) as sa, avg(sqrt(gx * gx + gy * gy + gz * gz)) as mg from re, range(0, 100000) q(k) where j >= k * 8 and j < k * 8 + 16 group by 1, 2, 3, 4 having count(*) = 16
), ex as (select *, """ + ", ".join(f"exp({a} + {b} * sa + {c} * mg) as x{k}" for k, (a, b, c) in enumerate(WEIGHTS)) + """ from wi
), pr as (select *, [x0 / (x0 + x1 + x2 + x3), x1 / (x0 + x1 + x2 + x3), x2 / (x0 + x1 + x2 + x3), x3 / (x0 + x1 + x2 + x3)] as p from ex
), win as (select device_id, day_ts, t0 as stretch, idx, t0 + idx * 500 as ts_ms, ['scratch', 'active', 'sleep', 'shake'][list_position(p, list_max(p))] as label, 0.0 as missing, p[1] as p_scratch, p[2] as p_active, p[3] as p_sleep, p[4] as p_shake from pr)"""
_CLASSIFIED = sequences._VITERBI.replace(domain.WINDOWS_SQL, _SAMPLES)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.classified_windows(readings(spark, sf_dir), LinearModel(), CLASSES, MODEL, 25.0, acc_unit="g", gyro_unit="rads")


@query(f"with {_SAMPLES} select device_id, day_ts, stretch as part_ms, idx, ts_ms, label, round(greatest(p_scratch, p_active, p_sleep, p_shake), 6) as confidence from win")
def classified_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a device's local day to classes of windows: units, resampling, features, a model."""
    return _classified(spark, sf_dir).select("device_id", "day_ts", "part_ms", "idx", "ts_ms", "label", scores.round_half(F.col("confidence"), 6).alias("confidence"))


_BEHAVIOUR = f"{_CLASSIFIED}, {sequences._FLAGS}, {sequences._PAINT}, beh as ({sequences._SEGMENTS})".replace("ts_ms + 2000", "ts_ms + 1000").replace("round(avg(p[list_position(['scratch', 'active', 'sleep', 'shake'], final)]), 6)", "round_even(avg(p[list_position(['scratch', 'active', 'sleep', 'shake'], final)]), 4)")


@query(f"""{_BEHAVIOUR}, coded as (
  select b.device_id, day_ts, start_ms as ts_start, end_ms as ts_end, case label when 'scratch' then 3 when 'sleep' then 2 else 1 end as behavior, cast(conf_mean as double) as confidence, n_windows
  from beh b join (select distinct device_id, t0, day_ts from sm) d on d.device_id = b.device_id and d.t0 = b.stretch
{sequences.JOINED.replace(" from behavior window", " from coded window").replace("any_value(behavior) as behavior, list", "any_value(behavior) as behavior, cast(sum(n_windows) as bigint) as n_windows, list")}
select device_id, day_ts, behavior, f.s as ts_start, f.e as ts_end, f.c as confidence, n_windows from g""")
def behaviour_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from readings to intervals of behaviour by local day, in stretches without a pause; touching intervals of one code are joined."""
    return inference.behaviour(_classified(spark, sf_dir), CLASSES, 1000, 500).drop("behavior_label")
