"""Decoding, intervals and signals on small cases with known results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays, scores, times, units
from strandline.operators import decode, intervals, islands, lookups, signal, upserts

BASE = 1_757_000_000_000
SMALL = ("scratch", "active", "sleep")
FULL = ("active", "sleep", "scratch", "not_worn", "shake")


def windows(spark, parts, classes, conf=0.95, step=1000):
    """parts: (class, how many windows[, confidence])."""
    rows, k = [], 0
    for c, n, *own in parts:
        for _ in range(n):
            p = own[0] if own else conf
            probs = [p if j == c else (1 - p) / (len(classes) - 1) for j in range(len(classes))]
            rows.append((1, k, BASE + k * step, classes[int(np.argmax(probs))], probs, None))
            k += 1
    return spark.createDataFrame(rows, "device_id long, idx long, ts_ms long, label string, probs array<double>, spec double")


def decoded(spark, parts, classes, algo="viterbi", window=2000, stride=1000, **kw):
    w = windows(spark, parts, classes, step=stride, **kw)
    stable = decode.stabilise(w, ["device_id"], ["idx"], classes, window, stride, algo=algo)
    return sorted((r.start_ms, r.end_ms, r.final, r.n_windows, r.conf_mean) for r in decode.segments(stable, ["device_id"], ["idx"], classes).collect())


def count(found, label):
    return sum(x[2] == label for x in found)


def test_viterbi_segments(spark):
    assert count(decoded(spark, [(1, 20), (0, 4), (1, 3), (0, 4), (1, 20)], SMALL), "scratch") == 1
    assert count(decoded(spark, [(1, 20), (0, 4), (1, 5), (0, 4), (1, 20)], SMALL), "scratch") == 2
    assert count(decoded(spark, [(1, 20), (0, 1), (1, 20)], SMALL, conf=0.6), "scratch") == 0
    found = decoded(spark, [(1, 10), (0, 4)], SMALL)
    assert [(a - BASE, b - BASE) for a, b, *_ in found] == [(0, 10_000), (10_000, 15_000)]
    found = decoded(spark, [(1, 20), (0, 1, 0.99), (0, 1, 0.6), (0, 1, 0.99), (0, 1, 0.6), (1, 20)], SMALL)
    assert [x[4] for x in found if x[2] == "scratch"] == [pytest.approx(0.795, abs=1e-3)]


def test_shakes_belong_to_the_scratch_they_touch(spark):
    found = decoded(spark, [(0, 20), (4, 2), (2, 6), (4, 2), (0, 20)], FULL, window=1000, stride=500)
    scratch = [x for x in found if x[2] == "scratch"]
    assert [(b - a) for a, b, *_ in scratch] == [5000]
    assert count(decoded(spark, [(0, 20), (3, 30), (0, 20)], FULL, window=1000, stride=500), "not_worn") == 1


def test_stable_differs_and_unknown_algorithms_fail(spark):
    rng = np.random.default_rng(0)
    parts = [(int(rng.integers(3)), 1, float(rng.uniform(0.4, 0.9))) for _ in range(120)]
    assert decoded(spark, parts, SMALL) != decoded(spark, parts, SMALL, algo="stable")
    with pytest.raises(ValueError, match="algo"):
        decode.stabilise(windows(spark, [(0, 1)], SMALL), ["device_id"], ["idx"], SMALL, 2000, 1000, algo="other")


def test_viterbi_path_against_all_paths():
    rng = np.random.default_rng(1)
    import itertools

    every = [rng.dirichlet([1, 1, 1], n) for n in (6, 1, 6, 3, 5, 2, 6, 6)]
    begins = np.cumsum([0, *map(len, every[:-1])])
    paths = np.split(decode.viterbi_paths(np.concatenate(every), begins, 3.0), begins[1:])
    for probs, path in zip(every, paths, strict=True):
        value = lambda path, probs=probs: sum(np.log(probs[k, c]) for k, c in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        best = max(map(value, itertools.product(range(3), repeat=len(probs))))
        assert value(path) == pytest.approx(best)
    assert len(decode.viterbi_paths(np.zeros((0, 3)), np.zeros(0, np.int64), 3.0)) == 0


def test_short_runs_are_absorbed_by_the_longer_neighbour():
    z = np.arange(12) * 1000
    labels = ["a"] * 5 + ["b"] * 1 + ["c"] * 4 + ["a"] * 2
    assert decode.absorb_short(labels, z, z + 1000, 3000) == ["a"] * 6 + ["c"] * 6
    assert decode.absorb_short(["a", "b"], z[:2], z[:2] + 1000, 500) == ["a", "b"]
    assert decode.absorb_short([], z[:0], z[:0], 500) == []
    rng = np.random.default_rng(7)
    for _ in range(200):
        labels = list(rng.choice(list("abc"), rng.integers(1, 40)))
        z = np.cumsum(rng.integers(1, 4, len(labels) + 1)) * 1000
        assert decode.absorb_short(labels, z[:-1], z[1:], 5000) == plain_absorb(labels, z[:-1].tolist(), z[1:].tolist(), 5000)


def plain_absorb(labels, z0, z1, least):
    labels = list(labels)
    while True:
        edges = [0] + [k for k in range(1, len(labels)) if labels[k] != labels[k - 1]] + [len(labels)]
        runs = list(zip(edges, edges[1:], strict=False))
        size = [z1[b - 1] - z0[a] for a, b in runs]
        k = min(range(len(runs)), key=size.__getitem__)
        if len(runs) == 1 or size[k] >= least:
            return labels
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(runs)]
        to = max(near, key=lambda j: (size[j], -j))
        for i in range(*runs[k]):
            labels[i] = labels[runs[to][0]]


def test_sequences_are_whole_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(d, k, BASE + k * 1000, [float(x) for x in rng.dirichlet([1, 1, 1])]) for d in range(30) for k in range(int(rng.integers(1, 60)))]
    df = spark.createDataFrame(rows, "d long, idx long, z0 long, probs array<double>").withColumn("z1", F.col("z0") + 1000)
    whole = sorted(map(tuple, decode.viterbi(df, ["d"], ["idx"], SMALL).select("d", "idx", "decoded").collect()))
    monkeypatch.setattr(decode, "ROWS_AT_ONCE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    assert sorted(map(tuple, decode.viterbi(df, ["d"], ["idx"], SMALL).select("d", "idx", "decoded").collect())) == whole
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == len(rows)
    assert decode.viterbi(df.limit(0), ["d"], ["idx"], SMALL).count() == 0


def test_a_split_bout_of_shaking_is_judged_as_one(spark):
    """Two shakes on both sides of a scratch: gaps tie the shakes together; each alone is too short to stay."""
    classes = ("active", "sleep", "scratch", "not_worn", "shake")
    # The scratch takes the shakes that touch it; those further off stay one bout with two windows.
    parts = [(0, 20), (4, 1, 0.6), (0, 2), (2, 6), (0, 2), (4, 1, 0.6), (0, 20)]
    w = windows(spark, parts, classes, step=1000)
    p = {c: F.col("probs")[k] for k, c in enumerate(classes)}
    marked = w.withColumn("z0", F.col("ts_ms")).withColumn("z1", F.col("ts_ms") + 1000).withColumn("_shake", F.col("idx").between(20, 31))
    marked = decode._bouts(marked, ["device_id"], ["idx"], "_shake", "_bout_shake", decode.StableParams()).withColumn("_shake", F.col("_shake") & (F.col("label") == "shake"))
    kept = decode._kept(marked, ["device_id"], "_shake", "_bout_shake", p["shake"], decode.StableParams(), None)
    assert sorted(r.idx for r in kept.where("_shake").collect()) == [20, 31]


def test_candidates_by_probability_and_by_spectrum(spark):
    parts = [(1, 5), (0, 1, 0.4), (0, 2, 0.35), (1, 6), (1, 3), (1, 5), (0, 4, 0.9), (1, 5)]
    w = windows(spark, parts, SMALL).withColumn("spec", F.when(F.col("idx").between(14, 16), 0.9).otherwise(0.1)).withColumn("z0", F.col("ts_ms")).withColumn("z1", F.col("ts_ms") + 1000)
    found = spark.createDataFrame([(1, BASE + 22_000, BASE + 26_000)], "device_id long, start_ms long, end_ms long")
    run = lambda **kw: sorted((r.start_ms - BASE, r.end_ms - BASE, r.n_windows, r.spec, r.reason) for r in decode.candidates(w, found, ["device_id"], ["idx"], F.col("probs")[0], spec="spec", **kw).collect())
    assert run() == [(5000, 8000, 3, 0.1, "low_conf")]
    assert run(params=decode.StableParams(candidate_spec_min=0.5)) == [(5000, 8000, 3, 0.1, "low_conf"), (14_000, 17_000, 3, 0.9, "spectral")]


def test_majority_and_gaps(spark):
    rows = [(1, k, c) for k, c in enumerate([2, 2, 2, 1, 2, 2, 2])] + [(2, 0, 2), (2, 1, 1)] + [(3, k, c) for k, c in enumerate([1, 2, 1, 2, 2])]
    df = spark.createDataFrame(rows, "d long, k long, c int")
    got = {(r.d, r.k): r.smoothed for r in islands.majority_smooth(df, ["d"], ["k"], "c").collect()}
    assert [got[1, k] for k in range(7)] == [2] * 7 and [got[2, k] for k in range(2)] == [2, 1]
    assert [got[3, k] for k in range(5)] == [1, 1, 2, 2, 2]
    w = spark.createDataFrame([(1, BASE + 1000 * k, 2, 0.9) for k in range(5)], "d long, ts long, c int, conf double")
    merged = islands.merge_windows(w, ["d"], ["ts"], "c", "ts", "conf", 2000, F.lit(2500)).collect()
    assert [(r.start_ms - BASE, r.end_ms - BASE, r.n_windows) for r in merged] == [(0, 6000, 5)]
    two = spark.createDataFrame([(1, 0, 2, 0.8), (1, 10_000, 2, 1.0)], "d long, ts long, c int, conf double")
    assert islands.merge_windows(two, ["d"], ["ts"], "c", "ts", "conf", 2000, F.lit(5000)).count() == 2
    assert [r.confidence for r in islands.merge_windows(two, ["d"], ["ts"], "c", "ts", "conf", 2000, F.lit(30_000)).collect()] == [0.9]


def test_intervals_against_brute_force(spark):
    rng = np.random.default_rng(3)
    segs = [(1, k, int(a), int(a + rng.integers(500, 9_000_000))) for k, a in enumerate(rng.integers(0, 50_000_000, 40))]
    cuts = np.sort(rng.choice(60_000_000, 40, replace=False))
    holes = [(1, int(a), int(b)) for a, b in cuts.reshape(-1, 2)]
    s = spark.createDataFrame(segs, "d long, id long, start_ms long, end_ms long")
    h = spark.createDataFrame(holes, "d long, hole_start long, hole_end long")
    want = []
    for _, k, a, b in segs:
        pieces = [(a, b)]
        for _, x, y in holes:
            pieces = [p for u, v in pieces for p in ([(u, v)] if y <= u or x >= v else [(u, min(x, v)), (max(y, u), v)]) if p[1] > p[0]]
        want += [(k, u, v) for u, v in pieces if v - u >= 1000]
    got = sorted((r.id, r.start_ms, r.end_ms) for r in intervals.subtract(s, h, ["d"], ["id"]).collect())
    assert got == sorted(want)
    pairs = sorted((r.id, r.hole_start) for r in intervals.overlap_join(s, h, ["d"], ("start_ms", "end_ms"), ("hole_start", "hole_end")).collect())
    assert pairs == sorted((k, x) for _, k, a, b in segs for _, x, y in holes if a < y and b > x)


def test_zones_resolve(spark):
    others = {"Foo/Bar": "UTC", "America/NewYork": "UTC", "america/new_york": "UTC", "ASIA/CHONGQING": "Asia/Shanghai", "PRC": "Asia/Shanghai", "China": "Asia/Shanghai", "BEIJING": "Asia/Shanghai", "Japan": "Japan", "Singapore": "Singapore", "EST5EDT": "EST5EDT", "CST-8": "-08:00", "UTC + 8": "+08:00", "gmt+5:45": "+05:45", "Etc/GMT-3": "Etc/GMT-3", "ETC/GMT+3": "UTC", "+14:30": "+14:30", "+9:75": "+10:15", "HST": "HST", "JST": "UTC"}
    both = spark.createDataFrame(list(others.items()), "n string, want string").select("n", "want", times.resolve_zone(F.col("n")).alias("z"))
    both = both.withColumn("clock", times.local_text(F.lit(BASE), F.col("z")))
    assert {r.n: r.z for r in both.where("clock is not null").collect()} == others
    names = ["UTC", " est ", "CST", "Asia/Shanghai", "+05:30", "UTC+8", "GMT+08", "", None, "nonsense", "+15:00", "Asia/Beijing", "America/Argentina/Buenos_Aires"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.z for r in df.select(times.resolve_zone(F.col("n")).alias("z")).collect()]
    assert got == ["UTC", "America/New_York", "America/New_York", "Asia/Shanghai", "+05:30", "+08:00", "+08:00", "UTC", "UTC", "UTC", "UTC", "Asia/Shanghai", "America/Argentina/Buenos_Aires"]
    parse = lambda text, zone: df.limit(1).select(times.parse_time(F.lit(text), F.lit(zone)).alias("t")).first().t
    assert parse("2026-08-19 10:00:00.000", "Asia/Shanghai") == 1_787_104_800_000
    assert parse("2026-08-19T10:00:00+00:00", "Asia/Shanghai") == parse("2026-08-19 10:00:00", "UTC")
    assert parse("1787104800000", "UTC") == 1_787_104_800_000 and parse("never", "UTC") is None
    start, end = df.limit(1).select(*times.day_range(F.lit("2024-11-03").cast("date"), F.lit("America/New_York"))).first()
    assert end - start == 25 * 3_600_000


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [value(scores.count_score(F.lit(z))) for z in (2.0, 4.0, 9.0, 0.0, -1.0)] == [12.5, 25, 25, 0, 0]
    assert [value(scores.night_score(F.lit(a), F.lit(b))) for a, b in ((0, 0), (1, 1), (2, 2), (3, 4), (6, 4))] == [0, 5, 8, 17, 20]
    assert [value(scores.temperature_score(F.lit(t), F.lit(0.0))) for t in (37.9, 38.5, 39.3, 40.0)] == [0, 2, 6, 10]
    assert value(scores.temperature_score(F.lit(40.0), F.lit(241.0))) == 0 and value(scores.temperature_score(F.lit(None).cast("double"), F.lit(0.0))) == 0
    assert [value(scores.level(F.lit(s))) for s in (0.0, 9.9, 10.0, 50.0, 99.0, 100.0)] == [0, 0, 1, 5, 9, 10]
    assert [value(scores.alert(F.lit(n))) for n in (0, 1, 2, 3, 4, 5, 10)] == [0, 0, 1, 2, 2, 3, 3]
    assert [value(scores.phase(F.lit(n))) for n in (2, 3, 13, 14, 29, 30)] == [0, 1, 1, 2, 2, 3]


def test_array_statistics(spark):
    def stats(x):
        s = arrays.time_stats(F.col("x"))
        return spark.createDataFrame([([float(v) for v in x],)], "x array<double>").select(*[c.alias(k) for k, c in s.items()]).first().asDict()

    flat = stats([5.0] * 50)
    assert (flat["mean"], flat["std"], flat["range"], flat["rms"], flat["skew"], flat["kurtosis"]) == (5, 0, 0, 5, 0, 0)
    assert stats([101.0, 99.0] * 25)["crossings"] == 49
    assert stats([1, 3, 2, 5, 5, 1, 2, 1])["peaks"] == 3
    x = np.random.default_rng(5).normal(size=40)
    got, want = stats(x), signal.time_features(x[None, :])[0]
    assert list(got.values()) == pytest.approx(want.tolist(), rel=1e-9)


def plain_resample(x, source, target):
    """One channel in plain numpy, counted in milliseconds."""
    step, times = 1000.0 / target, np.arange(len(x)) / source * 1000.0
    width = max(1, round(step / (1000.0 / source)))
    smooth = np.convolve(x, np.full(width, 1.0 / width), "same")[: len(x)]
    return np.interp(np.arange(times[0], times[-1], step), times, smooth)


def test_resampling(spark):
    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 7, 50, 249, 250, 251, 1000]
    rows = [(n, k, float(v)) for n in sizes for k, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "n long, k long, v double")
    for source, target in ((25.0, 16.0), (25.0, 25.0), (50.0, 25.0), (16.0, 25.0), (104.0, 26.0)):
        got = {}
        for r in signal.resample(df, ["n"], "k", source, target, ("v",)).orderBy("n", "sample").collect():
            got.setdefault(r.n, []).append((r.sample, r.v))
        for n in sizes:
            want = plain_resample(np.array([v for m, _, v in rows if m == n]), source, target)
            assert [k for k, _ in got.get(n, [])] == list(range(len(want)))
            if n >= source / target:
                assert [v for _, v in got.get(n, [])] == pytest.approx(want.tolist(), abs=1e-9)


def test_resampled_lengths(spark):
    """The number of samples for every length up to 4,000, from the places of the new samples alone."""
    for source, target in ((25.0, 16.0), (25.0, 25.0), (50.0, 25.0), (104.0, 26.0), (16.0, 25.0), (50.0, 16.0)):
        one = spark.range(4000).select(F.lit(1).alias("d"), F.col("id").alias("k"), F.lit(1.0).alias("v"))
        # Sample j lies after input k: so many samples there are for the sequence of k + 2 inputs at most.
        places = signal.resample(one, ["d"], "k", source, target, ("v",)).select("sample").orderBy("sample").collect()
        assert [r.sample for r in places] == list(range(len(places)))
        for n in range(2, 4000, 1 if (source, target) == (25.0, 16.0) else 37):
            times = np.arange(n) / source * 1000.0
            step = 1000.0 / target
            assert int(np.ceil(times[-1] / step)) == len(np.arange(0.0, times[-1], step))
        assert len(places) == len(np.arange(0.0, 3999 / source * 1000.0, 1000.0 / target))


def test_signal_kernels():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 50, 6))
    assert signal.window_features(x, 25.0).shape == (4, 193) and signal.window_features(x, 25.0, False).shape == (4, 171) and signal.legacy_features(x, 25.0).shape == (4, 78)
    assert len(signal.feature_names(True)) == 193 and len(signal.feature_names(False)) == 171
    wave = np.sin(2 * np.pi * 5 * np.arange(50) / 25)[None, :]
    assert abs(signal.spectral_features(wave, 25.0)[0, 2] - 5.0) <= 1.5
    shares = signal.spectral_features(rng.normal(size=(1, 50)), 25.0)[0, 4:]
    assert (shares >= 0).all() and 0.9 <= shares.sum() <= 1 + 1e-6
    up = signal.align(x + np.array([3.0, 4.0, 1.0, 0, 0, 0]))
    mean = up[:, :, :3].mean(axis=1)
    assert np.allclose(mean[:, :2], 0, atol=1e-9) and (mean[:, 2] > 0).all()
    freq, power = signal.welch(x[:, :, 0], 25.0)
    size, hann = 32, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    plain = []
    for a in (0, 16):
        part = x[0, a : a + size, 0]
        if len(part) == size:
            part = (part - part.mean()) * hann
            plain.append([abs(sum(part * np.exp(-2j * np.pi * k * np.arange(size) / size))) ** 2 / (25 * (hann**2).sum()) * (2 if 0 < k < 16 else 1) for k in range(17)])
    assert np.allclose(power[0], np.mean(plain, axis=0))
    assert signal.feature_names(True)[136:146] == ["sma_acc", "sma_gyro", "corr_acc_xy", "corr_acc_yz", "corr_acc_xz", "corr_gyro_xy", "corr_gyro_yz", "corr_gyro_xz", "acc_mag_mean", "acc_mag_std"]
    tone = np.sin(2 * np.pi * 4 * np.arange(64) / 16)[None, :]  # at half of 8 Hz: the second and third band meet at 3 and 6 Hz
    centre, spread, peak, _, *bands = signal.spectral_features(tone, 16.0)[0]
    assert peak == 4.0 and centre == pytest.approx(4.0, abs=0.05) and spread < 0.5 and bands[2] > 0.99


def test_geometry():
    keys = ("hz", "window", "step", "resample")
    of = lambda *a: tuple(signal.geometry(*a)[k] for k in keys)
    assert of({"hz": 16, "window_s": 1.0, "stride_s": 0.5}, 25) == (16, 16, 8, True)
    assert of({}, 25, 2.0, 0.5) == of(None, 25) == (25, 50, 25, False)
    assert of({"hz": 16, "window_s": 2.0, "stride_s": 1.0}, 25) == (16, 32, 16, True)
    assert of({"hz": 16, "window_s": 1.0}, 25, 2.0, 0.5) == (16, 16, 16, True)  # the step follows from the general window
    assert of({"hz": 16}, "unknown") == (16, 32, 16, False) and of({"hz": 16}, None) == (16, 32, 16, False)
    assert of({"hz": 16, "window_size": 20, "stride": 5}, 16) == (16, 20, 5, False)
    assert of({"hz": 1, "window_s": 0.1, "stride_s": 0.1}, 1) == (1, 1, 1, False)
    with pytest.raises(ValueError, match="rate"):
        signal.geometry({}, "unknown")


def test_classifier_columns_are_put_in_order(spark):
    class Model:
        classes_ = ["b", "a"]

        def predict_proba(self, x):
            return np.column_stack([x[:, 0], 1 - x[:, 0]])

    df = spark.createDataFrame([(1, [0.2]), (2, [0.9])], "id long, features array<double>")
    got = {r.id: (r.label, r.probs) for r in signal.classify(df, Model(), ["a", "b"]).collect()}
    assert got[1][0] == "a" and got[2][0] == "b" and got[1][1] == pytest.approx([0.8, 0.2])
    with pytest.raises(ValueError, match="lacks"):
        signal.classify(df, Model(), ["a", "z"])


def test_keyed_writes(spark):
    table = spark.createDataFrame([(1, 10, "a", None), (2, 20, "b", "x"), (None, 5, "n", "n")], "k long, v long, s string, c string")
    batch = spark.createDataFrame([(2, 21, None, None), (3, 30, "d", "y"), (3, 31, "e", "z"), (None, 6, "m", "m")], "k long, v long, s string, c string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(upserts.first_wins(table, batch, ["k"], [F.col("v")])) == sorted([(1, 10, "a", None), (2, 20, "b", "x"), (None, 5, "n", "n"), (3, 30, "d", "y"), (None, 6, "m", "m")], key=repr)
    got = rows(upserts.upsert(table, batch, ["k"], [F.desc("v")], keep=("c",), coalesce=("s",)))
    assert got == sorted([(1, 10, "a", None), (2, 21, "b", "x"), (3, 31, "e", "z"), (None, 5, "n", "n"), (None, 6, "m", "m")], key=repr)


def test_longest_match(spark):
    rules = spark.createDataFrame([("IMU1", 1, "A"), ("IMU10", 2, "B"), ("x", 3, "C")], "match string, rule_no int, device_id string")
    names = spark.createDataFrame([(1, "rec_IMU10.csv"), (2, "rec_imu1.csv"), (3, "zXz"), (4, "none")], "id long, name string")
    got = {r.id: r.device_id for r in lookups.longest_match(names, rules, "name", ("id",)).collect()}
    assert got == {1: "B", 2: "A", 3: "C"}


def test_units(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "ax double, ay double, az double")
    assert units.scale(df, "G", "dps", gyro=()).first().ax == 9.80665
    assert units.scale(df, "ms2", "rads", ("ax",), ("ay",), "g", "dps").first()[:2] == (1.0 / 9.80665, 2.0 * 57.29577951308232)
    said = units.diagnosis(df.selectExpr("1 as k", "9.7 as a", "3.0 as r").union(df.selectExpr("2", "1.02", "3.0")).union(df.selectExpr("3", "4.0", "3.0")), "k", F.col("a"), F.col("r"))
    assert {r.k: (r.unit, r.verdict, r.text) for r in said.collect()} == {1: ("ms2", "agrees", "median |acc| 9.700 looks like m/s², as set"), 2: ("g", "differs", "median |acc| 1.020 looks like g, set is m/s²"), 3: (None, "unknown", "median |acc| 4.000 fits neither m/s² nor g")}
    with pytest.raises(ValueError, match="unit"):
        units.factor("furlong", units.ACCELERATION)


def test_groups_in_pandas_keep_nulls(spark):
    df = pd.DataFrame({"d": [1, 1], "idx": [1, 0], "x": [2.0, 4.0]})
    out = signal.resample(spark.createDataFrame(df), ["d"], "idx", 2.0, 4.0, ("x",)).collect()
    assert [(r.sample, r.x) for r in sorted(out, key=lambda r: r.sample)] == [(0, 4.0), (1, 3.0)]


def test_centre_zones_and_gaps(spark):
    """Zones around centres leave gaps: one within a hysteresis bout ends nothing, and a shake over three seconds away is not taken in."""
    from strandline.operators import decode

    classes = ("scratch", "active", "shake")
    p = {"s": [0.9, 0.05, 0.05], "a": [0.1, 0.85, 0.05], "h": [0.1, 0.1, 0.8]}
    name = {"s": "scratch", "a": "active", "h": "shake"}

    def final(text, times, algo):
        rows = [(1, k, t, name[c], p[c]) for k, (c, t) in enumerate(zip(text, times, strict=True))]
        df = spark.createDataFrame(rows, "d long, idx long, ts_ms long, label string, probs array<double>")
        # A single sure window is no bout of its own here, so what is one bout shows.
        params = decode.StableParams(single=2.0, smooth_windows=1, min_state_ms=0)
        out = decode.stabilise(df, ("d",), ("idx",), classes, 1000, 500, params, algo, centre=True)
        return "".join({"scratch": "s", "active": "a", "shake": "h"}[r.final] for r in out.orderBy("idx").collect())

    near, far = [0, 500, 1000, 1500, 2000, 2500], [0, 500, 1000, 7000, 7500, 8000]
    assert final("aassaa", [0, 500, 1000, 7000, 7500, 8000], "stable") == "aassaa"  # one hysteresis run
    assert final("aassaa", [0, 500, 1000, 7000, 7500, 8000], "viterbi") == "aaaaaa"  # two bouts of one window each
    assert final("assh" + "aa", near, "stable") == "asssaa" and final("assh" + "aa", [0, 500, 1000, 5000, 5500, 6000], "stable")[3] != "s"
    assert final("aasshh", far[:2] + [6000, 6500, 7000, 7500], "viterbi") == "aassss"


def test_windows_by_places_are_those_by_rows(spark, monkeypatch):
    import random

    from strandline.operators import decode, islands, signal

    monkeypatch.setattr(signal, "_WINDOWS", 5)
    monkeypatch.setattr(decode, "ROWS_AT_ONCE", 40)
    rng = random.Random(9)
    rows = [(s, "x", k, *[rng.choice([None, rng.random()]) if s == 3 else rng.random() for _ in range(6)]) for s, n in enumerate([1, 7, 8, 9, 40, 41, 100, 0, 16]) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "d long, g string, k long, ax double, ay double, az double, gx double, gy double, gz double").repartition(3)
    keys = ("d", "g")
    for size, step in ((8, 4), (8, 8), (5, 3), (16, 20)):
        by_rows = signal.window_arrays(islands.sliding_windows(df, keys, ["k"], size, step), keys)
        by_places = signal.strided_windows(df, keys, ["k"], size, step)
        whole = lambda df: sorted(repr((r.d, r.g, r.window_idx, [list(r[c]) for c in signal.CHANNELS])).replace("None", "nan") for r in df.collect())
        assert whole(by_places) == whole(by_rows)
    assert signal.strided_windows(df.limit(0), keys, ["k"], 8, 4).count() == 0


def test_means_of_candidates_are_rounded_as_the_sql_does(spark, tmp_path):
    import duckdb
    from oracle import difference

    from strandline.plans import sequences

    values = [19, 21, 22, 15, 22, 23, 19, 16]  # their mean probability is a hair under 0.3971875, and 397187.5 once it is multiplied
    events = [(k, 1_704_672_000 + k, 1, "error", 1 + v / 100, "") for k, v in enumerate(values)]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(1,)], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("scratch_candidates", "surest_candidates"):
        assert [r.conf_mean for r in sequences.QUERIES[name](spark, str(tmp_path)).collect()] == [0.397188]
        assert difference(spark, con, str(tmp_path), sequences.QUERIES[name], sequences.ORACLES[name]) == ""


def test_stable_takes_few_sorts_and_tasks_by_rows(spark, capsys):
    assert decode.tasks_for(100, 4) == 4 and decode.tasks_for(36_000_000, 4) == 180
    w = windows(spark, [(1, 9), (2, 4), (0, 3), (2, 2), (0, 9)], FULL)
    run = lambda **kw: decode.stabilise(w, ["device_id"], ["idx"], FULL, 2000, 1000, algo="stable", **kw)
    assert sorted(map(tuple, run(tasks=7).collect())) == sorted(map(tuple, run().collect()))
    capsys.readouterr()
    run(tasks=7).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(device_id" in plan and ", 7), REPARTITION_BY_NUM" in plan
    assert plan.count("- Sort [") <= 5


@pytest.mark.parametrize("size,step", [(16, 8), (5, 5), (4, 7)])
def test_windows_are_cut_while_a_sequence_comes(spark, monkeypatch, size, step):
    import pyarrow as pa

    samples = spark.createDataFrame([], "d long, sample long, ax double, ay double, az double, gx double, gy double, gz double")
    caught = []
    monkeypatch.setattr(type(samples), "mapInArrow", lambda self, run, schema: caught.append(run))
    signal.strided_windows(samples, ["d"], ["sample"], size, step)

    lengths = [3, 60_000, size, 1, 20_000, 40, 17, 9_000]
    d = np.repeat(np.arange(len(lengths)), lengths)
    at = np.concatenate([np.arange(n) for n in lengths])
    taken = []

    def batches(many):
        table = pa.table({"d": d, **{c: (d * 1e6 + at) for c in signal.CHANNELS}, "_first": at == 0})
        for b in table.to_batches(max_chunksize=many):
            taken.append(b.num_rows)
            yield b

    wanted = [(s, k, s * 1e6 + k * step) for s, n in enumerate(lengths) for k in range(max(0, (n - size) // step + 1))]
    for many in (10_000, 13_001):
        taken.clear()
        out = caught[0](batches(many))
        first = next(out)
        assert len(taken) == 1  # the sequence of 60,000 samples is not waited for
        got = pa.Table.from_batches([first, *out])
        ax = np.stack(got["ax"].to_numpy())
        assert list(zip(got["d"].to_pylist(), got["window_idx"].to_pylist(), ax[:, 0].tolist())) == wanted
        assert (np.diff(ax, axis=1) == 1).all() and ax.shape[1] == size
    few = caught[0](b for b in pa.table({"d": d[:70], **{c: d[:70] * 1e6 + at[:70] for c in signal.CHANNELS}, "_first": at[:70] == 0}).to_batches(max_chunksize=3))
    assert [tuple(x) for r in few for x in zip(r["d"].to_pylist(), r["window_idx"].to_pylist())] == [(1, k) for k in range((67 - size) // step + 1)]
