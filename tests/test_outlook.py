"""Groups, patterns, nearest rows, rhythm, trends and faults against plain versions on random data."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from oracle import database, difference
from strandline.operators import cohorts, patterns, rhythm
from strandline.plans import outlook

DATA = "/root/testdata/sf0.01"
HOUR = 3_600_000


@pytest.mark.parametrize("name", list(outlook.QUERIES))
def test_against_sql(spark, name):
    assert difference(spark, database(DATA), DATA, outlook.QUERIES[name], outlook.ORACLES[name]) == ""


def test_group_baseline_falls_back(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.choice("xyz") if k % 9 else None, rng.choice("mn"), float(rng.randrange(50))) for k in range(120)]
    df = spark.createDataFrame(rows, "device long, size string, breed string, age string, v double")
    levels = ((("size", "breed", "age"), 9), (("size", "breed"), 17), (("size",), 60), ((), 0))
    got = {(r["size"], r.breed, r.age): (r.level, r.n_members, r.group_mean) for r in cohorts.group_baseline(df, "v", levels).collect()}
    assert set(got) == {r[1:4] for r in rows}
    for group, (level, n, mean) in got.items():
        for at, (columns, least) in enumerate(levels):
            own = [r[4] for r in rows if r[1 : 1 + len(columns)] == group[: len(columns)]]
            if len(own) >= least:
                assert (level, n) == (at, len(own)) and math.isclose(mean, statistics.mean(own))
                break
    assert {x[0] for x in got.values()} == {0, 1, 2}
    assert {r.level for r in cohorts.group_baseline(df, "v", ((("size", "breed", "age"), 99), (("size",), 99), ((), 0))).collect()} == {2}
    assert cohorts.group_baseline(df.limit(0), "v", levels).count() == 0


def test_ranks_and_intensity(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(6)])) for k in range(80)] + [(99, "alone", 1)]
    got = {r.id: r.percentile for r in cohorts.rank_within(spark.createDataFrame(rows, "id long, g string, v int"), ("g",), "v").collect()}
    for k, g, v in rows:
        others = [x for _, h, x in rows if h == g and x is not None]
        want = None if v is None else 0.0 if len(others) == 1 else sum(x < v for x in others) / (len(others) - 1)
        assert got[k] == want if want is None else math.isclose(got[k], want)
    bouts = [(1, float(x)) for x in range(100)] + [(2, 70.0), (2, 100.0), (2, 150.0)]
    kinds = {(r.d, r.p): (r.intensity, r.weight) for r in cohorts.intensity(spark.createDataFrame(bouts, "d long, p double"), "d", "p").collect()}
    assert [kinds[2, p][0] for p in (70.0, 100.0, 150.0)] == [0, 1, 2] and kinds[2, 150.0][1] == 2.5
    assert sorted(x[0] for k, x in kinds.items() if k[0] == 1) == [0] * 33 + [1] * 34 + [2] * 33


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(3)
    values = [rng.gauss(100, 30) for _ in range(20_000)]
    df = spark.createDataFrame([(k % 7, v) for k, v in enumerate(values)], "part long, v double").withColumn("d", F.lit(1))
    whole = cohorts.merge_sketches(cohorts.quantile_sketches(df, ("d", "part"), "v"), ("d",))
    for q in (0.33, 0.67):
        found = whole.select(F.kll_sketch_get_quantile_double("sketch", F.lit(q))).first()[0]
        assert abs(sum(v <= found for v in values) / len(values) - q) < 0.0166  # the rank error of k = 200, at 99 %


def plain_pattern(rows, steps):
    """For each row that ends a match, the latest rows before it, by trying all."""
    out = []
    for device in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == device)

        def latest(k, before):
            """The latest match of the first k + 1 steps that ends before `before`."""
            for _, ts, flags in reversed(own):
                if ts < before and flags[k]:
                    match = ending(k, ts)
                    if match:
                        return match
            return None

        def ending(k, ts):
            if k == 0:
                return [ts]
            match = latest(k - 1, ts)
            return [*match, ts] if match and ts - match[-1] <= steps[k] else None

        for _, ts, flags in own:
            if flags[-1]:
                match = ending(len(steps) - 1, ts)
                if match:
                    out.append((device, *match))
    return sorted(out)


def test_patterns_on_random_streams(spark):
    rng = random.Random(4)
    for _ in range(4):
        rows = [(rng.randrange(3), ts, [rng.random() < 0.3 for _ in range(3)]) for ts in rng.sample(range(400), 150)]
        steps = [0, rng.choice([2, 5, 20]), rng.choice([1, 6, 50])]
        df = spark.createDataFrame(rows, "device long, ts long, flags array<boolean>")
        found = patterns.ordered_pattern(df, ("device",), "ts", [(F.col("flags")[k], most) for k, most in enumerate(steps)])
        assert sorted((r.device, *r.times) for r in found.collect()) == plain_pattern(rows, steps)


def test_nearest_before_on_random_streams(spark):
    rng = random.Random(5)
    for most in (1, 7, 60):
        left = [(rng.choice([1, 2, None]), rng.randrange(-200, 300), k) for k in range(120)]
        right = [(rng.choice([1, 2, None]), rng.choice([None, *range(-200, 300)]), rng.randrange(9)) for _ in range(60)]
        found = patterns.nearest_before(spark.createDataFrame(left, "d long, t long, v long"), spark.createDataFrame(right, "d long, t long, v long"), ("d",), "t", most, "v", "near")
        want = []
        for d, t, k in left:
            own = max(((s, v) for e, s, v in right if e == d and s is not None and t - most <= s <= t), default=(None, None))
            want.append(repr((d, t, k, own[1], own[0])))
        assert sorted(repr((r.d, r.t, r.v, r.near, r.near_ts)) for r in found.collect()) == sorted(want)


def test_onsets_on_both_sides_of_midnight(spark):
    day = 24 * HOUR
    # Asleep at 23:00 and 1:00 by turns, eight hours each; a nap at 15:00.
    rows = [(1, n * day + (23 if n % 2 else 25) * HOUR, n * day + (23 if n % 2 else 25) * HOUR + 8 * HOUR) for n in range(8)] + [(1, n * day + 15 * HOUR, n * day + 16 * HOUR) for n in range(8)]
    nights = rhythm.main_sleep(spark.createDataFrame(rows, "d long, ts_start long, ts_end long"), "d", F.lit(0))
    got = sorted((r.night, r.wake - r.onset, r.n_runs, r.nap_ms) for r in nights.collect())
    assert got == [(n, 8 * HOUR, 2, HOUR) for n in range(8)]
    means = {r.night: r.onset_mean for r in rhythm.circadian(nights, "d", F.lit(0)).collect()}
    assert means[0] == pytest.approx(1.0) and min(means[1], 24 - means[1]) == pytest.approx(0, abs=1e-9)
    assert all(x > 23 or x <= 1 + 1e-9 for x in means.values())


def test_trends_with_missing_days(spark):
    import numpy as np

    rng = random.Random(6)
    days = sorted(rng.sample(range(20_000, 20_060), 40))
    rows = [(1, d, rng.choice([None, 0, 1, 5, 9])) for d in days]
    got = {r.day: r for r in rhythm.trends(spark.createDataFrame(rows, "d long, day long, v int"), "d", "day", "v", normal=F.col("v") == 0).collect()}
    for d in days:
        for span in (7, 30):
            own = [(x, v) for _, x, v in rows if d - span < x <= d and v is not None]
            want = np.polyfit([x - d for x, _ in own], [v for _, v in own], 1)[0] if len(own) > 1 else None
            assert got[d][f"trend_{span}d"] == (want if want is None else pytest.approx(want, abs=1e-9))
        zero = [x for _, x, v in rows if x <= d and v == 0]
        assert got[d].days_since_normal == (d - max(zero) if zero else None)


def test_faults(spark):
    rng = random.Random(7)
    rows = []
    for k in range(25 * 900):  # a quarter of an hour at 25 Hz
        s = k / 25
        ax = 1.0 if 100 <= s < 450 else 1 + rng.gauss(0, 0.2)
        gx = 0.0 if 200 <= s < 830 else rng.gauss(0, 5)
        rows.append((1, 1_700_000_000_000 + k * 40, ax, rng.gauss(0, 0.2), 16.0 if k % 5000 == 7 else 0.5 + rng.gauss(0, 0.2), gx, 0.0, 0.0))
    df = spark.createDataFrame(rows, "d long, ts long, ax double, ay double, az double, gx double, gy double, gz double")
    r = rhythm.faults(df, ("d",), "ts", ("ax", "ay", "az"), ("gx", "gy", "gz")).first()
    # 350 seconds without motion hold 51 spans of 300; up to seven noisy seconds at either end add too little; 630 silent ones hold 31 of 600.
    assert 51 <= r.n_flat_ax <= 66 and (r.n_flat_ay, r.n_flat_az, r.n_silent, r.n_saturated, r.n_seconds) == (0, 0, 31, 5, 900)
    order = spark.createDataFrame([(1, k, t) for k, t in enumerate([1, 3, 2, 2, 5, 4])], "d long, k long, ts long")
    assert rhythm.inversions(order, ("d",), "k", "ts").first().n_inversions == 2
