"""Streams against the batch queries: the decoder at random cuts and after restarts, days once they are complete."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import decode, inference, islands
from strandline.streaming import completion, decoding, incremental

CLASSES = ("scratch", "active", "sleep", "shake")
DAY = 86_400_000


@pytest.fixture
def stateful(spark):
    spark.conf.set(*decoding.PROVIDER)
    yield spark
    spark.conf.unset(decoding.PROVIDER[0])


def test_online_viterbi_gives_the_whole_path():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 40, 400):
        for sharp in (0.3, 2.0):
            probs = rng.dirichlet([sharp] * 4, n)
            probs[rng.random(n) < 0.2] = 0.25  # ties
            want = decode.viterbi_paths(probs, np.array([0]), 3.0).tolist() if n else []
            decoder, got, open_windows = decoding.OnlineViterbi(4, 3.0), [], []
            for p in probs:
                got += decoder.push(p)
                # What is remembered is all that goes on.
                decoder = decoding.OnlineViterbi(4, 3.0, decoder.score.tolist(), np.array(decoder.back).ravel().tolist())
                open_windows.append(len(decoder.back))
            got += decoder.finish()
            assert got == want
            if n == 400:
                assert np.mean(open_windows) < 60


def windows(seed, devices=3, n=700):
    """device_id, ts_ms, day_ts, label, probs with long states, scratching, shakes, pauses and midnights."""
    rng = random.Random(seed)
    out = []
    for device in range(devices):
        ts, state, k = DAY - 120_000 + device * 10_000, "active", 0
        while k < n:
            state = rng.choice([c for c in CLASSES if c != state])
            for _ in range(rng.choice([1, 2, 3, 8, 30])):
                p = [rng.random() * 0.2 for _ in CLASSES]
                p[CLASSES.index(state)] += rng.choice([0.2, 0.6, 1.0])
                p = [x / sum(p) for x in p]
                out.append((device, ts, ts // DAY * DAY, CLASSES[p.index(max(p))], p))
                ts, k = ts + 500, k + 1
            if rng.random() < 0.06:
                ts += rng.choice([1500, 2500, 60_000])
    return out


SCHEMA = "device_id long, ts_ms long, day_ts long, label string, probs array<double>"


@pytest.mark.parametrize("seed", [1, 2])
def test_decoder_on_a_stream_equals_the_batch_query(stateful, tmp_path, seed):
    spark, rng = stateful, random.Random(seed)
    rows = windows(seed)
    df = islands.with_part(spark.createDataFrame(rows, SCHEMA), ("device_id", "day_ts"), "ts_ms", 2000)
    order = F.row_number().over(islands.ordered(("device_id", "day_ts", "part_ms"), ("ts_ms",))) - 1
    batch = inference.behaviour(df.withColumn("idx", order), CLASSES, 1000, 500).drop("behavior_label")
    # Rows come in about the order of time, in files of random sizes; a window may be late by some seconds.
    rows.sort(key=lambda r: r[1] + rng.randrange(8000))
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    files = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    files += [[(99, 30 * DAY, 30 * DAY, "sleep", [0.0, 0.0, 1.0, 0.0])], [(99, 30 * DAY + 500, 30 * DAY, "sleep", [0.0, 0.0, 1.0, 0.0])]]
    path = f"file://{tmp_path}/events"
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k % 2 == 1 or k >= len(files) - 2:  # sometimes two files at once; each time a new query goes on from the checkpoint
            stream = decoding.blocks(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), CLASSES, 1000, late="10 seconds")
            query = stream.writeStream.foreachBatch(decoding.store_behaviour(path, CLASSES)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            assert query.awaitTermination(300)
    names = sorted(batch.columns)
    key = lambda df: sorted(tuple(r[c] for c in names) for r in df.select(*names).collect())
    got, want = key(incremental.latest(spark, path, "day_ts").where("device_id < 99")), key(batch)
    assert len(want) > 60 and {r[names.index("behavior")] for r in want} == {1, 2, 3}
    assert got == want


def test_days_are_given_out_once_when_they_are_complete(stateful, tmp_path):
    """Europe/Berlin in 2024: the 31st of March has 23 hours, the 27th of October 25."""
    from datetime import datetime
    from zoneinfo import ZoneInfo

    spark, zone = stateful, ZoneInfo("Europe/Berlin")
    at = lambda *x: int(datetime(2024, *x, tzinfo=zone).timestamp() * 1000)
    hour, schema = 3_600_000, "device_id long, ts_ms long"
    days = [(1, at(3, 30)), (1, at(3, 31)), (2, at(3, 31)), (1, at(4, 1)), (2, at(10, 27)), (1, at(10, 28))]
    steps = [
        [(1, at(3, 30) + hour), (1, at(3, 31) + hour), (2, at(3, 31) + 5 * hour)],
        [(1, at(3, 31) + 20 * hour), (1, at(4, 1)), (None, at(4, 1)), (1, None)],
        [(2, at(10, 27)), (2, at(10, 27) + 24 * hour + 1)],
        [(1, at(3, 31) + hour), (1, at(10, 28))],  # too late to count
        [(3, at(12, 1))], [(3, at(12, 1) + 1)],
    ]
    seen = []
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = completion.completed_days(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), F.lit("Europe/Berlin"), late="0 seconds")
        query = stream.writeStream.foreachBatch(lambda df, n, k=k: seen.extend((k, r.device_id, r.day_ts, r.n_rows) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    assert sorted(x[1:3] for x in seen) == sorted(days) and len(seen) == len(days)
    counts = {x[1:3]: x[3] for x in seen}
    assert counts[1, at(3, 31)] == 2 and counts[2, at(10, 27)] == 2


def test_failed_days_are_run_again_three_times_and_none_is_lost(spark, tmp_path):
    calls = []

    def assess(days):
        rows = [(r.device_id, r.day_ts) for r in days.collect()]
        calls.append(sorted(rows))
        fails = {1: 99, 2: 2}  # device 1 always, device 2 twice
        out = [(d, t, None if sum((d, t) in c for c in calls) > fails.get(d, 0) else f"no {d}") for d, t in rows]
        return spark.createDataFrame([(d, t, None if e else 10 * d, e) for d, t, e in out], "device_id long, day_ts long, score long, error string")

    write = completion.assess_each_batch(f"file://{tmp_path}/t", assess)
    frame = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "device_id long, day_ts long, n_rows long")
    waits = lambda: {(r.device_id, r.day_ts): (r.retry_count, r.status) for r in completion.waiting_days(spark, f"file://{tmp_path}/t").collect()}
    write(frame([(1, 0), (2, 0), (3, 0)]), 0)
    assert waits() == {(1, 0): (1, "pending"), (2, 0): (1, "pending")}
    write(frame([(3, DAY)]), 1)
    assert calls[-1] == [(1, 0), (2, 0), (3, DAY)] and waits() == {(1, 0): (2, "pending"), (2, 0): (2, "pending")}
    write(frame([]), 2)
    assert waits() == {(1, 0): (3, "abandoned")}
    # The same batch again gives the same.
    calls.pop()
    write(frame([]), 2)
    assert waits() == {(1, 0): (3, "abandoned")}
    write(frame([(4, DAY)]), 3)
    assert calls[-1] == [(4, DAY)] and waits() == {(1, 0): (3, "abandoned")}
    got = incremental.latest(spark, f"file://{tmp_path}/t/results", "day_ts")
    assert sorted((r.device_id, r.day_ts, r.score) for r in got.collect()) == [(2, 0, 20), (3, 0, 30), (3, DAY, 30), (4, DAY, 40)]
