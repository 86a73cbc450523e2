"""Queries against their SQL, readers, streams and the baseline."""

import json

import pytest
from pyspark.sql import functions as F

from oracle import database, difference
from strandline.functions import scores, times
from strandline.operators import assessment, rollup, upserts
from strandline.plans import catalog
from strandline.sources import imports, readers, sinks
from strandline.streaming import incremental

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(DATA)


@pytest.mark.parametrize("name", ["daily_assessment", "ewma_soft_freeze", "interval_subtract", "bout_merge", "upsert_merge", "longest_match", "time_stats", "prf_metrics", "timezone_day_key", "sliding_windows"])
def test_query_agrees_with_its_sql(spark, con, name):
    assert difference(spark, con, DATA, catalog.QUERIES[name], catalog.ORACLES[name]) == ""


def test_wear_and_rollup(spark):
    hour = 3_600_000
    rows = [(1, 0, 0, 400 * 60_000, 2, 0.9), (1, 0, 10 * hour, 10 * hour + 200 * 60_000, 1, 0.9), (1, 0, 15 * hour, 20 * hour, 4, 0.9), (2, 0, 0, 24 * hour, 4, 0.5), (3, 0, 0, 600_000, 0, None), (3, 0, hour, hour + 20_000, 3, None)]
    b = spark.createDataFrame(rows, "device_id long, day_ts long, ts_start long, ts_end long, behavior int, confidence double")
    assert {r.device_id: r.wear_minutes for r in rollup.wear_minutes(b).collect()} == {1: 600, 2: 0, 3: 10}
    three = rollup.daily(b).where("device_id = 3").first()
    assert (three.scratch_count, three.wpeb_score, three.night_scratch_count) == (1, 1.5, 1)


def test_far_off_days_do_not_move_the_baseline(spark):
    state = spark.createDataFrame([(1, 10.0, 1.0, 5), (2, 10.0, 1.0, 5)], "device_id long, baseline_mean double, wpeb_mean double, valid_days int")
    rows = spark.createDataFrame([(1, 1, 20, 0.5, 1.0), (1, 2, 20, 1.5, 1.0), (1, 3, 90, 2.5, 1.0)], "device_id long, day_ts long, scratch_count int, zscore double, wpeb_score double")
    got = {r.device_id: (r.baseline_mean, r.valid_days) for r in assessment.ewma(rows, state).collect()}
    assert got[1] == (pytest.approx(0.97 * 11 + 0.03 * 20), 7) and got[2] == (10.0, 5)


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a_infer.json").write_text(json.dumps({"windows": [{"ts": "2026-08-19 10:00:00.000", "label": "scratch", "conf": 0.9}, {"ts": "1", "label": "not_worn", "conf": 1}]}))
    (tmp_path / "bad_infer.json").write_text("{nothing")
    got = readers.inference_json(spark, f"file://{tmp_path}").collect()
    assert [(r.ts_ms, r.behavior, r.confidence) for r in got] == [(1_787_133_600_000, 3, 0.9)]
    (tmp_path / "w.csv").write_text("﻿device_sn,ts,label,conf\nA,5000,sleep,0.5\n")
    kind, df = readers.inference_csv(spark, f"file://{tmp_path}/w.csv")
    assert kind == "windows" and [tuple(r) for r in df.collect()] == [("A", 5000, 2, 0.5)]
    (tmp_path / "e.csv").write_text("device_sn,start_ts,end_ts,label,conf\nA,1,2,scratch,1\n")
    assert readers.inference_csv(spark, f"file://{tmp_path}/e.csv")[0] == "events"
    (tmp_path / "l.csv").write_text("ts,label,conf\n1000, sleep ,\n2000,not_worn,1\n3000,other,1\n4000,scratch,0.25\n")
    assert [tuple(r) for r in readers.inference_csv(spark, f"file://{tmp_path}/l.csv")[1].collect()] == [("", 1000, 2, 0.0), ("", 4000, 3, 0.25)]
    (tmp_path / "empty.csv").write_text("ts,label\n")
    kind, none = readers.inference_csv(spark, f"file://{tmp_path}/empty.csv")
    assert (kind, none.count()) == ("windows", 0)
    (tmp_path / "n_infer.json").write_text(json.dumps({"windows": [{"ts": "5", "label": "睡觉"}]}))
    (tmp_path / "daily_scratch_stats_infer.json").write_text(json.dumps({"windows": [{"ts": "6", "label": "睡觉"}]}))
    assert sorted((r.ts_ms, r.behavior, r.confidence) for r in readers.inference_json(spark, f"file://{tmp_path}").collect()) == [(5, 2, 0.0), (1_787_133_600_000, 3, 0.9)]
    (tmp_path / "z.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="neither"):
        readers.inference_csv(spark, f"file://{tmp_path}/z.csv")
    with pytest.raises(Exception, match="no time"):
        readers.windows_of(spark.createDataFrame([(("noon", "sleep", 1.0),)], "w struct<ts: string, label: string, conf: double>")).collect()
    assert {r.file.rsplit("/")[-1]: r.kind for r in readers.kinds_of_csv(spark, f"file://{tmp_path}").collect()} == {"w.csv": "windows", "e.csv": "events", "z.csv": "unknown", "l.csv": "windows", "empty.csv": "windows"}
    pool = spark.createDataFrame([("sleep", 2, [0.5, 1.0, -2.0])], "label string, label_int int, features array<double>")
    readers.write_feature_pool(pool, f"file://{tmp_path}/pool", 3)
    assert [tuple(r) for r in readers.feature_pool(spark, f"file://{tmp_path}/pool").collect()] == [("sleep", 2, [0.5, 1.0, -2.0])]
    env = spark.createDataFrame([("a", 1, "1.5", None, "x"), ("a", 2, "2.5", "", "36"), ("b", 1, "x", "", None)], "device_sn string, ts_ms long, env_temp string, env_humidity string, neck_temp string")
    marks = spark.createDataFrame([("a", 1)], "device_sn string, last_env_ts long")
    assert [tuple(r) for r in readers.environment_after(env, marks).collect()] == [("a", 2, 2.5, None, 36.0)]
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, 6), ("c", 3, 7)], "device_sn string, ts_ms long, x int")
    for every in (None, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "device_sn string"), spark.createDataFrame([("a",)], "device_sn string")):
        for known in ([("a", 1)], [], [("a", 9), ("b", 1), ("c", 2), ("d", 4)]):
            marks = spark.createDataFrame(known, "device_sn string, last_processed_ts long")
            want = [(s, t) for s, t in (("a", 1), ("a", 2), ("b", 1), ("c", 3)) if t > dict(known).get(s, 0) and (every is None or every.count() > 1 or s in ("a", *dict(known)))]
            assert sorted((r.device_sn, r.ts_ms) for r in readers.after(rows, marks, "device_sn", "ts_ms", devices=every).collect()) == want
    body = json.dumps({"samples": [{"ts": 2, "ax": 1}, {"ts": 1, "ax": 3}]})
    rows = readers.request(spark.createDataFrame([(1, body), (2, "{}")], "id long, body string"), "body").collect()
    assert [(r.id, r.sample, r.ts_ms, r.ax) for r in rows] == [(1, 0, 1, 3.0), (1, 1, 2, 1.0)]
    battery = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 1, 1)], "device_sn string, ts_ms long, charging int")
    assert {r.device_sn: r.charging for r in readers.charging(battery).collect()} == {"a": False, "b": True}


def test_import_of_a_mixed_folder(spark, tmp_path):
    files = {
        "a/w1.csv": "device_sn,ts,label,conf\nA,1000,sleep,0.5\nA,2000,scratch,\n",
        "a/w2.csv": "\ufefflabel,conf,ts,more\nscratch,0.25,20260819T1000,x\nother,none,never,y\n",
        "b/e.csv": "start_ts,end_ts,label,conf,device_sn\n1,5,sleep,1,B\n7,9,睡觉,0.5,\n",
        "b/bad_time.csv": "ts,label\n1000,sleep\nnoon,sleep\n", "bad_number.csv": "ts,label,conf\n1000,sleep,much\n", "bad_header.csv": "x,y\n1,2\n", "none.csv": "ts,label\n", "daily_scratch_stats.csv": "x\n1\n",
        "a/x_infer.json": json.dumps({"windows": [{"ts": "2026-08-19T10:00:00+08:00", "label": "active", "conf": 0.5}, {"ts": "?", "label": "other"}]}),
        "y_infer.json": "{nothing", "z_infer.json": json.dumps({"windows": [{"ts": "5", "label": "sleep"}, {"label": "sleep"}]}), "n_infer.json": json.dumps({"windows": []}), "o_infer.json": "{}",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = imports.read_folder(spark, f"file://{tmp_path}", "Asia/Shanghai")
    name = lambda r: r.file.rsplit("/")[-1]
    at = 1_787_104_800_000
    assert sorted((name(r), r.device_sn, r.ts_ms, r.behavior, r.confidence) for r in found.windows.collect()) == [("w1.csv", "A", 1000, 2, 0.5), ("w1.csv", "A", 2000, 3, 0.0), ("w2.csv", "", at, 3, 0.25), ("x_infer.json", "", at, 1, 0.5)]
    assert sorted((name(r), r.device_sn, r.ts_start, r.ts_end, r.behavior, r.confidence) for r in found.events.collect()) == [("e.csv", "", 7, 9, 2, 0.5), ("e.csv", "B", 1, 5, 2, 1.0)]
    problems = {name(r): r.error for r in found.problems.collect()}
    assert problems.pop("bad_header.csv").startswith("neither") and problems == {"bad_time.csv": "no time: noon", "bad_number.csv": "no number: much", "y_infer.json": "no JSON", "z_infer.json": "no time: "}
    assert imports.read_folder(spark, f"file://{tmp_path}", csv=False).events.count() == 0
    with pytest.raises(ValueError, match="both"):
        readers.inference_csv(spark, f"file://{tmp_path}/[ab]/[we]*.csv")


def test_times_as_iso_writes_them(spark):
    from datetime import datetime, timezone

    texts = ["2026-08-19", "20260819T100501", "2026-08-19 10", "2026-08-19T10:05", "2026-08-19 10:05:01,25", "2026-08-19T10:05:01.123456789", "2026-W34-3", "2026W343T10", "2026-W53", "2020-W53-7", "2026-08-19T10:05:01Z", "2026-08-19T10:05+08", "20260819T1005-0330", "2026-08-19 10:05:01.5+05:45:30"]
    wrong = ["", "noon", "2026-13-01", "2026-02-30", "2026-08-19T25:00", "2026-08-19T10:60", "2026-W54-1", "2026-W10-8", "10:05", "2026-0819"]
    got = spark.createDataFrame([(t,) for t in texts + wrong], "t string").select("t", times.parse_time(F.col("t"), F.lit("UTC")).alias("ms")).collect()

    def plain(text):
        when = datetime.fromisoformat(text)
        return int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() * 1000)

    for r in got:
        try:
            want = plain(r.t)
        except ValueError:
            want = None
        assert r.ms == want, r


def run_stream(spark, df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(out)


def test_windows_go_on_across_batches(spark, tmp_path):
    schema = "device_id long, ts_ms long, value double"
    for k in range(3):
        spark.createDataFrame([(1, 10 * k + j, float(10 * k + j)) for j in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.window_idx, r.start_ms, r["mean"]) for r in run_stream(spark, incremental.count_windows(stream, 5, 3), tmp_path).collect())
    values = [10 * k + j for k in range(3) for j in range(4)]
    assert got == [(i, values[3 * i], sum(values[3 * i : 3 * i + 5]) / 5) for i in range(3)]


def test_streamed_days_and_repeats(spark, tmp_path):
    schema = "device_id long, ts_start long, ts_end long, behavior int, event_time timestamp"
    hour = 3_600_000
    day = 1_704_067_200_000
    rows = [(1, day + k * hour, day + k * hour + 60_000, 3) for k in range(30)] + [(1, day, day + 60_000, 3), (1, day + 90 * hour, day + 90 * hour, 1)]
    df = spark.createDataFrame(rows, "device_id long, ts_start long, ts_end long, behavior int").withColumn("event_time", F.timestamp_millis("ts_start"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    (tmp_path / "a").mkdir()
    assert run_stream(spark, incremental.first_events(stream()), tmp_path / "a").count() == 31
    (tmp_path / "b").mkdir()
    got = {r.day_ts: r.n for r in run_stream(spark, incremental.daily_counts(stream()), tmp_path / "b").collect()}
    assert got == {day: 25, day + 86_400_000: 6}


def test_errors_are_rows_and_are_retried(spark):
    errors = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (3, 0, None)], "device_id long, day_ts long, error string")
    before = spark.createDataFrame([(2, 0, 2), (3, 0, 1)], "device_id long, day_ts long, retry_count int")
    got = {r.device_id: (r.retry_count, r.status) for r in incremental.retry_table(errors, before).collect()}
    assert got == {1: (1, "pending"), 2: (3, "abandoned")}
    # A day that was not run this time waits on.
    before = spark.createDataFrame([(4, 0, 1, "old"), (5, 0, 3, "old"), (1, 0, 1, "old")], "device_id long, day_ts long, retry_count int, error string")
    got = {r.device_id: (r.retry_count, r.status, r.error) for r in incremental.retry_table(errors, before).collect()}
    assert got == {1: (2, "pending", "x"), 2: (1, "pending", "x"), 4: (1, "pending", "old"), 5: (3, "abandoned", "old")}

    def run(pdf):
        if pdf["d"].iloc[0] == 2:
            raise KeyError("no")
        return pdf

    df = spark.createDataFrame([(1, 1.0), (2, 1.0)], "d long, x double")
    out = {r.d: r.error for r in df.groupBy("d").applyInPandas(incremental.with_errors(run, ("d",), ["d", "x"]), "d long, x double, error string").collect()}
    assert out[1] is None and out[2].startswith("KeyError")


def test_upserts_of_micro_batches_touch_their_days_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    batches = [[(1, 10, "a"), (2, 10, "b")], [(1, 20, "c")], [(2, 10, "B"), (3, 10, "d")], []]
    schema = "device_id long, day_ts long, value string"

    def merge(before, batch):
        return batch if before is None else upserts.upsert(before, batch, ("device_id", "day_ts"), [F.col("value")])

    write = incremental.upsert_each_batch(f"file://{path}", merge)
    rows = lambda: sorted((r.device_id, r.day_ts, r.value) for r in incremental.latest(spark, f"file://{path}", "day_ts").collect())
    for number, rows_in in zip((0, 3, 4, 5), batches, strict=True):  # versions in between are missing
        write(spark.createDataFrame(rows_in, schema), number)
    want = [(1, 10, "a"), (1, 20, "c"), (2, 10, "B"), (3, 10, "d")]
    assert rows() == want
    write(spark.createDataFrame(batches[2], schema), 4)  # again after a failure
    assert rows() == want
    assert sorted(p.name for p in (tmp_path / "table" / "v=4").iterdir() if p.is_dir()) == ["day_ts=10"]
    assert incremental.drop_old_versions(spark, f"file://{path}", "day_ts", keep=0) == 1 and rows() == want


def test_polling_keeps_clocks_that_are_ahead_apart(spark, tmp_path):
    schema = "device_id long, ts_ms long"
    spark.createDataFrame([(1, 1000), (1, 2000), (2, 1 << 50)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    go = lambda: incremental.poll(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda rows, n: seen.extend((n, r.device_id, r.ts_ms) for r in rows.collect()), str(tmp_path / "c"), quarantine=f"file://{tmp_path}/q", available_now=True)
    assert go().awaitTermination(120)
    assert sorted(seen) == [(0, 1, 1000), (0, 1, 2000)]
    assert [r.device_id for r in spark.read.parquet(f"file://{tmp_path}/q").collect()] == [2]
    spark.createDataFrame([(3, 5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert go().awaitTermination(120)
    assert sorted(seen)[2:] == [(1, 3, 5)]  # what was read is not read again


def test_polling_handles_what_waited_once_the_clock_has_passed(spark, tmp_path):
    schema = "device_id long, ts_ms long"
    seen, now = [], 0
    for k, (now, rows) in enumerate([(10, [(1, 5), (1, 15), (2, 40)]), (20, [(3, 25)]), (30, [(3, 26)]), (50, [(4, 7)])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = incremental.poll(stream, lambda got, n: seen.extend((n, r.ts_ms) for r in got.collect()), str(tmp_path / "c"), quarantine=f"file://{tmp_path}/q", available_now=True, clock=lambda t=now: t)
        assert query.awaitTermination(120)
    assert sorted(seen) == [(0, 5), (1, 15), (2, 25), (2, 26), (3, 7), (3, 40)]
    assert sorted(p.name for p in (tmp_path / "q").iterdir() if p.name[0] == "b") == ["batch=2", "batch=3"]


def test_second_source_where_the_first_is_not_there(spark, tmp_path):
    from strandline.operators import lookups

    second = lambda: spark.range(2)
    assert lookups.with_fallback(lambda: spark.read.parquet(f"file://{tmp_path}/none"), second).count() == 2
    with pytest.raises(ZeroDivisionError):
        lookups.with_fallback(lambda: 1 // 0, second)
    assert "broadcast" in lookups.bounded(spark.range(5))._jdf.queryExecution().toString().lower()
    assert "broadcast" not in lookups.bounded(spark.range(5), 3)._jdf.queryExecution().toString().lower()


def test_complete_days(spark):
    day = 86_400_000
    rows = [(1, 10 * day, 11 * day + 5), (2, 10 * day, 10 * day + 5), (3, 20 * day, 21 * day + 5)]
    df = spark.createDataFrame(rows, "device_id long, day_ts long, last_ts long")
    assert [r.device_id for r in incremental.complete_days(df, F.lit("UTC"), F.lit(20 * day + 5)).collect()] == [1]


def test_streamed_local_days(spark, tmp_path):
    schema = "device_id long, ts_start long, ts_end long, behavior int, event_time timestamp"
    hour, day = 3_600_000, 1_704_067_200_000
    rows = [(1, day + k * hour, day + k * hour + 60_000, 3) for k in range(30)] + [(1, day + 200 * hour, day + 200 * hour, 1)]
    df = spark.createDataFrame(rows, "device_id long, ts_start long, ts_end long, behavior int").withColumn("event_time", F.timestamp_millis("ts_start"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {r.day_ts: r.n for r in run_stream(spark, incremental.daily_counts(stream, zone=F.lit("Asia/Shanghai")), tmp_path).collect()}
    assert got == {day - 8 * hour: 16, day + 16 * hour: 14}


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1, 0.5), (None, 2, 0.25)], "name string, n int, share double")
    lines = [r.line for r in sinks.markdown(df, "Report", [F.col("n")]).orderBy("line_no").collect()]
    assert lines == ["## Report", "", "| name | n | share |", "| --- | --- | --- |", "| a\\|b | 1 | 0.5 |", "|  | 2 | 0.25 |"]
    sinks.write_csv(df, f"file://{tmp_path}/csv")
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1
    table = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1, 10), (2, 20)], "device_id long, day_ts long")
    sinks.write_variant(one, table, "a")
    sinks.write_variant(one.where("device_id = 1"), table, "b")
    sinks.write_variant(one.where("device_id = 2").withColumn("device_id", F.lit(9).cast("long")), table, "a")
    assert sorted((r.variant, r.day_ts, r.device_id) for r in spark.read.parquet(table).collect()) == [("a", 10, 1), ("a", 20, 9), ("b", 10, 1)]


def test_gated_windows_are_told_apart(spark, con):
    """the rows of confidence_gate name their stretch, as its SQL does."""
    assert difference(spark, con, DATA, catalog.QUERIES["confidence_gate"], catalog.ORACLES["confidence_gate"]) == ""


def test_round_even_on_the_double(spark):
    """F1: halves go by the double times its power of ten, as in SQL: 0.5055 * 1000 is under 505.5."""
    rows = spark.createDataFrame([(0.5055,), (-150.425,), (34.325,), (0.0625,), (-0.0004,), (None,)], "x double")
    own = [(r.a, r.b) for r in rows.select(scores.round_even(F.col("x"), 3).alias("a"), scores.round_even(F.col("x"), 2).alias("b")).collect()]
    import duckdb

    assert own == duckdb.sql("select round_even(x, 3) + 0.0, round_even(x, 2) + 0.0 from (values (0.5055::double), (-150.425), (34.325), (0.0625), (-0.0004), (null)) v(x)").fetchall()
    days = spark.createDataFrame([(60, 1440, 37.67, 30.0, 60.0, 1.0, 60)], "scratch_count int, wear_minutes int, neck_temp double, baseline_mean double, baseline_std double, temp_coef double, valid_days int")
    assert assessment.with_zscore(days, scores.Thresholds(reference_temperature=38.0)).first().zscore == 0.505


def test_mean_z_is_rounded_on_eighteen_places(spark):
    """F1: 0.501 - 0.5 is a hair over 0.001 as a double, so half of it has digits beyond the 18 places that the SQL looks at."""
    rows = [(1, k, z, 3, abnormal) for k, (z, abnormal) in enumerate([(-0.5, False), (0.501, True)])] + [(2, 0, -1.0, 3, False), (2, 1, 0.997, 3, True)]
    days = spark.createDataFrame(rows, "device_id long, day_ts long, zscore double, eval_phase int, is_abnormal boolean")
    found = {(r.device_id, r.day_ts): r.avg_zscore for r in assessment.with_streak(days).collect()}
    import duckdb

    written = "(select cast(cast({} as varchar) as decimal(30,18)) * 1000 as t)"
    sql = "select cast(case when t - floor(t) > 0.5 or t - floor(t) = 0.5 and floor(t) % 2 <> 0 then floor(t) + 1 else floor(t) end as double) / 1000 + 0.0 from "
    wanted = [duckdb.execute(sql + written.format(f"({a} / 100.0 + {z}::double) / 2")).fetchone()[0] for a, z in ((-50, 0.501), (-100, 0.997))]
    assert [found[1, 1], found[2, 1]] == wanted == [0.0, -0.002]
