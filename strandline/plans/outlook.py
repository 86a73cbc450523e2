"""Queries on groups of devices, patterns in time, sleep and its rhythm, trends and faults of sensors; and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY_MS
from ..operators import cohorts, islands, patterns, rhythm, rollup
from . import days, domain, signals
from .domain import BEHAVIOR_SQL, EV_SQL, HOUR_MS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = ("device_id", "day_ts")
R6 = lambda c: F.round(c, 6).alias(c)
LEVELS = ((("size", "breed", "age"), 30), (("size", "breed"), 10), (("size",), 30), ((), 0))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# Groups: the nation of a device's owner stands for the breed, its region for the size, the segment for the age.


def members(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    """A row a device: its groups, the sum of a daily value before SPLIT, and its days."""
    daily = rollup.daily(domain.behavior(spark, sf_dir)).where(F.col("day_ts") < days.SPLIT)
    own = daily.groupBy("device_id").agg(F.sum(value).alias("total"), F.count("*").alias("n_days"), F.avg(value).alias("own_mean"), F.stddev_pop(value).alias("own_std"))
    c, n = domain.table(spark, sf_dir, "customer"), domain.table(spark, sf_dir, "nation")
    groups = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("device_id"), F.col("n_regionkey").alias("size"), F.col("n_name").alias("breed"), F.col("c_mktsegment").alias("age"))
    return own.join(groups, "device_id")


_MEMBERS = """{daily}, mem as (
  select device_id, n_regionkey as size, n_name as breed, c_mktsegment as age, total, n_days, own_mean, own_std
  from (select device_id, sum({value}) as total, count(*) as n_days, avg({value}) as own_mean, stddev_pop({value}) as own_std from daily where day_ts < {split} group by 1)
  join customer on c_custkey = device_id join nation on n_nationkey = c_nationkey)"""


def _members(value: str) -> str:
    return _MEMBERS.format(daily=days._DAILY, value=value, split=days.SPLIT)


_GROUPS = f"""{_members("scratch_count")}, sets as (
  select size, breed, age, grouping(size, breed, age) as k, count({{0}}) as n_members, avg({{0}}) as group_mean, stddev_pop({{0}}) as group_std from mem group by grouping sets ((size, breed, age), (size, breed), (size), ())
), chosen as (
  select f.size, f.breed, f.age, case g.k when 0 then 0 when 1 then 1 when 3 then 2 else 3 end as level, g.n_members, g.group_mean, g.group_std
  from sets f join sets g on f.k = 0 and (g.k = 7 or g.k = 3 and g.size = f.size and g.n_members >= 30 or g.k = 1 and g.breed = f.breed and g.size = f.size and g.n_members >= 10 or g.k = 0 and g.size = f.size and g.breed = f.breed and g.age = f.age and g.n_members >= 30)
  qualify row_number() over (partition by f.size, f.breed, f.age order by g.k) = 1)"""


@query(f"with {_GROUPS.format('total')} select size, breed, age, level, n_members, round(group_mean, 6) as group_mean, round(group_std, 6) as group_std from chosen")
def group_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group of devices the baseline of the finest group with enough members."""
    found = cohorts.group_baseline(members(spark, sf_dir, "scratch_count"), "total", LEVELS)
    return found.select("size", "breed", "age", "level", "n_members", R6("group_mean"), R6("group_std"))


@query(f"""with {_GROUPS.format('own_mean')}
select d.device_id, d.day_ts, level, round((scratch_count - own_mean) / greatest(own_std, 0.5) * least(n_days / 30, 1.0) + (scratch_count - group_mean) / greatest(group_std, 0.5) * (1 - least(n_days / 30, 1.0)), 6) + 0.0 as zscore
from daily d join mem using (device_id) join chosen using (size, breed, age) where d.day_ts >= {days.SPLIT}""")
def blended_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scores by a device's own baseline and its group's, by how long it is worn."""
    own = members(spark, sf_dir, "scratch_count")
    groups = cohorts.group_baseline(own, "own_mean", LEVELS)
    daily = rollup.daily(domain.behavior(spark, sf_dir)).where(F.col("day_ts") >= days.SPLIT)
    z = lambda kind: (F.col("scratch_count") - F.col(f"{kind}_mean")) / F.greatest(F.col(f"{kind}_std"), F.lit(0.5))
    joined = daily.join(own, "device_id").join(groups, ["size", "breed", "age"])
    return joined.select(*KEYS, "level", (F.round(cohorts.blended(z("own"), z("group"), F.col("n_days")), 6) + 0.0).alias("zscore"))


@query(f"with {_members('move_min')} select device_id, size, age, cast(total as bigint) as total, round(percent_rank() over (partition by size, age order by total), 9) as percentile from mem")
def cohort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How active a device is among those of its size and age."""
    own = members(spark, sf_dir, "move_min").select("device_id", "size", "age", F.col("total").cast("long").alias("total"))
    return cohorts.rank_within(own, ("size", "age"), "total").select("device_id", "size", "age", "total", F.round("percentile", 9).alias("percentile"))


@query(f"""with {EV_SQL}, b as (select device_id, event_id, day_ts, value * 2 as peak from ev where code = 3
), own as (select device_id, quantile_cont(peak, 0.33) as a, quantile_cont(peak, 0.67) as b, count(*) as n from b group by 1
), c as (select b.*, case when peak < case when n >= 5 then a else 80.0 end then 0 when peak < case when n >= 5 then own.b else 150.0 end then 1 else 2 end as intensity from b join own using (device_id))
select device_id, day_ts, count(*) filter (intensity = 0) as n_light, count(*) filter (intensity = 1) as n_medium, count(*) filter (intensity = 2) as n_heavy, cast(sum(case intensity when 0 then 1.0 when 1 then 1.5 else 2.5 end) as double) as weighted from c group by 1, 2""")
def intensity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts of each day by the thirds of their device's own peaks, and their weighted count."""
    e = domain.events(spark, sf_dir).where("event_type = 'error'").withColumn("peak", F.col("value") * 2)
    found = cohorts.intensity(e.select("device_id", "event_id", "day_ts", "peak"), "device_id", "peak")
    each = [F.count(F.when(F.col("intensity") == k, 1)).alias(f"n_{c}") for k, c in enumerate(("light", "medium", "heavy"))]
    return found.groupBy(*KEYS).agg(*each, F.sum("weight").alias("weighted"))


# Patterns in time

_LATEST = "(select max(x.day_ts) from {0} x where x.device_id = y.device_id and x.day_ts < y.day_ts)"


@query(f"""with {days._DAILY}, f as (
  select device_id, day_ts, n > 0 and 10 * move_min * n < 8 * m as less_active, n > 0 and 10 * sleep_min * n < 8 * s as less_sleep, n > 0 and 10 * scratch_count * n > 12 * c as more_scratching from (
    select *, count(*) over w as n, sum(move_min) over w as m, sum(sleep_min) over w as s, sum(scratch_count) over w as c from daily window w as (partition by device_id order by day_ts rows between 7 preceding and 1 preceding))
), ca as (select device_id, day_ts from f where less_active
), cb as (select * from (select device_id, day_ts, {_LATEST.format("ca")} as first_ts from f y where less_sleep) where day_ts - first_ts <= {4 * DAY_MS}
), cc as (select * from (select device_id, day_ts, {_LATEST.format("cb")} as second_ts from f y where more_scratching) where day_ts - second_ts <= {4 * DAY_MS})
select cc.device_id, first_ts, second_ts, cc.day_ts as third_ts from cc join cb on cb.device_id = cc.device_id and cb.day_ts = second_ts""")
def cascade_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with less activity, then with less sleep, then with more scratching than the week before, each within four days."""
    from pyspark.sql import Window

    week = Window.partitionBy("device_id").orderBy("day_ts").rowsBetween(-7, -1)
    d = rollup.daily(domain.behavior(spark, sf_dir)).withColumn("_n", F.count("*").over(week))
    low = lambda c: (F.col("_n") > 0) & (10 * F.col(c) * F.col("_n") < 8 * F.sum(c).over(week))
    high = (F.col("_n") > 0) & (10 * F.col("scratch_count") * F.col("_n") > 12 * F.sum("scratch_count").over(week))
    flagged = d.select(*KEYS, low("move_min").alias("a"), low("sleep_min").alias("b"), high.alias("c"))
    found = patterns.ordered_pattern(flagged, ("device_id",), "day_ts", [(F.col("a"), 0), (F.col("b"), 4 * DAY_MS), (F.col("c"), 4 * DAY_MS)])
    return found.select("device_id", *[F.col("times")[k].alias(f"{c}_ts") for k, c in enumerate(("first", "second", "third"))])


@query(f"""with {EV_SQL}, s as (select distinct device_id, ts_ms as day_ts from ev where code = 2), a as (select device_id, ts_ms as day_ts, event_id from ev where code = 1 and value >= 40),
m as (select distinct device_id, day_ts, {_LATEST.format("s")} as still_ts from a y)
select device_id, still_ts, day_ts as burst_ts from m where day_ts - still_ts <= {6 * HOUR_MS}""")
def homecomings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rest, and a burst of activity within six hours of it."""
    e = domain.events(spark, sf_dir)
    steps = [(F.col("event_type") == "view", 0), ((F.col("event_type") == "click") & (F.col("value") >= 40), 6 * HOUR_MS)]
    found = patterns.ordered_pattern(e, ("device_id",), "ts_ms", steps)
    return found.select("device_id", F.col("times")[0].alias("still_ts"), F.col("times")[1].alias("burst_ts")).distinct()


@query(f"""with {EV_SQL}, s as (select device_id, event_id, ts_ms from ev where code = 3), l as (select device_id, ts_ms as left_ts, max(event_id) as left_id from ev where code = 0 group by 1, 2),
j as (select s.*, l.left_ts, l.left_id from s asof left join l on s.device_id = l.device_id and s.ts_ms >= l.left_ts)
select device_id, event_id, case when ts_ms - left_ts <= {6 * HOUR_MS} then left_id end as left_id, case when ts_ms - left_ts <= {6 * HOUR_MS} then left_ts end as left_ts, case when ts_ms - left_ts <= {6 * HOUR_MS} then cast(0.5 as double) else cast(1.0 as double) end as weight from j""")
def discounted_scratches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scratches count half up to six hours after the owner has left."""
    e = domain.events(spark, sf_dir)
    left = e.where("event_type = 'signup'").select("device_id", "ts_ms", F.col("event_id").alias("left_id"))
    found = patterns.nearest_before(e.where("event_type = 'error'").select("device_id", "event_id", "ts_ms"), left, ("device_id",), "ts_ms", 6 * HOUR_MS, "left_id")
    return found.select("device_id", "event_id", "left_id", F.col("left_id_ts").alias("left_ts"), F.when(F.col("left_id").isNotNull(), 0.5).otherwise(1.0).alias("weight"))


@query(f"""with {days._Z}, p as (
  select device_id, day_ts, coalesce(abs(zscore) > case eval_phase when 1 then 2.0 when 2 then 1.5 when 3 then 1.0 end, false) as o, case eval_phase when 1 then 5 when 2 then 4 when 3 then 3 end as least from z
), r as (select *, sum(case when o then 0 else 1 end) over (partition by device_id order by day_ts) as run from p)
select *, coalesce(streak >= least, false) as persistent from (select device_id, day_ts, cast(sum(case when o then 1 else 0 end) over (partition by device_id, run order by day_ts) as integer) as streak, least from r)""".replace("select *, coalesce(streak", "select device_id, day_ts, streak, coalesce(streak"))
def persistent_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in a row beyond the limit of the device's phase, and whether they freeze its baseline."""
    a = days._assessed(spark, sf_dir)
    by_phase = lambda *values: F.when(F.col("eval_phase") == 1, values[0]).when(F.col("eval_phase") == 2, values[1]).when(F.col("eval_phase") == 3, values[2])
    return patterns.persistent(a, ("device_id",), "day_ts", F.col("zscore"), by_phase(2.0, 1.5, 1.0), by_phase(5, 4, 3)).select(*KEYS, "streak", "persistent")


# Sleep and trends

_OFFSET = f"(device_id % 24 - 12) * {HOUR_MS}"
_SLEEP = f"""{BEHAVIOR_SQL}, sl as (select * from behavior where behavior = 2
), q as (select *, sum(case when reach >= ts_start then 0 else 1 end) over (partition by device_id order by ts_start, ts_end, confidence) as part from (
  select *, max(ts_end) over (partition by device_id order by ts_start, ts_end, confidence rows between unbounded preceding and 1 preceding) as reach from sl)
), runs as (select device_id, min(ts_start) as onset, max(ts_end) as wake from q group by device_id, part
), nights as (
  select device_id, night, onset, wake, n_runs, naps - case when wake - onset < {2 * HOUR_MS} then wake - onset else 0 end as nap_ms from (
    select *, cast(floor((onset + {_OFFSET} - {DAY_MS // 2}) / {DAY_MS}) as bigint) as night, count(*) over w as n_runs, cast(coalesce(sum(case when wake - onset < {2 * HOUR_MS} then wake - onset end) over w, 0) as bigint) as naps, row_number() over (w order by wake - onset desc, onset) as k
    from runs window w as (partition by device_id, floor((onset + {_OFFSET} - {DAY_MS // 2}) / {DAY_MS}))) where k = 1)"""


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = domain.behavior(spark, sf_dir).where("behavior = 2")
    runs = islands.coalesce_events(b, ("device_id",))
    return rhythm.main_sleep(runs, "device_id", F.expr(_OFFSET))


@query(f"with {_SLEEP} select device_id, night, onset, wake, n_runs, nap_ms from nights")
def main_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest sleep of each night, from noon to noon, and the naps beside it."""
    return nights(spark, sf_dir)


_TIME = "((({0} + " + _OFFSET + f") % {DAY_MS} + {DAY_MS}) % {DAY_MS}) * (2 * pi() / {DAY_MS})"
_MEAN = "round(((atan2(sum(sin({0})), sum(cos({0}))) * 24 / (2 * pi())) + 24) % 24, 3)"


@query(f"""with {_SLEEP} select a.device_id, a.night, {_MEAN.format(_TIME.format("b.onset").replace("device_id", "b.device_id"))} as onset_mean, {_MEAN.format(_TIME.format("b.wake").replace("device_id", "b.device_id"))} as wake_mean
from nights a join nights b on b.device_id = a.device_id and b.night between a.night - 6 and a.night group by 1, 2""")
def circadian_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a device falls asleep and wakes up, as circular means of seven nights."""
    found = rhythm.circadian(nights(spark, sf_dir), "device_id", F.expr(_OFFSET))
    return found.select("device_id", "night", F.round("onset_mean", 3).alias("onset_mean"), F.round("wake_mean", 3).alias("wake_mean"))


@query(f"""with {days._DAILY}, x as (select device_id, day_ts, cast(floor((day_ts + {DAY_MS // 2}) / {DAY_MS}) as bigint) as d, scratch_count as y from daily)
select a.device_id, a.day_ts, case when count(*) filter (b.d > a.d - 7) > 1 then round(regr_slope(b.y, b.d) filter (b.d > a.d - 7), 9) + 0.0 end as trend_7d, round(avg(b.y) filter (b.d > a.d - 7), 6) as mean_7d, round(stddev_pop(b.y) filter (b.d > a.d - 7), 6) as std_7d,
  case when count(*) filter (b.d > a.d - 30) > 1 then round(regr_slope(b.y, b.d) filter (b.d > a.d - 30), 9) + 0.0 end as trend_30d, round(avg(b.y) filter (b.d > a.d - 30), 6) as mean_30d, round(stddev_pop(b.y) filter (b.d > a.d - 30), 6) as std_30d, a.d - max(b.d) filter (b.y = 0) as days_since_normal
from x a join x b on b.device_id = a.device_id and b.d <= a.d group by a.device_id, a.day_ts, a.d""")
def scratch_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes, means and spreads of daily scratches over 7 and 30 days, of which some are missing; days since one without scratches."""
    d = rollup.daily(domain.behavior(spark, sf_dir)).withColumn("d", F.floor((F.col("day_ts") + DAY_MS // 2) / DAY_MS))
    found = rhythm.trends(d, "device_id", "d", "scratch_count", normal=F.col("scratch_count") == 0)
    return found.select(*KEYS, *[(F.round(f"trend_{k}d", 9) + 0.0).alias(f"trend_{k}d") for k in (7, 30)], *[R6(f"{s}_{k}d") for s in ("mean", "std") for k in (7, 30)], "days_since_normal")


# Faults

_AXES = ("ax", "ay", "az")


@query(f"""with {signals._SAMPLES.split(', nu as (')[0]}, s as (
  select device_id, ts // 1000 as second, count(*) as n, count(*) filter (greatest(abs(ax), abs(ay), abs(az)) / 9.80665 > 0.35) as beyond, min(case when greatest(abs(gx), abs(gy), abs(gz)) = 0 then 1 else 0 end) as silent,
    {", ".join(f"sum({c} / 9.80665 - 1.0) as {c}_s, sum(({c} / 9.80665 - 1.0) * ({c} / 9.80665 - 1.0)) as {c}_q" for c in _AXES)} from sm group by 1, 2
), f as (select *, count(*) over w as covered, min(silent) over w as quiet, {", ".join(f"sum({c}_q) over w / sum(n) over w - (sum({c}_s) over w / sum(n) over w) * (sum({c}_s) over w / sum(n) over w) as {c}_v" for c in _AXES)}
  from s window w as (partition by device_id order by second range between 3 preceding and current row))
select device_id, count(*) as n_seconds, {", ".join(f"count(*) filter (covered = 4 and {c}_v < 0.0108) as n_flat_{c}" for c in _AXES)}, count(*) filter (covered = 4 and quiet = 1) as n_silent, cast(sum(beyond) as bigint) as n_saturated from f group by 1""")
def sensor_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes that stand still, a silent gyroscope and readings beyond the range, over spans that fit the short readings here."""
    r = signals.readings(spark, sf_dir)
    return rhythm.faults(r, ("device_id",), "ts_ms", _AXES, ("gx", "gy", "gz"), flat_s=4, silent_s=4, still=0.0108, range_g=0.35)


@query(f"with {EV_SQL} select device_id, count(*) filter (earlier) as n_inversions from (select device_id, ts_ms < lag(ts_ms) over (partition by device_id order by event_id) as earlier from ev) group by 1")
def time_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose time is before that of the event that came before."""
    return rhythm.inversions(domain.events(spark, sf_dir), ("device_id",), "event_id", "ts_ms")
