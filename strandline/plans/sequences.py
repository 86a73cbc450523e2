"""Queries on ordered rows: runs, sessions, smoothing, bouts, decoding, intervals; and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import decode, intervals, islands
from . import domain
from .domain import BEHAVIOR_SQL, CLASSES, SEQ, WINDOWS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ORDER = ("idx",)
R6 = lambda c: scores.round_half(F.col(c), 6).alias(c)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_RUNS = """r as (
  select *, sum(new) over (partition by device_id, stretch order by idx) as run from (
    select *, case when label is distinct from lag(label) over (partition by device_id, stretch order by idx) or idx = 0 then 1 else 0 end as new from win))"""


@query(f"with {WINDOWS_SQL}, {_RUNS} select device_id, stretch, run, any_value(label) as label, min(ts_ms) as start_ms, max(ts_ms) as last_ms, count(*) as n_windows from r group by 1, 2, 3")
def run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one label."""
    return islands.run_islands(domain.windows(spark, sf_dir), SEQ, ORDER, "label").select(*SEQ, "run", "label", "start_ms", "last_ms", "n_windows")


@query(f"""with {domain.EV_SQL}, d as (
  select device_id, stretch, ts_ms - lag(ts_ms) over (partition by device_id, stretch order by ts_ms) as d from ev
), k as (
  select *, row_number() over (partition by device_id, stretch order by d) as k, count(*) over (partition by device_id, stretch) as n from d where d is not null
), every as (select distinct device_id, stretch from ev)
select device_id, stretch, coalesce((select greatest(cast(floor(d * 2.5) as bigint), 2000) from k where k.device_id = e.device_id and k.stretch = e.stretch and k.k = k.n // 2 + 1), 5000) as gap_ms from every e""")
def gap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pause that ends a session, from the usual stride of each sequence."""
    return islands.gap_threshold(domain.events(spark, sf_dir), SEQ, "ts_ms", 2000)


_SESSIONS = """s as (
  select *, sum(new) over (partition by device_id, stretch order by ts_ms rows unbounded preceding) as session from (
    select *, case when ts_ms - lag(ts_ms) over (partition by device_id, stretch order by ts_ms) <= 36000000 then 0 else 1 end as new from ev))"""


@query(f"with {domain.EV_SQL}, {_SESSIONS} select device_id, stretch, session, min(ts_ms) as start_ms, max(ts_ms) as last_ms, count(*) as n from s group by 1, 2, 3")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches without a pause of over ten hours."""
    s = islands.with_session(domain.events(spark, sf_dir), SEQ, "ts_ms", F.lit(36_000_000))
    return s.groupBy(*SEQ, "session").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"))


@query(f"""with {domain.EV_SQL}, r as (
  select *, sum(new) over (partition by device_id, stretch order by ts_ms, event_id) as run from (
    select *, case when code = lag(code) over w and ts_ms - lag(ts_ms) over w <= 36000000 then 0 else 1 end as new from ev window w as (partition by device_id, stretch order by ts_ms, event_id)))
select device_id, stretch, any_value(code) as code, min(ts_ms) as start_ms, max(ts_ms) + 2000 as end_ms, round_even(avg(floor(value)), 4) as confidence, count(*) as n_windows from r group by device_id, stretch, run""")
def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one label without a pause between, merged to events."""
    e = domain.events(spark, sf_dir).withColumn("code", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in domain.CODES.items() for x in kv]), "event_type"), F.lit(0))).withColumn("whole", F.floor("value"))
    merged = islands.merge_windows(e, SEQ, ("ts_ms", "event_id"), "code", "ts_ms", "whole", 2000, F.lit(36_000_000))
    return merged


@query(f"""with {WINDOWS_SQL}, {_RUNS}, g as (
  select device_id, stretch, run, any_value(label) as label, min(idx) as a, max(idx) as b, round_even(avg(floor(value)), 4) as confidence, count(*) as n_windows from r group by 1, 2, 3)
select device_id, stretch, run, label, confidence, n_windows, a * 25 as start_sample, coalesce(lead(a) over (partition by device_id, stretch order by run), b) * 25 + 50 as end_sample from g""")
def legacy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as older versions cut them."""
    return islands.legacy_events(domain.windows(spark, sf_dir).withColumn("whole", F.floor("value")), SEQ, ORDER, "label", "idx", "whole", 50, 25)


_SMOOTH = """select device_id, stretch, idx, code, smoothed from (
  select w.device_id, w.stretch, w.idx, w.code, case when w.n < 5 then w.code else v.code end as smoothed,
    row_number() over (partition by w.device_id, w.stretch, w.idx order by count(*) desc, v.code) as k
  from (select *, count(*) over (partition by device_id, {by}) as n from {of}) w join {of} v on v.device_id = w.device_id and v.{by} = w.{by} and v.{at} between w.{at} - 2 and w.{at} + 2
  group by w.device_id, w.stretch, w.idx, w.code, w.n, v.code) where k = 1"""


@query(f"with {WINDOWS_SQL} " + _SMOOTH.format(by="stretch", of="win", at="idx"))
def majority_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent code of five windows."""
    return islands.majority_smooth(domain.windows(spark, sf_dir), SEQ, ORDER, "code").select(*SEQ, "idx", "code", "smoothed")


@query(f"""with {WINDOWS_SQL}, b as (
  select *, sum(case when missing > 0 then 1 else 0 end) over (partition by device_id, stretch order by idx) as part from win
), p as (select *, device_id || '/' || stretch || '/' || part as key, row_number() over (partition by device_id, stretch, part order by idx) as at from b)
""" + _SMOOTH.format(by="key", of="p", at="at"))
def gap_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but not across breaks in the recording (here windows with missing samples)."""
    w = domain.windows(spark, sf_dir)
    broken = w.withColumn("part", F.sum((F.col("missing") > 0).cast("int")).over(islands.ordered(SEQ, ORDER)))
    return islands.majority_smooth(broken, (*SEQ, "part"), ORDER, "code").select(*SEQ, "idx", "code", "smoothed")


@query(f"with {WINDOWS_SQL} select device_id, stretch, idx, ts_ms as z0, coalesce(lead(ts_ms) over (partition by device_id, stretch order by idx), ts_ms + 2000) as z1, ts_ms + 500 as c0, ts_ms + 1500 as c1 from win")
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each window stands for, up to the next one and around its centre."""
    w = islands.with_zone(domain.windows(spark, sf_dir), SEQ, ORDER, "ts_ms", 2000, 1000)
    centred = islands.with_zone(w.withColumnsRenamed({"z0": "a", "z1": "b"}), SEQ, ORDER, "ts_ms", 2000, 1000, centre=True)
    return centred.select(*SEQ, "idx", F.col("a").alias("z0"), F.col("b").alias("z1"), F.col("z0").alias("c0"), F.col("z1").alias("c1"))


@query(f"""with {WINDOWS_SQL}, m as (
  select device_id, stretch, idx, sum(cast(round(p_active * 1000000) as bigint)) over w as a, sum(cast(round(p_sleep * 1000000) as bigint)) over w as s from win window w as (partition by device_id, stretch order by idx rows between 3 preceding and 3 following))
select device_id, stretch, idx, case when a >= s then 'active' else 'sleep' end as state from m""")
def moving_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelier state over seven windows."""
    w = domain.windows(spark, sf_dir).withColumn("probs", F.transform("probs", lambda p: F.round(p * 1_000_000).cast("long")))
    return islands.moving_state(w, SEQ, ORDER, "probs", (("active", 1), ("sleep", 2))).select(*SEQ, "idx", "state")


_HYSTERESIS = """h as (
  select *, stay and max(case when p >= {enter} then 1 else 0 end) over (partition by device_id, stretch, run order by idx) = 1 as in_bout from (
    select *, sum(new) over (partition by device_id, stretch order by idx) as run from (
      select *, case when stay is distinct from lag(stay) over (partition by device_id, stretch order by idx) then 1 else 0 end as new from (
        select *, p_scratch as p, p_scratch >= {stay} as stay from win))))"""


@query(f"""with {WINDOWS_SQL}, {_HYSTERESIS.format(enter=0.5, stay=0.25)} select device_id, stretch, run, min(idx) as first_idx, max(idx) as last_idx, round(max(p), 6) as conf_max from h where in_bout group by 1, 2, 3""")
def hysteresis_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts entered at 0.5 and left under 0.25."""
    w = domain.windows(spark, sf_dir)
    p = F.col("probs")[0]
    marked = islands.hysteresis(w, SEQ, ORDER, p, 0.5, 0.25)
    numbered = islands.with_run(marked.withColumn("_stay", p >= 0.25), SEQ, ORDER, F.col("_stay")).where("in_bout")
    return numbered.groupBy(*SEQ, "run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), scores.round_half(F.max(p), 6).alias("conf_max"))


_ZONED = "z as (select *, ts_ms as z0, coalesce(lead(ts_ms) over (partition by device_id, stretch order by idx), ts_ms + 2000) as z1 from h)"
_FILLED = """f as (
  select *, in_bout or coalesce(first_value(case when in_bout then z0 end ignore nulls) over (partition by device_id, stretch order by idx rows between 1 following and unbounded following)
    - last_value(case when in_bout then z1 end ignore nulls) over (partition by device_id, stretch order by idx rows between unbounded preceding and 1 preceding) <= 4000, false) as filled from z)"""


@query(f"""with {WINDOWS_SQL}, {_HYSTERESIS.format(enter=0.5, stay=0.25)}, {_ZONED}, {_FILLED} select device_id, stretch, idx, filled as in_bout from f""")
def bout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts at most four seconds apart joined."""
    w = islands.with_zone(domain.windows(spark, sf_dir), SEQ, ORDER, "ts_ms", 2000, 1000)
    marked = islands.hysteresis(w, SEQ, ORDER, F.col("probs")[0], 0.5, 0.25)
    return islands.fill_gaps(marked, SEQ, ORDER, "in_bout", 4000).select(*SEQ, "idx", "in_bout")


@query(f"""with {WINDOWS_SQL}, k as (
  select *, sum(new) over (partition by device_id, stretch order by idx) as k from (
    select *, label in ('scratch', 'shake') as either, case when (label in ('scratch', 'shake')) is distinct from lag(label in ('scratch', 'shake')) over (partition by device_id, stretch order by idx) then 1 else 0 end as new from win))
select device_id, stretch, idx, either and max(case when label = 'scratch' then 1 else 0 end) over (partition by device_id, stretch, k) = 1 as in_bout from k""")
def shake_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shakes that touch a scratch belong to it."""
    w = domain.windows(spark, sf_dir).withColumn("in_bout", F.col("label") == "scratch")
    return islands.absorb(w, SEQ, ORDER, "in_bout", F.col("label") == "shake").select(*SEQ, "idx", "in_bout")


@query(f"""with {WINDOWS_SQL}, s as (select *, case when label in ('active', 'sleep') then label end as s from win)
select device_id, stretch, idx, coalesce(last_value(s ignore nulls) over (partition by device_id, stretch order by idx rows unbounded preceding),
  first_value(s ignore nulls) over (partition by device_id, stretch order by idx rows between current row and unbounded following)) as state from s""")
def forward_fill_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events take the state before them, leading ones the first."""
    state = F.when(F.col("label").isin("active", "sleep"), F.col("label"))
    return islands.forward_fill(domain.windows(spark, sf_dir), SEQ, ORDER, state, "state").select(*SEQ, "idx", "state")


@query(f"""with {WINDOWS_SQL}, z as (
  select *, ts_ms as z0, coalesce(lead(ts_ms) over (partition by device_id, stretch order by idx), ts_ms + 2000) as z1,
    case label when 'scratch' then p_scratch when 'active' then p_active when 'sleep' then p_sleep else p_shake end as p from win
), r as (select *, sum(new) over (partition by device_id, stretch order by idx) as run from (
  select *, case when label is distinct from lag(label) over (partition by device_id, stretch order by idx) then 1 else 0 end as new from z))
select device_id, stretch, any_value(label) as label, min(z0) as start_ms, max(z1) as end_ms, round(max(p), 6) as conf_max, round(avg(p), 6) as conf_mean, count(*) as n_windows, round_even(avg(missing), 3) as spec from r group by device_id, stretch, run""")
def segment_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a label as segments with confidences."""
    w = islands.with_zone(domain.windows(spark, sf_dir), SEQ, ORDER, "ts_ms", 2000, 1000).withColumn("final", F.col("label"))
    s = decode.segments(w, SEQ, ORDER, CLASSES, "missing")
    return s.select(*SEQ, F.col("final").alias("label"), "start_ms", "end_ms", R6("conf_max"), R6("conf_mean"), "n_windows", "spec")


_HOLES = f"""{WINDOWS_SQL}, z as (select *, ts_ms as z0, coalesce(lead(ts_ms) over (partition by device_id, stretch order by idx), ts_ms + 2000) as z1 from win), hp as (
  select *, sum(case when z0 > reach or reach is null then 1 else 0 end) over (partition by device_id, stretch order by z0) as part from (
    select *, max(z1) over (partition by device_id, stretch order by z0 rows between unbounded preceding and 1 preceding) as reach from z where missing >= 0.5)
), holes as (select device_id, stretch, min(z0) as hole_start, max(z1) as hole_end from hp group by device_id, stretch, part)"""


@query(f"with {_HOLES} select * from holes")
def missing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where samples are missing."""
    return islands.missing_spans(islands.with_zone(domain.windows(spark, sf_dir), SEQ, ORDER, "ts_ms", 2000, 1000), SEQ)


@query(f"""with {_HOLES}, {_RUNS}, seg as (
  select r.device_id, r.stretch, run, min(z0) as start_ms, max(z1) as end_ms from r join z using (device_id, stretch, idx) group by 1, 2, 3
), cut as (
  select s.*, hole_start, hole_end from seg s join holes h on s.device_id = h.device_id and s.stretch = h.stretch and hole_start < end_ms and hole_end > start_ms
), pieces as (
  select device_id, stretch, run, start_ms, end_ms from seg s where not exists (select 1 from cut c where c.device_id = s.device_id and c.stretch = s.stretch and c.run = s.run)
  union all select device_id, stretch, run, start_ms, min(hole_start) from cut group by device_id, stretch, run, start_ms
  union all select device_id, stretch, run, hole_end, coalesce(lead(hole_start) over (partition by device_id, stretch, run order by hole_start), end_ms) from cut
) select * from pieces where end_ms - start_ms >= 1000""")
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without the stretches where samples are missing."""
    w = islands.with_zone(domain.windows(spark, sf_dir), SEQ, ORDER, "ts_ms", 2000, 1000)
    found = islands.with_run(w, SEQ, ORDER, F.col("label")).groupBy(*SEQ, "run").agg(F.min("z0").alias("start_ms"), F.max("z1").alias("end_ms"))
    return intervals.subtract(found, islands.missing_spans(w, SEQ), SEQ, ("run",))


@query(f"""with {_HOLES} select z.device_id, z.stretch, z.idx, exists (select 1 from holes h where h.device_id = z.device_id and h.stretch = z.stretch and h.hole_start < z.z1 and h.hole_end > z.z0) as taken from z""")
def overlap_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that a span with missing samples overlaps."""
    w = islands.with_zone(domain.windows(spark, sf_dir), SEQ, ORDER, "ts_ms", 2000, 1000)
    return intervals.mark_overlap(w, islands.missing_spans(w, SEQ), SEQ, ("idx",), ("z0", "z1"), ("hole_start", "hole_end")).select(*SEQ, "idx", "taken")


@query(f"""with {WINDOWS_SQL}, n as (select *, count(*) over (partition by device_id, stretch) as n from win)
select device_id, stretch, idx // 4 as window_idx, min(ts_ms) as start_ms, round(avg(value), 6) as mean_value, count(*) as n
from n where idx // 4 <= (n - 4) // 4 and n >= 4 group by 1, 2, 3""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four rows, full ones alone."""
    s = islands.sliding_windows(domain.windows(spark, sf_dir), SEQ, ORDER, 4, 4)
    return s.groupBy(*SEQ, "window_idx").agg(F.min("ts_ms").alias("start_ms"), scores.round_half(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


@query(f"""with {WINDOWS_SQL}, n as (select *, count(*) over (partition by device_id, stretch) as n from win), k as (select unnest(range(0, 100000)) as window_idx)
select device_id, stretch, window_idx, min(ts_ms) as start_ms, round(avg(value), 6) as mean_value, count(*) as n
from n join k on window_idx * 2 <= idx and idx < window_idx * 2 + 5 and window_idx * 2 + 5 <= n group by 1, 2, 3""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five rows, one every two rows."""
    s = islands.sliding_windows(domain.windows(spark, sf_dir), SEQ, ORDER, 5, 2)
    return s.groupBy(*SEQ, "window_idx").agg(F.min("ts_ms").alias("start_ms"), scores.round_half(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


@query(f"""with {BEHAVIOR_SQL}, c as (select device_id, day_ts, ts_start, ts_end, case behavior when 0 then 1 else behavior end as behavior, round(confidence, 2) as confidence from behavior),
r as (select *, sum(new) over w as run from (select *, case when behavior is distinct from lag(behavior) over w then 1 else 0 end as new from c window w as (partition by device_id, day_ts order by ts_start, behavior, ts_end, confidence)) window w as (partition by device_id, day_ts order by ts_start, behavior, ts_end, confidence)),
p as (select *, sum(case when reach >= ts_start then 0 else 1 end) over (partition by device_id, day_ts, run order by ts_start, behavior, ts_end, confidence) as part from (
  select *, max(ts_end) over (partition by device_id, day_ts, run order by ts_start, behavior, ts_end, confidence rows between unbounded preceding and 1 preceding) as reach from r))
select device_id, day_ts, any_value(behavior) as behavior, min(ts_start) as ts_start, max(ts_end) as ts_end, count(*) as n_events from p group by device_id, day_ts, run, part""")
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one code that touch, joined."""
    b = domain.behavior(spark, sf_dir).withColumn("behavior", F.when(F.col("behavior") == 0, 1).otherwise(F.col("behavior"))).withColumn("confidence", F.round("confidence", 2))
    return islands.coalesce_events(b, ("device_id", "day_ts")).drop("confidence")


#: Neighbouring events of one code that touch, folded in order.
JOINED = """), r as (select *, sum(new) over w as run from (select *, case when behavior is distinct from lag(behavior) over w then 1 else 0 end as new from behavior window w as (partition by device_id, day_ts order by ts_start, behavior, ts_end, confidence)) window w as (partition by device_id, day_ts order by ts_start, behavior, ts_end, confidence)
), q as (select *, sum(case when reach >= ts_start then 0 else 1 end) over (partition by device_id, day_ts, run order by ts_start, behavior, ts_end, confidence) as part from (
  select *, max(ts_end) over (partition by device_id, day_ts, run order by ts_start, behavior, ts_end, confidence rows between unbounded preceding and 1 preceding) as reach from r)
), l as (select device_id, day_ts, any_value(behavior) as behavior, list(struct_pack(s := ts_start, e := ts_end, c := cast(confidence as double)) order by ts_start, ts_end, confidence) as l from q group by device_id, day_ts, run, part
), g as (select *, list_reduce(l, lambda a, x: struct_pack(s := a.s, e := greatest(a.e, x.e), c := cast(round_even((a.c * greatest(a.e - a.s, 1) + x.c * greatest(x.e - x.s, 1)) / (greatest(a.e - a.s, 1) + greatest(x.e - x.s, 1)), 4) as double))) as f from l)"""


@query(f"""with {BEHAVIOR_SQL[:-1]}{JOINED}
select device_id, day_ts, behavior, f.s as ts_start, f.e as ts_end, f.c as confidence, cast(len(l) as integer) as n_events from g""")
def confidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with confidences folded in order, rounded at each step."""
    return islands.coalesce_events(domain.behavior(spark, sf_dir), ("device_id", "day_ts"))


_VITERBI = f"""with recursive {WINDOWS_SQL}, e as (
  select device_id, stretch, idx, ts_ms, label, missing, [p_scratch, p_active, p_sleep, p_shake] as p, [ln(greatest(0.000001, p_scratch)), ln(greatest(0.000001, p_active)), ln(greatest(0.000001, p_sleep)), ln(greatest(0.000001, p_shake))] as emit,
    count(*) over (partition by device_id, stretch) as n from win
), f as (
  select device_id, stretch, idx, n, emit as s, [0, 0, 0, 0] as b from e where idx = 0
  union all
  select e.device_id, e.stretch, e.idx, e.n, list_transform([1, 2, 3, 4], lambda k: greatest(f.s[k], list_max(f.s) - 3.0) + e.emit[k]),
    list_transform([1, 2, 3, 4], lambda k: case when f.s[k] >= list_max(f.s) - 3.0 then k else list_position(f.s, list_max(f.s)) end)
  from f join e on e.device_id = f.device_id and e.stretch = f.stretch and e.idx = f.idx + 1
), t as (
  select device_id, stretch, idx, list_position(s, list_max(s)) as c from f where idx = n - 1
  union all
  select f.device_id, f.stretch, f.idx - 1, f.b[t.c] from t join f on f.device_id = t.device_id and f.stretch = t.stretch and f.idx = t.idx where t.idx > 0
), decoded as (select e.*, ['scratch', 'active', 'sleep', 'shake'][c] as decoded from e join t using (device_id, stretch, idx))"""

# Bouts of two flags (sc, sh) to the final label: gaps, shakes that touch scratches, limits, painting. state is what lies under them.
_GAP = "{0} or coalesce(first_value(case when {0} then z0 end ignore nulls) over (partition by device_id, stretch order by idx rows between 1 following and unbounded following) - last_value(case when {0} then z1 end ignore nulls) over (partition by device_id, stretch order by idx rows between unbounded preceding and 1 preceding) <= 4000, false)"
_RUN = "sum(case when ({0}) is distinct from ({1}) then 1 else 0 end) over (partition by device_id, stretch order by idx)"
_PAINT = f"""g1 as (select * replace ({_GAP.format("sc")} as sc, {_GAP.format("sh")} as sh) from flags
), g2 as (select *, lag(sh) over w as psh, sc or shaken as either, lag(sc or shaken) over w as peither from g1 window w as (partition by device_id, stretch order by idx)
), g3 as (select *, {_RUN.format("sh", "psh")} as sh_bout, {_RUN.format("either", "peither")} as er from g2
), g4 as (select * exclude (sc), either and max(case when sc then 1 else 0 end) over (partition by device_id, stretch, er) = 1 as sc from g3
), g5 as (select * replace ({_GAP.format("sc")} as sc) from g4
), g6 as (select *, lag(sc) over (partition by device_id, stretch order by idx) as psc, sh and not sc as rem from g5
), g7 as (select *, {_RUN.format("sc", "psc")} as sc_bout from g6
), g8 as (select *, sc and (count(*) filter (where sc) over a >= 2 and avg(p[1]) filter (where sc) over a >= 0.45 or max(p[1]) filter (where sc) over a >= 0.85) as sc_kept,
  rem and (count(*) filter (where rem) over b >= 2 and avg(p[4]) filter (where rem) over b >= 0.45 or max(p[4]) filter (where rem) over b >= 0.85) as sh_kept
  from g7 window a as (partition by device_id, stretch, sc_bout), b as (partition by device_id, stretch, sh_bout)
), final as (select *, case when sc_kept then 'scratch' when sh_kept then 'shake' else state end as final from g8
), seg as (select *, sum(case when final is distinct from pf then 1 else 0 end) over (partition by device_id, stretch order by idx) as run from (select *, lag(final) over (partition by device_id, stretch order by idx) as pf from final))"""
_SEGMENTS = """select device_id, stretch, any_value(final) as label, min(z0) as start_ms, max(z1) as end_ms, round(max(p[list_position(['scratch', 'active', 'sleep', 'shake'], final)]), 6) as conf_max,
  round(avg(p[list_position(['scratch', 'active', 'sleep', 'shake'], final)]), 6) as conf_mean, count(*) as n_windows from seg group by device_id, stretch, run"""
_ZONES = "ts_ms as z0, coalesce(lead(ts_ms) over (partition by device_id, stretch order by idx), ts_ms + 2000) as z1"
_FLAGS = f"""flags as (
  select *, coalesce(last_value(case when decoded in ('active', 'sleep') then decoded end ignore nulls) over (partition by device_id, stretch order by idx rows unbounded preceding),
    first_value(case when decoded in ('active', 'sleep') then decoded end ignore nulls) over (partition by device_id, stretch order by idx rows between current row and unbounded following), 'active') as state,
    decoded = 'scratch' as sc, decoded = 'shake' as sh, label = 'shake' or decoded = 'shake' as shaken, {_ZONES} from decoded)"""


@query(f"{_VITERBI} select device_id, stretch, idx, label, decoded from decoded")
def viterbi_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path through the probabilities of each sequence."""
    return decode.viterbi(domain.windows(spark, sf_dir), SEQ, ORDER, CLASSES).select(*SEQ, "idx", "label", "decoded")


def _absorbed(source: str, least: int) -> str:
    """CTEs that end in `absorbed`: source (idx, z0, z1, lab) with the label of each window once short runs are gone, one merge a step."""
    size = "list_transform(runs, lambda x: x.b - x.a)"
    return f"""ru as (
  select *, sum(case when lab is distinct from plab then 1 else 0 end) over (partition by device_id, stretch order by idx) as r from (select *, lag(lab) over (partition by device_id, stretch order by idx) as plab from {source})
), rl as (
  select device_id, stretch, list(struct_pack(l := l, a := a, b := b, n := n) order by r) as runs from (select device_id, stretch, r, any_value(lab) as l, min(z0) as a, max(z1) as b, count(*) as n from ru group by device_id, stretch, r) group by device_id, stretch
), ab as (
  select device_id, stretch, runs, 0 as step from rl
  union all
  select device_id, stretch, list_concat(list_concat(list_slice(runs, 1, lo - 1), [struct_pack(l := lab, a := runs[lo].a, b := runs[hi].b, n := cast(list_sum(list_transform(list_slice(runs, lo, hi), lambda x: x.n)) as bigint))]), list_slice(runs, hi + 1, len(runs))), step + 1
  from (select *, case when k > 1 and runs[k - 1].l = lab then k - 1 else k end as lo, case when k < len(runs) and runs[k + 1].l = lab then k + 1 else k end as hi
    from (select *, case when k = 1 or k < len(runs) and runs[k + 1].b - runs[k + 1].a > runs[k - 1].b - runs[k - 1].a then runs[k + 1].l else runs[k - 1].l end as lab
      from (select *, list_position({size}, list_min({size})) as k from ab where len(runs) > 1 and list_min({size}) < {least})))
), un as (
  select device_id, stretch, x.l as absorbed, sum(x.n) over (partition by device_id, stretch order by j) as upto, x.n as n
  from (select device_id, stretch, unnest(runs) as x, generate_subscripts(runs, 1) as j from (select device_id, stretch, arg_max(runs, step) as runs from ab group by 1, 2))
), absorbed as (select s.*, un.absorbed from {source} s join un on un.device_id = s.device_id and un.stretch = s.stretch and s.idx < un.upto and s.idx >= un.upto - un.n)"""


@query(f"with recursive {WINDOWS_SQL}, zo as (select *, label as lab, {_ZONES} from win), {_absorbed('zo', 3000)} select device_id, stretch, idx, label, absorbed from absorbed")
def absorb_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of under three seconds taken over by their neighbours."""
    w = islands.with_zone(domain.windows(spark, sf_dir), SEQ, ORDER, "ts_ms", 2000, 1000)
    return decode.absorb_short_runs(w, SEQ, ORDER, "label", 3000).select(*SEQ, "idx", "label", "absorbed")


def _stable(spark: SparkSession, sf_dir: str, algo: str) -> DataFrame:
    tasks = decode.tasks_for(domain.table(spark, sf_dir, "events").count(), spark.sparkContext.defaultParallelism)
    w = domain.windows(spark, sf_dir, tasks).select(*SEQ, *ORDER, "ts_ms", "label", "probs", "missing")
    return decode.stabilise(w, SEQ, ORDER, CLASSES, 2000, 1000, algo=algo, tasks=tasks)


def _segments(stable: DataFrame) -> DataFrame:
    s = decode.segments(stable, SEQ, ORDER, CLASSES)
    return s.select(*SEQ, F.col("final").alias("label"), "start_ms", "end_ms", R6("conf_max"), R6("conf_mean"), "n_windows")


@query(f"{_VITERBI}, {_FLAGS}, {_PAINT} {_SEGMENTS}")
def stabilise_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after decoding."""
    return _segments(_stable(spark, sf_dir, "viterbi"))


@query(f"""with recursive {WINDOWS_SQL}, zo as (
  select device_id, stretch, idx, ts_ms, label, [p_scratch, p_active, p_sleep, p_shake] as p, {_ZONES}, case when avg(p_active) over k >= avg(p_sleep) over k then 'active' else 'sleep' end as lab
  from win window k as (partition by device_id, stretch order by idx rows between 3 preceding and 3 following)
), {_absorbed('zo', 10000)}, hy as (
  select *, {_RUN.format("p[1] >= 0.25", "c")} as c_run, {_RUN.format("p[4] >= 0.25", "h")} as h_run from (select *, lag(p[1] >= 0.25) over w as c, lag(p[4] >= 0.25) over w as h from absorbed window w as (partition by device_id, stretch order by idx))
), flags as (
  select device_id, stretch, idx, ts_ms, label, p, z0, z1, absorbed as state, label = 'shake' as shaken, p[1] >= 0.25 and max(case when p[1] >= 0.5 then 1 else 0 end) over (partition by device_id, stretch, c_run order by idx) = 1 as sc,
    p[4] >= 0.25 and max(case when p[4] >= 0.5 then 1 else 0 end) over (partition by device_id, stretch, h_run order by idx) = 1 as sh from hy
), {_PAINT} {_SEGMENTS}""")
def stabilise_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after smoothing and hysteresis."""
    return _segments(_stable(spark, sf_dir, "stable"))


_CANDIDATES = f"""{_VITERBI}, {_FLAGS}, {_PAINT}, found as (
  select device_id, stretch, min(z0) as a, max(z1) as b from seg where final = 'scratch' group by device_id, stretch, run
), low as (
  select *, stay and max(case when p[1] >= 0.3 then 1 else 0 end) over (partition by device_id, stretch, lrun order by idx) = 1 as lo from (
    select *, sum(case when stay is distinct from pstay then 1 else 0 end) over (partition by device_id, stretch order by idx) as lrun from (
      select device_id, stretch, idx, z0, z1, p, missing, p[1] >= 0.25 as stay, lag(p[1] >= 0.25) over (partition by device_id, stretch order by idx) as pstay from seg))
), low2 as (select *, lag(lo) over (partition by device_id, stretch order by idx) as plo from (select * replace ({_GAP.format("lo")} as lo) from low)
), low3 as (select *, sum(case when lo is distinct from plo then 1 else 0 end) over (partition by device_id, stretch order by idx) as bout from low2
), mark as (select *, exists (select 1 from found f where f.device_id = l.device_id and f.stretch = l.stretch and l.z0 < f.b and l.z1 > f.a) as taken from low3 l
), span as (select *, min(case when lo and not taken then z0 end) over w as fa, max(case when lo and not taken then z0 end) over w as fb, count(*) filter (where lo and not taken) over w as fn from mark window w as (partition by device_id, stretch, bout)
), cand as (select device_id, stretch, min(z0) as start_ms, max(z1) as end_ms, max(p[1]) as conf_max, avg(p[1]) as conf_mean, count(*) as n_windows, round_even(avg(missing), 3) as spec, 'low_conf' as reason
  from span where fn >= 2 and z0 between fa and fb group by device_id, stretch, bout having avg(p[1]) >= 0.3
), ranked as (select * replace (round(conf_max, 6) as conf_max, round(conf_mean, 6) as conf_mean), cast(row_number() over (partition by device_id, stretch order by conf_mean desc, start_ms) as integer) as rank from cand)"""


def _candidates(spark: SparkSession, sf_dir: str, most: int | None) -> DataFrame:
    stable = _stable(spark, sf_dir, "viterbi")
    found = decode.segments(stable, SEQ, ORDER, CLASSES).where("final = 'scratch'")
    return decode.candidates(stable, found, SEQ, ORDER, F.col("probs")[0], most=most, spec="missing").withColumn("conf_max", R6("conf_max")).withColumn("conf_mean", R6("conf_mean"))


@query(f"{_CANDIDATES} select * from ranked")
def scratch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts that the final segments do not have."""
    return _candidates(spark, sf_dir, None)


@query(f"{_CANDIDATES} select * from ranked where rank <= 1")
def surest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest of them in each sequence."""
    return _candidates(spark, sf_dir, 1)


@query("""with x as (select vec_id, vec_id % 20 * 100 as start_ms, vec_id % 20 * 100 + 3000 as end_ms, vec_id % 20 as s, vec_id % 20 + 30 as e, list_transform(embedding, lambda v: abs(cast(v as double))) as y from embeddings
), l as (select *, list_sort(y[s + 1:e]) as inner_y from x), m as (select *, inner_y[len(inner_y) // 2 + 1] * 0.3 as thr from l
), r as (select *, list_min(list_filter(range(greatest(0, s - 10), least(63, s + 10) + 1), lambda i: y[i + 1] >= thr)) as a, list_max(list_filter(range(greatest(0, e - 10), least(63, e + 10) + 1), lambda i: y[i + 1] >= thr)) as b from m)
select vec_id, cast(case when a is not null and b > a then a * 100 else start_ms end as bigint) as start_ms, cast(case when a is not null and b > a then (b + 1) * 100 else end_ms end as bigint) as end_ms from r""")
def refined_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends moved to where an envelope of energy (here an embedding) rises and falls."""
    e = domain.table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0).cast("long").alias("t0_ms"), F.lit(10.0).alias("hz"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("energy"))
    s = e.withColumn("start_ms", (F.pmod("vec_id", F.lit(20)) * 100).cast("long")).withColumn("end_ms", F.col("start_ms") + 3000)
    return decode.refine(s).select("vec_id", "start_ms", "end_ms")
