"""Runs, sessions, bouts and smoothing over ordered rows, as window expressions.

Every function takes the columns that tell sequences apart (`keys`, as a rule device and day, so that no device's whole
history meets in one task) and one order; windows with the same keys and order share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scores


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def with_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: Column, gap: tuple[Column, Column] | None = None, name: str = "run") -> DataFrame:
    """A number for each run of equal labels. gap: (distance to the row before, most) ends a run as well."""
    w = ordered(keys, order)
    new = F.lag(F.lit(True)).over(w).isNull() | ~label.eqNullSafe(F.lag(label).over(w))
    if gap is not None:
        new = new | (gap[0] > gap[1])
    return df.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, ts: str = "ts_ms") -> DataFrame:
    """Runs of equal labels: first and last time and how many rows."""
    runs = with_run(df, keys, order, F.col(label))
    return runs.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min(ts).alias("start_ms"), F.max(ts).alias("last_ms"), F.count("*").alias("n_windows"))


def gap_threshold(df: DataFrame, keys: Sequence[str], ts: str, window_ms: int, name: str = "gap_ms") -> DataFrame:
    """For each sequence 2.5 times its usual stride, the upper middle one, and a window at least."""
    w = ordered(keys, [ts])
    strides = df.withColumn("_d", F.col(ts) - F.lag(ts).over(w)).where(F.col("_d").isNotNull())
    by_size = Window.partitionBy(*keys).orderBy("_d")
    ranked = strides.select(*keys, "_d", F.row_number().over(by_size).alias("_k"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    middle = ranked.where("_k = _n div 2 + 1").select(*keys, F.greatest(F.floor(F.col("_d") * 2.5).cast("long"), F.lit(window_ms).cast("long")).alias(name))
    every = df.select(*keys).distinct()
    return every.join(middle, list(keys), "left").select(*keys, F.coalesce(name, F.greatest(F.lit(int(window_ms * 2.5)), F.lit(window_ms)).cast("long")).alias(name))


def with_session(df: DataFrame, keys: Sequence[str], ts: str, gap: Column, name: str = "session") -> DataFrame:
    """A number for each stretch without a step of more than gap."""
    w = ordered(keys, [ts])
    new = F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def with_part(df: DataFrame, keys: Sequence[str], ts: str, gap: int, name: str = "part_ms") -> DataFrame:
    """The time at which the stretch of each row began: one without a step of more than gap. It tells the stretches of a sequence apart."""
    w = ordered(keys, [ts])
    first = F.coalesce(F.col(ts) - F.lag(ts).over(w) > gap, F.lit(True))
    return df.withColumn("_first", F.when(first, F.col(ts))).withColumn(name, F.last("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def merge_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, ts: str, confidence: str, window_ms: int, gap: Column) -> DataFrame:
    """Windows of one label with no gap between become events; an event ends a window after its last one began."""
    w = ordered(keys, order)
    runs = with_run(df, keys, order, F.col(label), (F.coalesce(F.col(ts) - F.lag(ts).over(w), F.lit(0)), gap))
    grouped = runs.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min(ts).alias("start_ms"), (F.max(ts) + window_ms).alias("end_ms"), scores.round_even(F.avg(confidence), 4).alias("confidence"), F.count("*").alias("n_windows"))
    return grouped.drop("run")


def legacy_events(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, index: str, confidence: str, window: int, step: int) -> DataFrame:
    """Runs as events in samples, as older versions cut them: all but the last end where the next run's first window ends."""
    runs = with_run(df, keys, order, F.col(label))
    grouped = runs.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min(index).alias("_first"), F.max(index).alias("_last"), scores.round_even(F.avg(confidence), 4).alias("confidence"), F.count("*").alias("n_windows"))
    following = F.lead("_first").over(ordered(keys, ["run"]))
    return grouped.withColumn("start_sample", F.col("_first") * step).withColumn("end_sample", F.coalesce(following, F.col("_last")) * step + window).drop("_first", "_last")


def coalesce_events(events: DataFrame, keys: Sequence[str], code: str = "behavior", start: str = "ts_start", end: str = "ts_end", confidence: str = "confidence", totals: Sequence[str] = ()) -> DataFrame:
    """Neighbouring events of one code that touch or overlap are one. Confidences are averaged by duration, rounded to four places at each step, so they are folded in order; totals are summed."""
    order = [start, code, end, confidence]
    runs = with_run(events, keys, order, F.col(code), name="_run")
    w = Window.partitionBy(*keys, "_run").orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = runs.withColumn("_new", F.coalesce((reach < F.col(start)).cast("int"), F.lit(1)))
    apart = apart.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(confidence).alias("c"))))
    grouped = apart.groupBy(*keys, "_run", "_part").agg(F.first(code).alias(code), each.alias("_e"), *(F.sum(c).alias(c) for c in totals))

    def fold(a: Column, x: Column) -> Column:
        d0, d1 = F.greatest(a["e"] - a["s"], F.lit(1)), F.greatest(x["e"] - x["s"], F.lit(1))
        mean = scores.round_even((a["c"] * d0 + x["c"] * d1) / (d0 + d1), 4)
        return F.struct(a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e"), mean.alias("c"))

    first = F.col("_e")[0]
    folded = F.aggregate(F.slice("_e", 2, F.size("_e")), first, fold)
    out = grouped.withColumn("_f", folded)
    return out.select(*keys, code, F.col("_f.s").alias(start), F.col("_f.e").alias(end), F.col("_f.c").alias(confidence), F.size("_e").alias("n_events"), *totals)


def majority_smooth(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, k: int = 5, name: str = "smoothed") -> DataFrame:
    """The most frequent label of the k rows around each, the smallest on ties; sequences of under k rows stay as they are."""
    half = k // 2
    around = F.collect_list(label).over(ordered(keys, order).rowsBetween(-half, half))
    n = F.count("*").over(Window.partitionBy(*keys))

    def better(best: Column, x: Column) -> Column:
        times = F.size(F.filter(F.col("_around"), lambda y: y == x))
        return F.when(times > best["n"], F.struct(times.alias("n"), x.alias("label"))).otherwise(best)

    start = F.struct(F.lit(0).alias("n"), F.col("_around")[0].alias("label"))
    best = F.aggregate(F.array_sort(F.array_distinct("_around")), start, better)["label"]
    return df.withColumn("_around", around).withColumn(name, F.when(n < k, F.col(label)).otherwise(best)).drop("_around")


def with_zone(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, window_ms: int, stride_ms: int, centre: bool = False) -> DataFrame:
    """The stretch of time z0 to z1 that each window stands for: up to the next window, or a stride around its centre."""
    if centre:
        middle = F.col(ts) + window_ms // 2
        return df.withColumn("z0", middle - stride_ms // 2).withColumn("z1", middle + stride_ms // 2)
    following = F.lead(ts).over(ordered(keys, order))
    return df.withColumn("z0", F.col(ts)).withColumn("z1", F.coalesce(following, F.col(ts) + window_ms))


def moving_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], probs: str, states: Sequence[tuple[str, int]], k: int = 7, name: str = "state") -> DataFrame:
    """The state of the greatest mean probability over the k windows around; states are (name, place in probs), the first wins ties."""
    half = k // 2
    w = ordered(keys, order).rowsBetween(-half, half)
    means = F.array(*[F.avg(F.col(probs)[at]).over(w) for _, at in states])
    names = F.array(*[F.lit(s) for s, _ in states])
    return df.withColumn("_m", means).withColumn(name, F.element_at(names, F.array_position("_m", F.array_max("_m")).cast("int"))).drop("_m")


def hysteresis(df: DataFrame, keys: Sequence[str], order: Sequence[str], p: Column, enter: float, stay: float, name: str = "in_bout") -> DataFrame:
    """Whether a row is in a bout: a run of p >= stay, from its first p >= enter on."""
    w = ordered(keys, order)
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("_stay", p >= stay).withColumn("_at", F.row_number().over(w))
    # The last row with p >= enter lies behind the last one outside; by places, so that the rows stay in the one order.
    entered = F.max(F.when(p >= enter, F.col("_at"))).over(until) > F.coalesce(F.max(F.when(~F.coalesce("_stay", F.lit(False)), F.col("_at"))).over(until), F.lit(0))
    return numbered.withColumn(name, F.when(F.col("_stay").isNotNull(), F.col("_stay") & F.coalesce(entered, F.lit(False)))).drop("_stay", "_at")


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, gap_ms: int) -> DataFrame:
    """Rows between two flagged ones whose zones are at most gap_ms apart are flagged as well."""
    w = ordered(keys, order)
    before = F.last(F.when(F.col(flag), F.col("z1")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col(flag), F.col("z0")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn(flag, F.col(flag) | F.coalesce(after - before <= gap_ms, F.lit(False)))


def absorb(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, other: Column, gap: tuple[Column, Column] | None = None, run: str | None = None) -> DataFrame:
    """Rows of `other` that touch flagged ones, directly or through each other, are flagged as well. gap: (distance to the row before, most) at which rows still touch. run keeps the numbers of such runs: rows then lie in the order (run, *order), which needs no further sort."""
    number = run or "_run"
    runs = with_run(df, keys, order, F.col(flag) | other, gap, name=number)
    whole = ordered((*keys, number), order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = runs.withColumn(flag, (F.col(flag) | other) & (F.max(F.col(flag).cast("int")).over(whole) == 1))
    return marked if run else marked.drop(number)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last known value; before the first known one, that."""
    w = ordered(keys, order)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(back, ahead))


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, p: Column, spec: str | None = None) -> DataFrame:
    """Runs of the final label with their zones, confidences and mean spectral share."""
    runs = with_run(df.withColumn("_p", p), keys, order, F.col(label))
    share = scores.round_even(F.avg(spec), 3) if spec else F.lit(None).cast("double")
    return runs.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min("z0").alias("start_ms"), F.max("z1").alias("end_ms"), F.max("_p").alias("conf_max"), F.avg("_p").alias("conf_mean"), F.count("*").alias("n_windows"), share.alias("spec"))


def missing_spans(df: DataFrame, keys: Sequence[str], missing: str = "missing", least: float = 0.5) -> DataFrame:
    """Zones with a share of missing samples of `least` or more, joined where they touch."""
    holes = df.where(F.col(missing) >= least)
    w = ordered(keys, ["z0", "z1"])
    reach = F.max("z1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = holes.withColumn("_new", F.coalesce((F.col("z0") > reach).cast("int"), F.lit(1)))
    parts = parts.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, "_part").agg(F.min("z0").alias("hole_start"), F.max("z1").alias("hole_end")).drop("_part")


def sliding_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, step: int, index: str = "window_idx") -> DataFrame:
    """Each row once for every window of `size` rows that it is in; windows begin every `step` rows and only full ones stay."""
    w = ordered(keys, order)
    numbered = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    first = F.greatest(F.lit(0), F.expr(f"(_i - {size}) div {step} + if(_i >= {size}, 1, 0)"))
    last = F.least(F.expr(f"_i div {step}"), F.expr(f"if(_n >= {size}, (_n - {size}) div {step}, -1)"))
    spread = numbered.where(last >= first).withColumn(index, F.explode(F.sequence(first, last)))
    return spread.withColumn("position", F.col("_i") - F.col(index) * step).drop("_i", "_n")
