"""From probabilities of windows to clean segments of behaviour.

Two steps depend on all that came before within a sequence and run in numpy over many sequences at once: the Viterbi path,
and the repeated absorption of short runs. All else (bouts, gaps, shakes, thresholds, painting, segments) is window expressions.

A sequence is what `keys` tell apart, as a rule a device's day: 172,800 windows at two a second, so a group is bounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scores
from . import islands, intervals


@dataclass(frozen=True)
class StableParams:
    """Limits of the decoder."""

    scratch: str = "scratch"
    shake: str = "shake"
    smooth_windows: int = 7
    min_state_ms: int = 10_000
    enter: float = 0.5
    stay: float = 0.25
    gap_ms: int = 4000
    shake_gap_ms: int = 3000
    min_windows: int = 2
    min_mean: float = 0.45
    single: float = 0.85
    spectral_min: float = 0.0
    switch_cost: float = 3.0
    candidate_enter: float = 0.3
    candidate_stay: float = 0.25
    candidate_windows: int = 2
    candidate_mean: float = 0.3
    candidate_most: int = 40
    candidate_spec_min: float = 0.0
    refine_margin_s: float = 1.0
    refine_ratio: float = 0.3


def viterbi_paths(probs: np.ndarray, begins: np.ndarray, switch_cost: float) -> np.ndarray:
    """States of the best path through each sequence of (n, classes) probabilities; begins: where sequences begin.

    One step is taken for all sequences at once, the longest ones first in the arrays. Staying wins ties with switching,
    the first class ties between classes.
    """
    n, m = probs.shape
    length = np.diff(np.append(begins, n))
    order = np.argsort(-length, kind="stable")
    begin, length = begins[order], length[order]
    emit, own = np.log(np.maximum(probs, 1e-6)), np.arange(m, dtype=np.int16)
    back, path = np.empty((n, m), np.int16), np.empty(n, np.int16)
    score = emit[begin]
    # alive[t]: how many sequences have more than t windows.
    alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    for t in range(1, len(alive)):
        k = alive[t]
        now, at = score[:k], begin[:k] + t
        best = now.argmax(axis=1)
        switch = now[np.arange(k), best] - switch_cost
        stays = now >= switch[:, None]
        back[at] = np.where(stays, own, best[:, None])
        score[:k] = np.where(stays, now, switch[:, None]) + emit[at]
    state = score.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        path[begin[:k] + t] = state[:k]
        if t:
            state[:k] = back[begin[:k] + t, state[:k]]
    return path


def absorb_short(labels: Sequence[str], z0: np.ndarray, z1: np.ndarray, least_ms: int) -> list[str]:
    """Runs of under least_ms take the label of the longer neighbour (the left one on ties), the shortest first, until none is left.

    Runs are a linked list, and a heap gives the next one, so it takes n log n steps.
    """
    n = len(labels)
    if not n:
        return []
    change = np.flatnonzero([a != b for a, b in zip(labels[1:], labels[:-1], strict=True)]) + 1
    first = np.append(0, change)
    kind, begin, end = [labels[k] for k in first], z0[first].tolist(), z1[np.append(change, n) - 1].tolist()
    left, right = list(range(-1, len(kind) - 1)), [*range(1, len(kind)), -1]
    size = lambda k: end[k] - begin[k]
    heap = [(size(k), k) for k in range(len(kind)) if size(k) < least_ms]
    heapq.heapify(heap)
    into = list(range(len(kind)))

    def join(a: int, b: int) -> None:
        """Run b becomes part of a, the run before it."""
        into[b], end[a], right[a] = a, end[b], right[b]
        if right[b] >= 0:
            left[right[b]] = a

    while heap:
        length, k = heapq.heappop(heap)
        if into[k] != k or length != size(k):
            continue
        a, b = left[k], right[k]
        if a < 0 and b < 0:
            break
        to = b if a < 0 or b >= 0 and size(b) > size(a) else a
        kind[k] = kind[to]
        if b >= 0 and kind[b] == kind[k]:
            join(k, b)
        if a >= 0 and kind[a] == kind[k]:
            join(a, k)
            k = a
        if size(k) < least_ms:
            heapq.heappush(heap, (size(k), k))
    out, now = [], 0
    for k, many in enumerate(np.diff(np.append(first, n)).tolist()):
        now = k if into[k] == k else now
        out += [kind[now]] * many
    return out


#: Rows of whole sequences that are worked on at once.
ROWS_AT_ONCE = 50_000
#: Windows that a task sorts: some 0.2 kB each, in each sort of settle().
ROWS_A_TASK = 200_000


def tasks_for(rows: int, least: int) -> int:
    """How many tasks so many windows take, so that what a task holds doesn't grow with them."""
    return max(least, -(-rows // ROWS_A_TASK))


def whole_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole sequences, many short ones together, and where each begins; _first marks a sequence's first row. No more than a sequence beyond ROWS_AT_ONCE is held."""
    held, rows = [], 0

    def done(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, np.flatnonzero(table["_first"].to_numpy())

    for batch in batches:
        begins = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
        if len(begins) and rows + begins[-1] >= ROWS_AT_ONCE:
            yield done([*held, batch.slice(0, begins[-1])])
            held, rows, batch = [], 0, batch.slice(begins[-1])
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield done(held)


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, columns: Sequence[str], labels_of, tasks: int | None = None) -> DataFrame:
    """df with a string column that labels_of(batch of `columns`, begins of sequences) gives, dealt to `tasks` by keys if given.

    The window that marks the first row of each sequence deals out and sorts the rows; tasks then get whole sequences one
    after another.
    """
    first = F.row_number().over(islands.ordered(keys, order)) == 1
    names = [f.name for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_sequences(batches):
            if table.num_rows:
                labels = labels_of(table.select(columns), begins)
                yield from table.select(names).append_column(name, pa.array(labels, pa.string())).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = df.withColumn("_first", first).mapInArrow(run, f"{fields}, `{name}` string")
    return out.repartition(tasks, *keys) if tasks else out


def viterbi(df: DataFrame, keys: Sequence[str], order: Sequence[str], classes: Sequence[str], switch_cost: float = 3.0, probs: str = "probs", name: str = "decoded", tasks: int | None = None) -> DataFrame:
    """The most likely class of each window given its sequence; every row has a probability for each class."""
    names = np.array(classes, object)

    def labels_of(table: pa.Table, begins: np.ndarray) -> np.ndarray:
        values = table[probs].combine_chunks().flatten().to_numpy().astype(np.float64)
        return names[viterbi_paths(values.reshape(table.num_rows, -1), begins, switch_cost)]

    return _in_order(df, keys, order, name, [probs], labels_of, tasks)


def absorb_short_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, least_ms: int = 10_000, name: str = "absorbed", tasks: int | None = None) -> DataFrame:
    def labels_of(table: pa.Table, begins: np.ndarray) -> list[str]:
        labels, z0, z1 = table[state].to_pylist(), table["z0"].to_numpy(), table["z1"].to_numpy()
        ends = np.append(begins[1:], len(labels))
        return [x for a, b in zip(begins.tolist(), ends.tolist(), strict=True) for x in absorb_short(labels[a:b], z0[a:b], z1[a:b], least_ms)]

    return _in_order(df, keys, order, name, [state, "z0", "z1"], labels_of, tasks)


def _whole_bout(keys: Sequence[str], order: Sequence[str], bout: str) -> WindowSpec:
    """All rows of a bout in their order, so that means of doubles, and what is at a limit, don't depend on how rows arrive."""
    return islands.ordered((*keys, bout), order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _kept(df: DataFrame, keys: Sequence[str], flag: str, bout: str, p: Column, params: StableParams, spec: str | None, order: Sequence[str] = ()) -> DataFrame:
    """flag, only for bouts whose flagged windows are long and sure enough, or very sure once."""
    of = _whole_bout(keys, order, bout)
    own = lambda c: F.when(F.col(flag), c)
    keep = ((F.count(own(p)).over(of) >= params.min_windows) & (F.avg(own(p)).over(of) >= params.min_mean)) | (F.max(own(p)).over(of) >= params.single)
    if spec and params.spectral_min > 0:
        keep = keep & F.coalesce(F.avg(own(F.col(spec))).over(of) >= params.spectral_min, F.lit(True))
    return df.withColumn(flag, F.col(flag) & F.coalesce(keep, F.lit(False)))


def _apart(keys: Sequence[str], order: Sequence[str]) -> Column:
    """How far the zone of a window is from that of the window before."""
    return F.coalesce(F.col("z0") - F.lag("z1").over(islands.ordered(keys, order)), F.lit(0))


def _bouts(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, name: str, params: StableParams, whole: str | None = None) -> DataFrame:
    """A number for each bout of flag; windows without it have numbers as well. Zones too far apart end a bout, but not within a run of `whole` (a flag), which hysteresis has found as one."""
    apart = _apart(keys, order)
    if whole:
        w = islands.ordered(keys, order)
        apart = F.when(F.col(whole) & F.coalesce(F.lag(whole).over(w), F.lit(False)), F.lit(0)).otherwise(apart)
    return islands.with_run(df, keys, order, F.col(flag), (apart, F.lit(params.gap_ms)), name=name)


def stabilise(df: DataFrame, keys: Sequence[str], order: Sequence[str], classes: Sequence[str], window_ms: int, stride_ms: int, params: StableParams = StableParams(), algo: str = "viterbi", centre: bool = False, spec: str | None = None, tasks: int | None = None) -> DataFrame:
    """df (with ts_ms, label and probs in the order of classes) with z0, z1 and the final label of every window.

    algo: `viterbi` decodes the whole sequence; `stable` smooths states, absorbs short ones and finds bouts by hysteresis.
    tasks: how many share the sequences (see tasks_for), the session's own count without it.
    """
    out = islands.with_zone(df, keys, order, "ts_ms", window_ms, stride_ms, centre)
    if algo == "viterbi":
        out = viterbi(out, keys, order, classes, params.switch_cost, tasks=tasks)
    elif algo != "stable":
        raise ValueError(f"algo {algo}")
    return settle(out, keys, order, classes, params, algo, spec, tasks).select(*df.columns, "z0", "z1", "final")


def _kinds(classes: Sequence[str], params: StableParams) -> tuple[list[str], list[tuple[str, int]]]:
    """The classes that are events, and the others with their places in probs."""
    events = [e for e in (params.scratch, params.shake) if e in classes]
    return events, [(c, k) for k, c in enumerate(classes) if c not in events]


def settle(out: DataFrame, keys: Sequence[str], order: Sequence[str], classes: Sequence[str], params: StableParams = StableParams(), algo: str = "viterbi", spec: str | None = None, tasks: int | None = None) -> DataFrame:
    """out (with z0, z1, label, probs, and for viterbi decoded) with the final label of every window."""
    events, states = _kinds(classes, params)
    p = {e: F.col("probs")[list(classes).index(e)] for e in events}
    names = out.columns
    if algo == "viterbi":
        state = F.when(~F.col("decoded").isin(events), F.col("decoded")) if events else F.col("decoded")
        out = islands.forward_fill(out, keys, order, state, "state")
        out = out.withColumn("state", F.coalesce("state", F.lit(states[0][0] if states else "")))
        flags = {e: F.col("decoded") == e for e in events}
        shaken = (F.col("label") == params.shake) | (F.col("decoded") == params.shake)
    else:
        out = islands.moving_state(out, keys, order, "probs", states, params.smooth_windows, "_smooth")
        out = absorb_short_runs(out, keys, order, "_smooth", params.min_state_ms, "state", tasks).drop("_smooth")
        for e in events:
            out = islands.hysteresis(out, keys, order, p[e], params.enter, params.stay, f"_in_{e}")
        flags = {e: F.col(f"_in_{e}") for e in events}
        shaken = F.col("label") == params.shake
    whole = lambda e: f"_in_{e}" if algo == "stable" else None
    for e in events:
        out = out.withColumn(f"_{e}", flags[e])
    for e in events:
        out = islands.fill_gaps(out, keys, order, f"_{e}", params.gap_ms)
    if set(events) == {params.scratch, params.shake}:
        # A bout of shaking is judged as one, also where scratching takes windows out of its middle.
        out = _bouts(out, keys, order, f"_{params.shake}", f"_bout_{params.shake}", params, whole(params.shake))
        out = islands.absorb(out, keys, order, f"_{params.scratch}", F.coalesce(shaken, F.lit(False)), (_apart(keys, order), F.lit(params.shake_gap_ms)), run="_together")
        order = ("_together", *order)
        out = islands.fill_gaps(out, keys, order, f"_{params.scratch}", params.gap_ms)
        out = out.withColumn(f"_{params.shake}", F.col(f"_{params.shake}") & ~F.col(f"_{params.scratch}"))
    for e in events:
        if f"_bout_{e}" not in out.columns:
            out = _bouts(out, keys, order, f"_{e}", f"_bout_{e}", params, whole(e))
        out = _kept(out, keys, f"_{e}", f"_bout_{e}", p[e], params, spec if e == params.scratch else None, order)
    final = F.col("state")
    for e in reversed(events):
        final = F.when(F.col(f"_{e}"), e).otherwise(final)
    return out.withColumn("final", final).select(*names, "final")


def segments(stable: DataFrame, keys: Sequence[str], order: Sequence[str], classes: Sequence[str], spec: str | None = None) -> DataFrame:
    """Segments of the final label, with confidences of that class."""
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("final")).cast("int")
    return islands.segments(stable, keys, order, "final", F.element_at("probs", place), spec)


def candidates(df: DataFrame, found: DataFrame, keys: Sequence[str], order: Sequence[str], p: Column, params: StableParams = StableParams(), most: int | None = None, spec: str | None = None) -> DataFrame:
    """Bouts that the final segments (start_ms, end_ms) have not taken, for people to look at.

    reason low_conf: by lower limits of the probability p. reason spectral (off unless candidate_spec_min is set): runs of
    other free windows whose spectral share is high. rank puts the surest first; `most` a sequence stay where it is given.
    """
    low = islands.hysteresis(df.withColumn("_p", p), keys, order, F.col("_p"), params.candidate_enter, params.candidate_stay, "_low")
    low = islands.with_run(islands.fill_gaps(low, keys, order, "_low", params.gap_ms), keys, order, F.col("_low"), name="_id")
    low = low.withColumn("_spec", F.col(spec).cast("double") if spec else F.lit(None).cast("double"))
    marked = intervals.mark_overlap(low, found, keys, order, ("z0", "z1"), ("start_ms", "end_ms"))
    bout = _whole_bout(keys, order, "_id")
    free = F.when(F.col("_low") & ~F.col("taken"), F.col("z0"))
    inside = marked.withColumn("_a", F.min(free).over(bout)).withColumn("_b", F.max(free).over(bout)).withColumn("_n", F.count(free).over(bout))

    def bouts(windows: DataFrame, run: str, reason: str) -> DataFrame:
        out = windows.groupBy(*keys, run).agg(F.min("z0").alias("start_ms"), F.max("z1").alias("end_ms"), F.max("_p").alias("conf_max"), F.avg("_p").alias("conf_mean"), F.count("*").alias("n_windows"), scores.round_even(F.avg("_spec"), 3).alias("spec"))
        return out.drop(run).withColumn("reason", F.lit(reason))

    whole = F.col("_n") >= params.candidate_windows
    out = bouts(inside.where(whole & F.col("z0").between(F.col("_a"), F.col("_b"))), "_id", "low_conf").where(F.col("conf_mean") >= params.candidate_mean)
    if params.candidate_spec_min > 0:
        rest = ~F.col("taken") & ~(F.col("_low") & whole) & F.coalesce(F.col("_spec") >= params.candidate_spec_min, F.lit(False))
        runs = islands.with_run(inside.withColumn("_rest", rest), keys, order, F.col("_rest"), name="_run")
        out = out.unionByName(bouts(runs.where("_rest"), "_run", "spectral").where(F.col("n_windows") >= params.candidate_windows))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("conf_mean"), "start_ms"))
    ranked = out.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= most) if most else ranked


def refine(segments_df: DataFrame, params: StableParams = StableParams()) -> DataFrame:
    """Segments with start and end moved to where energy rises and falls. Columns t0_ms, hz and energy hold the envelope around."""
    df = segments_df.withColumn("_n", F.size("energy"))
    place = lambda c: F.bround((F.col(c) - F.col("t0_ms")) / 1000.0 * F.col("hz"), 0).cast("int")
    df = df.withColumn("_s", place("start_ms")).withColumn("_e", place("end_ms")).withColumn("_m", F.bround(F.lit(params.refine_margin_s) * F.col("hz"), 0).cast("int"))
    inner = F.expr("array_sort(slice(energy, greatest(0, _s) + 1, greatest(0, least(_n, _e) - greatest(0, _s))))")
    df = df.withColumn("_inner", inner).withColumn("_limit", F.when(F.size("_inner") > 0, F.col("_inner")[F.expr("size(_inner) div 2")] * params.refine_ratio))
    reach = "filter(if(least(_n - 1, {0} + _m) >= greatest(0, {0} - _m), sequence(greatest(0, {0} - _m), least(_n - 1, {0} + _m)), array()), i -> energy[i] >= _limit)"
    df = df.withColumn("_from", F.expr(f"array_min({reach.format('_s')})")).withColumn("_to", F.expr(f"array_max({reach.format('_e')})"))
    moved = F.col("_from").isNotNull() & (F.col("_to") > F.col("_from"))
    at = lambda i: (F.col("t0_ms") + F.floor(i / F.col("hz") * 1000.0)).cast("long")
    df = df.withColumn("_start", F.when(moved, at(F.col("_from"))).otherwise(F.col("start_ms"))).withColumn("_end", F.when(moved, at(F.col("_to") + 1)).otherwise(F.col("end_ms")))
    return df.withColumn("start_ms", F.col("_start")).withColumn("end_ms", F.col("_end")).drop("_n", "_s", "_e", "_m", "_inner", "_limit", "_from", "_to", "_start", "_end")
