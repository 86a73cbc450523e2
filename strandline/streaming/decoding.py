"""The decoder on windows as they arrive: the same intervals as the batch query gives, however the stream is cut.

A device's windows wait in state until the watermark has passed them, so they are taken in order of time. An online
Viterbi decoder keeps the scores and the back pointers of the windows that are still open: once the best paths to all
classes meet in one window, it and all before it are decided. Decided windows are given out in blocks. A block ends where
nothing before depends on what follows, nor the other way round: between two windows of different lasting classes that no
event is near, or at a pause or the end of a local day. Window expressions of the batch decoder settle each block by itself;
intervals of one code that touch across blocks are joined when they are stored.

Defined results: windows later than the watermark are left out, as in any stream; a window whose time was there before
comes right after it; a block whose classes never change stays in state until a pause, at most for its local day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import labels, scores
from ..operators import decode, islands
from .incremental import upsert_each_batch

#: The state store that stateful processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OnlineViterbi:
    """Viterbi over windows that come one after another; score and back are all that it has to remember."""

    def __init__(self, classes: int, switch_cost: float, score: Sequence[float] = (), back: Sequence[int] = ()) -> None:
        self.cost, self.score = switch_cost, np.array(score, np.float64)
        # A row for each open window: from which class of the window before each class is reached best.
        self.back = [row for row in np.array(back, np.int64).reshape(-1, classes)]

    def push(self, probs: np.ndarray) -> list[int]:
        """Takes in a window and gives the classes of the windows that this decides, which are the first open ones."""
        emit, own = np.log(np.maximum(probs, 1e-6)), np.arange(len(probs))
        if not len(self.score):
            self.score, self.back = emit, [own]
            return []
        best = int(self.score.argmax())
        stays = self.score >= self.score[best] - self.cost
        self.back.append(np.where(stays, own, best))
        self.score = np.where(stays, self.score, self.score[best] - self.cost) + emit
        alive = own
        for t in range(len(self.back) - 1, 0, -1):
            alive = np.unique(self.back[t][alive])  # classes of window t - 1 on the best path to any class now
            if len(alive) == 1:
                return self._decide(int(alive[0]), t)
        return []

    def _decide(self, last: int, n: int) -> list[int]:
        """The classes of the first n open windows, the last of which has class `last`."""
        out = [last]
        for t in range(n - 1, 0, -1):
            out.append(int(self.back[t][out[-1]]))
        self.back = self.back[n:]
        return out[::-1]

    def finish(self) -> list[int]:
        """The classes of all open windows, as nothing follows."""
        return self._decide(int(self.score.argmax()), len(self.back)) if len(self.score) else []


_WINDOW = "ts_ms long, day_ts long, label string, probs array<double>"
_HELD = f"idx long, {_WINDOW}, decoded int"


class Blocks(StatefulProcessor):
    """A device's windows to blocks of decided ones."""

    def __init__(self, key: str, classes: Sequence[str], params: decode.StableParams, window_ms: int, pause_ms: int) -> None:
        self.key, self.classes, self.params, self.window_ms, self.pause_ms = key, list(classes), params, window_ms, pause_ms
        self.events = {k for k, c in enumerate(classes) if c in (params.scratch, params.shake)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WINDOW)
        self.held = handle.getListState("held", _HELD)
        self.decoder = handle.getValueState("decoder", "part_ms long, block long, score array<double>, back array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        waiting = [*self.waiting.get(), *zip(new["ts_ms"].tolist(), new["day_ts"].tolist(), new["label"].tolist(), [list(map(float, p)) for p in new["probs"]], strict=True)]
        yield from self._go_on(key, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._go_on(key, list(self.waiting.get()), timerValues.getCurrentWatermarkInMs())

    def _go_on(self, key: tuple, waiting: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        waiting.sort(key=lambda w: w[0])
        ready = [w for w in waiting if w[0] <= watermark]
        part, block, score, back = self.decoder.get() if self.decoder.exists() else (None, None, (), ())
        held = [list(h) for h in self.held.get()]
        decoder = OnlineViterbi(len(self.classes), self.params.switch_cost, score, back)
        out: list[tuple] = []
        first = next((k for k, h in enumerate(held) if h[5] is None), len(held))  # the first open window

        def give(n: int, after: int | None) -> None:
            """The first n held windows are a block; after: when the next window begins."""
            nonlocal held, first, block
            ends = [*(h[1] for h in held[1:n]), after if after is not None else held[n - 1][1] + self.window_ms]
            out.extend((h[2], part, block, h[0], h[1], h[1], end, h[3], h[4], self.classes[h[5]]) for h, end in zip(held[:n], ends, strict=True))
            held, first = held[n:], first - n
            block = after

        def close() -> None:
            nonlocal decoder, first
            for state in decoder.finish():
                held[first][5] = state
                first += 1
            if held:
                give(len(held), None)
            decoder = OnlineViterbi(len(self.classes), self.params.switch_cost)

        for ts, day, label, probs in ready:
            if held and (ts - held[-1][1] > self.pause_ms or day != held[-1][2]):
                close()
            if not held:
                part = block = ts
            held.append([held[-1][0] + 1 if held else 0, ts, day, label, probs, None])
            for state in decoder.push(np.array(probs)):
                held[first][5] = state
                first += 1
        if held and watermark > held[-1][1] + self.pause_ms:
            close()
        else:
            cut = self._cut(held[:first])
            if cut:
                give(cut, held[cut][1])
        rest = waiting[len(ready) :]
        self._store(part, block, decoder, held, rest)
        for at in {*(w[0] for w in rest[-1:]), *([held[-1][1] + self.pause_ms] if held else [])}:
            self.handle.registerTimer(at + 1)
        names = ["day_ts", "part_ms", "block", "idx", "ts_ms", "z0", "z1", "label", "probs", "decoded"]
        if out:
            done = pd.DataFrame(out, columns=names)
            done.insert(0, self.key, key[0])
            yield done

    def _cut(self, decided: list[list]) -> int:
        """How many of the decided windows are a block: up to the last change of class that no event is near."""
        quiet, cut, clear = True, 0, None  # clear: from when on the last event is far enough
        for k, (_, ts, _, label, _, state) in enumerate(decided):
            now = state not in self.events and label != self.params.shake
            if k and quiet and now and state != decided[k - 1][5] and (clear is None or ts > clear):
                cut = k
            if not now:
                clear = (decided[k + 1][1] if k + 1 < len(decided) else ts + self.window_ms) + self.params.gap_ms
            quiet = now
        return cut

    def _store(self, part: int | None, block: int | None, decoder: OnlineViterbi, held: list, rest: list) -> None:
        for state, rows in ((self.held, [tuple(h) for h in held]), (self.waiting, [tuple(w) for w in rest])):
            state.put(rows) if rows else state.clear()
        if held:
            self.decoder.update((part, block, decoder.score.tolist(), np.array(decoder.back).ravel().tolist()))
        else:
            self.decoder.clear()


def blocks(windows: DataFrame, classes: Sequence[str], window_ms: int, key: str = "device_id", params: decode.StableParams = decode.StableParams(), late: str = "1 minute", pause_ms: int = 2000) -> DataFrame:
    """windows (a stream of key, ts_ms, day_ts, label, probs) as decided windows: key, day_ts, part_ms, block, idx, ts_ms, z0, z1, label, probs, decoded."""
    kind = dict(windows.dtypes)[key]
    timed = windows.select(key, "ts_ms", "day_ts", "label", "probs", F.timestamp_millis("ts_ms").alias("event_time")).withWatermark("event_time", late)
    schema = f"`{key}` {kind}, day_ts long, part_ms long, block long, idx long, ts_ms long, z0 long, z1 long, label string, probs array<double>, decoded string"
    return timed.groupBy(key).transformWithStateInPandas(Blocks(key, classes, params, window_ms, pause_ms), schema, "append", "eventTime")


def behaviour_of_blocks(decided: DataFrame, classes: Sequence[str], key: str = "device_id", params: decode.StableParams = decode.StableParams(), codes: dict[str, int] = labels.CODES) -> DataFrame:
    """Intervals of blocks() as inference.behaviour() gives them, but for joins across blocks: key, day_ts, ts_start, ts_end, behavior, confidence, n_windows."""
    keys = (key, "day_ts", "part_ms", "block")
    found = decode.segments(decode.settle(decided, keys, ["idx"], classes, params), keys, ["idx"], classes)
    found = found.withColumn("behavior", F.try_element_at(labels.literal_map(codes), F.col("final"))).where("behavior is not null")
    return found.select(key, "day_ts", F.col("start_ms").alias("ts_start"), F.col("end_ms").alias("ts_end"), "behavior", scores.round_even(F.col("conf_mean"), 4).alias("confidence"), "n_windows")


def store_behaviour(path: str, classes: Sequence[str], key: str = "device_id", params: decode.StableParams = decode.StableParams(), codes: dict[str, int] = labels.CODES) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on blocks(): keeps the intervals of all days under path (read them with incremental.latest()).

    Blocks come in order of time, so joining what is stored with what is new folds confidences in the order of the batch query.
    """

    def merge(before: DataFrame | None, decided: DataFrame) -> DataFrame:
        new = behaviour_of_blocks(decided, classes, key, params, codes)
        every = new if before is None else before.select(*new.columns).unionByName(new)
        return islands.coalesce_events(every, (key, "day_ts"), totals=("n_windows",)).drop("n_events")

    return upsert_each_batch(path, merge)
