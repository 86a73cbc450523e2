"""Periodic runs of words, found by suffix automata, and the text without their repeats (operator 11).

A run is a longest stretch of consecutive words with a smallest period q (words q apart are identical) that has `least`
words and 2 q at least.

The states of a suffix automaton stand for the sets of places at which equal passages end; the links between states form a
tree in which a set is the union of those below. The ordered sets are merged from the longest states upwards, the smaller
into the larger. Two places that become neighbours in the set of a state whose passages have at least as many words as the
places are apart end a square: the words between them stand twice in a row. Places that are neighbours once all sets below
are merged can't have a shorter period. Each such pair (p - q, p) is a seed; those of one period at consecutive places
make one run, which reaches back from the first seed by the length that made it one.

A passage of `least` // 2 words inside a run comes again inside the run, and such passages cover all of its words. So states of shorter
passages seed nothing that longer ones don't, and words that no repeated passage of that length covers are in no run. The
latter are found for a batch of texts at once by hashes (equal hashes of different passages only leave more to the
automaton), again and again within the stretches that are left, and an automaton over the words themselves is built for
each stretch that stays. Work is n log n, memory about half a kB a word of the longest stretch.

Defined results: a null text has no words, no runs and an empty collapsed text; rows with one id or a null id, and repeated
rows, each stay a row; texts of any length are searched whole; an empty table gives no rows. Other columns are handed on
whatever their names, but for n_words, runs and collapsed, which are replaced. Where several runs share a word, it goes if any of
them has it after its first q words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ._pretokens import chunks
from ._spark import ready
from ._words import Words, mixed, rolling

LEAST = 12
#: Places in a block of an ordered set; a block of twice as many is split.
BLOCK = 512
_RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))


class Ends:
    """An ordered set of places, in blocks, so that adding one moves few others."""

    __slots__ = ("blocks", "size")

    def __init__(self, place: int) -> None:
        self.blocks, self.size = [[place]], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> tuple[int | None, int | None]:
        """Adds place, which is not in the set; gives its neighbours."""
        blocks = self.blocks
        k = max(0, bisect_right(blocks, place, key=itemgetter(0)) - 1) if len(blocks) > 1 else 0
        block = blocks[k]
        at = bisect_left(block, place)
        before = block[at - 1] if at else blocks[k - 1][-1] if k else None
        after = block[at] if at < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else None
        block.insert(at, place)
        self.size += 1
        if len(block) >= 2 * BLOCK:
            blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
        return before, after


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Of each state of the suffix automaton: the words of its longest passage, its link, and the place at which it was made (copies: -1)."""
    length, link, place, step = [0], [-1], [-1], [{}]
    last = 0
    for i, word in enumerate(words):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        place.append(i)
        step.append({})
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            to = step[at][word]
            if length[to] > length[at] + 1:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                place.append(-1)
                step.append(dict(step[to]))
                link[to] = copy
                while at >= 0 and step[at].get(word) == to:
                    step[at][word] = copy
                    at = link[at]
                to = copy
            link[new] = to
        last = new
    return length, link, place


def seeds(words: list, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): words that end at place and, as many as the period and `gram` at least, end a period earlier too."""
    length, link, place = automaton(words)
    sizes = np.array(length)
    order = np.argsort(-sizes, kind="stable")[: int((sizes >= gram).sum())]
    below: dict[int, list[Ends]] = defaultdict(list)
    found, periods = [], []
    for state in order.tolist():
        parts = below.pop(state, [])
        if place[state] >= 0:
            parts.append(Ends(place[state]))
        whole, most = parts[0], length[state]
        if len(parts) > 1:
            whole = max(parts, key=lambda p: p.size)
            near: dict[int, int] = {}
            for part in parts:
                if part is not whole:
                    for p in part:
                        before, after = whole.add(p)
                        if before is not None and p - before <= most:
                            near[p] = before
                        if after is not None and after - p <= most:
                            near[after] = p  # and no longer what was the neighbour until now
            found += near
            periods += [p - before for p, before in near.items()]
        if length[link[state]] >= gram:
            below[link[state]].append(whole)
    return np.array(found, np.int64), np.array(periods, np.int64)


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of words, by start and period."""
    gram = least // 2
    place, period = seeds(words, gram)
    if not len(place):
        return []
    both = np.unique(period * len(words) + place)
    period, place = both // len(words), both % len(words)
    first = np.ones(len(both), bool)
    first[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)
    begins = np.flatnonzero(first)
    q, stop = period[begins], place[np.append(begins[1:], len(both)) - 1] + 1
    start = place[begins] - q - np.maximum(q, gram) + 1
    long = stop - start >= np.maximum(least, 2 * q)
    return sorted(zip(start[long].tolist(), (stop - start)[long].tolist(), q[long].tolist(), strict=True))


def stretches(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of the stretches that can hold runs: all their words in passages that come again within the stretch."""
    gram = least // 2
    begins, ends, text = words.begins, words.ends, np.arange(len(words.begins))
    hashes = rolling(words.hashes, gram)
    left = -1
    while True:
        long = ends - begins >= least
        begins, ends, text = begins[long], ends[long], text[long]
        total = int((ends - begins).sum())
        if total in (0, left):
            return text, begins - words.begins[text], ends - words.begins[text]
        left = total
        n = ends - begins - gram + 1
        group = np.repeat(np.arange(len(n)), n)
        at = np.arange(int(n.sum())) + (begins - (np.cumsum(n) - n))[group]
        key = mixed(hashes[at] ^ mixed(group.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        at, group = at[again], group[again]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] > at[:-1] + gram) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        begins, ends, text = at[first], at[last] + gram, text[group[first]]


def collapse_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """All columns of docs, and n_words, runs (array of start, length, period by start and period), collapsed: the words without those that any run has after its first period, joined by one blank."""
    if least < 2:
        raise ValueError("a run has two words at least")
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    held = docs.select(F.struct(*names).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                found = Words(texts)
                inside = defaultdict(list)
                for text, start, stop in zip(*(x.tolist() for x in stretches(found, least)), strict=True):
                    inside[text].append((start, stop))
                every, collapsed = [], []
                for k, text in enumerate(texts):
                    words = (text.as_py() or "").encode().split()  # cuts at 0x20 and 0x09 to 0x0D, as words are defined
                    own = [(start + s, n, q) for start, stop in inside.get(k, ()) for s, n, q in runs_of(words[start:stop], least)]
                    if own:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for s, n, q in own:
                            edge[s + q] += 1
                            edge[s + n] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    every.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    collapsed.append(b" ".join(words).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found.counts, pa.int64()), pa.array(every, kind), pa.array(collapsed, pa.string())], ["row", "n_words", "runs", "collapsed"])

    schema = StructType([held.schema["row"]]).add("n_words", "long").add("runs", _RUNS).add("collapsed", "string")
    return held.mapInArrow(run, schema).select(*(F.col("row")[c].alias(c) for c in names), "n_words", "runs", "collapsed")


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents; a tenth of the texts, chosen by the id's checksum, go on periodically from one of their words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    periodic = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("words", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))).cast("int") + 1)), " ")
    docs = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", n)
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    return docs.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and collapsed text of every document, a tenth of them made periodic."""
    found = collapse_runs(with_periods(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # The greatest length; then the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}
