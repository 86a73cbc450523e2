"""Quality scores by histogram gradient-boosted trees over statistics of texts (operator 13).

Statistics are shares and means over a whole text's characters, words and lines, found for a batch of texts at once; labels, language,
source and id are no part of them. They are stored, so that no text is read twice. Trees are fitted on a sample of the labelled
rows that is bounded by `sample` (about so many rows, chosen by a hash of the id, whatever the corpus); each statistic is cut into up to
BINS bins at quantiles of the sample. A tree grows level by level: the gradients and curvatures of the logistic loss are summed for each
node, statistic and bin, and the best cut of each node follows from running sums over the bins. All trees are flattened into
arrays (statistic, cut, children, value), and rows of a batch go down a tree together, a level at a step.

Defined results: a null text is empty, and an empty text has statistics (zeros) and a score like any other; rows with one id or a null id, and repeated
rows, each stay a row; a row with a null id is never learnt from; labels of ids that are not there, and null labels, are ignored; several labels of one id
each count; texts of any length are measured whole; an empty table gives no rows; without labels, or with labels of one kind alone, all rows get one score: their share
of ones (without any 0.5). Columns other than id, text and label are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pretokens import chunks
from ._spark import ready, stored
from ._words import Words, buffer, mixed, rolling

SAMPLE = 20_000
BINS = 64
STATISTICS = [
    "characters", "words", "bytes a word", "spread of bytes a word", "longest word", "symbols", "digits", "capitals", "words with a capital first", "not ASCII", "exclamations", "commas", "sentence ends", "words at a sentence end",
    "lines", "words a line", "lines met before", "distinct words", "commonest word", "words like the one before", "words met three in a row before", "one-byte words", "entropy of bytes",
]
_BYTES = np.arange(256)
_KINDS = {name: np.isin(_BYTES, [*chars]) for name, chars in {"symbols": b"#*$%&|<>@^~=+_\\{}[]/", "digits": b"0123456789", "capitals": bytes(range(65, 91)), "not ASCII": bytes(range(128, 256)), "exclamations": b"!?", "commas": b",;:", "sentence ends": b"."}.items()}


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    data, offsets = buffer(texts)
    words, docs = Words(texts), len(offsets) - 1
    size, n = np.diff(offsets), words.counts
    bytes_of = np.bincount(np.repeat(np.arange(docs) * 256, size) + data, minlength=256 * docs).reshape(docs, 256)
    out = {k: _share(bytes_of[:, kind].sum(1), size) for k, kind in _KINDS.items()}
    of_word = np.repeat(np.arange(docs), n)
    begin, end = words.places
    length = (end - begin).astype(np.float64)
    mean = _share(np.bincount(of_word, length, docs), n)
    longest = np.zeros(docs)
    np.maximum.at(longest, of_word, length)
    out |= {"characters": np.log1p(size), "words": np.log1p(n), "bytes a word": mean, "longest word": np.log1p(longest)}
    out["spread of bytes a word"] = np.sqrt(np.maximum(0, _share(np.bincount(of_word, length**2, docs), n) - mean**2))
    share = lambda flag: _share(np.bincount(of_word, flag, docs), n)
    out["words with a capital first"] = share(_KINDS["capitals"][data[begin]])
    out["words at a sentence end"] = share(_KINDS["sentence ends"][data[end - 1]])
    out["one-byte words"] = share(length == 1)
    # Equal words of one text, counted by a hash of both.
    key = mixed(words.hashes ^ mixed(of_word.astype(np.uint64) + np.uint64(1)))
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    commonest = np.zeros(docs)
    np.maximum.at(commonest, of_word[first], times)
    out["distinct words"], out["commonest word"] = _share(np.bincount(of_word[first], minlength=docs), n), _share(commonest, n)
    like = np.zeros(len(key), bool)
    like[1:] = key[1:] == key[:-1]
    out["words like the one before"] = share(like)
    three = np.zeros(len(key), bool)
    if len(key) >= 3:
        at = np.flatnonzero(of_word[2:] == of_word[:-2])
        run = rolling(key, 3)[at]
        three[at] = True
        three[at[np.unique(run, return_index=True)[1]]] = False
    out["words met three in a row before"] = share(three)
    # Lines: how many, and how many of them are equal to an earlier one of the text.
    lines, again = np.zeros(docs), np.zeros(docs)
    for k, text in enumerate(texts):
        own = (text.as_py() or "").split("\n")
        lines[k], again[k] = len(own), len(own) - len(set(own))
    out |= {"lines": np.log1p(lines), "words a line": np.log1p(_share(n, lines)), "lines met before": _share(again, lines)}
    p = _share(bytes_of, size[:, None])
    out["entropy of bytes"] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    return np.stack([out[k] for k in STATISTICS], 1).astype(np.float32)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: of each node the statistic, the cut (values up to it go left), the left child (the right one follows), and the value; leaves are their own children."""

    base: float
    roots: np.ndarray
    statistic: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of x."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                # A leaf's cut is infinite, so its rows stay.
                node = self.left[node] + (x[rows, self.statistic[node]] > self.cut[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: float = 4.0) -> Forest:
    """Boosted trees on rows x with labels y (0, 1). least: the smallest sum of curvatures of a leaf."""
    kinds = x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(y) or share in (0, 1):
        empty = np.zeros(0, np.int64)
        return Forest(base, empty, empty, np.zeros(0, np.float32), empty, np.zeros(0), 0)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(kinds)]
    bins = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], 1)  # bin b: values up to cut b and above cut b - 1
    most = np.array([len(c) for c in cuts])
    allowed = np.arange(BINS)[None, :] < most[:, None]
    roots, statistic, cut, left, value, total = [], [], [], [], [], np.full(len(y), base)

    def leaf() -> int:
        statistic.append(0)
        cut.append(np.inf)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = p - y, p * (1 - p)
        roots.append(leaf())
        node, live = np.full(len(y), roots[-1]), np.array([roots[-1]])
        for level in range(depth + 1):
            at = np.searchsorted(live, node)  # nodes of one level have rising numbers
            here = (at < len(live)) & (live[np.minimum(at, len(live) - 1)] == node)
            g, h = np.bincount(at[here], slope[here], len(live)), np.bincount(at[here], curve[here], len(live))
            for k, v in zip(live, -rate * g / (h + ridge), strict=True):
                value[k] = v
            if level == depth:
                break
            cell = ((at[here] * kinds)[:, None] + np.arange(kinds)) * BINS + bins[here]
            sums = [np.bincount(cell.ravel(), np.repeat(w[here], kinds), len(live) * kinds * BINS).reshape(len(live), kinds, BINS).cumsum(2) for w in (slope, curve)]
            gl, hl = sums
            gr, hr = g[:, None, None] - gl, h[:, None, None] - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g**2 / (h + ridge))[:, None, None]
            gain = np.where(allowed & (hl >= least) & (hr >= least), gain, -np.inf).reshape(len(live), -1)
            best, new = gain.argmax(1), []
            for k, b, worth in zip(live.tolist(), best.tolist(), gain.max(1).tolist(), strict=True):
                if worth > 1e-6:
                    statistic[k], cut[k] = b // BINS, cuts[b // BINS][b % BINS]
                    left[k] = leaf()
                    new += [left[k], leaf()]
            if not new:
                break
            # Where a node has been cut, its rows go on.
            s, c, to = np.array(statistic), np.array(cut, np.float32), np.array(left)
            node = to[node] + (x[np.arange(len(y)), s[node]] > c[node])
            live = np.array(new)
        total += np.array(value)[node]
    return Forest(base, np.array(roots), np.array(statistic), np.array(cut, np.float32), np.array(left), np.array(value), depth)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and statistics (array of float, as STATISTICS) of every whole text."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                flat = statistics(batch.column(1).slice(a, b - a)).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(STATISTICS)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "statistics"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, statistics array<float>")


def learn(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id") -> Forest:
    """Trees from the rows of measured() that labels has an id for: from about `sample` labels, by a hash of the id, or from all where there are fewer."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    part = min(1.0, sample / max(1, known.count()))
    chosen = lambda df: df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else df
    found = chosen(rows.where("doc_id is not null")).join(chosen(known), "doc_id").toArrow().combine_chunks()  # bounded by sample
    x = found["statistics"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    y = found["label"].to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])  # sums of floats don't depend on the order of tasks
    return fit(x[order], y[order])


def score_quality(rows: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score, predicted of rows of measured()."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.select("doc_id", "statistics").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept for measuring: never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op13_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from two thirds of the labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = stored(measured(docs), "statistics")
    forest = learn(rows, labels.where(~held_out(F.col("doc_id"))))
    return score_quality(rows, forest).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op13_boosted_quality": op13_boosted_quality}
ORACLES: dict[str, str] = {}
