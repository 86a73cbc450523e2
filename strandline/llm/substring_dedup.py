"""Removal of word windows that also start in an earlier document (operator 5).

A window is `size` consecutive words of one document. Its anchor is the smallest hash of the GRAM-word sequences inside:
equal windows have equal anchors, and neighbouring windows mostly share theirs. So the number of documents with a
window is at most the number with its anchor.

First pass: each task counts the anchors of its documents (once a document) in the cells of a count-min sketch; the
partial sketches, kept as the cells in use, are merged block by block. What is counted are anchors and not windows, which
overestimates once more: a window whose anchor is estimated to be in one document is in one document, so nothing is lost.
What is broadcast is one bit a cell ("two or more"), 64 MB at most; the cells follow from the size of the input up to that.
When the corpus outgrows the cells, more windows pass to the second pass; results stay the same.

Second pass: only windows estimated repeated are grouped, by 128 bits: two 64-bit hashes, each over hashes of the words
that are independent of the other's, so two windows are taken as one only where both agree. A task first settles the windows that it
has seen in several documents itself: all but the smallest of these documents lose theirs on the spot, so a passage that
a third of the corpus shares is sent once per task and not once per document. The smallest document that has
a window keeps it; the words of the others' windows are removed from the texts in a last pass.

Defined results: a null text has no words; documents under `size` words lose nothing; a row with a null id neither
loses words nor takes any from others; rows with one id do not take from each other; repeated rows each stay a row; texts
of any length are searched whole; an empty table gives no rows. Other columns are handed on whatever their names, but for
n_words, n_removed and kept, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._pretokens import chunks
from ._sketch import met_twice, passes, size_for
from ._spark import ready
from ._words import Words, mixed, rolling, signed, windows

GRAM = 8
#: Candidate windows that a task holds before it settles and sends them.
HELD = 1_500_000


def anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all windows, and the anchor of each."""
    at = windows(words, size)
    gram = min(GRAM, size)
    low = rolling(words.hashes, gram)
    span, width = 1, size - gram + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    if span < width and len(low):
        low = np.minimum(low[: span - width], low[width - span :])
    return at, low[at]


def sketch(docs: DataFrame, size: int, cells: int) -> np.ndarray:
    """One bit for each cell: whether two documents or more have an anchor in it. docs: (doc_id, text)."""

    def once_a_document(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for a, b in chunks(batch.column(1)):
            words = Words(batch.column(1).slice(a, b - a))
            at, anchor = anchors(words, size)
            doc = np.searchsorted(words.ends, at, "right").astype(np.uint64)
            change = np.ones(len(at), bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            anchor, doc = anchor[change], doc[change]
            _, once = np.unique(mixed(anchor ^ mixed(doc + np.uint64(1))), return_index=True)
            yield anchor[once]

    return met_twice(docs, once_a_document, cells)


_FOUND = "k1 long, k2 long, doc_id long, mark long, start int, stop int, lost boolean"


def _settle(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, size: int) -> pa.RecordBatch:
    """The smallest document's windows go on; those of others that the same task holds are lost, and sent as spans."""
    order = np.lexsort((doc, k2, k1))
    k1, k2, doc, mark, start = (x[order] for x in (k1, k2, doc, mark, start))
    first = np.ones(len(k1), bool)
    first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    smallest = doc[first][np.cumsum(first) - 1]
    lost = doc > smallest
    own = ~lost
    a, m, d = start[lost], mark[lost], doc[lost]
    order = np.lexsort((a, m, d))
    a, m, d = a[order], m[order], d[order]
    new = np.ones(len(a), bool)
    new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (a[1:] > a[:-1] + size)
    last = np.append(np.flatnonzero(new)[1:], len(a)) - 1 if len(a) else np.zeros(0, np.int64)
    d, m, b, a = d[new], m[new], a[last] + size, a[new]
    spread = mixed(d.astype(np.uint64) * np.uint64(31) + a.astype(np.uint64))  # these need no grouping, so any key does
    join = lambda x, y: np.concatenate([x, y])
    columns = [join(k1[own], signed(spread)), join(k2[own], d), join(doc[own], d), join(mark[own], m), join(start[own], a), join(start[own] + size, b), join(np.zeros(own.sum(), bool), np.ones(len(a), bool))]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["k1", "k2", "doc_id", "mark", "start", "stop", "lost"])


def repeated_spans(docs: DataFrame, size: int, cells: int | None = None) -> DataFrame:
    """(doc_id, mark, spans): for each text that loses words the spans of its windows that start in an earlier document. docs: (doc_id, mark, text); mark tells rows with one id apart."""
    spark = docs.sparkSession
    cells = cells or size_for(docs)
    bits = spark.sparkContext.broadcast(sketch(docs.select("doc_id", "text"), size, cells))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = bits.value, [], 0
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                words = Words(batch.column(2).slice(a, b - a), both=True)
                at, anchor = anchors(words, size)
                at = at[passes(anchor, seen, cells)]
                doc = np.searchsorted(words.ends, at, "right")
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                marks = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)
                held.append((signed(rolling(words.hashes, size, 0))[at], signed(rolling(words.second, size, 1))[at], ids[doc].astype(np.int64), marks[doc].astype(np.int64), (at - words.begins[doc]).astype(np.int32)))
                n += len(at)
                if n > HELD:
                    yield _settle(*map(np.concatenate, zip(*held, strict=True)), size)
                    held, n = [], 0
        if n:
            yield _settle(*map(np.concatenate, zip(*held, strict=True)), size)

    found = docs.where(F.col("doc_id").isNotNull()).mapInArrow(find, _FOUND)
    first = F.min("doc_id").over(Window.partitionBy("k1", "k2"))
    gone = found.withColumn("first", first).where(F.col("lost") | (F.col("first") < F.col("doc_id")))
    span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))
    return gone.groupBy("doc_id", "mark").agg(F.collect_list(span).alias("spans"))


def remove_repeats(docs: DataFrame, size: int = 50, cells: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and n_words, n_removed, kept: the kept words joined by one blank. Columns of docs with these names are replaced."""
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    text = F.col(text_col).cast("string")
    # The other columns travel in a struct, so their names are free.
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"), F.struct(*(c for c in names if c != text_col)).alias("row"))
    spans = repeated_spans(held.select("doc_id", "mark", "text"), size, cells)
    joined = held.join(spans, ["doc_id", "mark"], "left").select("row", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if own.is_valid:
                    packed = np.sort(own.values.to_numpy())
                    start, stop = packed >> 32, packed & 0xFFFFFFFF
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, stop, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(stay)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["row", "text", "n_words", "n_removed", "kept"])

    # bytes.split() cuts at 0x20 and 0x09 to 0x0D, as the words are defined.
    schema = StructType([held.schema["row"], held.schema["text"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    own = lambda c: F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("row")[c].alias(c)
    return joined.mapInArrow(remove, schema).select(*map(own, names), "n_words", "n_removed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents covered by 50-word windows of earlier documents, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES: dict[str, str] = {}
