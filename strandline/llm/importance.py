"""Importance resampling of documents towards a target distribution (operator 12).

Features are all runs of one to three consecutive words, counted by the CRC-32 of their bytes modulo `buckets`. A first pass
over the source and one over the target sum the counts of each bucket; a bucket's gain is the logarithm of how much more
often the target has it, in whole thousandths. A second pass adds up the gains of each document's features from an array
of all gains. Checksums of runs are put together from those of their words, a batch of texts at once.

A score is the weight plus Gumbel noise that depends on the id alone, so that the highest scores are a draw without
replacement. They are found by an exact histogram of the integer scores: its rows are dealt by ranges of scores and stored, the sums of
the ranges after one give how many documents lie above it, and running sums inside a range the rank offset of each score. The
cutoff is the score whose offset is below the number to draw and whose own documents reach it; within a score that
survives, documents follow each other by id. No step orders all documents, and what the driver gets is one row a bucket
and one a range.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z: digits, letters and all that is not ASCII.

Defined results: a null or empty text has no words, no features and the weight 0; documents of fewer than `least` words, and rows
with a null id, have no rank (a null id no score either) and are not counted among those to draw from; rows with one id have the same noise and
are drawn each for itself (which of them comes first is open where their scores are equal); repeated rows each stay a row; texts of any length
are counted whole; an empty source gives no rows, an empty target counts nothing. Columns other than id and text are ignored whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._pretokens import chunks
from ._spark import ready, stored
from ._words import buffer

LONGEST = 3
BUCKETS = 10_000
_BYTES = np.arange(256, dtype=np.uint8)
_LOWERED = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)
_INSIDE = (_LOWERED >= 0x80) | (_LOWERED >= ord("a")) & (_LOWERED <= ord("z")) | (_LOWERED >= ord("0")) & (_LOWERED <= ord("9"))
#: Words of up to so many bytes have a table of their own for moving a checksum on.
_NEAR = 64


@lru_cache(1)
def _step() -> np.ndarray:
    """What one byte makes of a CRC-32 register (polynomial 0xEDB88320, reflected)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by what it makes of each value of each of the four bytes."""
    out = table[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= table[k][crc >> np.uint32(8 * k) & np.uint32(255)]
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps over 0 to _NEAR zero bytes, and over powers of two of them."""
    own = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    near = [own]
    for _ in range(_NEAR):
        near.append(_step()[near[-1] & np.uint32(255)] ^ near[-1] >> np.uint32(8))
    doubled = [near[1]]
    for _ in range(31):
        doubled.append(_moved(doubled[-1], doubled[-1]))
    return np.array(near), doubled


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of two strings in a row, from those of both and the length of the second."""
    near, doubled = _tables()
    short = np.minimum(length, _NEAR)
    out = near[short, 0, first & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= near[short, k, first >> np.uint32(8 * k) & np.uint32(255)]
    long = np.flatnonzero(length > _NEAR)
    if len(long):
        crc, rest = first[long], length[long]
        for bit in range(int(rest.max()).bit_length()):
            some = rest >> bit & 1 == 1
            crc[some] = _moved(doubled[bit], crc[some])
        out[long] = crc
    return out ^ second


def word_sums(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of words, by their first, second, third bytes and so on."""
    out = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-length)
    ordered, at, table = length[order], begin[order], _step()
    crc = out[order]
    for k in range(min(_NEAR, int(ordered[0]) if len(ordered) else 0)):
        m = int(np.searchsorted(-ordered, -k))  # words of more than k bytes
        crc[:m] = table[(crc[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ crc[:m] >> np.uint32(8)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(length > _NEAR):
        out[k] = zlib.crc32(data[begin[k] : begin[k] + length[k]].tobytes())
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of each text, and for runs of 1, 2 and 3 words: the buckets of all runs, and how many of them are there up to the end of each text."""
    data, offsets = buffer(texts)
    data = _LOWERED[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = np.append(_INSIDE[data], False)
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    stop = inside[:-1] & (~inside[1:] | edge[1:])
    begin, length = np.flatnonzero(start), np.flatnonzero(stop) + 1
    length -= begin
    own = word_sums(data, begin, length)
    stops = np.searchsorted(begin, offsets)
    counts, spaced = np.diff(stops), joined(own, np.full(len(own), zlib.crc32(b" "), np.uint32), np.ones(len(own), np.int64))
    text = np.repeat(np.arange(len(counts)), counts)
    left = stops[1:][text] - np.arange(len(own))  # words up to the end of the text
    out, run, width = [], own, length
    for n in range(1, LONGEST + 1):
        whole = left[: len(run)] >= n
        out.append(((run[whole] % np.uint32(buckets)).astype(np.int64), np.cumsum(np.maximum(0, counts - n + 1))))
        # One word and a blank come before the run that starts a word later.
        more = max(0, len(run) - 1)
        run, width = joined(spaced[:more], run[1:], width[1:]), length[:more] + 1 + width[1:]
    return counts, out


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                for found, _ in features(batch.column(0).slice(a, b - a), buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "n": total[used]})

    ready(docs.sparkSession)
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p target / p source)) of each bucket, with one more of each."""
    s, t, more = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + more) / ((a + 1) * (t + more)))) for a, b in zip(map(float, source), map(float, target), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every whole text."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                counts, found = features(batch.column(1).slice(a, b - a), len(gain))
                n, weight = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for bucket, stops in found:
                    total = np.append(0, np.cumsum(gain[bucket]))
                    weight += np.diff(total[stops], prepend=0)
                    n += np.diff(stops, prepend=0)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_words": counts.astype(np.int64), "n_features": n, "weight": weight})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):  # noqa: ANN001, ANN201
    """floor(1000 x a Gumbel variable) of an id, as a column."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int) -> DataFrame:
    """scored (stored; with doc_id, score and eligible) and rank: 1, 2, 3 ... by score, then id, for `percent` of a hundred eligible rows, rounded down; null for the others."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = scored.where("eligible").groupBy("score").agg(F.count("*").alias("n"))
    # Stored, so that a range stays what it is however often it is read.
    histogram = stored(counts.repartitionByRange(parts, F.col("score").desc()).withColumn("range", F.spark_partition_id()), "scores")
    above, before = 0, []
    for r in histogram.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # one row a range
        before.append((r["range"], above))
        above += r["n"]
    drawn = percent * above // 100
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not drawn:
        return none
    wanted = [x for x in before if x[1] < drawn]
    in_range = Window.partitionBy("range").orderBy(F.col("score").desc())
    start = scored.sparkSession.createDataFrame(wanted, "range int, before long")
    earlier = F.coalesce(F.sum("n").over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = histogram.join(F.broadcast(start), "range").select("score", "n", (F.col("before") + earlier).alias("offset")).where(F.col("offset") < drawn)
    cutoff = offsets.agg(F.min("score")).first()[0]
    survives = F.col("eligible") & (F.col("score") >= cutoff)
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = scored.where(survives).join(offsets.select("score", "offset"), "score").withColumn("rank", rank)
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*none.columns).unionByName(none.where(~survives | survives.isNull()))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank is null where it isn't drawn."""
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, target_col))
    scored = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("eligible", (F.col("n_words") >= least) & F.col("doc_id").isNotNull())
    return draw(stored(scored, "scored"), percent).drop("eligible")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of documents, drawn towards the texts of benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
#: The checksum of a run is made a bit at a time, from its bytes in hex.
_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, row_number() OVER () AS n, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), split AS MATERIALIZED (
  SELECT side, n, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS MATERIALIZED (
  SELECT side, n, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM split
), coded AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)
), bits AS (
  -- Each byte and seven zeros: of every value the register takes one bit.
  SELECT f, list_prepend(4294967295, list_transform(range(0, 4 * len(h)), lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || h[(i // 4 + 1):(i // 4 + 2)])::BIGINT ELSE 0 END)) AS b FROM coded
), sums AS MATERIALIZED (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 10000 AS bucket FROM bits
), found AS MATERIALIZED (SELECT side, n, bucket FROM runs JOIN sums USING (f)
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM found GROUP BY bucket
), totals AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counts
), gain AS (
  SELECT bucket, floor(1000 * ln(((c.t + 1)::DOUBLE * (a.s + 10000)) / ((c.s + 1)::DOUBLE * (a.t + 10000))))::BIGINT AS gain FROM counts c, totals a
), weights AS (SELECT n, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM found JOIN gain USING (bucket) WHERE side = 'd' GROUP BY n
), scored AS (
  SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (n) WHERE side = 'd'
), ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS r, count(*) FILTER (words >= 20 AND doc_id IS NOT NULL) OVER () AS eligible FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN words >= 20 AND r <= 5 * eligible // 100 THEN r END AS rank FROM ranked
"""
ORACLES = {"op12_importance_resampling": _SQL}
