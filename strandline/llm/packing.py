"""Packing of token sequences into windows of fixed capacity by minimum bin slack (operator 6).

A document's ids, end id included, are cut into whole windows and one remainder. A whole window is a sequence of its own.
For the remainders only their lengths matter: the histogram of lengths (at most `capacity` rows) goes to the driver,
where bitset subset-sum dynamic programming finds the multiset of lengths that fills a window closest to its capacity.
That pattern is used as often as the remaining counts allow, so the number of patterns is bounded by the capacity, not
by the documents. Each remainder then takes the place that its rank among its length's remainders has in the patterns.

No rows are sorted for that: the task that cuts a document says which of its own pieces of that length this is (part,
nth), and the stored pieces keep it. Ranks are nth plus the pieces of the same length in the parts before, which is a
running sum over the counts by length and part. Whole windows are numbered in the same way, after the others.

Defined results: null and empty texts have the end id alone; rows with one id or a null id each are a document; repeated
rows are packed as often as they are there; an empty table gives no pieces. Columns other than id and text are ignored
whatever their names. A text of any length is cut like the others; one task holds a text at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._pretokens import chunks, library_store
from ._spark import binaries, ready, stored

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times}, how many windows of it) that use up counts.

    Each pattern contains the longest length that is left and fills the window as far as any multiset of the remaining
    lengths with it can. reach[k] has bit s set where the lengths up to the k-th can sum to s; counts are added as
    powers of two (binary splitting), and walking reach back tells how often each length is taken.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    out = []
    mask = (1 << (capacity + 1)) - 1
    while left:
        longest = max(left)
        room = capacity - longest
        lengths = [x for x in sorted(left, reverse=True) if x <= room]
        most = {x: min(left[x] - (x == longest), room // x) for x in lengths}
        reach = [1]
        for x in lengths:
            bits, k, n = reach[-1], 1, most[x]
            while n > 0:
                k = min(k, n)
                bits |= bits << (k * x)
                n -= k
                k *= 2
            reach.append(bits & mask & ((1 << (room + 1)) - 1))
        at = reach[-1].bit_length() - 1
        pattern = {longest: 1}
        for k in range(len(lengths) - 1, -1, -1):
            x, times = lengths[k], 0
            while not reach[k] >> (at - times * x) & 1:
                times += 1
            if times:
                pattern[x] = pattern.get(x, 0) + times
                at -= times * x
        windows = min(left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= n * windows
            if not left[x]:
                del left[x]
        out.append((pattern, windows))
    return out


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of every document: whole windows of `capacity` ids, then what remains; ids are little-endian unsigned 32-bit.

    nth tells the pieces of one length and part apart; it depends on the order of rows within the task, so pieces are to
    be stored before they are packed.
    """
    ready(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part = library_store(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                flat, per_doc = store.encode_texts(batch.column(1).slice(a, b - a))
                ends = np.cumsum(per_doc)
                flat = np.insert(flat, ends, end_id).astype("<u4")
                n = per_doc + 1
                k = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), k)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * capacity
                length = np.minimum(capacity, n[row] - start)
                # Pieces of one length get consecutive numbers in their order.
                order = np.argsort(length, kind="stable")
                many = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(row), np.int64)
                nth[order] = seen[length[order]] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                seen += many
                # The pieces lie one after another in flat.
                data, stops = flat.tobytes(), np.append(0, 4 * np.cumsum(length))
                crc = [zlib.crc32(data[x:y]) for x, y in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                out = {"doc_id": batch.column(0).slice(a, b - a).take(pa.array(row)), "start": start, "length": length.astype(np.int32), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": n[row], "part": np.full(len(row), part, np.int32), "nth": nth}
                yield pa.RecordBatch.from_pydict(out | ({"ids": binaries(data, stops)} if with_ids else {}))
        store.forget()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a stored table with length, part and nth) with sequence_id and offset.

    To the driver go a row for each length, and one for each part with how many whole windows it has. What is broadcast
    has a row for each length, with the places of that length in the patterns. Pieces meet the counts before them by
    length and part, in whatever join the sizes of these counts allow.
    """
    spark = pieces.sparkSession
    counts = pieces.where(F.col("length") < capacity).groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most `capacity` rows for each part of the stored table.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    per_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    by_length: dict[int, list] = {length: [] for length in per_length}
    first_rank, first_sequence = dict.fromkeys(per_length, 0), 0
    for pattern, windows in minimum_bin_slack(per_length, capacity):
        at = 0
        for length, times in sorted(pattern.items(), reverse=True):
            low = first_rank[length]
            first_rank[length] += times * windows
            by_length[length].append((low, first_rank[length], times, first_sequence, at))
            at += times * length
        first_sequence += windows
    slots = spark.createDataFrame(list(by_length.items()), "length int, slots array<struct<low: long, high: long, times: long, sequence: long, at: long>>")
    ranked = pieces.where(F.col("length") < capacity).join(base, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base")).join(F.broadcast(slots), "length")
    slot = F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    placed = ranked.withColumn("slot", slot).withColumn("k", F.col("rank") - F.col("slot.low"))
    within = F.pmod(F.col("k"), F.col("slot.times"))
    packed = placed.withColumn("sequence_id", F.col("slot.sequence") + F.expr("k div slot.times")).withColumn("offset", F.col("slot.at") + within * F.col("length"))
    whole = pieces.where(F.col("length") == capacity)
    total, parts = first_sequence, []
    for r in sorted(whole.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each stored part
        parts.append((r["part"], total))
        total += r["n"]
    alone = whole.join(spark.createDataFrame(parts, "part int, first long"), "part")
    alone = alone.withColumn("sequence_id", F.col("first") + F.col("nth")).withColumn("offset", F.lit(0).cast("long"))
    columns = [*(c for c in pieces.columns if c not in ("part", "nth")), "sequence_id", "offset"]
    return packed.select(columns).unionByName(alone.select(columns))


def sequences(packed: DataFrame, capacity: int, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (padded to capacity); a sequence has at most `capacity` pieces."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(parts, "").alias("x"))
    pad = f"{pad_id & 0xFF:02X}{pad_id >> 8 & 0xFF:02X}{pad_id >> 16 & 0xFF:02X}{pad_id >> 24 & 0xFF:02X}"
    return filled.select("sequence_id", "n_tokens", F.unhex(F.concat("x", F.repeat(F.lit(pad), (capacity - F.col("n_tokens")).cast("int")))).alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """documents, tokenised, cut and packed: a row for each piece, with its ids unless they are not wanted."""
    import public_tokenizers

    pieces = stored(cut(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id, capacity, with_ids=with_ids), "pieces")
    return pack(pieces, capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of at most 1024 ids: a row for each piece, by place and checksum."""
    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
