"""Similarity join of documents on the Jaccard similarity of their word n-gram sets (operator 10).

A set's n-grams are ordered rare first; two sets with 100 * intersection >= percent * union share one of their first
n - ceil(percent * n / 100) + 1 n-grams (prefix filter). The steps:

1. Each task hashes its documents' n-grams, and counts in how many documents they are in a table of CELLS counters.
   The merged table, one byte a cell, fixes the order: class of frequency, then hash. Any order that all documents
   share is right; the table's size bounds how well rare and frequent n-grams are told apart. Documents with equal sets are one node, the smallest id among them.
2. An n-gram in the prefix of one node alone joins nothing: a count-min sketch of all prefixes leaves out most of these,
   and the rest go when the others are grouped.
3. Nodes that share a prefix n-gram are candidates if their lengths and the n-gram's positions (positional filter) still
   allow the similarity, and are verified if the counts of n-grams by hash range (suffix filter; the ranges are about a
   fifth as many as the n-grams) do: only then are their n-grams fetched. First each node is
   held against one hub, the first node of one of its n-grams, which ties most copies together; n-grams whose nodes are
   all in one component need nothing more. HUB_ROUNDS such rounds take a pair a node each.
4. Of the n-grams left, those of at most SMALL nodes give the pairs not yet in one component, made distinct and verified
   once. The nodes of others go into groups of about BLOCK by length, as only like lengths can link; a task gets two
   groups at a time, first with the counts by hash range alone. For the nodes that still have a partner the n-grams are fetched: the task skips pairs that share
   an earlier prefix n-gram (they are verified there), and returns a spanning forest of its links, not the pairs.
5. Connected components of the links. Rows find their set's component by its 128 bits; sets that more than a 4096th of
   the rows have, 4096 at most, are broadcast for that, so that no task gets all copies of one text.

Sets are of 64-bit hashes, and equal sets are found by 128 bits. Keys in rare-first order have 8 bits for the class and 56
of the hash; pairs are verified on these.

Defined results: words of a null text: none; documents without words have no n-grams and link with nothing; rows with
one id are one node and each keep their own n_shingles; rows with a null id link with nothing and have no component id;
repeated rows are kept. Texts of any length are shingled whole. Columns other than id and text are ignored whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pretokens import chunks
from ._sketch import bit_set, merge_groups, met_twice, passes, size_for
from ._spark import binaries, drop_stored, ready, stored
from ._words import Words, mixed, rolling, signed, windows
from .components import components

CELLS, _BLOCK_CELLS = 1 << 22, 1 << 16
SMALL, BLOCK, HUB_ROUNDS = 32, 384, 2
#: n-grams a hash range has on average, at most twice as many; every set has RANGES ranges at least.
IN_RANGE, RANGES = 4, 16
_NODE_BITS = 1 << 24
#: Sets that more than this share of the rows have are told apart from the others when rows look for their set.
HEAVY = 4096


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all texts, sorted within each text, and how many each text has."""
    words = Words(texts, lower=True)
    at = windows(words, size)
    whole = rolling(words.hashes, size)[at]
    doc = np.searchsorted(words.ends, at, "right")
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):  # a text of fewer words is one n-gram
        own = np.array([rolling(words.hashes[words.begins[k] : words.ends[k]], int(words.counts[k]))[0] for k in short], np.uint64)
        whole, doc = np.append(whole, mixed(own + words.counts[short].astype(np.uint64))), np.append(doc, short)
    order = np.lexsort((whole, doc))
    whole, doc = whole[order], doc[order]
    new = np.ones(len(whole), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])
    return whole[new], np.bincount(doc[new], minlength=len(texts))


def _ranges(grams: np.ndarray, n: np.ndarray) -> list[bytes]:
    """How many n-grams of each text fall in each of its hash ranges, a power of two of them; 255 stands for more as well."""
    size = np.maximum(RANGES, 1 << np.floor(np.log2(np.maximum(n / IN_RANGE, 1))).astype(np.int64))
    begin = np.cumsum(size) - size
    at = np.repeat(begin, n) + (grams >> np.uint64(20)).astype(np.int64) % np.repeat(size, n)
    counts = np.minimum(np.bincount(at, minlength=int(size.sum())), 255).astype(np.uint8).tobytes()
    return [counts[a : a + k] for a, k in zip(begin.tolist(), size.tolist(), strict=True)]


def shared_at_most(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of the n-grams that two sets share, by their ranges; the finer ranges are added up to the coarser."""
    if max(x.max(), y.max()) == 255:
        return 1 << 40
    x, y = (y, x) if len(x) > len(y) else (x, y)
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(7) & np.uint64(CELLS - 1)).astype(np.int64)


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n, s1, s2, ranges) for documents, and rows (block, counts) of the table of frequencies."""
    import hashlib

    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                grams, n = shingles(batch.column(1).slice(a, b - a), size)
                np.add.at(table, _cell(grams), 1)
                stops, data = np.cumsum(n), memoryview(grams.tobytes())
                names = [hashlib.blake2b(data[8 * (s - k) : 8 * s], digest_size=16).digest() for s, k in zip(stops.tolist(), n.tolist(), strict=True)]
                sign = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                m = b - a
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, m), "n": n, "s1": np.ascontiguousarray(sign[:, 0]), "s2": np.ascontiguousarray(sign[:, 1]), "ranges": pa.array(_ranges(grams, n), pa.binary()), "block": pa.nulls(m, pa.int32()), "counts": pa.nulls(m, pa.binary())})
        press = zstandard.ZstdCompressor(level=1)
        for k in range(CELLS // _BLOCK_CELLS):
            own = table[k * _BLOCK_CELLS : (k + 1) * _BLOCK_CELLS]
            if own.any():
                yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "s1": pa.nulls(1, pa.int64()), "s2": pa.nulls(1, pa.int64()), "ranges": pa.nulls(1, pa.binary()), "block": pa.array([k], pa.int32()), "counts": pa.array([press.compress(own.tobytes())], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, ranges binary, block int, counts binary")


def _classes_of_frequency(profile: DataFrame) -> np.ndarray:
    """One byte for each cell: 0 for counts that chance alone explains, then one more for each doubling."""
    import zstandard

    tasks = merge_groups(profile)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK_CELLS, np.uint32)
        for x in table["counts"]:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py(), max_output_size=4 * _BLOCK_CELLS), np.uint32)
        return pa.table({"block": table["block"][:1], "part": table["part"][:1], "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})

    schema = "block int, part int, counts binary"
    rows = profile.where("block is not null").select("block", F.pmod(F.xxhash64("counts"), F.lit(tasks)).cast("int").alias("part"), "counts")
    if tasks > 1:
        rows = rows.groupBy("block", "part").applyInArrow(add, schema)
    merged = rows.groupBy("block").applyInArrow(add, schema)
    total = np.zeros(CELLS, np.uint32)
    for r in merged.select("block", "counts").collect():  # CELLS counters in all, compressed
        total[r["block"] * _BLOCK_CELLS : (r["block"] + 1) * _BLOCK_CELLS] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"]), max_output_size=4 * _BLOCK_CELLS), np.uint32)
    mean = float(total.sum(dtype=np.uint64)) / CELLS
    usual = max(1.0, mean + 6 * mean**0.5 if mean > 0.5 else 1.0)
    over = np.maximum(total - min(mean, usual), 1.0)
    return np.where(total <= usual, 0, 1 + np.log2(over)).astype(np.uint8)


def _ordered(grams: np.ndarray, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The n-grams of each text rare first, as keys that sort in that order: class of frequency, then 56 bits of the hash."""
    key = classes[_cell(grams)].astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8)
    doc = np.repeat(np.arange(len(n)), n)
    return key[np.lexsort((key, doc))]


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def _some(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose cell, the third column, is in a bit set."""
    cell = batch.column(2).to_numpy()
    return batch.filter(pa.array((bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)))


def _prefixes(docs: DataFrame, size: int, percent: int, classes, nodes: DataFrame) -> DataFrame:
    """(doc_id, n, s1, keys): the prefix of each document of nodes, and of few others. Rows with one id and text come as often as they are there."""
    import hashlib

    bits = docs.sparkSession.sparkContext.broadcast(_node_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _some(batch, bits.value)
            for a, b in chunks(batch.column(1)):
                grams, n = shingles(batch.column(1).slice(a, b - a), size)
                keys, begin, k = _ordered(grams, n, classes.value), np.cumsum(n) - n, _prefix_length(n, percent)
                take = np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                data = memoryview(grams.tobytes())
                s1 = np.array([int.from_bytes(hashlib.blake2b(data[8 * s : 8 * (s + m)], digest_size=16).digest()[:8], "little", signed=True) for s, m in zip(begin.tolist(), n.tolist(), strict=True)], np.int64)
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(k)).astype(np.int32), pa.array(signed(keys[take])))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n": n, "s1": s1, "keys": lists})

    return _marked(docs).mapInArrow(run, "doc_id long, n long, s1 long, keys array<long>")


def _members(prefixes: DataFrame) -> DataFrame:
    """(gram, a, sa, n, pos): the prefix n-grams that a sketch of all prefixes says two documents or more may have."""
    tables = lambda batch: iter([np.asarray(batch.column(0).flatten()).view(np.uint64)])
    keys, cells = prefixes.select("keys"), size_for(prefixes)
    bits = prefixes.sparkSession.sparkContext.broadcast(met_twice(keys, tables, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(3)
            gram, k = np.asarray(keys.flatten()), np.diff(np.asarray(keys.offsets))
            row, pos = np.repeat(np.arange(len(k)), k), np.arange(len(gram)) - np.repeat(np.cumsum(k) - k, k)
            keep = np.flatnonzero(passes(gram.view(np.uint64), bits.value, cells))
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(gram[keep]), batch.column(0).take(at), batch.column(2).take(at), batch.column(1).take(at), pa.array(pos[keep].astype(np.int32))], ["gram", "a", "sa", "n", "pos"])

    return prefixes.select("doc_id", "n", "s1", "keys").mapInArrow(run, "gram long, a long, sa long, n long, pos int")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(_NODE_BITS)).alias("cell"))


def _node_bits(nodes: DataFrame) -> np.ndarray:
    """A bit set that has all nodes' ids, of _NODE_BITS bits whatever their number."""
    return bit_set(nodes.select(F.pmod(F.xxhash64("a"), F.lit(_NODE_BITS)).alias("cell")), _NODE_BITS)


def _sets(docs: DataFrame, size: int, classes, nodes: DataFrame) -> DataFrame:
    """(a, sa, keys) for the nodes, once each: all n-grams in order.

    A bit set of fixed size keeps most other documents from being worked on again.
    """
    import hashlib

    bits = docs.sparkSession.sparkContext.broadcast(_node_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = _some(batch, bits.value)
            for a, b in chunks(some.column(1)):
                grams, n = shingles(some.column(1).slice(a, b - a), size)
                keys, begin = _ordered(grams, n, classes.value), np.cumsum(n) - n
                data = memoryview(grams.tobytes())
                spans = [(8 * s, 8 * (s + m)) for s, m in zip(begin.tolist(), n.tolist(), strict=True)]
                s1 = np.array([int.from_bytes(hashlib.blake2b(data[s:e], digest_size=16).digest()[:8], "little", signed=True) for s, e in spans], np.int64)
                yield pa.RecordBatch.from_pydict({"a": some.column(0).slice(a, b - a), "sa": s1, "keys": binaries(keys.tobytes(), 8 * np.append(0, np.cumsum(n)))})

    every = _marked(docs).mapInArrow(run, "a long, sa long, keys binary")
    return every.dropDuplicates(["a", "sa"]).join(nodes.select("a", "sa").distinct(), ["a", "sa"], "left_semi")


def _other(nodes: DataFrame, *more: str) -> DataFrame:
    """nodes (a, sa, ...) under the names of a pair's second node."""
    return nodes.select(F.col("a").alias("b"), F.col("sa").alias("sb"), *(F.col(c).alias(f"{c}_b") for c in more))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "sa").union(pairs.select("b", "sb")).distinct()


def _linked(inter, na, nb, percent: int):
    return (100 + percent) * inter >= percent * (na + nb)


def _surviving(pairs: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, sa, b, sb) that the suffix filter leaves. short: (a, sa, n, ranges)."""
    both = pairs.join(short, ["a", "sa"]).join(_other(short, "n", "ranges"), ["b", "sb"])
    names = ["a", "sa", "b", "sb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            bound = [shared_at_most(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(batch.column(6), batch.column(7), strict=True)]
            yield batch.select(names).filter(pa.array(_linked(np.array(bound, np.int64), *n, percent), pa.bool_()))

    return both.select(*names, "n", "n_b", "ranges", "ranges_b").mapInArrow(run, "a long, sa long, b long, sb long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their n-grams."""
    both = pairs.join(_other(sets, "keys"), ["b", "sb"]).join(sets, ["a", "sa"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(_linked(inter, len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "keys", "keys_b").mapInArrow(run, "a long, b long")


def block_links(ids: np.ndarray, group: np.ndarray, known: np.ndarray, keys: list[np.ndarray], gram: int, within: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between nodes of two groups (or within one) that share n-gram `gram` first and are not known to be in one component."""
    m = len(ids)
    n = np.array([len(k) for k in keys])
    prefix = [k[:p] for k, p in zip(keys, _prefix_length(n, percent).tolist(), strict=True)]
    # Positions of the shared n-gram, and which pairs share an earlier one.
    position = np.array([np.searchsorted(p, np.uint64(gram)) for p in prefix])
    row = np.repeat(np.arange(m), position)
    earlier = np.concatenate([p[:k] for p, k in zip(prefix, position.tolist(), strict=True)]) if m else np.zeros(0, np.uint64)

    def together(row: np.ndarray, value: np.ndarray) -> np.ndarray:
        codes, _ = pd.factorize(value)
        shared = np.flatnonzero(np.bincount(codes) > 1) if len(codes) else np.zeros(0, np.int64)
        out = np.zeros((m, m), np.float32)
        for a in range(0, len(shared), 4096):
            place = np.full(int(codes.max()) + 1, -1)
            place[shared[a : a + 4096]] = np.arange(len(shared[a : a + 4096]))
            has = place[codes] >= 0
            table = np.zeros((m, len(shared[a : a + 4096])), np.float32)
            table[row[has], place[codes[has]]] = 1
            out += table @ table.T
        return out

    todo = together(row, earlier) == 0
    todo &= _linked(1 + np.minimum.outer(n - position - 1, n - position - 1), n[:, None], n[None, :], percent)
    todo &= _linked(np.minimum.outer(n, n), n[:, None], n[None, :], percent)
    todo &= np.triu(np.ones((m, m), bool), 1)
    todo &= known[:, None] != known[None, :]
    if not within:
        todo &= group[:, None] != group[None, :]
    if not todo.any():
        return []
    inter = together(np.repeat(np.arange(m), n), np.concatenate(keys))
    x, y = np.nonzero(todo & _linked(inter, n[:, None], n[None, :], percent))
    root = list(range(m))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def promising(group: np.ndarray, known: np.ndarray, n: np.ndarray, position: np.ndarray, ranges: list[np.ndarray], within: bool, percent: int) -> np.ndarray:
    """Which nodes of two groups (or of one) have a partner that length, positional and suffix filter leave, and that is not known to be in one component with them."""
    m = len(n)
    todo = _linked(1 + np.minimum.outer(n - position - 1, n - position - 1), n[:, None], n[None, :], percent)
    todo &= _linked(np.minimum.outer(n, n), n[:, None], n[None, :], percent)
    todo &= known[:, None] != known[None, :]
    if not within:
        todo &= group[:, None] != group[None, :]
    out, size, full = np.zeros(m, bool), np.array([len(r) for r in ranges]), np.array([r.max() == 255 for r in ranges])
    of_size = {int(k): np.flatnonzero(size == k) for k in np.unique(size)}
    for fine, places in of_size.items():
        counts = np.stack([ranges[k] for k in places]).astype(np.uint16)
        for coarse in (k for k in of_size if k <= fine):
            if not todo[np.ix_(of_size[coarse], places)].any():
                continue
            added = counts.reshape(len(places), -1, coarse).sum(axis=1, dtype=np.uint16)
            for i in of_size[coarse].tolist():
                at = np.flatnonzero(todo[i, places])
                if len(at):
                    shared = np.minimum(ranges[i], added[at]).sum(axis=1, dtype=np.int64)
                    good = places[at][_linked(shared, n[i], n[places[at]], percent) | full[i] | full[places[at]]]
                    out[good] = True
                    out[i] |= len(good) > 0
    return out


def _promising(hot: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """(gram, low, high, own, comp, a, sa): the nodes of frequent prefix n-grams, dealt into groups, that have a partner there which the filters leave.

    hot: (gram, a, sa, n, pos, comp). Groups are of one band of lengths, and meet those of their own and the neighbouring
    bands: sets further apart can't link. The nodes of an n-gram's largest known component need no comparison with each
    other: they are dealt into groups of their own, which meet those of the other nodes alone.
    """
    by_part = hot.groupBy("gram", "comp").agg(F.count("*").alias("k"))
    main = stored(by_part.groupBy("gram").agg(F.max_by("comp", F.struct("k", "comp")).alias("main")), "main")
    # Bands are a little wider than the ratio of lengths, so that rounding puts no pair further apart than a band.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101.0 / percent)))
    dealt = hot.join(main, "gram").withColumn("band", band).withColumn("inside", (F.col("comp") == F.col("main")).cast("long"))
    groups = dealt.groupBy("gram", "band", "inside").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    code = lambda band, inside, part: (band * 2 + inside) * (1 << 40) + part
    own = groups.withColumnRenamed("parts", "own_parts")
    others = groups.select("gram", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("to_band"), F.col("inside").alias("to_inside"), F.col("parts").alias("to_parts"))
    meets = own.join(others, ["gram", "band"]).where("inside = 0 or to_inside = 0")
    meets = stored(meets.groupBy("gram", "band", "inside", "own_parts").agg(F.collect_list(F.struct("to_band", "to_inside", "to_parts")).alias("to")), "meets")  # six at most
    dealt = dealt.join(meets, ["gram", "band", "inside"])
    dealt = dealt.withColumn("own", code(F.col("band"), F.col("inside"), F.pmod(F.xxhash64("a", "sa"), F.col("own_parts"))))
    every = F.flatten(F.transform("to", lambda t: F.transform(F.sequence(F.lit(0).cast("long"), t["to_parts"] - 1), lambda k: code(t["to_band"], t["to_inside"], k))))
    dealt = dealt.withColumn("other", F.explode(every))
    dealt = dealt.select("gram", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "comp", "a", "sa", "n", "pos")
    rows = dealt.join(short.select("a", "sa", "ranges"), ["a", "sa"])
    names = ["gram", "low", "high", "own", "comp", "a", "sa"]

    def run(table: pa.Table) -> pa.Table:
        ranges = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["ranges"]]
        within = table["low"][0].as_py() == table["high"][0].as_py()
        keep = promising(*(table[c].to_numpy() for c in ("own", "comp", "n", "pos")), ranges, within, percent)
        return table.select(names).filter(pa.array(keep))

    return rows.select(*names, "n", "pos", "ranges").groupBy("gram", "low", "high").applyInArrow(run, ", ".join(f"{c} long" for c in names))


def _block_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the nodes of frequent prefix n-grams, as _promising deals them."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["keys"]]
        low, high, gram = (table[c][0].as_py() for c in ("low", "high", "gram"))
        found = block_links(table["a"].to_numpy(), table["own"].to_numpy(), table["comp"].to_numpy(), keys, gram & 0xFFFFFFFFFFFFFFFF, low == high, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.join(sets, ["a", "sa"]).groupBy("gram", "low", "high").applyInArrow(run, "a long, b long")


def _open(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members (gram, a, sa, n, pos) with comp, the component known so far, c, and hub, of the n-grams whose nodes are not all in one component: a stored table.

    hub is the first node of the smallest component.
    """
    members = members.select("gram", "a", "sa", "n", "pos")
    if found is None:
        members = members.withColumn("comp", F.col("a"))
    else:
        members = members.join(found.select(F.col("node").alias("a"), F.col("component").alias("comp")), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    sizes = members.groupBy("gram").agg(F.count("*").alias("c"), F.max("comp").alias("top"), F.min(F.struct("comp", "a", "sa", "n", "pos")).alias("hub"))
    # Stored, so that the join can split the rows of a very frequent n-gram, which the counts can't.
    sizes = stored(sizes.where(F.col("top") > F.col("hub.comp")).select("gram", "c", "hub"), "sizes")
    out = stored(members.join(sizes, "gram"), "open")
    drop_stored(sizes)
    return out


def _possible(n, pos, nb, pos_b, percent: int):
    """Length filter and positional filter."""
    return _linked(F.least(n - pos, nb - pos_b), n, nb, percent) & _linked(F.least(n, nb), n, nb, percent)


def _hub_pairs(members: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """For each node outside its n-grams' smallest components one hub, the smallest that it has not been held against."""
    h = F.col("hub")
    far = members.where((F.col("comp") != h["comp"]) & _possible(F.col("n"), F.col("pos"), h["n"], h["pos"], percent))
    pairs = far.select(h["a"].alias("a"), h["sa"].alias("sa"), F.col("a").alias("b"), F.col("sa").alias("sb"))
    if tried is not None:
        pairs = pairs.join(tried, ["a", "sa", "b", "sb"], "left_anti")
    return pairs.groupBy("b", "sb").agg(F.min(F.struct("a", "sa")).alias("to")).select("to.a", "to.sa", "b", "sb")


def _by_set(rows: DataFrame, same: DataFrame, n_rows: int) -> DataFrame:
    """rows with the columns of same (s1, s2, k and others) by their set; k says how many rows a set has.

    Sets with more than a HEAVY-th of the rows, HEAVY at most, are broadcast: their rows are not dealt out by set.
    """
    key, most = ["s1", "s2"], n_rows // HEAVY
    heavy = F.broadcast(same.where(F.col("k") > most).withColumn("_heavy", F.lit(True)).drop("k"))
    found = rows.join(heavy, key, "left")
    light = found.where("_heavy is null").select(rows.columns).join(same.where(F.col("k") <= most).drop("k"), key, "left")
    return found.where("_heavy").drop("_heavy").unionByName(light)


def classify(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = stored(_profile(docs, size), "profile")
    classes = spark.sparkContext.broadcast(_classes_of_frequency(profile))
    rows = profile.where("block is null").select("doc_id", "n", "s1", "s2", "ranges")
    named = rows.where("n > 0 and doc_id is not null")
    same = stored(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("k")), "same")
    n_rows = same.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]

    # Of documents with equal sets the node alone stays.
    alone = same.select(F.col("node").alias("doc_id"), "s1")
    prefixes = _prefixes(docs.where("doc_id is not null"), size, percent, classes, alone.withColumnRenamed("doc_id", "a")).where("n > 0")
    prefixes = stored(prefixes.dropDuplicates(["doc_id", "s1"]).join(alone, ["doc_id", "s1"], "left_semi"), "prefixes")
    spread = stored(_members(prefixes), "members")
    drop_stored(prefixes)
    members = _open(spread, None)
    drop_stored(spread)
    nodes = members.select("a", "sa").distinct()
    short = named.select(F.col("doc_id").alias("a"), F.col("s1").alias("sa"), "n", "ranges").dropDuplicates(["a", "sa"])
    short = stored(short.join(nodes, ["a", "sa"], "left_semi"), "short")

    # One row can have several sets under one id; they are one node of the graph.
    several = named.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("doc_id")
    several = stored(named.select("doc_id", "s1", "s2").join(several, "doc_id"), "several")
    several = several.join(same.select("s1", "s2", "node"), ["s1", "s2"])
    first = several.groupBy("doc_id").agg(F.min("node").alias("a"))
    links, tried = stored(several.join(first, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "links"), None
    done = [profile, same, short, links]

    def verified(pairs: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The links of pairs, and the n-grams of their ends and of the nodes `more`: only what the suffix filter leaves is shingled again."""
        some = stored(_surviving(pairs, short, percent), "surviving")
        ends = _ends(some)
        sets = stored(_sets(docs, size, classes, ends if more is None else ends.union(more.select("a", "sa"))), "sets")
        done.extend((some, sets))
        return _verify(some, sets, percent), sets

    for _ in range(HUB_ROUNDS):
        pairs = stored(_hub_pairs(members, tried, percent), "hubs")
        tried = pairs if tried is None else tried.union(pairs)
        new, sets = verified(pairs)
        links = stored(links.union(new), "links")
        drop_stored(sets)
        done.remove(sets)
        found = components(links)
        less = _open(members, found)
        drop_stored(members)
        drop_stored(found)
        members = less
        done += [pairs, links]

    few = members.where(F.col("c") <= SMALL).select("gram", "a", "sa", "n", "pos", "comp")
    other = few.select("gram", F.col("a").alias("b"), F.col("sa").alias("sb"), F.col("n").alias("nb"), F.col("pos").alias("pos_b"), F.col("comp").alias("comp_b"))
    pairs = few.join(other, "gram").where((F.col("a") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & _possible(F.col("n"), F.col("pos"), F.col("nb"), F.col("pos_b"), percent))
    swapped = tried.select(F.col("b").alias("a"), F.col("sb").alias("sa"), F.col("a").alias("b"), F.col("sa").alias("sb"))
    pairs = pairs.select("a", "sa", "b", "sb").distinct().join(tried.union(swapped), ["a", "sa", "b", "sb"], "left_anti")
    many = stored(_promising(members.where(F.col("c") > SMALL).select("gram", "a", "sa", "n", "pos", "comp"), short, percent), "promising")
    new, sets = verified(pairs, many)
    links = stored(links.union(new).union(_block_links(many, sets, percent)), "links")
    found = components(links)
    by_set = stored(same.join(found, "node", "left").select("s1", "s2", "k", F.coalesce("component", "node").alias("component")), "by_set")
    for x in (*done, members, many, links, found):
        if x is not profile:
            drop_stored(x)
    found = _by_set(named.drop("ranges"), by_set, n_rows).select("doc_id", "n", "component")
    # Rows without n-grams are their own component; those without an id have none.
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).alias("component"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 5-word shingle sets of Jaccard similarity 0.8 or more."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}
ORACLES: dict[str, str] = {}
