"""Byte-level BPE by rank files: encoding with segment trees, and decoding (operator 8).

The distinct pre-tokens of a batch are encoded together, by padded length: a tree over the byte positions of each word
holds the smallest (rank, position) of the pairs of live neighbours, so its root is the leftmost pair of minimum rank.
A merge changes three leaves (the merged pair, its right part and the pair before), each a walk to the root. Words over
LONG bytes go through the same tree one at a time.

Defined results: a null text is empty; an empty text has no ids; ids decode to the text's own bytes; rows with one id or a
null id, and repeated rows, each stay a row; texts and pre-tokens of any length are encoded whole; an empty table gives no
rows. Columns other than id and text are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pretokens import Batch, Store, chunks
from ._spark import binaries, ready

LONG = 256
#: A tree's leaf holds rank << 8 | position at most in 31 bits.
MOST_RANKS = 1 << 22
_NONE = np.int32(2**31 - 1)


class Ranks:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.rank.values()) >= MOST_RANKS:
            raise ValueError(f"{path} has ranks from {MOST_RANKS} on")
        self.piece = [b""] * (max(self.rank.values()) + 1)
        for piece, rank in self.rank.items():
            self.piece[rank] = piece
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        # Pairs of pieces that join to a piece, by (left << 32 | right).
        self.pairs = {self.rank[p[:k]] << 32 | self.rank[p[k:]]: rank for p, rank in self.rank.items() for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank}
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[order].astype(np.int32)
        #: Ranks of all pairs of bytes.
        self.of_bytes = self.of_pairs(self.byte[:, None], self.byte[None, :])
        # All pieces one after another, and each rank as decimals with a blank, padded with zero bytes.
        self._spelled = np.frombuffer(b"".join(self.piece), np.uint8)
        self._size = np.fromiter(map(len, self.piece), np.int64, len(self.piece))
        self._begin = np.cumsum(self._size) - self._size
        said = [b"%d " % k for k in range(len(self.piece))]
        width = len(said[-1])
        self._said = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in said), np.uint8).reshape(-1, width)
        self._said_size = np.fromiter(map(len, said), np.int64, len(said))

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where they don't join; ids below zero join with nothing."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._ranks[at], _NONE)

    def decimals(self, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        """Each text's ids as decimals joined by one blank. ids: of all texts one after another."""
        wide = self._said[ids]
        flat = wide[wide != 0].tobytes()
        ends = np.append(0, np.cumsum(self._said_size[ids]))[np.append(0, np.cumsum(per_text))].tolist()
        return [flat[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids stand for."""
        size = self._size[ids]
        stops = np.append(0, np.cumsum(size))
        take = np.repeat(self._begin[ids] - stops[:-1], size) + np.arange(stops[-1])
        flat = self._spelled[take].tobytes()
        ends = stops[np.append(0, np.cumsum(per_text))].tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(2)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_words(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words of at most LONG bytes, all of one padded length, one after another, and how many each word has."""
    n = len(words)
    size = max(2, 1 << (max(map(len, words)) - 1).bit_length())
    bits = size.bit_length() - 1
    joined = np.frombuffer(b"".join([w.ljust(size, b"\0") for w in words]), np.uint8).reshape(n, size)
    length = np.fromiter(map(len, words), np.int64, n)
    places = np.arange(size, dtype=np.int32)
    # Row-wise next and previous live positions; `size` and -1 stand for the ends, column `size` of ids joins with nothing.
    ids = np.full((n, size + 1), -1, np.int32)
    ids[:, :-1] = np.where(places < length[:, None], ranks.byte[joined], -1)
    after = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, size, dtype=np.int32), (n, 1))
    tree = np.full((n, 2 * size), _NONE)
    rank = np.where(places[1:] < length[:, None], ranks.of_bytes[joined[:, :-1], joined[:, 1:]], _NONE)
    tree[:, size:-1] = np.where(rank < _NONE, rank << bits | places[:-1], _NONE)
    for k in range(size - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    rows = np.flatnonzero(tree[:, 1] < _NONE)

    def pair(r: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = ranks.of_pairs(ids[r, at], ids[r, after[r, at]])
        return np.where(rank < _NONE, rank << bits | at, _NONE)

    while len(rows):
        root = tree[rows, 1]
        at = root & np.int32(size - 1)
        gone = after[rows, at]
        beyond = after[rows, gone]
        ids[rows, at] = root >> np.int32(bits)
        ids[rows, gone] = -1
        after[rows, at] = beyond
        before[rows, beyond] = at
        ahead = before[rows, at]
        has = ahead >= 0
        # Three leaves change; their walks to the root go level by level together.
        changed = np.concatenate([rows, rows, rows[has]])
        node = np.concatenate([gone, at, ahead[has]]) + np.int32(size)
        tree[changed[: len(rows)], node[: len(rows)]] = _NONE
        tree[changed[len(rows) :], node[len(rows) :]] = pair(changed[len(rows) :], node[len(rows) :] - np.int32(size))
        for _ in range(bits):
            node = node >> 1
            tree[changed, node] = np.minimum(tree[changed, 2 * node], tree[changed, 2 * node + 1])
        rows = rows[tree[rows, 1] < _NONE]
    live = ids[:, :-1] >= 0
    return ids[:, :-1][live], live.sum(axis=1)


def merge_word(word: bytes, ranks: Ranks) -> np.ndarray:
    """As merge_words, for one word of any length."""
    n, pairs = len(word), ranks.pairs
    size = max(2, 1 << (n - 1).bit_length())
    none = (1 << 62, 0)
    ids = [*ranks.byte[np.frombuffer(word, np.uint8)].tolist(), -1]
    after, before = list(range(1, n + 1)), list(range(-1, n))
    tree = [none] * (2 * size)

    def pair(at: int) -> tuple[int, int]:
        rank = pairs.get(ids[at] << 32 | ids[after[at]]) if after[at] < n else None
        return none if rank is None else (rank, at)

    for k in range(n):
        tree[size + k] = pair(k)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(leaf: int, value: tuple[int, int]) -> None:
        node = leaf + size
        tree[node] = value
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] != none:
        rank, at = tree[1]
        gone = after[at]
        beyond = after[gone]
        ids[at], ids[gone], after[at] = rank, -1, beyond
        if beyond < n:
            before[beyond] = at
        put(gone, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    return np.array([x for x in ids if x >= 0], np.int64)


def encode_words(words: list[str], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each word has."""
    coded = [w.encode() for w in words]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, ids and how many ids
    by_size: dict[int, list[int]] = {}
    whole: list[int] = []
    for k, w in enumerate(coded):
        if w in ranks.rank:
            whole.append(k)
        elif len(w) > LONG:
            ids = merge_word(w, ranks)
            found.append((np.array([k]), ids, np.array([len(ids)])))
        else:
            by_size.setdefault((len(w) - 1).bit_length(), []).append(k)
    found.append((np.array(whole, np.int64), np.array([ranks.rank[coded[k]] for k in whole], np.int64), np.ones(len(whole), np.int64)))
    for bits, places in by_size.items():
        step = max(1, (1 << 17) >> bits)
        for a in range(0, len(places), step):
            some = places[a : a + step]
            found.append((np.array(some), *merge_words([coded[k] for k in some], ranks)))
    lengths = np.zeros(len(words), np.int64)
    for places, _, n in found:
        lengths[places] = n
    begin = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint32)
    for places, ids, n in found:
        out[np.repeat(begin[places] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out, lengths


@lru_cache(2)
def _coder(path: str) -> tuple[Ranks, Store]:
    """The ranks, and the ids of the pre-tokens met so far, of which a bounded number is kept."""
    ranks = load_ranks(path)
    return ranks, Store(lambda words: encode_words(words, ranks))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256 of the decimal ids joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, store = _coder(ranks_path)
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                ids, n = store.texts(Batch(batch.column(1).slice(a, b - a)))
                said = [hashlib.sha256(x).hexdigest() for x in ranks.decimals(ids, n)]
                own = binaries(ids.astype("<u4").tobytes(), 4 * np.append(0, np.cumsum(n)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_tokens": pa.array(n, pa.int64()), "ids": own, "ids_sha256": said})

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with the column ids replaced by decoded, the bytes that they stand for."""
    ready(encoded.sparkSession)
    columns = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        for batch in batches:
            for a, b in chunks(batch.column("ids")):
                own = batch.slice(a, b - a)
                each = [np.frombuffer(x.as_buffer(), "<u4") for x in own.column("ids")]
                decoded = ranks.decode(np.concatenate(each), np.array([len(x) for x in each]))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in columns), pa.array(decoded, pa.binary())], [*columns, "decoded"])

    schema = ", ".join(f"{c} {dict(encoded.dtypes)[c]}" for c in columns)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, of encode and then decode in one pass: ids leave no task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, store = _coder(ranks_path)
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                ids, n = store.texts(Batch(batch.column(1).slice(a, b - a)))
                said, back = ([hashlib.sha256(x).hexdigest() for x in f(ids, n)] for f in (ranks.decimals, ranks.decode))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": said, "decoded_sha256": back})

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded by ranks and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
