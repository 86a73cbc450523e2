"""A count-min sketch of hashes over a whole table, of which one bit a cell is kept: met twice or more.

Each task counts its own hashes, keeping the cells in use alone; the partial sketches are merged block by block. Counts
are over-estimates, so a hash whose cells are not all met twice is met once. The bits are DEPTH x cells whatever the
table; when it outgrows the cells more hashes pass, and none is lost. Only the bits come to the driver, as compressed
blocks of 8 kB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._words import mixed

DEPTH = 2
_BLOCK = 1 << 16
#: Partial tables of up to so many tasks are merged at once, of more in two steps, so that no group is large.
AT_ONCE = 256
_SKETCH = "block int, part int, cells binary, twice binary"
_BITS = pa.schema([("block", pa.int32()), ("bits", pa.binary())])
_TYPES = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("cells", pa.binary()), ("twice", pa.binary())])


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(cells - 1)).astype(np.int64) + row * cells


def passes(hashes: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Whether each hash may have been met twice."""
    out = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        cell = cells_of(hashes, row, cells)
        out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _merge(cells: list[np.ndarray], many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of partial sketches and whether each was counted twice: the same for all of them."""
    every, twice = np.concatenate(cells), np.concatenate(many)
    found, back, n = np.unique(every, return_inverse=True, return_counts=True)
    out = n > 1
    out[back[twice]] = True
    return found, out


def _rows(cells: np.ndarray, twice: np.ndarray, group: int) -> pa.RecordBatch:
    block = cells // _BLOCK
    edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(cells))
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    own = [(cells[a:b] % _BLOCK).astype("<u2").tobytes() for a, b in spans]
    return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]].astype(np.int32)), pa.array([group] * len(spans), pa.int32()), pa.array(own, pa.binary()), pa.array([np.packbits(twice[a:b]).tobytes() for a, b in spans], pa.binary())], schema=_TYPES)


def met_twice(table: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], cells: int) -> np.ndarray:
    """The bits. hashes_of gives a batch's hashes, each as often as it counts."""
    groups = merge_groups(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, twice, new, n = np.zeros(0, np.int64), np.zeros(0, bool), [], 0
        for batch in batches:
            for hashes in hashes_of(batch):
                new.extend(cells_of(hashes, row, cells) for row in range(DEPTH))
                n += DEPTH * len(hashes)
                if n > max(len(found), 1 << 20):
                    found, twice = _merge([found, *new], [twice, np.zeros(n, bool)])
                    new, n = [], 0
        found, twice = _merge([found, *new], [twice, np.zeros(n, bool)])
        yield _rows(found, twice, TaskContext.get().partitionId() % groups)

    def merge(part: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, "<u2").astype(np.int64) for x in part["cells"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(y, np.uint8), count=len(x)).astype(bool) for x, y in zip(own, part["twice"].to_pylist(), strict=True)]
        found, twice = _merge(own, many)
        return pa.table({"block": part["block"][:1], "part": part["part"][:1], "cells": [found.astype("<u2").tobytes()], "twice": [np.packbits(twice).tobytes()]}, _TYPES)

    def finish(part: pa.Table) -> pa.Table:
        bits = np.zeros(_BLOCK // 8, np.uint8)
        whole = merge(part)
        own = np.frombuffer(whole["cells"][0].as_py(), "<u2").astype(np.int64)
        at = own[np.unpackbits(np.frombuffer(whole["twice"][0].as_py(), np.uint8), count=len(own)).astype(bool)]
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pa.table({"block": part["block"][:1], "bits": [_press(bits)]}, _BITS)

    partial = table.mapInArrow(count, _SKETCH)
    if groups > 1:
        partial = partial.groupBy("block", "part").applyInArrow(merge, _SKETCH)
    return _gather(partial.groupBy("block").applyInArrow(finish, "block int, bits binary"), DEPTH * cells)


def merge_groups(table: DataFrame) -> int:
    """How many groups the tasks of table form for a first step of merging; one if no such step is needed."""
    tasks = table.rdd.getNumPartitions()
    return 1 if tasks <= AT_ONCE else int(tasks**0.5)


def _press(bits: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(bits.tobytes())


def _gather(blocks: DataFrame, cells: int) -> np.ndarray:
    """A bit set out of its blocks (block, compressed bits), one after another: cells / 8 bytes at most come to the driver."""
    import zstandard

    out, size = np.zeros(cells // 8, np.uint8), _BLOCK // 8
    for block, bits in blocks.select("block", "bits").collect():
        out[block * size : (block + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(bits), max_output_size=size), np.uint8)
    return out


def bit_set(table: DataFrame, cells: int) -> np.ndarray:
    """The bits of table's only column of cells, numbers under `cells` (a multiple of 2^16). Tasks hold a bit set of their own."""
    groups = merge_groups(table)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(cells // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        blocks = bits.reshape(-1, _BLOCK // 8)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([TaskContext.get().partitionId() % groups] * len(used), pa.int32()), pa.array([_press(blocks[k]) for k in used], pa.binary())], ["block", "part", "bits"])

    def unite(part: pa.Table) -> pa.Table:
        import zstandard

        every = np.zeros(_BLOCK // 8, np.uint8)
        for x in part["bits"]:
            every |= np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py(), max_output_size=_BLOCK // 8), np.uint8)
        return pa.table({"block": part["block"][:1], "part": part["part"][:1], "bits": [_press(every)]}, pa.schema([("block", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())]))

    schema = "block int, part int, bits binary"
    partial = table.mapInArrow(mark, schema)
    if groups > 1:
        partial = partial.groupBy("block", "part").applyInArrow(unite, schema)
    return _gather(partial.groupBy("block").applyInArrow(unite, schema), cells)


def size_for(table: DataFrame, most: int = 1 << 28) -> int:
    """Cells for a sketch of table: one for each four bytes that Spark expects it to have, from 2^22 to `most` (DEPTH x 2^28 bits: 64 MB).

    More cells only make it let fewer hashes pass that were met once.
    """
    expected = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(most, 1 << max(22, (expected // 4).bit_length()))
