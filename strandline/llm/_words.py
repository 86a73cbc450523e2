"""Words [^\\x20\\x09-\\x0D]+ of a whole batch of texts, as 64-bit hashes, found with numpy on the UTF-8 bytes."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE_BASES, _WORD_BASES = (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Words of more bytes are hashed by blake2b: polynomials modulo 2^64 can be led to collide by words of 1024 bytes.
_LONG = 256


@lru_cache(8)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of base and of its inverse modulo 2^64, n at least."""
    bits = max(16, n.bit_length())
    return _powers(base, bits), _powers(pow(base, -1, 1 << 64), bits)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """For each place the hash of the `size` values from there on; places too near to the end are left out."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    power, inverse = powers(_WORD_BASES[which], len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mixed((total[size:] - total[:-size]) * inverse[: len(h) - size + 1])


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (and the last ends)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """hashes: of all words in order; ends: for each text the words up to its end; begins: up to its begin; places: where each word begins and ends in the bytes.

    both: second has other hashes of the same words, so that two words are the same only where 128 bits are.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, both: bool = False) -> None:
        data, offsets = buffer(texts)
        if lower:
            data = _LOWER[data]
        n = len(data)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:n]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | edge[1:n]
        begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        length = end - begin
        long = np.flatnonzero(length > _LONG)
        sure = [hashlib.blake2b(data[begin[k] : end[k]].tobytes(), digest_size=16).digest() for k in long]

        def hashed(which: int) -> np.ndarray:
            power, inverse = powers(_BYTE_BASES[which], n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((data + np.uint64(1)) * power[:n], out=total[1:])
            out = mixed((total[end] - total[begin]) * inverse[begin] + length.astype(np.uint64))
            out[long] = [int.from_bytes(x[8 * which : 8 * which + 8], "little") for x in sure]
            return out

        self.hashes = hashed(0)
        self.second = hashed(1) if both else None
        self.places = begin, end
        stops = np.searchsorted(begin, offsets)
        self.begins, self.ends = stops[:-1], stops[1:]

    @property
    def counts(self) -> np.ndarray:
        return self.ends - self.begins


def windows(words: Words, size: int) -> np.ndarray:
    """The places at which `size` words of one text begin."""
    n = np.maximum(0, words.counts - size + 1)
    return np.repeat(words.begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
