"""Pre-tokens of byte-level BPE, found and numbered with numpy for a whole batch of texts.

The rules are those of the pattern that comes with the vocabulary files (public_tokenizers.PATTERN): contractions, an
optional blank before a run of letters, digits or other signs, and runs of white space of which the last character is
left to what follows. A text's tokens depend only on its pre-tokens, so encoders work on the distinct ones of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, DIGIT, SPACE = range(4)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Characters that are worked on at once; a longer text is one piece of work.
CHUNK = 1 << 19


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[points[m.start() : m.end()]] = kind
    return table


@lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of texts that follow each other."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    space = kind == SPACE
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = points[:-1] == 0x20
    blank_before &= ~first[:n]
    sign_next = np.zeros(n, bool)
    sign_next[:-1] = ~space[1:]
    sign_next &= ~first[1:]
    start = np.where(space, run | sign_next, run & ~blank_before)
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        ahead = np.zeros((2, len(quote)), np.uint32)
        in_text = np.ones(len(quote), bool)
        for k in (1, 2):
            at = np.minimum(quote + k, n)
            in_text &= ~first[at]
            ahead[k - 1, in_text] = points[at[in_text]]
        one = np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (ahead[0] == ord(a)) & (ahead[1] == ord(b))
        for found, length in ((one, 2), (two, 3)):
            at = quote[found]
            start[at + 1] = False
            rest = at + length
            rest = rest[rest < n]
            start[rest[~space[rest]]] = True
    return np.flatnonzero(start)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of texts of about CHUNK characters each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > CHUNK:
            yield at, i
            at, total = i, 0
        total += int(size)
    if at < len(sizes):
        yield at, len(sizes)


class Batch:
    """words: the distinct pre-tokens; codes: for each pre-token its place in words; per_doc: pre-tokens of each text."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        whole = "".join(texts.to_pylist())
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        doc_ends = np.cumsum(lengths)
        begin = starts(points, doc_ends - lengths)
        end = np.append(begin[1:], len(points)).astype(np.int64)
        self.per_doc = np.diff(np.searchsorted(begin, np.append(0, doc_ends)))
        hashes = [self._hash(points, begin, end, base) for base in _BASES]
        self.codes, _ = pd.factorize(hashes[0])
        self.codes = self.codes.astype(np.int64)
        n = int(self.codes.max()) + 1 if len(self.codes) else 0
        at = np.zeros(n, np.int64)
        at[self.codes[::-1]] = np.arange(len(self.codes) - 1, -1, -1)
        if (hashes[1] != hashes[1][at[self.codes]]).any():  # two pre-tokens with one hash: number the strings themselves
            self.codes, words = pd.factorize(np.array([whole[a:b] for a, b in zip(begin, end, strict=True)], object))
            self.codes, self.words = self.codes.astype(np.int64), list(words)
        else:
            self.words = [whole[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]

    @staticmethod
    def _hash(points: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
        n = len(points)
        size = max(CHUNK, 1 << n.bit_length()) + 1
        powers = _powers(int(base), size)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * powers[:n], out=total[1:])
        h = (total[end] - total[begin]) * powers[size - 1 - begin]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (end - begin).astype(np.uint64)


class Store:
    """Ids of the words met so far; forgets all when it holds more than its bounds."""

    def __init__(self, encode, most_words: int = 400_000, most_ids: int = 3_000_000) -> None:
        self.encode, self.most_words, self.most_ids = encode, most_words, most_ids
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 15, np.int64)
        self.n, self.used = 0, 0

    def forget(self) -> None:
        """At the end of a task: an idle worker holds no words."""
        self._clear()

    def _add(self, words: list[str]) -> None:
        flat, lengths = self.encode(words)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[self.n + 1 : self.n + 1 + len(words)] = self.used + np.cumsum(lengths)
        self.known.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)
        self.used += len(flat)

    def places(self, words: list[str]) -> np.ndarray:
        if self.n > self.most_words or self.used > self.most_ids:
            self._clear()
        new = [w for w in words if w not in self.known]
        if new:
            self._add(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def texts(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of the batch one after another, and how many each text has."""
        place = self.places(batch.words)
        begin, length = self.ends[place], self.ends[place + 1] - self.ends[place]
        begin, length = begin[batch.codes], length[batch.codes]
        stops = np.cumsum(length)
        total = int(stops[-1]) if len(stops) else 0
        take = np.repeat(begin - (stops - length), length) + np.arange(total)
        per_doc = np.diff(np.append(0, stops)[np.append(0, np.cumsum(batch.per_doc))])
        return self.ids[take], per_doc


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others for those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def library_encoder(path: str):
    """encode(words) with the tokenizers library for words that are pre-tokens already and hold no added token.

    The library gets them in its byte letters with blanks between, and the byte lengths of the ids tell where each word's
    ids end.
    """
    from tokenizers import pre_tokenizers

    tokenizer = _library(path)
    tokenizer.encode_special_tokens = True
    tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    size = np.zeros(max(vocabulary.values()) + 1, np.int64)
    size[list(vocabulary.values())] = [len(x) for x in vocabulary]
    letters = byte_letters()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(words).encode().decode("latin-1").translate(letters)
        spelled = joined.split(letters[10])
        if len(spelled) != len(words):  # a word with a line break in it
            spelled = [w.encode().decode("latin-1").translate(letters) for w in words]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(w) for w in spelled])) + 1
        return ids, np.diff(np.append(0, stops))

    return encode


def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class LibraryStore(Store):
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them: the strings of added tokens are tokens in a text."""

    def __init__(self, path: str) -> None:
        super().__init__(library_encoder(path))
        self.path, self.plain = path, None
        added = _library(path).get_added_tokens_decoder()
        self.added = "|".join(re.escape(t.content) for t in added.values())

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has. Texts with an added token go to the library as they are."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        if not odd.any():
            return self.texts(Batch(texts))
        if self.plain is None:
            self.plain = _library(self.path)
        flat, per_doc = self.texts(Batch(texts.filter(pa.array(~odd))))
        parts = iter(np.split(flat, np.cumsum(per_doc)[:-1]))
        own = [np.array(self.plain.encode(t, add_special_tokens=False).ids, np.uint32) if o else next(parts) for t, o in zip(texts.to_pylist(), odd.tolist(), strict=True)]
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)


@lru_cache(2)
def library_store(path: str) -> LibraryStore:
    return LibraryStore(path)


@lru_cache(8)
def largest_id(path: str) -> int:
    """The largest id of a tokenizer file, added tokens included."""
    return max(_library(path).get_vocab(with_added_tokens=True).values())
