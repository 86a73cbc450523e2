"""Token counts by a unigram model, with scores shared along a trie of pre-tokens (operator 7).

The distinct pre-tokens of a task go into a trie. A node stands for a prefix; its forward score, the best sum of piece
scores over all ways to cut the prefix, and the number of pieces of that way depend only on the prefix, so they are
computed once, when the node is made. The node at which a pre-token ends is its terminal and has its count.

Pieces come from a rank file; the piece of rank r scores -ln(r + 2), the order of a Zipf law. Equal scores go to fewer
pieces, then to the longer last piece. Every byte is a piece, so any text has a count.

A pre-token of over SHARED bytes shares its first ones with others; the rest is computed on its own with the scores of as
many bytes as the longest piece has, so neither the trie nor one endless pre-token grows without a bound.

Defined results: a null text is empty; an empty text has no pre-tokens and no tokens; rows with one id or a null id, and
repeated rows, each stay a row; texts of any length are counted whole; an empty table gives no rows. Columns other than
id and text are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pretokens import Batch, chunks
from ._spark import ready


#: Bytes of a pre-token that get nodes in the trie.
SHARED = 1024


def piece_scores(path: str) -> dict[bytes, float]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): -math.log(int(b) + 2) for a, b in map(bytes.split, f)}


class Trie:
    """Forgets its nodes when there are more than `most`, between two words."""

    def __init__(self, scores: dict[bytes, float], most: int = 600_000) -> None:
        self.scores, self.most = scores, most
        self.longest = max(map(len, scores))
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.pieces = [0.0], [0]

    def _step(self, word: bytes, k: int, score: list[float], pieces: list[int]) -> tuple[float, int]:
        """Best sum and fewest pieces for word[: k + 1]; score and pieces are those of its last prefixes, up to word[:k]."""
        best, fewest, n = -math.inf, 0, len(score)
        for start in range(max(0, k + 1 - self.longest), k + 1):
            own = self.scores.get(word[start : k + 1])
            if own is not None:
                total, many = score[start - k + n - 1] + own, pieces[start - k + n - 1] + 1
                if total > best or total == best and many < fewest:
                    best, fewest = total, many
        return best, fewest

    def count(self, word: bytes) -> int:
        """The terminal count of word; only nodes that are not there yet are computed."""
        child, node = self.child, 0
        score, pieces = [self.score[0]], [self.pieces[0]]
        for k, byte in enumerate(word[:SHARED]):
            key = node << 8 | byte
            node = child.get(key)
            if node is None:
                node = child[key] = len(self.score)
                best, fewest = self._step(word, k, score, pieces)
                self.score.append(best)
                self.pieces.append(fewest)
            score.append(self.score[node])
            pieces.append(self.pieces[node])
        for k in range(SHARED, len(word)):
            best, fewest = self._step(word, k, score, pieces)
            score.append(best)
            pieces.append(fewest)
            if len(score) > 2 * self.longest + SHARED:
                del score[: -self.longest], pieces[: -self.longest]
        return pieces[-1]

    def counts(self, words: list[str]) -> np.ndarray:
        # In order, so that words with a common prefix follow each other.
        coded = [w.encode() for w in words]
        out = np.zeros(len(words), np.int64)
        for k in sorted(range(len(words)), key=coded.__getitem__):
            if len(self.score) > self.most:
                self._clear()
            out[k] = self.count(coded[k])
        return out


@lru_cache(2)
def _trie(path: str) -> tuple[Trie, dict[str, int]]:
    return Trie(piece_scores(path)), {}


def count_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _trie(ranks_path)
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                split = Batch(batch.column(1).slice(a, b - a))
                if len(known) > 500_000:
                    known.clear()
                new = [w for w in split.words if w not in known]
                known.update(zip(new, trie.counts(new).tolist(), strict=True))
                each = np.fromiter(map(known.__getitem__, split.words), np.int64, len(split.words))[split.codes]
                total = np.append(0, np.cumsum(each))
                stops = np.cumsum(split.per_doc)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_pretokens": split.per_doc, "n_tokens": total[stops] - total[stops - split.per_doc]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every text of documents."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
