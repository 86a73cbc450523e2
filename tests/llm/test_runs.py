"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from strandline.llm import run_collapse
from strandline.llm._words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least):
    """Every period in turn: stretches of words that equal the one a period later, without those that have a shorter period."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k + q < len(words):
            stop = k
            while stop + q < len(words) and words[stop] == words[stop + q]:
                stop += 1
            s, e = k, stop + q
            if stop > k and e - s >= max(least, 2 * q) and not any(words[s : e - r] == words[s + r : e] for r in range(1, q)):
                found.append((s, e - s, q))
            k = stop + 1
    return sorted(found)


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_of_words(least, monkeypatch):
    monkeypatch.setattr(run_collapse, "BLOCK", 3)
    rng = random.Random(least)
    for _ in range(300):
        words = [str(rng.randrange(rng.choice([1, 2, 3, 5]))) for _ in range(rng.randrange(50))]
        words += words[: rng.randrange(9)] * rng.randrange(6) + [str(rng.randrange(3)) for _ in range(rng.randrange(5))]
        want = brute(words, least)
        assert run_collapse.runs_of(words, least) == want
        # The stretches that are left hold all runs, and none reaches into the next text.
        found = run_collapse.stretches(Words(pa.array([" ".join(words), " ".join(words[:7])])), least)
        got = [(a + s, n, q) for t, a, b in zip(*found, strict=True) if t == 0 for s, n, q in run_collapse.runs_of(words[a:b], least)]
        assert sorted(got) == want


def test_collapse_edges(spark):
    long = [f"w{k}" for k in range(700)]
    texts = [None, "", " \t\n", "x", "x " * 11, "x " * 12, "x\x0bx\n" * 300, " ".join(["a b c"] * 4), "é 漢 " * 9 + "z", " ".join(long * 3), "y " * 300_000, " ".join(long)]
    rows = [(k, t, "row", "own") for k, t in enumerate(texts)] + [(None, "x " * 20, None, None), (3, "x " * 20, "row", "own"), (3, "x " * 20, "row", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, runs string").repartition(4)
    got = run_collapse.collapse_runs(docs)
    assert got.columns == ["doc_id", "text", "row", "n_words", "runs", "collapsed"]
    want = []
    for doc, text, row, _ in rows:
        words = WORD.findall(text or "")
        runs = [(0, len(words), 1)] if len(words) > 1000 and words[0] == "y" else brute(words, 12) if len(words) < 1000 else [(0, 2100, 700)]
        want.append(repr((doc, row, len(words), runs, collapsed(words, runs))))
    assert sorted(repr((r.doc_id, r.row, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got.collect()) == sorted(want)
    assert run_collapse.collapse_runs(docs.limit(0)).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = []
    for doc, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words, 12)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(collapsed(words, runs))))
    got = [tuple(r) for r in run_collapse.op11_periodic_runs(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and sum(x[1] for x in want) > 20
