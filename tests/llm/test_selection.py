"""Importance resampling against a plain version; boosted trees against plain traversal and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from strandline.llm import boosted_quality, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(n=300, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abZé1漢Ä") for _ in range(rng.choice([1, 2, 3, 7, 90])))
    vocabulary = [word() for _ in range(200)]
    out = [rng.choice([" ", "\n", ", ", "--"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [None, "", " ,;\n", "one", "x" * 70_000 + " y", " ".join(vocabulary * 300), *out, *out[:5]]


def plain_resample(rows, target, percent, least, seed, buckets):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in (1, 2, 3) for k in range(len(words) - n + 1)]

    found = [(doc, *features(text)) for doc, text in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for text in target for b in features(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for doc, n_words, own in found:
        weight, score = sum(gain[b] for b in own), None
        if doc is not None:
            h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, n_words, len(own), weight, score, None])
    able = sorted((x for x in out if x[0] is not None and x[1] >= least), key=lambda x: (-x[4], x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[5] = k + 1
    return sorted(map(repr, out))


def test_features_are_checksums_of_runs():
    every = texts(30)
    counts, found = importance.features(pa.array(["skipped", *every]).slice(1))
    split = [WORD.findall((t or "").translate(LOWER)) for t in every]
    assert counts.tolist() == [len(w) for w in split]
    for n, (buckets, stops) in enumerate(found, 1):
        want = [[zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for k in range(len(w) - n + 1)] for w in split]
        assert buckets.tolist() == sum(want, []) and stops.tolist() == np.cumsum([len(x) for x in want]).tolist()


def test_resampling(spark):
    every = texts()
    rows = [(k * 7 % 1009, t, "x", 1.0) for k, t in enumerate(every)] + [(None, every[-1], None, None), (None, None, None, None), (14, every[40], "x", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, score double").repartition(5)
    target = spark.createDataFrame([(t,) for t in texts(20, 4)[4:]], "text string")
    for percent, least, buckets in ((5, 20, 10_000), (100, 0, 16), (0, 20, 100)):
        want = plain_resample([r[:2] for r in rows], [r.text for r in target.collect()], percent, least, 42, buckets)
        got = importance.resample(docs, target, percent, least, 42, buckets)
        assert sorted(repr([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]]) for r in got.collect()) == want
    assert importance.resample(docs.limit(0), target).count() == 0
    assert {r["rank"] for r in importance.resample(docs, target.limit(0), 10).collect()} > {1, 2, None}


def test_draw_with_many_ties(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(12), rng.random() < 0.9) for k in range(700)]
    scored = spark.createDataFrame(rows, "doc_id long, score long, eligible boolean")
    able = sorted((-s, d) for d, s, ok in rows if ok)
    for percent in (1, 33, 99):
        want = {d: k + 1 for k, (_, d) in enumerate(able[: percent * len(able) // 100])}
        assert {r.doc_id: r["rank"] for r in importance.draw(scored, percent).collect()} == {d: want.get(d) for d, _, _ in rows}


def test_statistics_of_texts():
    every = [None, "", "Ab ab ab. C#\nAb ab ab. C#\n", "é é é"]
    got = dict(zip(boosted_quality.STATISTICS, boosted_quality.statistics(pa.array(every)).T, strict=True))
    assert got["words"][2] == np.float32(math.log1p(8)) and got["lines"][2] == np.float32(math.log1p(3)) and got["lines met before"][2] == np.float32(1 / 3)
    assert got["distinct words"][2] == 0.5 and got["words with a capital first"][2] == 0.5 and got["symbols"][2] == np.float32(2 / 26)
    assert got["words met three in a row before"][2] == np.float32(2 / 8) and got["words like the one before"][3] == np.float32(2 / 3)
    assert not any(v[1] for k, v in got.items() if k != "lines") and (got["not ASCII"][3], got["bytes a word"][3]) == (0.75, 2)
    alone = [boosted_quality.statistics(pa.array([t], pa.string())) for t in texts(40)]
    assert np.allclose(np.concatenate(alone), boosted_quality.statistics(pa.array(texts(40))))


def test_trees_and_arrays():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, (3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 20) ^ (x[:, 3] > 9)).astype(float)
    forest = boosted_quality.fit(x, y, trees=30, depth=3)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.98

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] + (row[forest.statistic[node]] > forest.cut[node])
            total += forest.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.score(x[:200]), [walk(r) for r in x[:200]])
    # The first tree's root has the cut of the greatest gain over all statistics.
    p = y.mean()
    gain = lambda m: (y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + 1) + (y[~m] - p).sum() ** 2 / ((~m).sum() * p * (1 - p) + 1)
    best = max(gain(x[:, k] <= c) for k in range(5) for c in range(39))
    root = forest.roots[0]
    assert math.isclose(gain(x[:, forest.statistic[root]] <= forest.cut[root]), best)
    assert set(boosted_quality.fit(x, np.ones(3000)).score(x)) == {boosted_quality.fit(x[:1], np.ones(1)).score(x[:1])[0]}
    assert boosted_quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in boosted_quality.op13_boosted_quality(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for d, r in got.items())
    known = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(q == r.predicted for q, r in known) >= 0.95 * len(known) > 50


def test_quality_edges(spark):
    rows = [(k, t, 1, "x") for k, t in enumerate(texts(60))] + [(None, "null id", None, None), (3, "again", 1, None), (3, "again", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, statistics int, label string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(3, 0), (9999, 1), (None, 1), (5, None)], "doc_id long, quality int")
    found = boosted_quality.measured(docs)
    forest = boosted_quality.learn(found, labels)
    got = boosted_quality.score_quality(found, forest).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    # The same trees whatever the order and number of tasks.
    again = boosted_quality.learn(boosted_quality.measured(docs.repartition(7)), labels.repartition(3))
    assert again.cut.tolist() == forest.cut.tolist() and again.value.tolist() == forest.value.tolist()
    assert len(boosted_quality.learn(found, labels, sample=20).roots) in (0, 60)
    assert {r.score for r in boosted_quality.score_quality(found, boosted_quality.learn(found, labels.limit(0))).collect()} == {0.5}
    assert boosted_quality.score_quality(boosted_quality.measured(docs.limit(0)), forest).count() == 0
