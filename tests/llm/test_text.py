"""Text operators against brute force."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import _words, chat_format, components, license_scan, ngram_join, quality_rules, substring_dedup, telephony

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=0):
    """Texts with copies, near copies, shared passages, edges of white space, nulls and empty ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    draw = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base, out = draw(70), draw(60), []
    for k in range(n):
        words = draw(rng.randrange(0, 150))
        if k % 4 == 0:
            words[10:10] = passage[rng.randrange(15) :]
        if k % 5 == 0:
            words = [w if rng.random() > 0.012 * (k % 7) else rng.choice(vocabulary) for w in base]
        if k % 9 == 0 and out:
            words = rng.choice(out).split() if rng.random() < 0.7 else words
        out.append(rng.choice([" ", "\n", "\t ", "\x0b", "  "]).join(words))
    return out + ["", "  \n ", "one", "ONE", "one two THREE", "One Two three", "a b c d e", "A B c D e f", "x" * 3000, "w " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    rows = [(i * 3 % 1009, t, "x", "y", 1) for i, t in enumerate(texts)] + [(2000, None, "x", "y", 1), (None, texts[0], "x", "y", 2), (None, None, None, None, None), (0, texts[0], "x", "y", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, spans string, n long").repartition(5)


def test_word_hashes_tell_words_apart():
    texts = corpus(40, 3) + [None, "Ab aB"]
    w = _words.Words(pa.array(texts))
    split = [WORD.findall(t or "") for t in texts]
    assert w.counts.tolist() == [len(x) for x in split]
    flat = [x for s in split for x in s]
    assert len(set(flat)) == len(set(w.hashes.tolist())) == len(set(zip(flat, w.hashes.tolist(), strict=True)))
    lower = _words.Words(pa.array(["Ab aB É"]), lower=True).hashes
    assert lower[0] == lower[1] == _words.Words(pa.array(["ab"])).hashes[0]
    assert _words.Words(pa.array(["y", "Ab"]).slice(1), lower=True).hashes[0] == lower[0]
    assert (_words.rolling(w.hashes, 3)[5:] == _words.rolling(w.hashes[5:], 3)).all()


@pytest.mark.parametrize(("size", "cells"), [(50, 1 << 20), (5, 1 << 16)])
def test_substring_dedup(spark, docs, size, cells):
    rows = [(r.doc_id, WORD.findall(r.text or "")) for r in docs.collect()]
    first = {}
    for doc, w in rows:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    want = []
    for doc, w in rows:
        gone = {k + j for k in range(len(w) - size + 1) if doc is not None and first[tuple(w[k : k + size])] < doc for j in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((str(doc), len(w), len(gone), kept))
    got = substring_dedup.remove_repeats(docs, size, cells)
    assert {"spans", "n", "text"} <= set(got.columns) and len(got.columns) == len(set(got.columns))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()) == sorted(want)
    assert sum(x[2] for x in want) > 100
    assert substring_dedup.remove_repeats(docs.limit(0), size, cells).count() == 0


def test_very_long_texts(spark, monkeypatch):
    """Texts that are a piece of work of their own, with words of thousands of bytes, beside short ones."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**9)}" for _ in range(90_000)]
    words[500] = "x" * 5000
    long, other = " ".join(words), " ".join(w if k % 200 else f"z{k}" for k, w in enumerate(words))
    rows = [(1, " ".join(words[400:600])), (2, long), (3, other), (4, "short one"), (5, "x" * 700_000), (6, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classify(docs).collect()}
    assert {k: c for k, (_, c) in got.items()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 2} and got[2][0] == len(words) - 4 and got[5][0] == 1
    left = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert left[1] == (200, 0) and left[2] == (90_000, 200) and left[6] == (90_000, 90_000) and left[5] == (1, 0)
    assert left[3][1] == 90_000 - sum(k % 200 == 0 for k in range(90_000))


def test_substring_dedup_sends_in_parts(spark, docs, monkeypatch):
    whole = sorted(map(repr, substring_dedup.remove_repeats(docs, 20, 1 << 16).collect()))
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    assert sorted(map(repr, substring_dedup.remove_repeats(docs, 20, 64 * 1024).collect())) == whole


def brute_groups(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append((doc, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {d: d for d, _ in sets if d is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    known = [(d, s) for d, s in sets if d is not None]
    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(repr((d, len(s), None if d is None and s else d if not s else find(d))) for d, s in sets)


@pytest.mark.parametrize(("small", "block"), [(32, 384), (2, 3), (4, 50)])
def test_ngram_join(spark, docs, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.classify(docs).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute_groups(rows)
    if small == 32:
        assert ngram_join.classify(docs.limit(0)).count() == 0


def test_ngram_join_links_all_texts_of_an_id(spark):
    text = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    rows = [(1, text[0]), (2, text[1]), (3, text[2]), (4, text[3]), (5, text[0]), (5, text[1]), (5, text[2]), (6, text[1])]
    got = ngram_join.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute_groups(rows)


def test_sketches_and_bit_sets_in_two_steps(spark, monkeypatch):
    from strandline.llm import _sketch

    rng = np.random.default_rng(8)
    numbers = rng.integers(0, 1 << 20, 4000)
    df = spark.createDataFrame([(int(x),) for x in numbers], "cell long").repartition(7)
    hashes_of = lambda batch: iter([batch.column(0).to_numpy().view(np.uint64)])
    for at_once in (256, 1):
        monkeypatch.setattr(_sketch, "AT_ONCE", at_once)
        bits = _sketch.bit_set(df, 1 << 20)
        assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == sorted(set(numbers.tolist()))
        seen = _sketch.met_twice(df, hashes_of, 1 << 22)
        values, n = np.unique(numbers, return_counts=True)
        passed = _sketch.passes(values.astype(np.uint64), seen, 1 << 22)
        assert passed[n > 1].all() and passed[n == 1].mean() < 0.01
    assert not _sketch.bit_set(df.limit(0), 1 << 20).any()


def test_ranges_bound_what_sets_share():
    rng = np.random.default_rng(2)
    for _ in range(60):
        every = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = np.unique(rng.choice(every, rng.integers(1, 900))), np.unique(rng.choice(every, rng.integers(1, 900)))
        x, y = ngram_join._ranges(np.concatenate([a, b]), np.array([len(a), len(b)]))
        bound = ngram_join.shared_at_most(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))
    heap = np.arange(300, dtype=np.uint64)  # all in one range
    x = np.frombuffer(ngram_join._ranges(heap, np.array([300]))[0], np.uint8)
    assert ngram_join.shared_at_most(x, x) >= 300
    assert [len(r) for r in ngram_join._ranges(heap[:0], np.array([0, 0]))] == [16, 16]


@pytest.mark.parametrize("within", [True, False])
def test_promising_nodes_are_those_that_some_pair_leaves(within):
    rng = np.random.default_rng(5)
    every = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(every, k, replace=False)) for k in rng.integers(30, 80, 20)]
    sets += [np.unique(np.append(s[: len(s) - 3], rng.choice(every, rng.integers(1, 20)))) for s in sets] + [np.arange(300, dtype=np.uint64)] * 2
    n, m = np.array([len(s) for s in sets]), len(sets)
    ranges = [np.frombuffer(r, np.uint8) for r in ngram_join._ranges(np.concatenate(sets), n)]
    group, known, position = np.arange(m) // 20 % 2 * (not within), rng.integers(0, 30, m), rng.integers(0, 4, m)
    want = set()
    for i in range(m):
        for j in range(m):
            apart = i != j and known[i] != known[j] and (within or group[i] != group[j])
            most = min(min(n[i] - position[i], n[j] - position[j]), ngram_join.shared_at_most(ranges[i], ranges[j]))
            if apart and 180 * most >= 80 * (n[i] + n[j]):
                want |= {i, j}
    got = ngram_join.promising(group, known, n, position, ranges, within, 80)
    assert 2 < len(want) < m and set(np.flatnonzero(got).tolist()) == want


def test_ngram_join_on_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(k, " ".join(w if rng.random() > rng.choice([0.0, 0.01, 0.03]) else f"z{rng.randrange(10**6)}" for w in base)) for k in range(220)]
    got = ngram_join.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute_groups(rows)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5)] + [(k, k + 1) for k in range(300, 340)]
    root = list(range(400))
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: root[k] for a, b in links if a != b for k in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_measures_and_estimation(spark, docs):
    def plain(text):
        w = WORD.findall(text or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)

    extra = [(5000, "### a | b\na\na\n \n \nb$ a a a a a a"), (5001, "a b c a b c a b"), (5002, "a b"), (5003, "word word " * 60), (5004, "good words here. " + " ".join(map(str, range(100))))]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    judged = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in judged)
    want = []
    for doc, text in rows:
        m = plain(text)
        want.append(repr((doc, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])))
    assert got == sorted(want)
    # The same estimation in plain Python.
    n_rules = len(quality_rules.RULES)
    votes = [[(0, 1, -1)[r.votes >> 2 * k & 3] for k in range(n_rules)] for r in judged]
    low, high = quality_rules.LOW, quality_rules.HIGH
    prior, good, bad = quality_rules.PRIOR, [quality_rules.ON_GOOD] * n_rules, [quality_rules.ON_BAD] * n_rules

    def odds_of(v):
        return math.log(prior / (1 - prior)) + sum(math.log(a / (1 - b)) if x > 0 else math.log((1 - a) / b) for x, a, b in zip(v, good, bad, strict=True) if x)

    for _ in range(quality_rules.ROUNDS):
        p = [1 / (1 + math.exp(-odds_of(v))) for v in votes]
        prior = min(0.99, max(0.01, sum(p) / len(p)))
        for k in range(n_rules):
            cast = [(v[k], q) for v, q in zip(votes, p, strict=True) if v[k]]
            good[k] = min(high, max(low, sum(q for x, q in cast if x > 0) / sum(q for _, q in cast))) if cast else quality_rules.ON_GOOD
            bad[k] = min(high, max(low, sum(1 - q for x, q in cast if x < 0) / sum(1 - q for _, q in cast))) if cast else quality_rules.ON_BAD
            bad[k] = max(bad[k], 1 - good[k])
    for r, v in zip(judged, votes, strict=True):
        odds = odds_of(v)
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_posterior_against_labels(spark):
    """No label is used: what the rules find out by themselves agrees with labels of quality."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs).join(labels, "doc_id").select("quality", "kept", "base_failed", "posterior").collect()
    good, bad = [[r for r in rows if r.quality == q and not r.base_failed] for q in (1, 0)]
    assert sum(r.kept for r in good) > 0.99 * len(good) > 1000
    assert sum(r.kept for r in bad) < 0.05 * len(bad) and len(bad) > 100


def test_quality_windows_survive_clashing_hashes(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_PLACE_BITS", 62)  # two bits of hash are left
    rows = [(1, "a b c d e f g a b c x y z"), (2, "q w e r t y u i o p")]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 6, 2: 0}


def talks(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\b \\t ### </turn>\n ok"), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "####</turn></turn"), (3, 0, "tool:\nx", "\\"), (3, 1, None, ""), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (4, 1, "assistant", "é漢 \U0001f642"), (5, 0, "user", ""), (6, 3, "human", "x"), (6, None, "user", "first"), (None, 0, "user", "no id")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    rows = talks(spark)
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_records(chat_format.as_records(rows), "conv_id")).collect()}
    by_id = {}
    for r in sorted(rows.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        by_id.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert set(got) == set(by_id)
    for k, turns in by_id.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_records(chat_format.as_records(rows.limit(0)), "conv_id").count() == 0


def test_chat_with_very_long_texts(spark):
    from pyspark.sql import functions as F

    word = F.repeat(F.lit('say "x"\\\n'), 2_500_000)  # 25 MB, more once it is escaped
    rows = spark.range(5).select((F.col("id") > 1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") < 3, word).otherwise("short").alias("text"))
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_records(chat_format.as_records(rows), "conv_id")).collect()}
    text = 'say "x"\\\n' * 2_500_000
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[0].n_turns == 2 and got[0].loss_chars == len(text) and got[0].loss_sha256 == sha(text)
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha(f"user\n{text}\nassistant\nshort\nuser\nshort\n")


def test_chat_record_too_long_to_be_parsed(spark, monkeypatch):
    """What may have been too long is an error, never a null."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(chat_format, "_LONG", 1000)
    turns = lambda n: spark.createDataFrame([('{"prompt": "' + "x" * n,)], "record string").select(chat_format.canonical_turns(F.col("record")).alias("t")).collect()
    assert turns(500)[0].t is None
    with pytest.raises(Exception, match="can't be parsed"):
        turns(2000)


def test_chat_layouts_by_fingerprint(spark):
    records = ['{"prompt": "p", "response": "r"}', '{"response": null, "prompt": "p"}', '{"instruction": "i", "input": 3, "output": "o"}', '{"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}', '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', '{"other": 1}', "[1]", "no json", None, '{"id": 7, "prompt": "p", "response": "r", "tags": [{"role": 1}]}', '{"messages": [], "source": "s"}', '{"source": {"role": "x"}, "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}]}', '{"prompt": "p", "completion": "c"}', '{"system": "s", "prompt": "p", "response": "r"}', '{"instruction": "i", "output": "o"}', '{"prompt": "p", "response": "r", "messages": []}', '{"messages": 3}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(records)], "id long, record string")
    got = {r.id: r.t and [tuple(x) for x in r.t] for r in df.select("id", chat_format.canonical_turns(df.record).alias("t")).collect()}
    pair = [("user", "a"), ("assistant", "b")]
    assert got == {0: [("user", "p"), ("assistant", "r")], 1: [("user", "p"), ("assistant", "")], 2: [("system", "i"), ("user", "3"), ("assistant", "o")], 3: pair, 4: pair, 5: None, 6: None, 7: None, 8: None, 9: [("user", "p"), ("assistant", "r")], 10: [], 11: pair, 12: [("user", "p"), ("assistant", "c")], 13: [("system", "s"), ("user", "p"), ("assistant", "r")], 14: [("user", "i"), ("assistant", "o")], 15: None, 16: None}
    out = {r.id: r.formatted for r in chat_format.format_records(df, "id").collect()}
    assert out[0] == "### user:\np</turn>\n### assistant:\nr</turn>\n" and out[5] is None and out[10] == "" and len(out) == len(records)
    unknown = {r.fields: r.n for r in chat_format.unknown_layouts(df).collect()}
    assert sum(unknown.values()) == 6 and unknown["OBJECT<other: BIGINT>"] == 1


def test_license_scanner_against_all_windows():
    """Short templates in random text: the best alignment over every window of the text, without any choice of windows."""
    rng = random.Random(3)
    found = 0
    for _ in range(150):
        vocabulary = [f"w{k}" for k in range(rng.randrange(6, 14))]
        template = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 10))]
        text = [rng.choice(vocabulary) if rng.random() < 0.5 else f"other{rng.randrange(50)}" for _ in range(rng.randrange(5, 22))]
        if rng.random() < 0.7:
            at = rng.randrange(len(text))
            text[at:at] = [w for w in template if rng.random() < 0.9]
        scanner = license_scan.Scanner({"t": " ".join(template)}, 0.8)
        best = 0
        hits = [w for w in text if w in template]
        for i in range(len(hits)):
            for j in range(i + 1, min(len(hits), i + license_scan.REACH * len(template)) + 1):
                best = max(best, len(license_scan.align(hits[i:j], template)))
        name, coverage, first, last = scanner.scan(" ".join(text))
        need = math.ceil(0.8 * len(template) - 1e-9)
        assert (name == "t") == (best >= need)
        if name:
            found += 1
            assert round(coverage * len(template)) == best and 0 <= first < last <= len(text)
    assert 20 < found < 150


def test_license_scanner_with_long_templates():
    """Templates of over SHORT words, of which not all ends of windows are tried: none is missed, and hardly any understated."""
    rng = random.Random(8)
    found = understated = 0
    for _ in range(24):
        vocabulary = [f"w{k}" for k in range(rng.randrange(20, 40))]
        template = [rng.choice(vocabulary) for _ in range(rng.randrange(33, 48))]
        text = [rng.choice(vocabulary) if rng.random() < 0.3 else f"other{rng.randrange(50)}" for _ in range(rng.randrange(5, 30))]
        at = rng.randrange(len(text))
        text[at:at] = [w if rng.random() < 0.95 else rng.choice(vocabulary) for w in template if rng.random() < 0.97]
        assert len(template) > license_scan.SHORT
        hits = [w for w in text if w in template]
        best = max(len(license_scan.align(hits[i:j], template)) for i in range(len(hits)) for j in range(i + 1, min(len(hits), i + license_scan.REACH * len(template)) + 1))
        name, coverage, _, _ = license_scan.Scanner({"t": " ".join(template)}, 0.8).scan(" ".join(text))
        assert (name == "t") == (best >= math.ceil(0.8 * len(template) - 1e-9))
        if name:
            found += 1
            assert best - 2 <= round(coverage * len(template)) <= best
            understated += round(coverage * len(template)) < best
    assert found > 12 and understated <= 1


def test_license_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Use of this thing is granted to whoever wants it, as long as the words stay.")
    (tmp_path / "Other.txt").write_bytes(b"All of it belongs to nobody \xff at all.")
    (tmp_path / "notes.md").write_text("no license")
    templates = license_scan.load_templates(str(tmp_path))
    assert set(templates) == {"Own-1.0", "Other"}
    rows = [(1, "Note: use of this thing is granted to whoever wants it as long as the words stay!"), (2, "all of it belongs to nobody at all"), (3, "no license"), (4, license_scan.TEMPLATES["MIT"])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, matches int")
    got = {r.doc_id: (r.license, r.coverage) for r in license_scan.scan_licenses(docs, templates).collect()}
    assert got == {1: ("Own-1.0", 1.0), 2: ("Other", 1.0), 3: (None, 0.0), 4: (None, 0.0)}


def test_license_alignment(spark):
    mit = license_scan.TEMPLATES["MIT"]
    words = license_scan.words_of(mit)
    assert len(license_scan.align(words, words)) == len(words)
    changed = words[:20] + ["some", "other"] + words[20:60] + words[63:]
    assert len(license_scan.align(changed, words)) == len(words) - 3
    for text, template in (("a x b y c", "a b c"), ("q a a b", "a b"), ("", "a"), ("c b a", "a b c")):
        pairs = license_scan.align(text.split(), template.split())
        assert all(text.split()[i] == template.split()[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    notice = "Released under the MIT License."
    rows = [(1, "lorem ipsum the " * 50 + notice + " the under the " * 60), (2, f"{notice}\n{notice}"), (3, "under the license the mit"), (4, None), (5, ""), (6, "x " + mit.replace("copies", "clones") + " y"), (7, "Licensed under CC BY-NC 4.0."), (8, "Licensed under the Apache License, Version 2.0."), (None, notice), (9, "z " * 30000 + notice)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert {k: r.license for k, r in got.items()} == {1: "MIT-notice", 2: "MIT-notice", 3: None, 4: None, 5: None, 6: "MIT", 7: "CC-BY-NC-4.0-notice", 8: "Apache-2.0-notice", None: "MIT-notice", 9: "MIT-notice"}
    assert (got[9].first_word, got[9].last_word, got[9].coverage) == (30000, 30005, 1.0)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    values = [random.Random(k).sample(range(30), 12) for k in range(20)]
    for v in values:
        kept = [v[k] for k in license_scan.increasing(v)]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        assert kept == sorted(kept) and len(kept) == max(best)


def test_edited_notices_are_found_at_every_offset():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    gpl = license_scan.TEMPLATES["GPL-3.0-notice"].split()
    mit = license_scan.TEMPLATES["MIT"].split()
    long = [*mit[:30], *(f"more{k}" for k in range(90)), *mit[30:70], *(f"word{k}" for k in range(90)), *mit[74:]]
    cases = (("MIT-notice", "Released under the terms of the popular MIT License".split()), ("GPL-3.0-notice", [*gpl[:6], *"a b c d e f".split(), *gpl[6:]]), ("MIT", long))
    for name, notice in cases:
        template = license_scan.words_of(license_scan.TEMPLATES[name])
        for offset in range(3 * len(template)):
            text = [f"q{k}" for k in range(offset)] + notice + ["z"] * 50
            pairs = license_scan.align(license_scan.words_of(" ".join(text)), template)
            got = scanner.scan(" ".join(text))
            assert got[0] == name and got[1] >= len(pairs) / len(template) >= 0.8, (name, offset, got)
            assert got[2:] == (pairs[0][0], pairs[-1][0] + 1)
    # The template's own words on both sides, as often as they like.
    for around in ("the ", "license the ", "under the mit "):
        for times in range(30):
            got = scanner.scan(around * times + "Released under the terms of the popular MIT License " + around * times)
            assert got[:2] == ("MIT-notice", 1.0)


def test_every_license_of_a_text_is_returned(spark):
    t = license_scan.TEMPLATES
    scanner = license_scan.Scanner(t, 0.8)
    for name, text in t.items():
        assert scanner.scan("q w " + text + " z")[:2] == (name, 1.0)
        assert [x[0] for x in scanner.matches(text)] == [name]
    assert all(license_scan.KEYS[n] & set(license_scan.words_of(t[n])) for n in license_scan.KEYS)
    rows = [(1, "Copyright 2020 A. All rights reserved."), (2, t["MIT"] + " " + t["MIT-warranty"]), (3, t["Apache-2.0-notice"] + " x y z " + t["MIT-notice"]), (4, "All rights reserved. " + t["BSD-3-Clause"]), (5, "Released under the ABC License."), (6, None)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: {x.license for x in r.matches} for k, r in got.items()} == {1: {"All-rights-reserved"}, 2: {"MIT", "MIT-warranty"}, 3: {"Apache-2.0-notice", "MIT-notice"}, 4: {"All-rights-reserved", "BSD-3-Clause"}, 5: set(), 6: set()}
    assert [got[k].license for k in range(1, 7)] == ["All-rights-reserved", "MIT", "MIT-notice", "BSD-3-Clause", None, None]
    spans = {x.license: (x.first_word, x.last_word) for x in got[3].matches}
    assert spans == {"Apache-2.0-notice": (0, 8), "MIT-notice": (11, 16)}


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(88, int(block[2]))
    out = [value]
    for byte in block[4:].tolist():
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def plain_g711(byte, a_law):
    """One sample by the segments of G.711."""
    if a_law:
        byte ^= 0x55
        segment, low = byte >> 4 & 7, byte & 15
        size = (2 * low + 1) * 8 if segment == 0 else (2 * low + 33) * 8 << segment - 1
        return size if byte & 0x80 else -size
    byte ^= 0xFF
    size = ((2 * (byte & 15) + 33 << (byte >> 4 & 7)) - 33) * 4
    return -size if byte & 0x80 else size


def test_telephony_tables_and_blocks():
    mu, al = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (al[0xD5], al[0x55], al[0x2A], al[0xAA]) == (8, -8, -32256, 32256)
    assert sorted(set(mu.tolist())) == sorted({-x for x in mu.tolist()}) and len(set(al.tolist())) == 256
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (7, 36), dtype=np.uint8)

    assert telephony.decode_adpcm(blocks).tolist() == [plain_adpcm(b) for b in blocks]
    assert telephony.resample(np.array([0, 10, -10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 0, -10, -10]
    with pytest.raises(ValueError, match="WAV"):
        telephony.open_wav(b"RIFFxxxx")
    time = np.arange(16_000) / 16_000
    tone = lambda hz: (10_000 * np.sin(2 * np.pi * hz * time)).astype(np.int16)
    size = lambda x: float(np.sqrt((x[200:-200].astype(float) ** 2).mean()))
    assert len(telephony.resample(tone(500), 16_000, 8000)) == 8000
    assert size(telephony.resample(tone(500), 16_000, 8000)) == pytest.approx(size(tone(500)), rel=0.01)
    assert size(telephony.resample(tone(6000), 16_000, 8000)) < 0.01 * size(tone(6000))
    assert (telephony.resample(np.full(100, 7, np.int16), 16_000, 8000) == 7).all()


def test_samples_are_packed_without_loss(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 64, 1001):
        pcm = rng.integers(-32768, 32768, n).astype("<i2")
        assert (telephony.unpacked(*telephony.packed(pcm)) == pcm).all() and len(telephony.unpacked(*telephony.packed(pcm))) == n
        double = telephony.resample(pcm, 8000, 16_000)
        even, rest = telephony.packed(double)
        assert rest is None and len(even) == len(double) and (telephony.unpacked(even, rest) == double).all()
    # Whatever the rate, what is read back is what was resampled.
    media = telephony.store_media(spark.createDataFrame([(k, "some text " * k) for k in range(90)], "doc_id long, text string"))
    for rate in (8000, 11_025, 16_000, 24_000):
        want = {r.doc_id: (r.pcm_bytes, r.pcm_crc32) for r in telephony.features(media, rate).collect()}
        assert {r.doc_id: (r.pcm_bytes, r.pcm_crc32) for r in telephony.store_pcm(media, rate).collect()} == want


def test_telephony_query_stores_its_samples(spark, docs, tmp_path):
    from strandline.llm._spark import shared_dir

    docs.limit(20).write.parquet(f"{tmp_path}/documents.parquet")
    here = Path(shared_dir(spark).removeprefix("file://"))
    before = set(here.iterdir())
    got = sorted(telephony.op1_telephony(spark, str(tmp_path)).select("payload_sha256", "pcm_bytes", "pcm_crc32").collect())
    new = {x.name.split("-")[0]: x for x in set(here.iterdir()) - before}
    files = [r.media for r in spark.read.parquet(str(new["media"])).collect()]
    held = spark.read.parquet(str(new["pcm"])).collect()
    kept = {r.payload_sha256: telephony.unpacked(next(r[f"pcm_{c}"] for c in telephony.NAMES.values() if r[f"pcm_{c}"] is not None), r.pcm_rest).tobytes() for r in held}
    expected = []
    for _, payload, rate, pcm in telephony.expand(files):
        raw = telephony.resample(pcm, rate, 16000).astype("<i2").tobytes()
        name = hashlib.sha256(payload).hexdigest()
        assert kept[name] == raw
        expected.append((name, len(raw), zlib.crc32(raw)))
    assert got == sorted(expected)


def test_telephony_round_trip(spark, docs):
    got = telephony.store_pcm(telephony.store_media(docs)).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    assert len(got) == docs.count()
    kinds = set()
    for r in got:
        raws = [raw for raw in texts[r.doc_id] if len(raw) == r.n_bytes]
        payloads = [raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw)) for raw in raws]
        assert (r.payload_bytes, r.payload_sha256) in [(len(p), hashlib.sha256(p).hexdigest()) for p in payloads]
        kinds.add(r.feature.split(";")[0])
        payload = next(p for p in payloads if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        which = zlib.crc32(payload) % 3
        tag, align, bits = ((7, 1, 8), (6, 1, 8), (0x11, 36, 4))[which]
        if which < 2:
            pcm, speed, form = [plain_g711(b, which == 1) for b in payload], 8000, b"\0\0"
        else:
            pcm = [v for k in range(0, len(payload), 36) for v in plain_adpcm(np.frombuffer(payload[k : k + 36], np.uint8))]
            speed, form = 8000 * 36 // 65, (2).to_bytes(2, "little") + (65).to_bytes(2, "little")
        number = lambda v, n=4: v.to_bytes(n, "little")
        head = number(tag, 2) + number(1, 2) + number(8000) + number(speed) + number(align, 2) + number(bits, 2) + form
        body = b"WAVEfmt " + number(len(head)) + head + b"fact" + number(4) + number(len(pcm)) + b"data" + number(len(payload)) + payload
        assert r.media_sha256 == hashlib.sha256(b"RIFF" + number(len(body)) + body).hexdigest()
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
        assert r.feature.split(";")[1:] == [f"samples={len(pcm)}", f"peak={max(map(abs, pcm))}", f"energy={sum(v * v for v in pcm) // len(pcm)}", f"crossings={crossings}"]
        double = [v for a, b in zip(pcm, [*pcm[1:], pcm[-1]], strict=True) for v in (a, (a + b) // 2)]
        assert r.pcm == np.array(double, "<i2").tobytes()
        assert r.pcm_bytes == len(r.pcm) and r.media_bytes > r.payload_bytes
    assert len(kinds) == 3
    assert telephony.features(telephony.store_media(docs.limit(0))).count() == 0
