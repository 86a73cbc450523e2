"""The corpus pipeline against a plain version of every stage."""

import random
import re

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from strandline.llm import quality_rules  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randrange(3, 9))) for _ in range(900)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    passage = sentence(70)
    rows = []
    for k in range(90):
        lines = [sentence(rng.randrange(8, 20)) for _ in range(rng.randrange(5, 14))]
        if k % 4 == 1:
            lines.insert(2, passage)
        text = "\n".join(lines)
        if k % 7 == 3:
            text = rows[rng.randrange(len(rows))][1]
        if k % 7 == 5:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if k % 11 == 6:
            text = "### $$$ | % " * 40
        if k % 11 == 8:
            text = "the same line\n" * 60
        rows.append((500 - 3 * k, text))
    # A text that is a piece of work of its own.
    rows.append((9500, "\n".join(" ".join([*rng.choices(vocabulary, k=11), f"w{k}."]) for k in range(9000))))
    rows += [(9000, ""), (9001, None), (9002, "short"), (9003, passage), (None, rows[0][1]), (rows[0][0], rows[0][1])]
    return [(i, t, "en", "web", None if t is None else len(t)) for i, t in rows]


def n_grams(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_near(rows):
    sets, group = [n_grams(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            linked = rows[i][0] is not None and rows[j][0] is not None
            if linked and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    # The first rows of ids by id, then the others.
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    seen, place = set(), {}
    for r in order:
        place[id(r)] = (r[0] in seen, r[0], r[1] or "")
        seen.add(r[0])
    stay = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None and (g not in stay or place[id(r)] < place[id(stay[g])]):
            stay[g] = r
    return list(stay.values()) + [r for r in rows if r[0] is None]


def plain_passages(rows, size=50):
    first, out = {}, []
    split = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, split, strict=True):
        for k in range(len(w) - size + 1):
            if r[0] is not None:
                first[tuple(w[k : k + size])] = min(first.get(tuple(w[k : k + size]), r[0]), r[0])
    for r, w in zip(rows, split, strict=True):
        gone = {k + j for k in range(len(w) - size + 1) if r[0] is not None and first[tuple(w[k : k + size])] < r[0] for j in range(size)}
        if not gone:
            out.append(r)
        elif len(gone) < len(w):
            text = " ".join(x for k, x in enumerate(w) if k not in gone)
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def test_stages_and_run_agree_with_plain_versions(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    key = lambda r: (str(r[0]), r[1] or "")
    judged = {(r.doc_id, r.text): r.kept for r in quality_rules.judge(docs, keep=("text",)).collect()}
    now = sorted((r for r in rows if judged[r[0], r[1]]), key=key)
    assert 0 < len(now) < len(rows)
    df = docs
    wants = [now, plain_near(now)]
    wants.append(plain_passages(wants[-1]))
    assert len(wants[0]) > len(wants[1]) and wants[1] != wants[2]
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], wants, strict=True):
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns
        assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert len({r[0] for r in wants[-1]}) == len(wants[-1])
    ids = {str(r[0]): [*tokenizer.encode(r[1], add_special_tokens=False).ids, 0] for r in wants[-1]}
    pieces = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    got, filled = {}, {}
    for p in sorted(pieces, key=lambda p: p.start):
        got.setdefault(str(p.doc_id), []).extend(np.frombuffer(p.ids, "<u4").tolist())
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == ids
    for own in filled.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= corpus_pipeline.CAPACITY


def test_stages_take_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
    extra = "votes double, kept string, n_words boolean, n_removed string, _row string, _first long, _doc int, _mark string, _spans string, row string, mark string, `odd name` map<string,int>"
    more = (1.5, "mine", True, "x", "r", 7, 8, "m", "s", "w", "k", {"a": 1})
    texts = [" ".join(f"w{j}x{k}." for j in range(80)) for k in range(3)] + [" ".join([*(f"w{j}x0." for j in range(60)), *(f"q{j}." for j in range(60))])]
    rows = [(k, t, "en", "web", len(t), *more) for k, t in enumerate(texts)]
    # One id twice, with texts of its own: both stay, as they do not link. A null id stays as well.
    rows += [(9, "zz " + texts[1].replace("x1", "y"), "en", "web", 1, *more), (9, "aa " + texts[1].replace("x1", "v"), "en", "web", 1, *more), (None, texts[0], "en", "web", 5, *more)]
    df = spark.createDataFrame(rows, SCHEMA + ", " + extra)
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, "")
        assert df.columns == spark.createDataFrame([], SCHEMA + ", " + extra).columns, name
        got = df.collect()
        assert all(tuple(r)[5:] == more for r in got), name
        ids = sorted(str(r.doc_id) for r in got)
        assert ids == ["0", "1", "2", "3", "9", "9", "None"], name
    assert sorted(r.text[:2] for r in got if r.doc_id == 9) == ["aa", "zz"]
    assert {r.doc_id: (r.n_chars, len(r.text)) for r in got}[3][0] == {r.doc_id: len(r.text) for r in got}[3] < len(texts[3])
    packed = corpus_pipeline.STAGES[3][1](spark, df, "")
    assert packed.where("doc_id = 9").count() == 2


def test_rows_of_one_id_that_do_not_link_stay(spark):
    text = [" ".join(f"w{j}x{k}" for j in range(60)) for k in range(4)]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (2, text[1]), (2, text[2]), (3, text[2]), (3, None), (4, text[3]), (4, text[3]), (None, text[3])]
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = sorted((str(r.doc_id), r.text or "") for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == sorted([("1", text[0]), ("2", text[1]), ("2", text[2]), ("3", ""), ("4", text[3]), ("None", text[3])])
    # Without a column n_chars as well.
    assert corpus_pipeline.repeated_passages(spark, docs, "").columns == docs.columns
