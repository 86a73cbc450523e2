"""Token operators against the libraries themselves and against plain dynamic programming."""

import hashlib
import io
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from strandline.llm import _pretokens, byte_bpe, packing, token_archive, token_counts  # noqa: E402

ODD = ["", None, "a", " ", "  \n", "don't 'twas we'll I'VE ''s\n's", "x " * 5000, "aaaa" * 600, "Été ça va? 漢字 ²½", "<|endoftext|> hi", "a<|endoftext|>  b<|endoftext|>", "tab\t\tend  ", "🙂🙂 é", "\x1c\x85 　a"]


def texts(n=300, seed=0):
    rng = random.Random(seed)
    signs = [*"aZé ' \n\t1²_-.,stmdrevl", "　", "漢", "'s", "'re", "  ", " 'll", "🙂", "\x1c", "the ", " of"]
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(texts())] + [(3, "again", "x"), (None, "no id", "x"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pretokens_follow_the_pattern():
    import regex

    every = [t or "" for t in texts(3000, 5)]
    batch, at = _pretokens.Batch(pa.array(every)), 0
    for text, n in zip(every, batch.per_doc, strict=True):
        assert [batch.words[c] for c in batch.codes[at : at + n]] == regex.findall(P.PATTERN, text)
        at += n


def test_store_forgets_but_stays_right(library):
    store = _pretokens.LibraryStore(P.path("byte_bpe_50k.json"))
    store.most_words = 5
    for some in (texts(20, 1), texts(20, 2)):
        flat, n = store.encode_texts(pa.array(some))
        assert flat.tolist() == [i for t in some for i in library(t)]
        assert n.tolist() == [len(library(t)) for t in some]


def test_archives_round_trip(spark, docs, library):
    folder = token_archive.scratch(spark, "t")
    manifest = token_archive.write_archives(docs, P.path("byte_bpe_50k.json"), 2, folder)
    got = sorted((r.start, r.doc_id, r.n_tokens, crc(np.frombuffer(r.ids, "<u4"))) for r in token_archive.read_archives(manifest).collect())
    start, seen = 0, []
    for s, doc, n, check in got:
        assert s == start
        start += n
        seen.append((doc, n, check))
    want = [(r.doc_id, len(library(r.text)) + 1, crc([*library(r.text), 2])) for r in docs.collect()]
    assert [x[0] is not None for x in seen] == sorted(x[0] is not None for x in seen)
    assert [x[0] for x in seen if x[0] is not None] == sorted(x[0] for x in seen if x[0] is not None)
    assert sorted(map(repr, seen)) == sorted(map(repr, want))


def test_archive_reads_single_documents_and_notices_damage():
    out = io.BytesIO()
    w = token_archive.ArchiveWriter(out, 2)
    for k in range(20):
        w.add(k, np.arange(k + 1))
    w.close()
    data = out.getvalue()
    r = token_archive.ArchiveReader(io.BytesIO(data), len(data))
    assert r.ids(7).tolist() == list(range(8)) and len(r) == 20
    assert [len(x) for _, some in r.slices(40) for x in some] == list(range(1, 21))
    import zstandard

    assert zstandard.ZstdDecompressor().decompress(data[: int(r.entries[0, 0])], max_output_size=2) == b"\0\0"
    bad = bytearray(data)
    bad[int(r.begins[7]) + int(r.entries[7, 0]) - 1] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        token_archive.ArchiveReader(io.BytesIO(bytes(bad)), len(bad)).ids(7)


def test_archive_width_follows_from_the_ids(spark, docs):
    path = P.path("byte_bpe_50k.json")
    small = docs.limit(3)
    write = lambda **kw: token_archive.write_archives(small, path, folder=token_archive.scratch(spark, "t"), **kw)
    wide = write(end_id=70_000)
    assert {r.width for r in wide.collect()} == {4} and {r.width for r in write(end_id=2).collect()} == {2}
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 70_000 for r in token_archive.read_archives(wide).collect())
    with pytest.raises(ValueError, match="do not fit"):
        write(end_id=70_000, width=2)
    with pytest.raises(ValueError, match="does not fit"):
        token_archive.ArchiveWriter(io.BytesIO(), 2).add(1, np.array([65_536]))


def test_archive_of_no_rows(spark, docs):
    manifest = token_archive.write_archives(docs.limit(0), P.path("byte_bpe_50k.json"), 2, token_archive.scratch(spark, "t"))
    assert token_archive.read_archives(manifest).count() == 0


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing_places_every_id_once(spark, docs, library, capacity):
    rows = packing.pack_documents(docs, capacity).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        if r.doc_id in (3, None):
            continue
        want = [*library(r.text), 0]
        own = sorted(by_doc[r.doc_id], key=lambda x: x.start)
        assert [i for x in own for i in np.frombuffer(x.ids, "<u4").tolist()] == want
        assert [x.start for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))]
        assert {x.doc_tokens for x in own} == {len(want)}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(r.ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.sequences(packing.pack_documents(docs, capacity), capacity).where(f"octet_length(ids) <> {4 * capacity}").count() == 0
    assert packing.pack_documents(docs.limit(0), capacity).count() == 0


def test_minimum_bin_slack_fills_as_far_as_possible():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randrange(5, 40)
        counts = {rng.randrange(1, capacity): rng.randrange(1, 6) for _ in range(6)}
        left = dict(counts)
        for pattern, windows in packing.minimum_bin_slack(counts, capacity):
            longest = max(left)
            assert pattern[longest] >= 1
            items = [x for x, n in left.items() for _ in range(n)]
            items.remove(longest)
            sums = {longest}
            for x in items:
                sums |= {s + x for s in sums if s + x <= capacity}
            assert sum(x * n for x, n in pattern.items()) == max(sums)
            for x, n in pattern.items():
                left[x] -= n * windows
                assert left[x] >= 0
                if not left[x]:
                    del left[x]
        assert not left


def test_segment_tree_encodes_as_the_library(spark, docs):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(r.doc_id), len(ids := own.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), (r.text or "").encode()) for r in docs.collect())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(docs, path), path).collect())
    assert got == want
    trip = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, path).collect())
    assert trip == sorted((a, n, x, hashlib.sha256(t).hexdigest()) for a, n, x, t in want)
    assert byte_bpe.encode(docs.limit(0), path).count() == 0
    words = [bytes(random.Random(k).choices(b"ab thein", k=k + 1)) for k in range(120)]
    loaded = byte_bpe.load_ranks(path)
    for w in words:
        assert byte_bpe.merge_word(w, loaded).tolist() == byte_bpe.merge_words([w], loaded)[0].tolist()


def test_unigram_counts_are_those_of_plain_dynamic_programming(spark, docs):
    import regex

    path = P.path("byte_bpe_50k.tiktoken")
    scores = token_counts.piece_scores(path)
    longest = max(map(len, scores))

    def plain(word):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - longest), e):
                own = scores.get(word[s:e])
                if own is not None:
                    total, n = best[s][0] + own, best[s][1] + 1
                    if total > best[e][0] or total == best[e][0] and n < best[e][1]:
                        best[e] = (total, n)
        return best[-1][1]

    rows = docs.collect()
    small = spark.createDataFrame(rows, docs.schema)
    want = sorted((str(r.doc_id), len(w := regex.findall(P.PATTERN, r.text or "")), sum(plain(x.encode()) for x in w)) for r in rows)
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(small, path).collect()) == want
    trie = token_counts.Trie(scores, most=10)
    words = [" there", " then", "the", " thereby"]
    assert [trie.counts(words).tolist(), trie.counts(words).tolist()] == [[plain(w.encode()) for w in words]] * 2
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    # One endless pre-token keeps the trie small.
    for word in ("x" * 5000, "ab" * 1500 + "z", "".join(random.Random(1).choices("abcdefgh", k=4000))):
        trie = token_counts.Trie(scores)
        assert trie.count(word.encode()) == plain(word.encode()) and len(trie.score) <= token_counts.SHARED + 1
