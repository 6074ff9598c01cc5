import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lumispark.llm import suffix_repeats
from lumispark.llm.suffix_repeats import SuffixIndex, contexts, dedup_report, drop_repeats, promising, repeat_groups

SCHEMA = "doc_id long, text string, key string, spans int"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(np.frombuffer(d, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.choice([20, 60, 150]))) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randrange(len(parts)), p[a : a + rng.randrange(30, 500)])
        texts.append(" ".join(parts))
    edited = list(texts[3] * 3)
    edited[len(edited) // 2] = "#"
    return texts + ["", None, "short", "ab" * 300, "x" * 1000, texts[0], texts[0], "".join(edited), passages[0][:50], "ab" * 300 + "c"]


@pytest.mark.parametrize("length", [20, 50])
def test_report_matches_brute_force(spark, length):
    texts = corpus(length)
    rows = [(i, t, "k", None) for i, t in enumerate(texts)]
    want = brute(texts, length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_report(spark.createDataFrame(rows, SCHEMA), length).collect()}
    assert got == dict(enumerate(want))


def test_split_buckets_give_the_same(spark):
    texts = corpus(9)
    rows = [(i, t, "k", None) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_report(spark.createDataFrame(rows, SCHEMA), 30, bucket=1).collect()}
    assert got == dict(enumerate(brute(texts, 30)))


def test_blocks_of_long_texts_overlap(spark, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1 << 21))
    texts = [long, long[1_500_000:1_500_300] + "!", "?" + long[(1 << 20) - 150 : (1 << 20) + 150]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in dedup_report(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == {0: (1 << 21, 600, 2), 1: (301, 300, 1), 2: (301, 300, 1)}


def test_contexts_cover_every_string_once():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(300))) for _ in range(30)]
    found = contexts(texts, 40)
    seen = Counter((t, s + k) for t, s, w in zip(found["text"], found["start"], found["width"]) for k in range(w))
    assert seen == Counter((t, s) for t, d in enumerate(texts) for s in range(len(d) - 39))


def test_maximal_repeats_are_those_of_the_definition():
    rng = random.Random(6)
    for _ in range(30):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 40))) for _ in range(4)]
        index = SuffixIndex(pieces, 4)
        got = set()
        for depth, first, last in index.maximal_repeats():
            places = [(int(np.searchsorted(index.ends, s, side="right")), int(s)) for s in index.starts[first : last + 1]]
            got.add(frozenset((p, s - int(index.begins[p]), depth) for p, s in places))
        want = set()
        strings = {p[i:j] for p in pieces for i in range(len(p)) for j in range(i + 4, len(p) + 1)}
        for s in strings:
            at = [(k, i) for k, p in enumerate(pieces) for i in range(len(p)) if p.startswith(s, i)]
            right = {pieces[k][i + len(s) : i + len(s) + 1] or (k, i) for k, i in at}
            left = {pieces[k][i - 1 : i] if i else (k, i) for k, i in at}
            if len(at) > 1 and len(right) > 1 and len(left) > 1:
                want.add(frozenset((k, i, len(s)) for k, i in at))
        assert got == want


def test_pieces_passed_over_hold_no_repeat():
    rng = random.Random(8)
    for length in (5, 12):
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(3, 40))) for _ in range(12)]
        times = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        want = {k for k, p in enumerate(pieces) for i in range(len(p) - length + 1) if times[p[i : i + length]] > 1}
        assert want <= set(promising(pieces, length).tolist())
    assert promising([b"abc"], 5).size == 0


def test_texts_are_cut(spark):
    shared = "é" * 60 + "shared passage of many words that comes twice"
    rows = [(1, "one " + shared + " end", "k", 1), (2, "two " + shared + " fin", "k", 2), (3, None, None, None), (None, "no id", None, None)]
    got = drop_repeats(spark.createDataFrame(rows, SCHEMA), 40)
    assert got.columns == ["doc_id", "text", "key", "spans"]
    assert {r.doc_id: (r.text, r.key, r.spans) for r in got.collect()} == {1: ("oneend", "k", 1), 2: ("twofin", "k", 2), 3: (None, None, None), None: ("no id", None, None)}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_report(empty).count() == 0 and drop_repeats(empty).count() == 0
    rows = [(None, "n" * 50 + str(k) * 250, None, None) for k in range(2)] + [(7, "word " * 60, None, None)] * 2 + [(7, "other", None, None)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in dedup_report(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 300, 250, 1), (0, 300, 250, 1), (7, 5, 0, 0), (7, 300, 300, 1), (7, 300, 300, 1)]


@pytest.mark.parametrize("bucket", [4000, 1])
def test_repeat_groups_are_equal_strings_and_cover_what_is_removed(spark, bucket):
    texts = corpus(4)
    length = 40
    data = [(t or "").encode() for t in texts]
    rows = [(i, t, "k", None) for i, t in enumerate(texts)]
    groups = {}
    for r in repeat_groups(spark.createDataFrame(rows, SCHEMA), length, bucket=bucket).collect():
        groups.setdefault(r.repeat_id, []).append((r.doc_id, r.start, r.length))
    covered = [np.zeros(len(d), bool) for d in data]
    for places in groups.values():
        assert len(places) == len(set(places)) > 1
        assert len({data[d][a : a + n] for d, a, n in places}) == 1 and min(n for *_, n in places) >= length
        for d, a, n in places:
            covered[d][a : a + n] = True
    assert [int(c.sum()) for c in covered] == [n for _, n, *_ in brute(texts, length)]
    # every pair of places with one string stands together in some group
    where = {}
    for d, t in enumerate(data):
        for i in range(len(t) - length + 1):
            where.setdefault(t[i : i + length], set()).add((d, i))
    together = {frozenset((d, a + k) for d, a, n in places) for places in groups.values() for k in range(places[0][2] - length + 1)}
    assert all(any(w <= t for t in together) for w in where.values() if len(w) > 1)


def test_a_hot_passage_at_the_real_length(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join([*(word() for _ in range(30)), passage[rng.randrange(0, 40) :], *(word() for _ in range(30))]) for _ in range(150)] + [passage] * 20
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    for bucket in (4000, 20):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_report(spark.createDataFrame(rows, SCHEMA), bucket=bucket).collect()}
        assert got == dict(enumerate(brute(texts, 200)))
