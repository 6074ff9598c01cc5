import random
import re
from collections import Counter, defaultdict

import pytest

from lumispark.llm.collocations import Trie, collocations, folded, frequent, merged, scored, shards

SCHEMA = "doc_id long, lang string, text string, phrase string, n long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts_of(texts, depth):
    f = Counter()
    for t in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(len(w)):
                f[()] += 1
                for m in range(1, depth + 1):
                    if k + m <= len(w):
                        f[tuple(w[k : k + m])] += 1
    return f


def brute(rows, depth=3, least=10, share=50, top=2000):
    by = defaultdict(list)
    for lang, text in rows:
        by["und" if lang is None else lang].append(text)
    out = []
    for lang, texts in by.items():
        f = counts_of(texts, depth)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for q, b in found.items())
            if not inside:
                score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, f[()], -score))
    return sorted(out)


def corpus(seed, many):
    rng = random.Random(seed)
    words = ["a", "a\x01", "B", "b", "é", "Zed", "the", "of", "x\x00y", "日本", "The", "c-d", "'"]
    ends = [" ", " ", "  ", "\t", ". ", ",", "\n", "\r", "; ", " ? ", "\x0b"]
    text = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "en", "fr", None, "und"]), rng.choice([None, "", text(), text(), text()])) for _ in range(many)]


@pytest.mark.parametrize("size,range_size,depth", [(1 << 20, 1 << 20, 3), (200, 300, 3), (90, 1 << 20, 2), (1 << 20, 500, 2)])
def test_against_brute_force(spark, size, range_size, depth):
    rows = corpus(size, 150)
    docs = spark.createDataFrame([(k, lang, t, "z", 1) for k, (lang, t) in enumerate(rows)], SCHEMA)
    got = collocations(docs, depth=depth, size=size, range_size=range_size)
    assert sorted(map(tuple, got.collect())) == brute(rows, depth)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_the_best_few_and_ties(spark):
    rows = [("en", f"p{k} q{k} . " * 10) for k in range(30)] + [("en", "p0 q0 r0 " * 5)] * 3
    docs = spark.createDataFrame([(0, *r, None, None) for r in rows], SCHEMA)
    got = collocations(docs, top=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, top=7)


def test_nulls_long_texts_and_an_empty_table(spark):
    rows = [(None, None), (None, ""), ("en", " \t. "), ("fr", "mot " * 5_000 + "fin " + "mè n " * 20_000), ("fr", "w" * 3_000)]
    docs = spark.createDataFrame([(None, *r, None, None) for r in rows], SCHEMA)
    assert sorted(map(tuple, collocations(docs, size=1_000).collect())) == brute(rows)
    assert collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 7, 20, 64, 10_000])
def test_shards_count_what_the_whole_text_has(size):
    texts = [t or "" for _, t in corpus(size, 40)]
    text = folded("\n".join(texts).encode())
    blocks = [data for part, more in shards(text, 3, size) for _, data in Trie.of(part, more, 3).parts([])]
    phrases, _, counts, _ = frequent(merged(blocks, 3), 1)
    assert {p.decode(): c for p, c in zip(phrases, counts.tolist())} == {" ".join(p): c for p, c in counts_of(texts, 3).items()}


def test_ranges_cut_a_trie_without_loss():
    text = folded("\n".join(t or "" for _, t in corpus(3, 60)).encode())
    trie = Trie.of(text, 0, 3)
    bounds = sorted([(b"a",), (b"a", b"b"), (b"b", b"a", b"zz"), (b"nothing",), (b"the", b"of")])
    again = merged([data for _, data in trie.parts(bounds)], 3)
    assert again.words.to_pylist() == trie.words.to_pylist() and (again.keys == trie.keys).all() and (again.counts == trie.counts).all()
    for k, data in trie.parts(bounds):
        for p in frequent(merged([data], 3), 1)[0]:
            path = tuple(p.split(b" ")) if p else ()
            assert (k == 0 or path >= bounds[k - 1]) and (k == len(bounds) or path < bounds[k])


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_019
    rows = [(big, big + 2, big + 7), (1 << 40, 1 << 41, (1 << 40) + 1)]
    got = [r.score for r in scored(spark.createDataFrame(rows, "a long, l long, r long")).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in rows]
