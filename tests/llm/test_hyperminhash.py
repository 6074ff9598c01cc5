import random

import numpy as np
import pytest

from lumispark.llm import hyperminhash as module
from lumispark.llm.hyperminhash import EMPTY, bitmap, can_reach, compressed, could_be, drop_hyperminhash_duplicates, estimates, hyperminhash_duplicates, registers

SCHEMA = "doc_id long, text string, node string, many int, key string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)
    return sorted(map(tuple, hyperminhash_duplicates(docs, **more).collect()), key=str), docs


def corpus():
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = []
    for _ in range(50):
        base = words(rng.randrange(3, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):  # similarities from about 0.5 to 1
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 12))):
                copy[rng.randrange(len(copy))] = f"c{rng.randrange(9)}"
            texts.append(" ".join(copy))
    hot = words(120)
    texts += [" ".join([*hot[:k], f"n{k}", *hot[k + 1 :]]) for k in range(3, 117)]  # a large group
    line = words(12)
    texts += [" ".join([*words(40), *line, *words(40)]) for _ in range(60)]  # a common line links nothing
    for n in range(1, 14):  # small sets around the bound
        base = [f"s{n}x{k}" for k in range(n)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join([*base, "other"]), " ".join([*base, "more", "yet"])]
    texts += ["", None, " \n ", "A b", "a  B", "x", "X", "y"]
    rng.shuffle(texts)
    return [(1000 - i, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus()
    got, docs = run(spark, rows)
    assert got == brute(rows)
    kept = drop_hyperminhash_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in got if r[3])


def test_crowded_keys_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 5)
    monkeypatch.setattr(module, "CHAIN", 7)
    rng = random.Random(2)
    frame = [f"f{k}" for k in range(60)]
    texts = []
    for g in range(25):
        own = [f"g{g}x{k}" for k in range(rng.randrange(10, 60))]
        texts += [" ".join([*frame, *own, f"e{g}{m}"]) for m in range(rng.randrange(1, 5))]
    rows = [(k, t) for k, t in enumerate(texts)]
    assert run(spark, rows, band=1)[0] == brute(rows)  # one register is a key, so many unlike texts share some


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b c"), (7, "a b c"), (7, "a b c"), (7, "d"), (3, ""), (None, "z"), (None, "z")], [(1, "lang " * 300_000 + "ende"), (2, "lang " * 300_000 + "ende"), (3, "lang " * 300_000)]])
def test_nulls_repeated_rows_long_texts_and_empty_tables(spark, rows):
    got, _ = run(spark, rows)
    want = [(i, n, c, i == c) for i, n, c, _ in brute(rows)]
    assert got == sorted(want, key=str)


def test_registers_order_and_estimates():
    values = np.sort(np.random.default_rng(3).integers(1, 1 << 32, 5000).astype(np.uint64))
    held = compressed(np.concatenate([np.array([0, 1, 2, 3], np.uint64), values])).astype(int)
    zeros, rest = held >> 10, held & 1023
    assert all((-zeros[k], rest[k]) <= (-zeros[k + 1], rest[k + 1]) for k in range(len(held) - 1)) and held.max() < EMPTY
    rng = np.random.default_rng(4)
    for common, own in ((900, 100), (300, 700), (0, 1000), (90, 10)):
        pool = [np.unique(rng.integers(0, 1 << 64, common + 2 * own, np.uint64)) for _ in range(200)]
        sides = [(np.sort(np.concatenate([p[:common], p[common : common + own]])), np.sort(np.concatenate([p[:common], p[common + own :]]))) for p in map(rng.permutation, pool)]
        a, b = (np.array([registers(s[k]) for s in sides]) for k in (0, 1))
        n = np.full(200, common + own)
        value, some = estimates(a, b, n, n)
        assert abs(value.mean() - common / (common + 2 * own)) < 0.02
        assert could_be(value, some, 80).all() or common / (common + 2 * own) < 0.8


def test_bitmaps_never_leave_out_a_similar_pair():
    rng = np.random.default_rng(5)
    for n in (3, 40, 600, 9000):
        for _ in range(30):
            a, extra = (np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for _ in range(2))
            b = np.unique(np.concatenate([a[rng.integers(0, max(1, n // 5)) :], extra[: rng.integers(0, max(1, n // 5))]]))
            both = len(np.intersect1d(a, b))
            words = [np.frombuffer(bitmap(x), "<u8") for x in (a, b)]
            seen = bool(can_reach(*words, len(a), len(b), 80))
            assert seen or 100 * both < 80 * (len(a) + len(b) - both)
            assert not can_reach(words[0], np.frombuffer(bitmap(extra), "<u8"), len(a), len(extra), 80) or n == 9000


def test_a_crowded_key_of_one_component_takes_about_a_row_a_node(spark):
    many, lone = 20_000, 5
    by_key = spark.range(many).selectExpr("id AS node", "7L AS key")
    roots = spark.range(lone, many).selectExpr("id AS node", f"{lone}L AS root")
    met = module.crowded(by_key, roots)
    assert met.filter("NOT asks").count() == many  # blocks of equal size would take a row a node and block
    assert met.filter("asks").count() == lone * -(-many // (module.BLOCK * module.WIDER))


def test_of_two_blocks_each_pair_meets_once(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 4)
    monkeypatch.setattr(module, "WIDER", 2)
    root = lambda n: n if n < 30 else 30
    by_key = spark.range(60).selectExpr("id AS node", "7L AS key")
    roots = spark.createDataFrame([(n, root(n)) for n in range(60)], "node long, root long")
    rows = [r.asDict() for r in module.crowded(by_key, roots).collect()]
    met = [tuple(sorted((a["node"], b["node"]))) for a in rows if a["asks"] for b in rows if not b["asks"] and (a["one"], a["two"]) == (b["one"], b["two"]) and a["root"] != b["root"] and (not b["minor"] or b["node"] > a["node"])]
    assert sorted(met) == [(a, b) for a in range(60) for b in range(a + 1, 60) if root(a) != root(b)]
