import math
import random
import re
from collections import Counter, defaultdict

import pyspark.sql.functions as F
import pytest

from lumispark.llm.kneser_ney import PACKET, UNIFORM, KneserNey, _discounts, fold_of, gram_blocks, grams_of, of_ids, perplexities, quality, trusted_ids, units

SCHEMA = "doc_id long, text string, lang string, keep string, threshold int"


def slow_bits(train, order, discounts, text):
    """The textbook recursion over dictionaries."""
    tables = {order: Counter()}
    for t in train:
        t = b"\0" * (order - 1) + t
        tables[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    follow = {n: defaultdict(dict) for n in tables}
    for n, table in tables.items():
        for g, c in table.items():
            follow[n][g[:-1]][g[-1]] = c

    def p(n, gram):
        if n == 0:
            return UNIFORM
        own = follow[n].get(gram[:-1])
        below = p(n - 1, gram[1:])
        if own is None:
            return below
        d = lambda c: discounts[n][min(c, 3) - 1]
        total = sum(own.values())
        c = own.get(gram[-1], 0)
        return ((c - d(c)) if c else 0) / total + sum(d(x) for x in own.values()) / total * below

    text = b"\0" * (order - 1) + text
    return sum(-math.log2(p(order, text[i : i + order])) for i in range(len(text) - order + 1))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["".join(rng.choice("aab cdé") for _ in range(rng.randrange(1, 60))) for _ in range(60)]


def slow_units(text):
    out, last = b"", None
    for piece in re.findall(rb"\s+|\S+", text):
        if piece.isspace():
            out += piece
        elif piece == last and out[-1:].isspace():
            out = out.rstrip() + b"\x01"
        else:
            out, last = out + piece, piece
    return out


def test_units():
    for text in (b"", b"a", b"a a", b"a  a\na b", b" the the theme the", b"x y x y", b"aa a aa aa aa.", b"en. en. en.\nen. x x", b"a a b b a a"):
        assert units(text) == slow_units(text), text
    assert units(b"du du du oui") == b"du\x01\x01 oui"


def test_blocks_have_the_grams_of_whole_texts():
    texts = [b"abcdefghij" * 30, b"", b"xy", b"q" * 7, b"hello there" * 4, b"z"]
    want, begins = grams_of(texts, 4)
    for most in (5, 16, 100, 10_000):
        got = {k: [] for k in range(len(texts))}
        for first, grams, edges in gram_blocks(texts, 4, most):
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                got[first + k] += grams[a:b].tolist()
        assert got == {k: want[begins[k] : begins[k + 1]].tolist() for k in got}


def test_probabilities_match_the_recursion_in_chunks_of_any_size(spark, texts):
    order, frame = 3, spark.createDataFrame([(t,) for t in texts[:40]], "text string")
    model = KneserNey.train(frame, order)
    fold = {r.text: r.f for r in frame.select("text", fold_of(F.col("text")).alias("f")).collect()}
    trains = [[units(t.encode()) for t in texts[:40] if fold[t] != f] for f in (-1, 0, 1)]
    assert all(len(t) > 5 for t in trains)
    discounts = []
    for k, train in enumerate(trains):
        raw = {order: Counter()}
        for t in train:
            t = b"\0" * (order - 1) + t
            raw[order].update(t[i : i + order] for i in range(len(t) - order + 1))
        for n in (2, 1):
            raw[n] = Counter(g[1:] for g in raw[n + 1])
        assert {n: model.seen.filter(f"gram_order = {n} AND p{k} IS NOT NULL").count() for n in raw} == {n: len(raw[n]) for n in raw}
        discounts.append({n: _discounts(spark.createDataFrame([(c,) for c in raw[n].values()], "c0 long"))[0] for n in raw})
    docs = [(i, t, "x", None, None) for i, t in enumerate(texts[40:] + ["", None, "zzz qqq", "b b b c", texts[40]])]
    frame = spark.createDataFrame(docs, SCHEMA)
    whole = {r.doc_id: r for r in perplexities(frame, model).collect()}
    parts = {r.doc_id: r for r in perplexities(frame.repartition(3), model, chunk=40).collect()}
    for i, t, *_ in docs:
        data = (t or "").encode()
        for got in (whole[i], parts[i]):
            assert got.n_bytes == len(data)
            if not data:
                assert got.perplexity is None and got.without == [None, None]
                continue
            want = [2 ** (slow_bits(train, order, d, units(data)) / len(units(data))) for train, d in zip(trains, discounts)]
            assert [got.perplexity, *got.without] == pytest.approx(want, rel=1e-6)


def test_a_text_longer_than_a_packet_is_read_whole(spark, texts):
    model = KneserNey.train(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    long = " ".join(texts * 700) + "zzzz" * 9
    own = units(long.encode())
    assert len(own) > PACKET
    times = Counter(grams_of([own], 3)[0].tolist())
    bits = {r.gram: r.b0 for r in model.bits(spark.createDataFrame([(g,) for g in times], "gram long")).collect()}
    got = perplexities(spark.createDataFrame([(1, long, "", "", 1), (2, "aab", "", "", 1)], SCHEMA), model)
    assert {r.doc_id: r.perplexity for r in got.collect()}[1] == pytest.approx(2 ** (sum(bits[g] * n for g, n in times.items()) / len(own)), rel=1e-6)


def test_probabilities_of_a_context_sum_to_one(spark, texts):
    model = KneserNey.train(spark.createDataFrame([(t,) for t in texts], "text string"), 4)
    contexts = (b"aab", b"a b", b"zzz", b"\0\0a", b"b c")
    grams = [(int.from_bytes(c + bytes([b]), "big"),) for c in contexts for b in range(256)]
    sums = model.bits(spark.createDataFrame(grams, "gram long")).groupBy(F.shiftright("gram", 8)).agg(F.sum(F.pow(F.lit(2.0), -F.col("b0"))).alias("p")).collect()
    assert len(sums) == len(contexts) and all(r.p == pytest.approx(1.0) for r in sums)


def test_ids_are_found_by_either_join(spark):
    docs = spark.createDataFrame([(i % 7 or None, str(i)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)] + [(None, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    ids = trusted_ids(labels)
    assert sorted(r.id for r in ids.collect()) == [2, 4, 6, 8]
    near, far = (sorted(r.text for r in of_ids(docs, ids, "doc_id", n).collect()) for n in (100, 0))
    assert near == far == sorted(str(i) for i in range(20) if i % 7 in (2, 4, 6))


def test_junk_is_told_from_prose(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice(["the", "house", "river", "runs", "stone", "under"]) for _ in range(60))
    junk = lambda: "".join(rng.choice("QX#$%&!~") for _ in range(200))
    docs = [(i, prose() if i % 5 else junk(), "en" if i % 2 else None, "k", 1) for i in range(200)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 100)]
    got = quality(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), order=3).collect()
    assert got[0].asDict().keys() == {"doc_id", "lang", "n_bytes", "perplexity", "threshold", "keep"}
    assert not any(r.keep for r in got if r.doc_id % 5 == 0)
    assert sum(r.keep for r in got if r.doc_id % 5) > 130


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality(spark.createDataFrame([], SCHEMA), labels).count() == 0
    got = quality(spark.createDataFrame([(1, "abc", "en", None, None), (None, None, None, None, None), (1, "abc", "en", None, None)], SCHEMA), labels).collect()
    assert sorted((r.n_bytes, r.keep, r.threshold) for r in got) == [(0, False, None), (3, True, None), (3, True, None)]
