import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumispark.llm import packing
from lumispark.llm.packing import _fill, best_fit, local_search, pack, slots

JSON = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length int, piece string"


def items(bins):
    return sum((Counter({n: k * many for n, k in p}) for p, many in bins.items()), Counter())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_are_whole(counts):
    first = best_fit(counts, 64)
    better = local_search(first, 64)
    for bins in (first, better):
        assert items(bins) == Counter(counts) and all(_fill(p) <= 64 for p in bins)
    assert sum(better.values()) <= sum(first.values())


def test_search_empties_bins_that_best_fit_leaves():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 1}  # 38 in bins of 10
    loose = Counter({((6, 1), (3, 1)): 2, ((5, 1), (4, 1)): 2, ((2, 1),): 1})
    assert items(loose) == Counter(counts)
    assert sum(local_search(loose, 10).values()) == 4


def test_search_makes_one_for_one_and_two_for_one_exchanges():
    assert packing._exchanges(((5, 1), (2, 1)), ((3, 1), (1, 1)), 2) == (2, (5,), (3,)) or packing._exchanges(((5, 1), (2, 1)), ((3, 1), (1, 1)), 2)[0] == 2
    assert packing._exchanges(((4, 1), (3, 1)), ((6, 1),), 1) == (1, (4, 3), (6,))


def test_search_ends_only_when_no_exchange_is_left():
    rng = np.random.default_rng(1)
    lengths = np.clip(np.rint(rng.normal(800, 150, 20_000)), 1, 2048).astype(int).tolist()
    first = best_fit(Counter(lengths), 2048)
    assert sum(_fill(p) < 2048 for p in first) > 447
    bins = local_search(first, 2048)
    assert items(bins) == Counter(lengths) and sum(bins.values()) < sum(first.values())
    under = sorted((p for p in bins if _fill(p) < 2048), key=_fill)
    for giver in under[::12]:
        for taker in under:
            if giver != taker or bins[giver] > 1:
                assert packing._exchanges(giver, taker, 2048 - _fill(taker))[0] <= max(0, _fill(giver) - _fill(taker))


def test_slots_cover_each_rank_once():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 65) for _ in range(500))
    bins = local_search(best_fit(counts, 64), 64)
    table = slots(bins)
    assert len(table["length"]) == sum(len(p) for p in bins)


def test_pack_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_BUCKET", 7)  # hot lengths are spread over buckets
    rng = random.Random(4)
    texts = [None, "", "short", "same text"] + ["same text"] * 30 + [" ".join(rng.choice(["the", "quick", "brown", "zebra"]) for _ in range(rng.choice([3, 50, 700, 5000]))) for _ in range(40)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, "same text", 1, "x")]
    got = pack(spark.createDataFrame(rows, SCHEMA), JSON).collect()
    library = Tokenizer.from_file(JSON)
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 2048) + 1


def test_edges(spark):
    assert pack(spark.createDataFrame([], SCHEMA), JSON).count() == 0
    got = pack(spark.createDataFrame([(None, None, None, None)], SCHEMA), JSON).collect()
    assert [(r.doc_id, r.piece, r.start, r.length, r.offset) for r in got] == [(None, 0, 0, 1, 0)]
