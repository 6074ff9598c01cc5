import random

import pyspark.sql.functions as F
import pytest

from lumispark.llm import near_copies as module
from lumispark.llm.near_copies import drop_near_copies, near_copies
from lumispark.llm.shared import written

SCHEMA = "doc_id long, text string, node string, keys int"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def slow_components(rows):
    least = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}
    linked = [(i, j) for i in sets for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            if least[j] < least[i]:
                least[i], changed = least[j], True
    return least


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        base = words(rng.randrange(60, 500))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):  # a few changed words: similarities from about 0.5 to 1
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    hot = words(200)
    texts += [" ".join([*hot[:k], f"n{k}", *hot[k + 1 :]]) for k in range(5, 195, 2)]  # a large group
    texts += ["", None, " \n ", "A b c", "a  B C", "x"]
    rng.shuffle(texts)
    return [(1000 - i, t) for i, t in enumerate(texts)]


def test_near_copies_match_brute_force(spark, rows):
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA)
    want = slow_components(rows)
    got = {r.doc_id: r.component_id for r in near_copies(frame).collect()}
    assert got == want
    kept = drop_near_copies(frame)
    assert kept.columns == ["doc_id", "text", "node", "keys"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_the_pipeline_drops_planted_near_copies(spark, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    stage = dict(pipeline.STAGES)["near_dedup"]
    kept = {r.doc_id for r in stage(spark, spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA), "").collect()}
    assert kept == set(slow_components(rows).values())


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_copies(empty).count() == 0 and drop_near_copies(empty).count() == 0
    rows = spark.createDataFrame([(None, "same words here now", None, None), (5, "same words here now", None, None), (5, "same words here now", None, None)], SCHEMA)
    assert [r.component_id for r in near_copies(rows).collect()] == [5, 5, 5]
    assert near_copies(rows.filter(F.col("doc_id").isNull())).first().component_id is None


def test_a_crowd_that_shares_its_keys_loses_no_link(spark, monkeypatch):
    """Texts over one template, 0.65 alike, and pairs of 0.85 among them; no chain helps the second round."""
    monkeypatch.setattr(module, "NEIGHBOURS", 0)
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template, texts = words(320), []
    for _ in range(120):
        texts.append([*template, *words(85)])
    for text in texts[:40]:
        copy = list(text)
        for at in rng.sample(range(len(copy)), 6):
            copy[at] = "changed"
        texts.append(copy)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = slow_components(rows)
    assert len(set(want.values())) == 120
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    nodes, _ = written(module.signatures(frame), "signatures")
    pairs = module.across(nodes, spark.createDataFrame([], "node long, root long"))
    assert 40 <= pairs.count() < 400  # of some thousand pairs that share a key, those the bitmaps allow
    by_node = {r.node: r.doc_id for r in nodes.collect()}
    found = {frozenset((by_node[r.a], by_node[r.b])) for r in module.links(frame, pairs).collect()}
    assert found == {frozenset(p) for p in want.items() if p[0] != p[1]}


def test_texts_are_read_for_their_sets_once(spark, rows, monkeypatch):
    asked, whole = [], module.shingle_sets
    monkeypatch.setattr(module, "shingle_sets", lambda docs, nodes, *more: asked.append(nodes.count()) or whole(docs, nodes, *more))
    found = near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() and len(asked) == 1 and asked[0]
