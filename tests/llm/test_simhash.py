import random
import re

import pyspark.sql.functions as F
import xxhash

from lumispark.llm.components import components
from lumispark.llm.simhash import drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component_id int"


def slow_fingerprint(text: str) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(fps: dict) -> dict:
    least = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_fingerprint_is_the_contract():
    for text in ["", " \t\n", "a", "A b", "A b C", "É B c\x85d e", "x " * 500, "\x1cq r s\x1f t", "one two\x0bthree\x0cfour"]:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_spark_hash_agrees(spark):
    text = "über den Fluß"
    assert spark.sql(f"SELECT xxhash64('{text}') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_links_connect_like_brute_force(spark):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    fps = set()
    for s in seeds:
        for _ in range(14):
            fps.add(s)
            s ^= 1 << rng.randrange(64)
            if rng.random() < 0.4:
                s ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.root for r in components(links, "fp", "other").collect()}
    want = slow_components(dict(zip(signed, fps)))
    assert {f: got.get(f, f) for f in signed} == want


def test_links_of_crowded_slots_are_all_pairs(spark):
    rng = random.Random(9)
    half, fps = rng.getrandbits(32), set()
    for shift in (0, 32):  # many fingerprints share one segment, some but for one bit
        for _ in range(60):
            rest = rng.getrandbits(6) << 3
            for flip in (0, 1 << rng.randrange(32)):
                fps.add(((half ^ flip) << shift) | (rest << (32 - shift)))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for hot in (1, 8, 64, 10_000):
        rows = [(r.fp, r.other) for r in fingerprint_links(frame, hot).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want, hot


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(150)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(80)]
    base = [[rng.choice(vocab) for _ in range(300)] for _ in range(6)]
    texts = []
    for words in base:
        for _ in range(5):
            edited = list(words)
            edited[rng.randrange(300)] = "edit"
            texts.append(" ".join(edited))
    texts += ["", None, " \n ", "A", "a", "x y", "X Y", texts[0], texts[0]]
    rows = [(100 - i, t, "z", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {i: slow_fingerprint(t or "") for i, t, *_ in rows}
    assert len(got) == len(rows)
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == slow_components(fps)
    kept = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_components(fps).values()))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "same words here now", None, None), (5, "same words here now", None, None), (5, "same words here now", None, None)], SCHEMA)
    assert [r.component_id for r in near_duplicates(rows).collect()] == [5, 5, 5]
    assert near_duplicates(rows.filter(F.col("doc_id").isNull())).first().component_id is None


def test_rounds_broadcast_nothing(spark, monkeypatch):
    """Files of ids weigh little, but as broadcast tables they would grow with the corpus on the driver."""
    from lumispark.llm import components as rounds
    from lumispark.llm import simhash

    def look(df, tag):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString(), tag
        return write(df, tag)

    write = rounds.written
    for module in (rounds, simhash):
        monkeypatch.setattr(module, "written", look)
    docs = spark.createDataFrame([(k, f"a b c d e f {k // 2}") for k in range(20)], "doc_id long, text string")
    assert all(r.component_id <= r.doc_id - r.doc_id % 2 for r in simhash.near_duplicates(docs).collect())
