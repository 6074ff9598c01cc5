import hashlib
import random
import zlib

import pyspark.sql.functions as F
import pytest

from lumispark.llm.merkle import leaf_digest, merkle_manifest, node_digest, tamper_report, verified_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, place):
    out = []
    for level in levels[:-1]:
        first = place - place % 3
        out.append((place % 3, [x for k, x in enumerate(level[first : first + 3]) if k != place % 3]))
        place //= 3
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            node = leaf_of((*row[:4], row[4].replace("\n", ""))) if bad else leaf_of(row)
            for own, others in steps:
                node = sha("".join(others[:own] + [node] + others[own:]))
            root = top[-1][0]
            out.append((row[0], leaf_of(row), trees[s][-1][0], root, sha("".join(x for _, o in steps for x in o)), node, node == root))
    return sorted(out, key=str)


def rows_of(seed, many, sources):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * many), many)
    text = lambda: rng.choice([None, "", "a\nb", "plain", "é\n" * 50, "z" * rng.randrange(2000)])
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 3, -7]), text()) for i in ids]


@pytest.mark.parametrize("many,sources,levels", [(1, ["a"], 7), (3, [None], 7), (400, [None, "", "a", "B", "é", "ab"], 7), (700, ["hot"] * 9 + ["s1", "s2"], 2), (260, ["hot"] * 5 + [f"s{k}" for k in range(40)], 1)])
def test_against_brute_force(spark, many, sources, levels):
    rows = rows_of(many, many, sources)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    if levels == 7:
        got = tamper_report(docs)
    else:  # several superblocks above each other
        changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
        presented = leaf_digest([*map(F.col, fields[:-1]), changed])
        got = verified_manifest(merkle_manifest(docs, leaf_digest([F.col(c) for c in fields]), F.col("source"), F.col("doc_id"), {"presented": presented}, levels=levels), "presented")
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert many < 3 or 0 < sum(r[-1] for r in want) <= many


def test_repeated_ids_nulls_and_an_empty_table(spark):
    rows = [(5, "s", "en", 1, "x\n"), (5, "s", "en", 1, "x\n"), (5, "s", "en", 1, "y"), (None, "s", None, None, None), (None, None, None, None, "q\n"), (5, None, "en", 2, "w\n" * 200_000)]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert sorted(map(tuple, tamper_report(docs).collect()), key=str) == brute(rows)
    empty = tamper_report(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_lone_row_has_an_empty_proof(spark):
    (row,) = tamper_report(spark.createDataFrame([(1, "s", "en", 1, "x", None, None)], SCHEMA)).collect()
    assert row.root == row.subroot == row.leaf and row.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_equal_rows_are_spread_over_range_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        many = spark.range(3000).select(F.lit("s").alias("g"), F.lit(unhexed()).alias("d"), F.lit(None).cast("long").alias("i"))
        got = merkle_manifest(many, F.col("d"), F.col("g"), F.col("i"))
        assert got.select("place").distinct().count() == 3000 and got.select("root").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def unhexed():
    return bytearray(node_digest([b"x"]))
