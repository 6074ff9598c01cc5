import hashlib

import pyspark.sql.functions as F

from lumispark.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, group_size string, _text string"
ROWS = [(1, "a", "x", None), (7, "a", "y", None), (3, "A", None, None), (4, None, "n", None), (9, "", "e", None), (5, "é" * 9000, "l", None), (6, "a ", None, None), (7, "a", "y", None)]


def brute(rows):
    out = []
    for i, t, *_ in rows:
        same = [j for j, u, *_ in rows if (u or "") == (t or "")]
        out.append((i, max(same), len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def test_groups_match_brute_force(spark):
    got = exact_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(ROWS)
    assert sorted(r.doc_id for r in got if r.kept) == [3, 5, 6, 7, 9]


def test_collisions_of_the_hash_stay_apart(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    weak = exact_duplicates(docs, hash_fn=lambda t: F.lit(0))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in weak.collect()) == brute(ROWS)
    assert drop_exact_duplicates(docs, hash_fn=lambda t: F.lit(0)).count() == 5


def test_rows_kept_whole(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([ROWS[1], ROWS[2], ROWS[4], ROWS[5], ROWS[6]], key=str)
    smallest = drop_exact_duplicates(docs, keep="smallest")
    assert sorted(r.doc_id for r in smallest.collect()) == [1, 3, 4, 5, 6]
    assert [r.text for r in smallest.collect() if r.doc_id == 4] == [None]


def test_edges(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(None, "t", None, None), (None, "t", None, None), (2, "u", None, None), (None, "u", None, None)], SCHEMA)
    got = exact_duplicates(rows).collect()
    assert sorted((r.doc_id is None, r.keep_id or -1, r.kept) for r in got) == [(False, 2, True), (True, -1, False), (True, -1, True), (True, 2, False)]
