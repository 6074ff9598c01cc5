import hashlib
import os
import random
from collections import Counter

import pyspark.sql.functions as F
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from lumispark.llm.shared import written  # noqa: E402
from tests.llm.test_suffix_repeats import brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RUDE = ["stupid", "worthless", "idiot"]


def corpus():
    rng = random.Random(12)
    syllables = ["ba", "no", "ri", "tek", "lum", "so", "ven", "qua", "mi", "dor"]
    text = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    clean = [text(rng.randrange(30, 400)) for _ in range(160)]
    passage = text(120)
    docs = list(clean)
    docs += [" ".join(t.split()[:20] + [rng.choice(RUDE), rng.choice(RUDE)] + t.split()[20:]) for t in (text(80) for _ in range(60))]
    docs += [clean[0], clean[0], clean[3]]
    docs += [clean[5].replace("tek", "tek", 1) + " end"]
    docs += [text(50) + " " + passage + " " + text(50) for _ in range(2)]
    docs += ["", None]
    toxic = {i for i in range(160, 220)}
    return docs, toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, toxic = corpus()
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(docs)], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(220)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    all_docs, toxic = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        docs, _ = written(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: {r.doc_id for r in seen[name].collect()}
    kept = ids("toxicity")
    assert len(toxic & kept) <= 2 and set(range(160)) - kept == set()
    texts = {i: t or "" for i, t in enumerate(all_docs)}
    last = {}
    for i in sorted(kept):
        last[texts[i]] = i
    assert ids("exact_dedup") == set(last.values())
    assert ids("near_dedup") <= ids("exact_dedup") and len(ids("exact_dedup") - ids("near_dedup")) <= 3
    before = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    after = {r.doc_id: r for r in seen["suffix_dedup"].collect()}
    want = dict(zip(before, brute(list(before.values()), 200)))
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[i][3] and r.n_chars == len(r.text or "")
    assert sum(len(before[i] or "") - len(after[i].text or "") for i in after) > 500
    packed = seen["packing"].collect()
    assert {r.doc_id for r in packed} == set(after)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_run_gives_the_last_stage(spark, folder):
    rows = pipeline.run(spark, folder)
    assert "sequence_id" in rows.columns and rows.count() > 0


def test_nulls_empty_tables_and_repeated_rows(spark, folder):
    rows = [(None, None, None, None, None), (7, None, None, None, None), (7, "same words " * 40, None, None, 3), (7, "same words " * 40, None, None, 3), (8, "", "en", "s", 0)]
    for docs in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("spans", F.lit("x"))):
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs, _ = written(stage(spark, docs, folder), name)
            if name != "packing":
                assert docs.columns == columns
        docs.count()


def test_it_is_at_the_top():
    assert os.path.dirname(os.path.abspath(pipeline.__file__)) == os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_near_dedup_links_by_simhash_and_by_shingles(spark):
    """1 and 2 have one fingerprint and a similarity of 31 to 44; 2 and 3 are copies by their shingles, 3 far from 1's."""
    base = " ".join([f"w{k}" for k in range(31)] * 50)
    more = base + " " + " ".join(f"x{k}" for k in range(12))
    rows = [(1, base), (2, more), (3, more + " y0 y1"), (4, "something else that stands alone here"), (None, base), (5, "one of two rows"), (5, "another of two rows")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 4, 5, 5] and got.columns == docs.columns
