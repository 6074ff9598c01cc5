import random
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from lumispark.llm.toxicity import LONGEST, SHORTEST, bags, drop_toxic, fit, fit_on_labels, fitted_text, score_toxicity, split_words, window_logits

SCHEMA = "doc_id long, text string, score double, toxic int"
RUDE = ["stupid", "worthless", "disgusting", "pathetic"]


def make(n, rng):
    syllables = ["ba", "no", "ri", "tek", "lum", "so", "ven", "qua", "mi", "dor"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([5, 40, 400]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    data = make(600, random.Random(1))
    return fit([t for t, _ in data], [y for _, y in data])


def test_held_out_accuracy_and_unseen_misspellings(model):
    data = make(300, random.Random(2))
    scores = np.array(model.scorer().scores([t for t, _ in data]))
    assert ((scores >= 0.5) == np.array([y for _, y in data])).mean() > 0.97
    rude = model.scorer().scores(["so stuupid", "wworthless ba", "how disgustin", "ba no ri tek", "lum " * 50])
    assert min(rude[:3]) > 0.5 > max(rude[3:])


def test_bags_hold_every_n_gram():
    words = ["a", "word", "wörd", "x" * 300, "word"]
    begins, rows = bags(words)
    for k, w in enumerate(words):
        assert begins[k + 1] - begins[k] == 1 + sum(max(0, len(w) + 2 - n + 1) for n in range(SHORTEST, LONGEST + 1))
    assert rows[begins[1] : begins[2]].tolist() == rows[begins[4] : begins[5]].tolist()
    assert bags([])[1].size == 0


def test_collapsed_rows_score_as_averages(model):
    words = split_words("ba no stupid tek lum so ven qua mi dor ba")
    begins, rows = bags(words)
    parts = [model.row_logits[rows[a:b]] for a, b in zip(begins, begins[1:])]
    slow = [model.bias + np.concatenate(parts[i : i + 8]).mean() for i in range(len(words) - 7)]
    fast = window_logits(np.array([p.sum() for p in parts]), np.diff(begins), model.bias)
    assert np.allclose(slow, fast)


def test_a_full_store_changes_no_score(model):
    texts = [t for t, _ in make(40, random.Random(3))]
    small = model.scorer(most_known=3)
    assert [s for t in texts for s in small.scores([t])] == model.scorer().scores(texts)


def test_query_learns_from_the_other_folds_only(spark):
    data = make(400, random.Random(4))
    docs = spark.createDataFrame([(i, t, 0.5, 9) for i, (t, _) in enumerate(data)] + [(1000, None, None, None), (1001, "", None, None), (1002, " \n", None, None)], SCHEMA)
    kept = [(i, y) for i, (_, y) in enumerate(data)]
    labels = spark.createDataFrame(kept + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    spoiled = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    rows = score_toxicity(docs, fit_on_labels(docs, labels)).collect()
    assert sorted(rows) == sorted(score_toxicity(docs, fit_on_labels(docs, spoiled)).collect())
    assert len(rows) == 403 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == data[r.doc_id][1] for r in own) / len(own) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_edges(spark, model):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(empty, fit_on_labels(empty, labels)).count() == 0
    docs = spark.createDataFrame([(1, "you stupid", 1.0, 2), (2, "ba no", None, 0), (None, None, None, None), (2, "ba no", None, 0)], SCHEMA)
    assert [r.predicted for r in score_toxicity(docs, fit_on_labels(docs, labels)).collect()] == [0] * 4
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("doc_id = 2 OR doc_id IS NULL").collect()))


def test_long_labelled_texts_are_learned_from(spark):
    rng, rows = random.Random(8), []
    for i, (text, label) in enumerate(make(240, rng)):
        words = (text + " ") * 40 if not label else f"{text} " + f"{rng.choice(RUDE)} {text} " * 40
        rows.append((i, words, None, label))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    found = fit_on_labels(docs, labels, fit_characters=2000)
    fresh = [t for t, _ in make(100, random.Random(9))]
    assert np.ptp(found.scorer().scores(fresh)) > 0.5


def test_windows_reach_from_begin_to_end(spark):
    text = "".join(chr(0x4E00 + i) for i in range(5000))
    row = spark.createDataFrame([(1, text, None, 0), (2, "short", None, 0)], SCHEMA).select(fitted_text(F.col("text"), 1000, 10).alias("t")).collect()
    parts = row[0].t.split(" ")
    assert [len(p) for p in parts] == [100] * 10 and parts[0] == text[:100] and parts[-1] == text[-100:] and row[1].t == "short"


def test_repeats_can_be_kept(model):
    assert split_words("a A b b a", False) == ["a", "a", "b", "b", "a"] and split_words("a A b b a") == ["a", "b", "a"]
