import random
import re

from lumispark.llm.license_scan import scan_licenses
from lumispark.llm.license_templates import NOTICES, PHRASES

SCHEMA = "doc_id long, text string, row string, template string, words string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    words = words_of(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def labels_of(text, nearby=3, apart=8, least=0.5):
    """(labels, score) by the rule, vote by vote."""
    words, labels, shares = words_of(text), set(), []
    for template, label, exact in [*((p, x, True) for p, x in PHRASES.items()), *((n, x, False) for x, n in NOTICES.items())]:
        own = words_of(template)
        pairs = list(zip(own, own[1:]))
        votes = sorted((at, place) for at, pair in enumerate(zip(words, words[1:])) for place, x in enumerate(pairs) if x == pair)
        sessions = []
        for vote in votes:
            if not sessions or vote[0] - sessions[-1][-1][0] > apart:
                sessions.append([])
            sessions[-1].append(vote)
        for session in sessions:
            spans, last = [], None
            for diagonal in sorted({at - place for at, place in session}):
                if last is None or exact or diagonal - last > nearby:
                    spans.append([])
                spans[-1] += [v for v in session if v[0] - v[1] == diagonal]
                last = diagonal
            for span in spans:
                highest, found = -1, 0
                for _, place in sorted(span):
                    found += place > highest
                    highest = max(highest, place)
                share = found / len(pairs)
                if share == 1 if exact else share >= least:
                    labels.add(label)
                    shares.append(1.0 if exact else share)
    return ",".join(sorted(labels)), max(shares, default=0.0)


def run(spark, texts):
    rows = [(i, t, "a", "b", None) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_base_matches_brute_force(spark):
    texts = [
        "The MIT License", "mit\nlicense mit license, MIT-License", "GNU General Public License and Apache License v2", "general public", "public license general public license",
        "summit license", "mit é license", "émit license", "", None, "mit", "MIT  license " * 400, "x " * 30000 + "apache license", "general general public license license", "mit\x7flicense", "mit_license",
    ]
    got = run(spark, texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and (r.score == 1.0) == (r.n_base > 0)


def test_notices_survive_edits(spark):
    bsd = NOTICES["bsd"]
    edited = bsd.replace("source and binary", "source code and also in binary").replace("permitted", "hereby permitted")
    got = run(spark, [bsd, "pad " * 50 + edited, " ".join(words_of(bsd)[:6]), "of the and in the " * 100, bsd + NOTICES["isc"]])
    assert [got[i].labels for i in range(5)] == ["bsd", "bsd", "", "", "bsd,isc"]
    assert got[0].score == 1.0 and 0.5 <= got[1].score < 1 and got[3].score == 0
    assert got[0].n_base == 0 and got[0].first_word is None


def test_pairs_said_over_and_over_are_no_notice(spark):
    texts = ["to use " * 12, "without fee " * 12, "and distribute this " * 10, "the license you may not use " * 40]
    got = run(spark, texts)
    assert [(got[i].labels, got[i].score) for i in range(4)] == [("", 0.0)] * 4


def test_labels_match_brute_force(spark):
    rng, words = random.Random(4), sorted({w for n in NOTICES.values() for w in words_of(n)})
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(8)]
    for label in sorted(NOTICES):
        own = words_of(NOTICES[label])
        for changes in (0, 2, 5, 9, 14):
            copy = list(own)
            for _ in range(changes):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1, 3])] = rng.choices(words, k=rng.choice([0, 1, 1, 4, 9]))
                copy = copy or ["x"]
            texts.append(" ".join(rng.choices(words, k=30) + copy + rng.choices(words, k=30)))
        texts += [" ".join(reversed(own)), " ".join(own * 3), " ".join(own[: len(own) // 2] + ["x"] * 9 + own[len(own) // 2 :])]
    got = run(spark, texts)
    for i, text in enumerate(texts):
        assert (got[i].labels, got[i].score) == labels_of(text), text
    assert sum(got[i].labels != "" for i in range(len(texts))) > 20


def test_capitals_of_other_alphabets(spark):
    texts = ["\u212aa MIT LICENSE", "M\u0130T license", "\u00c9MIT License \u00c9 mit LICENSE", "\x00MIT\x00LICENSE\x7f"]
    got = run(spark, texts)
    for i, text in enumerate(texts):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == base(text), text


def test_edges(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "mit license", None, None, None), (1, "mit license", None, None, None), (None, "mit license", None, None, None)]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.n_base, r.n_words) for r in got] == [(1, 2)] * 3
