"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, its ends marked, and of itself, each hashed to a row of
an embedding table; so an unseen misspelling shares most rows with the word it stands for. A run of
words is the average of its bags' rows, and a linear softmax reads it. Table and softmax are trained
together in numpy on a bounded sample of labelled texts. A text is as toxic as its most toxic run of
`WINDOW` words: labels are of whole texts, so each round of training takes the runs that the model
of the round before rates highest. A single insult therefore counts as much in a long text as in a
short one.

Scoring needs no embedding any more: averaging and the softmax are linear, so a row comes down to
one number, a word to a sum and a count, and texts are scored where they lie, without a shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispark.llm.shared import hash_sample, text_of

ROWS_LOG2, DIMENSIONS, SHORTEST, LONGEST, WINDOW = 17, 16, 3, 6, 8
#: Labelled rows that the model is fitted on, at most, of each class.
TOXIC_ROWS, CLEAN_ROWS = 1500, 2500
#: Characters of a labelled text that the fit takes, and in how many windows of a longer one, spread
#: evenly from its begin to its end. Scoring reads texts whole.
FIT_CHARACTERS, FIT_WINDOWS = 100_000, 50
#: Length of a step of the table's rows, against that of the softmax.
STEP = 200.0
_BASE, _MIX = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str, collapse_repeats: bool = True) -> list[str]:
    """Lower-case words; with collapse_repeats, of a word said over and over one, so that noise on it
    can't add up (and an insult said twice in a row counts once)."""
    words = text.lower().split()
    return [w for w, before in zip(words, [None, *words]) if w != before] if collapse_repeats else words


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(begins, rows): rows[begins[i]:begins[i + 1]] is the bag of words[i]."""
    marked = [f"<{w.strip(string.punctuation) or w}>" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    sides = range(SHORTEST, LONGEST + 1)
    many = 1 + sum(np.maximum(sizes - n + 1, 0) for n in sides) if len(words) else sizes
    begins = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    rows = np.empty(int(begins[-1]), np.int32)
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        letters = np.frombuffer("".join(marked[k] for k in of.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size).astype(np.uint64)
        found = []
        for n in (*(n for n in sides if n <= size), size):
            h = np.zeros((len(of), size - n + 1), np.uint64)
            for k in range(n):
                h = h * _BASE + letters[:, k : size - n + 1 + k] + np.uint64(1)
            found.append(((h ^ (h >> np.uint64(29))) + np.uint64(n == size)) * _MIX >> np.uint64(64 - ROWS_LOG2))
        own = np.concatenate(found, axis=1).astype(np.int32)
        rows[begins[of][:, None] + np.arange(own.shape[1])] = own
    return begins, rows


def window_logits(sums: np.ndarray, counts: np.ndarray, bias: float, window: int = WINDOW) -> np.ndarray:
    """Logit of each run of `window` words (of the whole text where shorter) from its words' sums and counts."""
    if not len(sums):
        return np.array([bias])
    s, c = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    width = min(window, len(sums))
    return bias + (s[width:] - s[:-width]) / (c[width:] - c[:-width])


@dataclass
class ToxicityModel:
    """row_logits: what each embedding row adds to the logit of the toxic class, and its bias;
    collapse_repeats as in split_words."""

    row_logits: np.ndarray
    bias: float
    collapse_repeats: bool = True

    def scorer(self, most_known: int = 400_000) -> TextScorer:
        return TextScorer(self, most_known)


class TextScorer:
    """Scores texts; remembers words. The store is emptied when full, which changes no score."""

    def __init__(self, model: ToxicityModel, most_known: int):
        self.model, self.most_known = model, most_known
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.counts = np.zeros(1 << 16), np.zeros(1 << 16, np.int64)

    def _learn(self, words: list[str]) -> None:
        begins, rows = bags(words)
        first, end = len(self.known), len(self.known) + len(words)
        if end > len(self.sums):
            size = max(2 * len(self.sums), end)
            self.sums, self.counts = np.resize(self.sums, size), np.resize(self.counts, size)
        self.sums[first:end] = np.add.reduceat(self.model.row_logits[rows], begins[:-1])
        self.counts[first:end] = np.diff(begins)
        self.known.update(zip(words, range(first, end)))

    def scores(self, texts: list[str]) -> list[float]:
        """Probability that each text is toxic."""
        if len(self.known) > self.most_known:
            self._forget()
        split = [split_words(t, self.model.collapse_repeats) for t in texts]
        known = self.known
        fresh = list({w for words in split for w in words if w not in known})
        if fresh:
            self._learn(fresh)
        out = []
        for words in split:
            at = np.array([known[w] for w in words], np.int64)
            logit = window_logits(self.sums[at], self.counts[at], self.model.bias).max()
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))))
        return out


Runs = list[tuple[np.ndarray, int]]


class _Trainer:
    """Embedding table and softmax, trained together on labelled runs of words.

    The softmax takes Adagrad steps; rows take plain ones, so that a row which many runs share moves
    farther than one which a single run could be remembered by."""

    def __init__(self, begins: np.ndarray, rows: np.ndarray, seed: int):
        self.begins, self.rows, self.counts = begins, rows, np.diff(begins)
        self.rng = np.random.default_rng(seed)
        shape = (1 << ROWS_LOG2, DIMENSIONS)
        self.table = self.rng.normal(0, 0.1, shape).astype(np.float32)
        self.softmax = self.rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = [np.full((DIMENSIONS, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)]

    def learn(self, runs: Runs, rate: float, batch: int = 128) -> None:
        """One pass over the runs."""
        order = self.rng.permutation(len(runs))
        for part in np.array_split(order, max(1, len(order) // batch)):
            words = np.concatenate([runs[k][0] for k in part])
            sizes = np.array([self.counts[runs[k][0]].sum() for k in part])
            label = np.array([runs[k][1] for k in part])
            starts, many = self.begins[words], self.counts[words]
            flat = self.rows[np.repeat(starts - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(self.table[flat], at) / sizes[:, None].astype(np.float32)
            score = mean @ self.softmax + self.bias
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), label] -= 1
            back = (p @ self.softmax.T / sizes[:, None]).astype(np.float32)
            for value, seen, grad in ((self.softmax, self.seen[0], mean.T @ p / len(part)), (self.bias, self.seen[1], p.mean(axis=0))):
                seen += grad**2
                value -= rate * grad / np.sqrt(seen)
            order_in = np.argsort(flat, kind="stable")
            used, edges = np.unique(flat[order_in], return_index=True)
            grad = np.add.reduceat(back[np.repeat(np.arange(len(part)), sizes)[order_in]], edges)
            self.table[used] -= STEP * rate * grad

    def model(self) -> ToxicityModel:
        towards = self.softmax[:, 1] - self.softmax[:, 0]
        return ToxicityModel((self.table @ towards).astype(np.float64), float(self.bias[1] - self.bias[0]))


def fit(texts: list[str], toxic: list[int], seed: int = 11, rounds: int = 3, collapse_repeats: bool = True) -> ToxicityModel:
    """Train on runs of words of labelled texts.

    Which runs of a toxic text are its toxic ones isn't labelled. Two models are trained on a half
    of the texts each, and each half's runs are picked by the other half's model: what a model only
    remembers of its own texts picks nothing there, so round by round the picks settle on words
    that are toxic elsewhere too. The last model learns from all texts; clean texts give it the runs
    that it rates highest itself."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    split = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in split_words(t, collapse_repeats)], np.int64) for t in texts]
    begins, rows = bags(list(vocabulary))
    counts = np.diff(begins)
    half = rng.permutation(len(texts)) % 2
    again = int(np.clip(round(3 * 4000 / max(1, len(texts))), 3, 12))  # few texts are gone over more often

    def runs_of(model: ToxicityModel | None, which: np.ndarray, most: tuple[int, int], at_random: int) -> Runs:
        sums = np.add.reduceat(model.row_logits[rows], begins[:-1]) if model and len(vocabulary) else np.zeros(len(vocabulary))
        out: Runs = []
        for k in which.tolist():
            words, label = split[k], toxic[k]
            if not len(words):
                continue
            starts = rng.integers(0, max(0, len(words) - WINDOW) + 1, at_random).tolist() if not label or not model else []
            if model and most[label]:
                starts += np.argsort(-window_logits(sums[words], counts[words], model.bias), kind="stable")[: most[label]].tolist()
            out += [(words[s : s + WINDOW], label) for s in set(starts)]
        return out

    halves = [np.flatnonzero(half == h) for h in (0, 1)]
    models: list[ToxicityModel | None] = [None, None]
    for number in range(rounds):
        trained = []
        for h in (0, 1):
            trainer = _Trainer(begins, rows, seed + h)
            runs = runs_of(models[1 - h], halves[h], (4, 2), 8 if number == 0 else 2)
            for _ in range(again if runs else 0):
                trainer.learn(runs, 0.1)
            trained.append(trainer.model())
        models = trained
    last = _Trainer(begins, rows, seed + 2)
    picked = runs_of(models[1], halves[0], (4, 2), 2) + runs_of(models[0], halves[1], (4, 2), 2)
    clean = np.flatnonzero(np.array(toxic) == 0)
    for number in range(again + 1 if picked else 0):
        last.learn(picked + (runs_of(last.model(), clean, (4, 0), 0) if number else []), 0.1)
    found = last.model()
    return ToxicityModel(found.row_logits, found.bias, collapse_repeats)


def fitted_text(text: Column, most: int = FIT_CHARACTERS, windows: int = FIT_WINDOWS) -> Column:
    """The text, or `windows` evenly spread windows of it, `most` characters in all, if it is longer."""
    width = most // windows
    step = (F.length(text) - width) / (windows - 1)
    part = lambda i: F.substring(text, (F.floor(i * step) + 1).cast("int"), F.lit(width))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), part), " "))


def fit_on_labels(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
    fit_characters: int = FIT_CHARACTERS,
    collapse_repeats: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Fit on labelled rows that aren't held out, a fixed hash order of them up to the bounds.

    At most toxic_rows + clean_rows ids are broadcast and as many texts come to the driver, each with
    at most fit_characters characters: longer texts give windows spread over their whole length. Of
    rows that repeat an id the smallest text counts; an id labelled both ways is toxic. Without rows
    of both classes every score is the share of toxic labels among them, 0 without any.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    taken = []
    for label, most in ((1, toxic_rows), (0, clean_rows)):
        ids = hash_sample(known.filter(F.col("_toxic") == label), "doc_id", most)
        own = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "_toxic", fitted_text(F.col("_text"), fit_characters).alias("_text"))
        taken += own.groupBy("doc_id", "_toxic").agg(F.min("_text").alias("_text")).collect()
    taken.sort(key=lambda r: r.doc_id)
    classes = [r["_toxic"] for r in taken]
    if len(set(classes)) < 2:
        share = sum(classes) / len(classes) if classes else 0.0
        return ToxicityModel(np.zeros(1 << ROWS_LOG2), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    return fit([r["_text"] for r in taken], classes, collapse_repeats=collapse_repeats)


def held_out(id_col: str):
    """Whether the row is kept from training: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Texts are read whole. Null and empty texts, and texts without words, get the score of no words.
    Repeated rows each get their row, with equal scores. A null id is not held out. An empty table
    gives no rows; other columns are ignored. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: one number a table row
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                scores = np.array(scorer.scores(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose whole text is predicted toxic (a score of 0.5 or more).

    Null and empty texts get the score of no words; repeated rows stay or go together; very long texts
    are read whole. An empty table stays empty. Columns are those of docs. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        for texts in batches:
            out = []
            for first in range(0, len(texts), 256):
                out += scorer.scores(texts.iloc[first : first + 256].tolist())
            yield pd.Series(out, dtype="float64")

    return docs.filter(score(text_of(text_col)) < 0.5)
