"""License scan by diagonal voting, in DataFrame operations only.

Every rolling pair of words of a text is joined by hash with the places where templates have that
pair; the words themselves verify each match. A match at word p of the text and pair t of the
template is a vote on diagonal p - t. Votes that stand close together in the text are one session;
within it votes are gathered by diagonal, and neighbouring diagonals are merged into a span, as
inserted or missing words move the rest of a template to a diagonal nearby. Spans are verified: only
distinct places of the template in their order count, so a pair said over and over counts once. A
phrase counts where one diagonal holds all its pairs; a notice where a span holds enough of them.

The template index has as many rows as the templates have words, whatever the corpus, so it is
broadcast. One shuffle by row number carries votes, never texts, and no key is hot.
"""

from __future__ import annotations

import re
import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.llm.license_templates import NOTICES, PHRASES
from lumispark.llm.shared import text_of

#: What is not a word, after A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: The same characters, to trim.
ENDS = "".join(chr(c) for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))


def words_of(text: Column) -> Column:
    """Words of the text, A-Z lower-cased. lower() is the faster way, but it changes other letters
    too; of those only the Kelvin sign becomes an ASCII one, so only texts with it go letter by letter."""
    lowered = F.when(text.contains("\u212a"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    trimmed = F.btrim(lowered, F.lit(ENDS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAKS, -1))


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(BREAKS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def template_rows(phrases: Mapping[str, str], notices: Mapping[str, str]) -> list[tuple[str, int, int, str, int, bool]]:
    """(pair, template, place, label, pairs, exact): a row for each pair of words of each template."""
    rows = []
    for number, (text, label, exact) in enumerate([*((p, x, True) for p, x in phrases.items()), *((n, x, False) for x, n in notices.items())]):
        words = _template_words(text)
        rows += [(f"{a} {b}", number, at, label, len(words) - 1, exact) for at, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def template_index(spark: SparkSession, phrases: Mapping[str, str], notices: Mapping[str, str]) -> DataFrame:
    """template_rows as a table: the pair's two words and their hash."""
    index = spark.createDataFrame(template_rows(phrases, notices), "pair string, template int, place int, label string, pairs int, exact boolean")
    both = F.split("pair", " ")
    return index.select(F.xxhash64(both[0], both[1]).alias("pair_hash"), both[0].alias("first"), both[1].alias("second"), "template", "place", "label", "pairs", "exact")


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, str] = NOTICES,
    nearby: int = 3,
    apart: int = 8,
    least_share: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases, first_word and last_word are the smallest and largest word
    they start at, null without one. Votes of a notice at most `apart` words from the one before are
    a session; in it diagonals at most `nearby` apart are a span. In the order of the text, a vote
    of a span is verified if its place in the notice lies beyond those of all votes before it. A
    notice counts if a span has least_share of its pairs verified; score is 1 with a phrase, else
    the largest share of a notice that counts, else 0. Phrases and notices have two words at least.

    Null texts are empty ones: no words, no labels, score 0. Very long texts are read whole; the
    votes of one text meet in one task, where they can spill. Ties need no rule: labels are sorted
    and places are numbers. Repeated rows are scanned each. An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(text_of(text_col)).alias("words"))
    pairs = words.select("row", "doc_id", "words", F.posexplode_outer("words").alias("at", "word"))
    following = F.get("words", F.col("at") + 1)
    index = F.broadcast(template_index(spark, phrases, notices))
    same = (F.col("pair_hash") == F.xxhash64("word", following)) & (F.col("word") == F.col("first")) & (following == F.col("second"))
    voted = (
        pairs.join(index, same, "left")
        .filter(F.col("template").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))  # the first word keeps the row
        .select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.col("at").cast("long").alias("at"), "template", "place", "label", "pairs", "exact")
        .repartition("row")
    )
    of_row = ["row", "doc_id", "n_words", "template", "label", "pairs", "exact"]
    in_text = Window.partitionBy("row", "template").orderBy("at", "place")
    sessions = voted.withColumn("opens", F.coalesce(F.col("at") - F.lag("at").over(in_text) > apart, F.lit(False)).cast("int")).withColumn("session", F.sum("opens").over(in_text))
    diagonals = sessions.groupBy(*of_row, "session", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    across = Window.partitionBy("row", "template", "session").orderBy("diagonal")
    begins = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(across) > nearby, F.lit(False))
    spans = diagonals.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(across))
    along = Window.partitionBy("row", "template", "session", "span").orderBy(F.col("diagonal") + F.col("place"), "place")
    beyond = F.col("place") > F.coalesce(F.max("place").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    verified = (
        spans.select(*of_row, "session", "span", "diagonal", F.explode_outer("places").alias("place"))
        .withColumn("verified", beyond.cast("int"))
        .groupBy(*of_row, "session", "span")
        .agg(F.sum("verified").alias("found"), F.min("diagonal").alias("start"))
    )
    share = F.col("found") / F.col("pairs")
    is_place = F.col("exact") & (F.col("found") == F.col("pairs"))
    is_notice = ~F.col("exact") & (share >= least_share)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        verified.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(is_place, 1)).alias("n_base"),
            F.min(F.when(is_place, F.col("start"))).alias("first_word"),
            F.max(F.when(is_place, F.col("start"))).alias("last_word"),
            joined(F.when(is_place, F.col("label"))).alias("base_labels"),
            joined(F.when(is_place | is_notice, F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(is_place, 1.0).when(is_notice, share)), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
