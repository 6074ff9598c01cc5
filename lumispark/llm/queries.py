"""Queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.llm.additive_index import nearest_neighbours
from lumispark.llm.collocations import collocations
from lumispark.llm.exact_dedup import exact_duplicates
from lumispark.llm.hyperminhash import hyperminhash_duplicates
from lumispark.llm.kneser_ney import quality
from lumispark.llm.license_scan import scan_licenses, template_rows
from lumispark.llm.license_templates import NOTICES, PHRASES
from lumispark.llm.merkle import tamper_report
from lumispark.llm.packing import pack
from lumispark.llm.prefix_bpe import bpe_round_trip
from lumispark.llm.simhash import near_duplicates
from lumispark.llm.suffix_repeats import dedup_report
from lumispark.llm.token_cache import count_tokens
from lumispark.llm.toxicity import fit_on_labels, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_additive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_on_labels(docs, _table(spark, sf_dir, "labels")))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_report(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kneser_ney_quality": op1_kneser_ney_quality,
        "op2_additive_neighbours": op2_additive_neighbours,
        "op3_toxicity": op3_toxicity,
        "op4_suffix_repeats": op4_suffix_repeats,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_bpe_round_trip": op6_bpe_round_trip,
        "op7_token_counts": op7_token_counts,
        "op8_license_scan": op8_license_scan,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_collocations": op12_collocations,
        "op13_hyperminhash": op13_hyperminhash,
    }


_TEMPLATES = ", ".join(f"('{pair}', {template}, {place}, '{label}', {pairs}, {exact})" for pair, template, place, label, pairs, exact in template_rows(PHRASES, NOTICES))

ORACLES = {
    # written from the rule in scan_licenses: pairs as strings, sessions and spans named by their first
    # word and diagonal, a vote verified where no earlier one of its span has its place or a later one
    "op8_license_scan": rf"""
        WITH idx(pair, template, place, label, pairs, exact) AS (VALUES {_TEMPLATES}),
        t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT r, i - 1 AS place_at, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM t)),
        v AS (SELECT r, template, label, pairs, exact, place_at, place, place_at - place AS diagonal FROM p JOIN idx USING (pair)),
        o AS (SELECT *, place_at - coalesce(lag(place_at) OVER (PARTITION BY r, template ORDER BY place_at, place), -9) > 8 AS is_first FROM v),
        s AS (SELECT *, max(CASE WHEN is_first THEN place_at END) OVER (PARTITION BY r, template ORDER BY place_at, place ROWS UNBOUNDED PRECEDING) AS session FROM o),
        d AS (SELECT DISTINCT r, template, session, diagonal, exact FROM s),
        b AS (SELECT *, exact OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template, session ORDER BY diagonal) > 3, TRUE) AS is_first FROM d),
        n AS (SELECT r, template, session, diagonal, max(CASE WHEN is_first THEN diagonal END) OVER (PARTITION BY r, template, session ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM b),
        m AS (SELECT s.*, n.span FROM s JOIN n USING (r, template, session, diagonal)),
        x AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM m e WHERE e.r = m.r AND e.template = m.template AND e.session = m.session AND e.span = m.span
            AND (e.place_at < m.place_at OR e.place_at = m.place_at AND e.place < m.place) AND e.place >= m.place)),
        f AS (SELECT r, template, label, exact, span, count(*) / pairs AS share FROM x GROUP BY r, template, label, pairs, exact, session, span),
        k AS (SELECT r, count(*) FILTER (exact AND share = 1) AS n_base, min(span) FILTER (exact AND share = 1) AS first_word, max(span) FILTER (exact AND share = 1) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND share = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND share = 1 OR NOT exact AND share >= 0.5) AS labels,
            max(CASE WHEN exact AND share = 1 THEN 1.0::DOUBLE WHEN NOT exact AND share >= 0.5 THEN share END) AS score FROM f GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM t LEFT JOIN k USING (r)
    """,
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g USING (text)
    """,
    # trees level by level; steps has what stands before and after a row's node on its way to the root
    "op11_merkle_manifest": r"""
        WITH RECURSIVE crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(d) + 1), lambda i: ascii(d[i])::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS low FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS d FROM documents WHERE doc_id IS NOT NULL)),
        raw AS (SELECT row_number() OVER () AS r, doc_id, source, text, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
                CASE WHEN xor(low, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents LEFT JOIN crc USING (doc_id)),
        leaves AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS presented FROM raw),
        placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM leaves),
        node(grp, lvl, idx, many, digest) AS (SELECT grp, 0, place, count(*) OVER (PARTITION BY grp), leaf FROM placed
            UNION ALL SELECT grp, lvl + 1, idx // 3, any_value((many + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE many > 1 GROUP BY grp, lvl, idx // 3),
        sub AS (SELECT grp, digest AS subroot FROM node WHERE many = 1),
        top(lvl, idx, many, digest) AS (SELECT 0, grp, count(*) OVER (), subroot FROM sub
            UNION ALL SELECT lvl + 1, idx // 3, any_value((many + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE many > 1 GROUP BY lvl, idx // 3),
        tree AS (SELECT 0 AS stage, grp, lvl, idx, many, digest FROM node UNION ALL SELECT 1, 0, lvl, idx, many, digest FROM top),
        way AS (SELECT p.r, t.stage, t.lvl, t.grp, CASE WHEN t.stage = 0 THEN p.place ELSE p.grp END // CAST(pow(3, t.lvl) AS BIGINT) AS own FROM placed p
            JOIN (SELECT DISTINCT stage, grp, lvl FROM tree WHERE many > 1) t ON t.grp = CASE WHEN t.stage = 0 THEN p.grp ELSE 0 END),
        steps AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY stage, lvl) - 1 AS k, stage, lvl, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx > own), '') AS after
            FROM way JOIN tree USING (stage, grp, lvl) WHERE idx // 3 = own // 3 GROUP BY r, stage, lvl),
        folded(r, k, digest) AS (SELECT r, 0::BIGINT, presented FROM placed UNION ALL SELECT f.r, f.k + 1, sha256(before || digest || after) FROM folded f JOIN steps s ON s.r = f.r AND s.k = f.k),
        ends AS (SELECT r, arg_max(digest, k) AS folded_root FROM folded GROUP BY r),
        proofs AS (SELECT r, string_agg(before || after, '' ORDER BY k) AS proof FROM steps GROUP BY r)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed JOIN sub USING (grp) JOIN ends USING (r) LEFT JOIN proofs USING (r) CROSS JOIN (SELECT digest AS root FROM top WHERE many = 1)
    """,
    "op12_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        piece AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
        word AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
        gram AS (SELECT lang, w[i:i + m - 1] AS w FROM word, range(1, 4) g(m) WHERE i + m - 1 <= len(w)),
        f AS (SELECT lang, w, count(*) AS a FROM gram GROUP BY lang, w HAVING count(*) >= 10),
        total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
        cut AS (SELECT c.lang, c.w, c.a, k, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1) c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:]),
        low AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS nth FROM cut),
        inside AS (SELECT lang, w[i:i + 1] AS w, max(a) AS most FROM f, range(1, 3) s(i) WHERE len(w) = 3 GROUP BY ALL),
        kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, w) WHERE nth = 1 AND NOT coalesce(100 * most >= 50 * a, FALSE)),
        ranked AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
