import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyspark.sql.functions as F
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumispark.llm.prefix_bpe import PrefixTable, bpe_round_trip, chunks, text_encoder
from lumispark.llm.shared import new_path
from lumispark.llm.token_cache import CACHE_SCHEMA, count_tokens, default_cache
from lumispark.llm.tokens import ids_function, tokenizer_digest

RANKS, JSON, MODEL = (P.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, content string, n_tokens string"
TEXTS = ["", None, "Hello world", "Hello world", "naïve café 北京 👍🏽", " \n\t  x", "a" * 5000, "<|endoftext|> in <|endoftext|>", "don't   stop\x00\x1c\x85", "word " * 3000]
ROWS = [(i, t, "c", None) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def coder():
    return text_encoder(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_match_the_library(coder, library):
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"aaaabcde fthsin") for _ in range(rng.randrange(1, 70))) for _ in range(4000)]
    pieces += [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    want = [library._core_bpe.encode_single_piece(p) for p in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.batch.encode(pieces)] == want
    assert [coder.pieces.encode(p) for p in pieces[:600]] == want[:600]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_texts_match_the_library_and_come_back(text):
    coder = text_encoder(RANKS, P.PATTERN)
    ranks = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=coder.pieces.ranks, special_tokens={})
    (ids,) = coder.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == ranks.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_appends_and_edits_continue_from_stored_prefixes(coder, library):
    rng = random.Random(5)
    table, piece = PrefixTable(coder.pieces), b""
    for _ in range(60):
        more = bytes(rng.choice(b"thesinadorxq") for _ in range(rng.randrange(1, 6)))
        table.append(more)
        piece += more
        assert table.ids() == library._core_bpe.encode_single_piece(piece)
    for _ in range(40):
        a = rng.randrange(len(piece))
        b = min(len(piece), a + rng.randrange(4))
        new = bytes(rng.choice(b"abcdz") for _ in range(rng.randrange(3)))
        piece = piece[:a] + new + piece[b:]
        table.replace(a, b, new)
        assert table.ids() == library._core_bpe.encode_single_piece(piece)


def test_full_stores_change_nothing(library):
    from lumispark.llm.prefix_bpe import TextEncoder

    small = TextEncoder(text_encoder(RANKS, P.PATTERN).pieces.ranks, P.PATTERN, max_stored=5)
    texts = ["some words here and there", "other words, elsewhere; some more"] * 3
    assert [np.frombuffer(x, "<u4").tolist() for part in chunks(iter(texts), 20) for x in small.encode(part)] == [library.encode_ordinary(t) for t in texts]


def test_round_trip_query(spark, library):
    got = {r.doc_id: r for r in bpe_round_trip(spark.createDataFrame(ROWS, SCHEMA), RANKS, P.PATTERN, with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_round_trip(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


def test_rank_engine_equals_the_library_on_every_character():
    library, ids = Tokenizer.from_file(JSON), ids_function(JSON)
    for first in range(0, 0x110000, 0x4000):
        texts = [f"a{c}b {c} 1{c}{c}!{c}  {c}\n{c}x'{c}" for c in map(chr, range(first, first + 0x4000)) if not 0xD800 <= ord(c) < 0xE000]
        for t, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
            assert ids(t).tolist() == e.ids, t


def test_counts_match_the_library_and_fill_the_cache(spark):
    library = Tokenizer.from_file(JSON)
    docs, cache = spark.createDataFrame(ROWS, SCHEMA), new_path(spark, "test-cache")
    for _ in range(2):
        got = {r.doc_id: r for r in count_tokens(docs, JSON, cache).collect()}
        assert len(got) == len(ROWS)
        for i, text in enumerate(TEXTS):
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 512)
        assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})
    count_tokens(docs, MODEL, cache).count()
    stored = spark.read.parquet(cache)
    assert stored.select("tokenizer").distinct().count() == 2 and tokenizer_digest(JSON) != tokenizer_digest(MODEL)
    assert count_tokens(spark.createDataFrame([], SCHEMA), JSON).count() == 0


def test_a_second_run_of_the_default_cache_encodes_nothing(spark):
    docs = spark.createDataFrame([(i, f"stored once {i % 5}", None, None) for i in range(20)], SCHEMA)
    first = sorted(map(tuple, count_tokens(docs, JSON).collect()))
    cache = spark.read.schema(CACHE_SCHEMA).parquet(default_cache(spark))
    rows, files = cache.count(), len(cache.filter("tokenizer IS NOT NULL").select(F.input_file_name()).distinct().collect())
    assert sorted(map(tuple, count_tokens(docs, JSON).collect())) == first
    cache = spark.read.schema(CACHE_SCHEMA).parquet(default_cache(spark))
    assert (cache.count(), len(cache.select(F.input_file_name()).distinct().collect())) == (rows, files)


def test_stored_counts_are_used(spark):
    docs, cache = spark.createDataFrame([(1, "abc", None, None)], SCHEMA), new_path(spark, "test-cache")
    count_tokens(docs, JSON, cache).count()
    spark.read.parquet(cache).selectExpr("content", "77L AS n_tokens", "tokenizer").write.parquet(cache + "-other")
    assert count_tokens(docs, JSON, cache + "-other").first().n_tokens == 77
