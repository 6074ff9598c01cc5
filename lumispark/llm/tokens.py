"""Token ids by the public tokenizer files, one loaded tokenizer per Python worker.

A byte-level BPE .json whose merges stand in id order says the same as a table of ranks, so it is
run by the faster rank engine; ids equal those of the tokenizers library, special strings inside
texts included (the tests compare both on every Unicode character). Any other .json goes through
tokenizers, a .model through sentencepiece. A path must be readable on every executor.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _rank_engine(config: dict):
    """A tiktoken encoding for the config, or None if ranks can't stand for it."""
    import public_tokenizers
    import tiktoken

    model, pre = config["model"], config.get("pre_tokenizer") or {}
    plain = config.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in config["added_tokens"]):
        return None
    back = byte_alphabet()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merges]
    if ids != sorted(ids) or min(ids) < 256:
        return None
    added = {t["content"]: t["id"] for t in config["added_tokens"]}
    ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=4)
def ids_function(path: str):
    """text -> array of uint32 ids, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: np.array(pieces.encode(text), np.uint32)
    with open(path, encoding="utf-8") as file:
        engine = _rank_engine(json.load(file))
    if engine:
        return lambda text: engine.encode_to_numpy(text, allowed_special="all")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: its kind and the whole content of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(path.rsplit(".", 1)[-1].encode() + b"\0" + file.read()).hexdigest()
