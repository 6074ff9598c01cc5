"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one token that can end its encoding. The table keeps that last
token for each prefix; a longer prefix is settled by trying the tokens that end it and taking the
one that stands beside the last token of what is left. So an append continues from the stored
prefix, an edit re-encodes from the edit on, and ids are read off backwards.

Two tokens stand side by side unless some merge joins across their border. Such a merge joins a
token on the right edge of the left token's own merge tree with one on the left edge of the right
token's; it happens if both are whole when the merge's turn comes and neither has been used up.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispark.llm.shared import text_of

NEVER = 1 << 40


class PrefixTable:
    """Last tokens of a growing piece; the encoder may drop and continue it at any byte."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece, self.last = encoder, bytearray(), [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        data, last, e = bytes(self.piece), self.last, self.encoder
        for end in range(len(last), len(data) + 1):
            last.append(e.last_token(data, end, last))

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put new in place of piece[start:end]; prefixes before start stay as they are."""
        tail = bytes(self.piece[end:])
        del self.piece[start:], self.last[start + 1 :]
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end])
            end -= len(self.encoder.tokens[out[-1]])
        return out[::-1]


class PrefixEncoder:
    """ranks: token bytes to rank; rank order is merge order. At most 2 * max_stored verdicts on
    pairs are remembered, which bounds memory and changes no result."""

    def __init__(self, ranks: dict[bytes, int], max_stored: int = 300_000):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.max_stored = max_stored
        self._sides: dict[int, tuple] = {}
        self._beside: dict[int, bool] = {}

    def _merge_steps(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes the token."""
        parts, own = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
        while len(parts) > 2:
            found = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            at = found.index(min(found))
            if found[at] >= own:
                raise ValueError("a token that its own merges can't make")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _edges(self, token: int) -> tuple[list, list]:
        """Left and right edge of the token's merge tree: (bytes, made at, used up at), from the top."""
        if token not in self._sides:
            edges = []
            for side in (0, 1):
                part, gone, edge = self.tokens[token], NEVER, []
                while True:
                    made = self.ranks[part] if len(part) > 1 else -1
                    edge.append((part, made, gone))
                    if len(part) == 1:
                        break
                    part, gone = self._merge_steps(part)[side], made
                edges.append(edge)
            self._sides[token] = (edges[0], edges[1])
        return self._sides[token]

    def beside(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes stand together."""
        key = left << 32 | right
        known = self._beside.get(key)
        if known is None:
            known = True
            for x, made_x, gone_x in self._edges(left)[1]:
                for y, made_y, gone_y in self._edges(right)[0]:
                    joined = self.ranks.get(x + y)
                    # of two equal merges the left one goes first, hence < on the one side, <= on the other
                    if joined is not None and made_x < joined < gone_x and made_y < joined <= gone_y:
                        known = False
            if len(self._beside) >= 2 * self.max_stored:
                self._beside.clear()
            self._beside[key] = known
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The one token that can end data[:end], given the last tokens of all shorter prefixes."""
        ranks = self.ranks
        for start in range(max(0, end - self.longest), end):
            token = ranks.get(data[start:end])
            if token is not None and (not start or self.beside(last[start], token)):
                return token
        raise ValueError("a byte that is no token")

    def encode(self, piece: bytes) -> list[int]:
        return [self.ranks[piece]] if piece in self.ranks else PrefixTable(self, piece).ids()


def _spread(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class BatchEncoder:
    """The same prefix table for many short pieces at once, one column per prefix length.

    Substrings are found among the tokens by a 64-bit polynomial hash, and what was read off is
    compared with the piece's bytes; a piece that differs is encoded on its own.
    """

    LONGEST, BASE, SLOTS, PAIRS = 48, np.uint64(0x2545F4914F6CDD1D), 18, 20

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder
        self.lengths = np.array([len(encoder.tokens[i]) for i in range(len(encoder.tokens))], np.int64)
        hashes = np.empty(len(self.lengths), np.uint64)
        for i, token in encoder.tokens.items():
            h = 0
            for byte in token:
                h = (h * int(self.BASE) + byte + 1) % (1 << 64)
            hashes[i] = h
        slot = _spread(hashes, self.SLOTS)
        order = np.argsort(slot, kind="stable")
        self.keys = np.append(hashes[order], np.uint64(0))
        self.ids = np.append(order, -1).astype(np.int32)
        self.begin = np.searchsorted(slot[order], np.arange((1 << self.SLOTS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.begin).max())
        self.powers = np.array([pow(int(self.BASE), k, 1 << 64) for k in range(self.LONGEST + 1)], np.uint64)
        self.pair_key = np.full(1 << self.PAIRS, (1 << 64) - 1, np.uint64)
        self.pair_beside = np.zeros(1 << self.PAIRS, bool)

    def _tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Token of each hash, or -1."""
        slot = _spread(hashes, self.SLOTS)
        at, end = self.begin[slot], self.begin[slot + 1]
        found = np.full(len(hashes), -1, np.int32)
        for _ in range(self.deepest):
            live = np.flatnonzero((at < end) & (found < 0))
            if not len(live):
                break
            here = at[live]
            same = self.keys[here] == hashes[live]
            found[live[same]] = self.ids[here[same]]
            at = at + 1
        return found

    def _beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = _spread(pairs, self.PAIRS)
        known = self.pair_key[slot] == pairs
        out = self.pair_beside[slot]
        for k in np.flatnonzero(~known).tolist():
            out[k] = verdict = self.encoder.beside(int(left[k]), int(right[k]))
            self.pair_key[slot[k]], self.pair_beside[slot[k]] = pairs[k], verdict
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        out: list[bytes] = [b""] * len(pieces)
        for k in np.flatnonzero(sizes > self.LONGEST).tolist():
            out[k] = np.array(self.encoder.encode(pieces[k]), "<u4").tobytes()
        order = np.flatnonzero((sizes > 0) & (sizes <= self.LONGEST))
        order = order[np.argsort(-sizes[order], kind="stable")]
        if not len(order):
            return out
        sizes = sizes[order]
        n, width = len(order), int(sizes[0])
        data = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in order.tolist()), np.uint8).reshape(n, width)
        prefix = np.zeros((width + 1, n), np.uint64)
        for k in range(width):
            prefix[k + 1] = prefix[k] * self.BASE + (data[:, k].astype(np.uint64) + np.uint64(1))
        last = np.full((width + 1, n), -1, np.int32)
        for end in range(1, width + 1):
            open_rows = np.arange(np.searchsorted(-sizes, -end, side="right"))
            for start in range(end - 1, -1, -1):
                token = self._tokens(prefix[end, open_rows] - prefix[start, open_rows] * self.powers[end - start])
                fits = token >= 0
                if start:
                    here = np.flatnonzero(fits)
                    fits[here] = self._beside(last[start, open_rows[here]], token[here])
                last[end, open_rows[fits]] = token[fits]
                open_rows = open_rows[~fits]
                if not len(open_rows):
                    break
        ids, counts, end = np.zeros((n, width), "<u4"), np.zeros(n, np.int64), sizes.copy()
        rows = np.arange(n)
        while len(rows):
            token = last[end[rows], rows]
            counts[rows] += 1
            ids[rows, width - counts[rows]] = token
            end[rows] -= self.lengths[token]
            rows = rows[end[rows] > 0]
        tokens = self.encoder.tokens
        for k, row, first in zip(order.tolist(), ids, (width - counts).tolist()):
            own = row[first:]
            if b"".join([tokens[i] for i in own.tolist()]) != pieces[k]:
                own = np.array(self.encoder.encode(pieces[k]), "<u4")
            out[k] = own.tobytes()
        return out


class TextEncoder:
    """Whole texts: pieces by the pattern, each encoded on its own, known pieces looked up. The store
    of known pieces is emptied when full, which bounds memory and changes no result."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_stored: int = 400_000):
        self.pieces = PrefixEncoder(ranks, max_stored)
        self.batch = BatchEncoder(self.pieces)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.max_stored = max_stored

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > self.max_stored:
            known.clear()
        parts = [self.split(t) for t in texts]
        fresh = list({p for own in parts for p in own if p not in known})
        known.update(zip(fresh, self.batch.encode([p.encode() for p in fresh])))
        return [b"".join([known[p] for p in own]) for own in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def chunks(texts: Iterator[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of about `most` characters; a longer text makes a list of its own."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return TextEncoder(ranks, pattern)


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Ids are those of the rank table without special tokens; decoded_sha256 is of the bytes that the
    ids decode to. Null texts are empty ones: no ids, the digest of nothing. An empty table gives no
    rows; other columns are ignored; repeated rows each get their row. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(ranks_path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha, kept = [], [], [], []
            for texts in chunks(value.as_py() for value in batch.column("text")):
                for ids in coder.encode(texts):
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
