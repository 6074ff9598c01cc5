"""Collocations: word sequences that occur together more often than their parts would have it.

Tasks read their texts into count tries of limited depth, one for each language and shard of a few
megabytes: a node is a sequence of words, its count how often it occurs, the root's count all words.
A trie is held as arrays in the order of a depth-first walk: word ids in the byte order of the words,
end to end in one integer. It is cut at the boundaries of prefix ranges and serialised, each part
with its own words, so what is shuffled are compressed blocks of sorted nodes. A range gets the
blocks of all shards and merges them, sorted run by sorted run, adding the counts of equal nodes.
Boundaries lie between whole paths, so a word that starts a third of all sequences is spread over
as many ranges as its nodes fill; they come from a sample of texts and only balance the ranges.

Parts of a sequence that occurs `least` times occur as often, so only such nodes leave the merge.
The walk over a merged range finds the counts of left parts (a node's ancestors) and leaves open
those that lie in a range before; right parts are suffix links, followed by a join on the suffix.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumispark.llm.shared import hash_sample, scratch, text_of, written

DEPTH, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Bytes of text in a shard's trie; a task holds back up to four times as much for all languages.
SHARD = 4 << 20
#: Bytes of text a range is made for.
RANGE = 6 << 20
#: Texts read for the boundaries, and every so manieth sequence of theirs.
SAMPLE, EVERY = 2_000, 50
#: Added to the hash of a candidate to spread the first cut of a language's best over tasks.
SALTS = 16
_FOLD = bytes(0x0A if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 0x09 else c for c in range(256))

Path = tuple[bytes, ...]


def folded(text: bytes) -> bytes:
    """Lower case for A-Z; every piece separator a line feed, every word separator a space."""
    return text.lower().translate(_FOLD)


def shards(text: bytes, depth: int, size: int = SHARD) -> Iterator[tuple[bytes, int]]:
    """A folded text in parts of about size bytes, each with how many of its last words only complete
    sequences that start before them."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b"\n", at, at + size), text.rfind(b" ", at, at + size))
        if cut <= at:  # one word longer than a part
            cut = min((k for k in (text.find(b"\n", at + size), text.find(b" ", at + size)) if k >= 0), default=-1)
            if cut < 0:
                break
        end, more = cut, 0
        while more < depth - 1 and end < len(text):
            start = end
            while start < len(text) and text[start] == 0x20:
                start += 1
            if start == len(text) or text[start] == 0x0A:
                break  # no sequence goes on over the end of a piece
            end = min(k for k in (text.find(b" ", start), text.find(b"\n", start), len(text)) if k >= 0)
            more += 1
        yield text[at:end], more
        at = cut
    yield text[at:], 0


class Trie:
    """Nodes in depth-first order: keys (word ids from 1, base len(words) + 1, 0 for no word) and counts."""

    def __init__(self, words: pa.Array, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.words, self.keys, self.counts, self.depth = words, keys, counts, depth

    @property
    def base(self) -> int:
        return len(self.words) + 1

    @classmethod
    def of(cls, text: bytes, more: int, depth: int) -> Trie:
        """The trie of a part of a folded text whose last `more` words start nothing."""
        spaced = pa.array([text.replace(b"\n", b" \n ")], pa.large_binary())
        coded = pc.split_pattern(spaced, " ").flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        words = coded.dictionary.take(pa.array(order))
        plain = ~np.isin(order, pc.index_in(pa.array([b"", b"\n"], pa.large_binary()), coded.dictionary).fill_null(-1).to_numpy())
        ids = np.zeros(len(order), np.int64)
        ids[order] = np.cumsum(plain) * plain
        empty = pc.index_in(pa.scalar(b"", pa.large_binary()), coded.dictionary).as_py()
        tokens = coded.indices.to_numpy()
        tokens = ids[tokens[tokens != empty] if empty is not None else tokens]
        words = words.filter(pa.array(plain))
        base, starts = len(words) + 1, len(tokens) - more
        assert base**depth < 1 << 63, "a shard has too many different words for the depth"
        live = tokens[:starts] > 0
        keys, counts = [np.zeros(1, np.int64)], [np.array([live.sum()], np.int64)]
        path = tokens[:starts].copy()
        for level in range(depth):
            if level:
                follow = tokens[level : level + len(path)]
                path, live = path[: len(follow)], live[: len(follow)] & (follow > 0)
                path = path * base + follow
            found, many = np.unique(path[live], return_counts=True)
            keys.append(found * base ** (depth - 1 - level))
            counts.append(many)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        return cls(words, keys[order], counts[order], depth)

    def levels(self) -> list[np.ndarray]:
        """The word ids of the nodes by level."""
        out, rest = [], self.keys
        for _ in range(self.depth):
            rest, last = np.divmod(rest, self.base)
            out.append(last)
        return out[::-1]

    def before(self, path: Path, words: list[bytes]) -> int:
        """How many nodes come before a path."""
        key = 0
        for level in range(self.depth):
            key *= self.base
            if path is not None and level < len(path):
                at = bisect_left(words, path[level])
                key += at + 1
                if at == len(words) or words[at] != path[level]:
                    path = None  # every node from here on is on one side
        return int(np.searchsorted(self.keys, key))

    def parts(self, bounds: list[Path]) -> Iterator[tuple[int, bytes]]:
        """The number of each range between bounds that has nodes, and its block."""
        words = self.words.to_pylist()
        cuts = [0, *(self.before(b, words) for b in bounds), len(self.keys)]
        levels = self.levels()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                yield k, block(words, [level[a:b] for level in levels], self.counts[a:b])


def block(words: list[bytes], levels: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Nodes serialised: their own words, then the differences of their ids by level, then counts."""
    used = np.zeros(len(words) + 1, bool)
    for level in levels:
        used[level] = True
    used[0] = False
    place = np.cumsum(used)
    place[0] = 0
    own = b"\n".join(words[k - 1] for k in np.flatnonzero(used).tolist())
    arrays = [np.diff(place[level], prepend=0).astype("<i4") for level in levels] + [counts.astype("<i8")]
    head = np.array([len(counts), len(own)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + own + b"".join(a.tobytes() for a in arrays))


def opened(data: bytes, depth: int) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """What block() was given, with its own words only."""
    data = zstandard.ZstdDecompressor().decompress(data)
    many, size = np.frombuffer(data, "<i8", 2).tolist()
    words = data[16 : 16 + size].split(b"\n") if size else []
    levels = [np.cumsum(np.frombuffer(data, "<i4", many, 16 + size + 4 * many * k), dtype=np.int64) for k in range(depth)]
    return words, levels, np.frombuffer(data, "<i8", many, 16 + size + 4 * many * depth)


def merged(blocks: list[bytes], depth: int) -> Trie:
    """One trie of the blocks of a range, equal nodes added up."""
    parts = [opened(b, depth) for b in blocks]
    coded = pa.array([w for words, _, _ in parts for w in words], pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    ids, base, at, runs = rank[coded.indices.to_numpy()], len(order) + 1, 0, []
    assert base**depth < 1 << 63, "a range has too many different words; make ranges smaller"
    for words, levels, _ in parts:
        own = np.concatenate([[0], ids[at : at + len(words)]])
        at += len(words)
        key = np.zeros(len(levels[0]), np.int64)
        for level in levels:
            key = key * base + own[level]
        runs.append(key)
    keys, counts = np.concatenate(runs), np.concatenate([c for *_, c in parts])
    turn = np.argsort(keys, kind="stable")  # merges the sorted runs
    keys, counts = keys[turn], counts[turn]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return Trie(coded.dictionary.take(pa.array(order)), keys[first], np.add.reduceat(counts, first), depth)


def frequent(trie: Trie, least: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list[list[int | None]]]:
    """Phrases, lengths and counts of the nodes with that count or more (and the root), and the counts of
    their ancestors by length, None where they lie in another range."""
    kept = (trie.counts >= least) | (trie.keys == 0)
    levels = [level[kept] for level in trie.levels()]
    keys, counts = trie.keys[kept], trie.counts[kept]
    length = sum((level > 0).astype(np.int64) for level in levels)
    words = trie.words.to_pylist()
    phrases = [b" ".join(words[k - 1] for k in path if k) for path in zip(*(level.tolist() for level in levels))]
    lefts: list[list[int | None]] = [[] for _ in phrases]
    for k in range(1, trie.depth):
        step = trie.base ** (trie.depth - k)
        parent = keys // step * step
        at = np.minimum(np.searchsorted(keys, parent), len(keys) - 1)
        for i in np.flatnonzero(length > k).tolist():
            lefts[i].append(int(counts[at[i]]) if keys[at[i]] == parent[i] else None)
    return phrases, length, counts, lefts


def boundaries(rows: DataFrame, depth: int, parts: int) -> list[tuple[str, Path]]:
    """Up to parts - 1 sorted (lang, path) that split the sampled sequences evenly."""
    sampled = hash_sample(rows, "text", SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                paths, at = [], 0
                for piece in folded(text.as_py()).split(b"\n"):
                    words = piece.split()  # words of a piece hold no other white space
                    for k in range(-at % EVERY, len(words), EVERY):
                        paths.append(b" ".join(words[k : k + depth]))
                    at += len(words)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(paths), pa.string()), pa.array(paths, pa.binary())], ["lang", "path"])

    found = sampled.mapInArrow(run, "lang string, path binary").distinct().collect()
    paths = sorted({(r.lang, tuple(bytes(r.path).split(b" "))) for r in found}, key=lambda x: (x[0].encode(), x[1]))
    return sorted({paths[len(paths) * k // parts] for k in range(1, parts)}, key=lambda x: (x[0].encode(), x[1])) if paths else []


def blocks_of(rows: DataFrame, bounds: list[tuple[str, Path]], depth: int, size: int = SHARD) -> DataFrame:
    """(lang, range, block): the tries of the shards of rows (lang, text), cut at the bounds."""
    order = [(lang.encode(), path) for lang, path in bounds]

    def tries(lang: str, texts: list[bytes]) -> Iterator[tuple[str, int, bytes]]:
        low, high = bisect_left(order, (lang.encode(), ())), bisect_right([b[0] for b in order], lang.encode())
        own = [path for _, path in order[low:high]]
        for part, more in shards(b"\n".join(texts), depth, size):
            for k, data in Trie.of(part, more, depth).parts(own):
                yield lang, low + k, data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def let_go(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            for row in tries(lang, held.pop(lang)):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["lang", "range", "block"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = folded(text.as_py())
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= size:
                    yield from let_go(lang)
                elif sum(sizes.values()) >= 4 * size:
                    yield from let_go(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from let_go(lang)

    return rows.mapInArrow(run, "lang string, range long, block binary")


def frequent_nodes(docs: DataFrame, text_col: str, lang_col: str, depth: int, least: int, size: int = SHARD, range_size: int = RANGE) -> DataFrame:
    """(lang, phrase, words, count, lefts) of all sequences of up to depth words that occur least times,
    the empty phrase (all words of the language) among them."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bounds = boundaries(rows, depth, -(-total // range_size)) if total > range_size else []

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        phrases, length, counts, lefts = frequent(merged(table.column("block").to_pylist(), depth), least)
        columns = [pa.array([key[0].as_py()] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(length), pa.array(counts), pa.array(lefts, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, ["lang", "phrase", "words", "count", "lefts"])

    dealt = blocks_of(rows, bounds, depth, size)
    nodes = dealt.groupBy("lang", "range").applyInArrow(merge, "lang string, phrase binary, words long, count long, lefts array<long>")
    return nodes.withColumn("phrase", F.col("phrase").cast("string"))


def scored(cuts: DataFrame) -> DataFrame:
    """cuts with score: floor(1000000 * a * a / (l * r)) in whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, left, right = (batch.column(c).to_pylist() for c in ("a", "l", "r"))
            score = pa.array([1_000_000 * x * x // (y * z) for x, y, z in zip(a, left, right)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    return cuts.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema) + ", score long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, share: int = SHARE, top: int = TOP, size: int = SHARD, range_size: int = RANGE) -> DataFrame:
    """Each language's best phrases of 2 to depth (2 or 3) words: lang, rank, phrase, a, l, r, n, score.

    a is how often the phrase occurs (least times or more), l and r how often the parts of its lowest
    scoring cut do (ties: the shorter left part), n all words of the language. A phrase inside a longer
    one that occurs share % as often or more is left out. Ties in score go by a, then by the bytes of
    the phrase. A null language is `und`, null texts are empty; texts without words count nothing, and
    long ones are read whole, in parts that share the words across their borders. Repeated rows count
    each time. An empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        nodes, _ = written(frequent_nodes(docs, text_col, lang_col, depth, least, size, range_size), "frequent-nodes")
        counts = nodes.select("lang", F.col("phrase").alias("part"), F.col("count").alias("of_part"))
        found = nodes.filter(F.col("words") > 1).select("lang", "phrase", F.col("count").alias("a"), F.split("phrase", " ").alias("w"), "lefts")
        cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1))
        cuts = found.withColumn("k", cut).select(
            "lang", "phrase", "a", "k", F.expr("lefts[k - 1]").alias("l"), F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("part")
        )
        cuts, _ = written(cuts.join(counts, ["lang", "part"]).select("lang", "phrase", "a", "k", "l", "left", F.col("of_part").alias("r")), "cuts")
        known = cuts.filter(F.col("l").isNotNull()).drop("left")
        open_ = cuts.filter(F.col("l").isNull()).withColumnRenamed("left", "part").join(counts, ["lang", "part"])
        whole = known.unionByName(open_.select("lang", "phrase", "a", "k", F.col("of_part").alias("l"), "r"))
        lowest = scored(whole).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        inner = found.select("lang", F.col("a").alias("outer"), F.explode(_inside(depth)).alias("phrase")).filter(F.col("phrase").isNotNull())
        outer = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
        best = lowest.join(outer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("outer") < share * F.col("a"), F.lit(True)))
        best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        salted = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_rank") <= top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
        n = counts.filter(F.col("part") == "").groupBy("lang").agg(F.sum("of_part").alias("n"))
        out, path = written(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
        keep(path)
    return out.withColumn("rank", F.col("rank").cast("long"))


def _inside(depth: int) -> F.Column:
    """The shorter sequences of 2 words or more inside that of column w."""
    parts = []
    for many in range(2, depth):
        for at in range(depth - many + 1):
            parts.append(F.when((F.size("w") > many) & (F.size("w") >= at + many), F.array_join(F.slice("w", at + 1, many), " ")))
    return F.array(*parts) if parts else F.array(F.lit(None).cast("string"))
