"""Suffix-array dedup: bytes covered by a long string that starts anywhere else in the corpus.

Routing. Every string of `length` bytes has one anchor: the leftmost of its smallest k-gram hashes.
Equal strings have equal anchors at equal places, so strings can only match within an anchor's
bucket. Neighbouring strings of a text share their anchor; the text they cover is the anchor's
context. Equal contexts (anchor and content, 128 bits of hash, within one bucket) are counted before
they are moved, so a passage that a third of all texts share arrives as one row per map task. The
bytes of the first occurrence of each are fetched, and compared with the last by a 128-bit digest; of
a context that is alone in its bucket digests only, as nothing else can match it.

Buckets. The different contexts of many buckets make one enhanced suffix array. A stack scan over its
common-prefix lengths walks the interval tree; every interval of at least `length` bytes whose
left extensions differ is a maximal repeat, and all its occurrences are covered. A bucket with too
many contexts for one task is split by the strings themselves and counted instead.

A repeat is found within the strings of one anchor: one that is longer than a context comes as
overlapping parts, whose union is the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispark.llm.shared import text_of, written

GRAM = 32
BLOCK_LOG2 = 20
#: Contexts of one bucket that one task indexes; larger buckets are split by string.
BUCKET = 4_000
#: Bytes of contexts indexed together.
INDEXED = 1 << 20
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLE = np.random.default_rng(200).integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(base: int, many: int) -> np.ndarray:
    out = np.ones(many, np.uint64)
    done = 1
    while done < many:
        take = min(done, many - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


class _Rolling:
    """Hashes of any substring of a block by prefix sums, modulo 2^64."""

    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(data) >= len(_Rolling.powers):
            size = 1 << max(BLOCK_LOG2, (len(data) + 1).bit_length())
            _Rolling.powers, _Rolling.inverse = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.powers[: len(data)], out=self.sums[1:])

    def of(self, begins: np.ndarray, ends: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
        h = (self.sums[ends] - self.sums[begins]) * self.inverse[begins]
        return _mixed(h if salt is None else h ^ salt)

    def grams(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C1
    h = (h ^ (h >> np.uint64(28))) * _C2
    return h ^ (h >> np.uint64(32))


def contexts(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Contexts of all strings of `length` bytes in texts that together fit a block: text (its
    index), start, width (how many strings), anchor and content (hashes)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "width", "anchor", "content")}
    gram = min(GRAM, length)
    rolling = _Rolling(data)
    grams = rolling.grams(gram)
    mask = np.uint64((1 << BLOCK_LOG2) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    window, done = length - gram + 1, 1
    while 2 * done <= window:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < window:
        least = np.minimum(least[: len(least) - (window - done)], least[window - done :])
    anchor = (least & mask).astype(np.int64)
    whole = np.ones(len(anchor), bool)
    for size, end in zip(sizes.tolist(), ends.tolist()):
        whole[max(end - size, end - length + 1) : end] = False
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])) + 1
    begin = np.concatenate([[0], change])
    end = np.concatenate([change, [len(anchor)]])
    keep = whole[begin]
    begin, end = begin[keep], end[keep]
    at = anchor[begin]
    text = np.searchsorted(ends, begin, side="right")
    width = end - begin
    salt = (width.astype(np.uint64) * _C1) ^ ((at - begin).astype(np.uint64) * _C2)
    return {
        "text": text,
        "start": begin - (ends - sizes)[text],
        "width": width,
        "anchor": grams[at].view(np.int64),
        "content": rolling.of(begin, end + length - 1, salt).view(np.int64),
    }


class SuffixIndex:
    """Enhanced suffix array of the strings of `length` bytes or more in some pieces: their starts
    in suffix order and the common prefix of each with the one before, within the pieces."""

    def __init__(self, pieces: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(self.data)
        end_of = np.repeat(self.ends, sizes)
        place = np.arange(n)
        left = end_of - place  # bytes to the end of the piece
        code = np.zeros(n, np.uint64)
        for k in range(7):  # 9 bits a byte, 0 past the end
            inside = left > k
            symbol = np.zeros(n, np.uint64)
            symbol[inside] = self.data[place[inside] + k].astype(np.uint64) + np.uint64(1)
            code = code << np.uint64(9) | symbol
        self.levels: list[tuple[int, np.ndarray]] = []
        size, rank = 7, self._ranks(code)
        longest = int(sizes.max()) if n else 0
        self.levels.append((size, rank))
        while 2 * size < longest:
            rank = self._doubled(rank, size, place, left)
            size *= 2
            self.levels.append((size, rank))
        starts = np.flatnonzero(left >= length)
        self.starts = starts[np.argsort(self._doubled(rank, size, starts, left[starts]), kind="stable")]
        self.left = left
        self.common = self._common(self.starts[:-1], self.starts[1:])

    @staticmethod
    def _doubled(rank: np.ndarray, size: int, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Ranks of the strings of 2 * size bytes at some places, from the ranks of those of size bytes."""
        inside = left > size
        second = np.zeros(len(at), np.uint64)
        second[inside] = rank[at[inside] + size].astype(np.uint64) + np.uint64(1)
        return SuffixIndex._ranks(rank[at].astype(np.uint64) * np.uint64(len(rank) + 2) + second)

    @staticmethod
    def _ranks(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))[: len(keys)]
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, by halving steps of equal ranks, then bytes."""
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        for size, rank in [*self.levels[-1:], *reversed(self.levels)]:  # the longest may fit twice
            can = np.flatnonzero(out + size <= most)
            same = can[rank[a[can] + out[can]] == rank[b[can] + out[can]]]
            out[same] += size
        for _ in range(7):
            can = np.flatnonzero(out < most)
            same = can[self.data[a[can] + out[can]] == self.data[b[can] + out[can]]]
            out[same] += 1
        return out

    def maximal_repeats(self) -> list[tuple[int, int, int]]:
        """(prefix length, first, last): intervals of self.starts that share a prefix of at least
        `length` bytes and can't all be extended to the left by one byte."""
        starts, common, length = self.starts, self.common, self.length
        if not len(common):
            return []
        before = np.where(starts > 0, self.data[starts - 1].astype(np.int64), -1)
        opening = np.isin(starts, self.begins)  # nothing stands to the left: differs from all
        differs = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | opening[1:] | opening[:-1])])
        found = []
        long = np.concatenate([[False], common >= length, [False]])
        edges = np.flatnonzero(long[1:] != long[:-1])
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):  # starts[low..high] hang together
            if high == low + 1:
                found.append((int(common[low]), low, high))
                continue
            stack: list[tuple[int, int]] = []  # (prefix length, first) of open intervals, rising
            for at, shared in enumerate([*common[low:high].tolist(), 0], low):
                first = at
                while stack and stack[-1][0] > shared:
                    depth, first = stack.pop()
                    found.append((depth, first, at))
                if shared and (not stack or stack[-1][0] < shared):
                    stack.append((shared, first))
        return [x for x in found if differs[x[2]] > differs[x[1]]]

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, from, to): what maximal repeats cover, one row for each start with a repeat."""
        reach = np.zeros(len(self.starts), np.int64)
        for depth, first, last in sorted(self.maximal_repeats()):
            reach[first : last + 1] = depth
        has = np.flatnonzero(reach)
        piece, low = self._placed(self.starts[has])
        return piece, low, low + reach[has]

    def _placed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, place within it) of places in the joined bytes."""
        piece = np.searchsorted(self.ends, at, side="right")
        return piece, at - self.begins[piece]

    def groups(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(pieces, places in them, length) of all occurrences of each maximal repeat."""
        return [(*self._placed(self.starts[first : last + 1]), depth) for depth, first, last in self.maximal_repeats()]


def promising(pieces: list[bytes], length: int) -> np.ndarray:
    """Indexes of pieces that may hold a string of `length` bytes which starts anywhere else in them.

    Strings are compared by three words each, at their begin, middle and end: equal strings always
    pass, so the suffix array of the rest has every repeat, and most pieces need no sorting."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    word = min(8, length)
    if len(data) < length:
        return np.zeros(0, np.int64)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    starts = np.flatnonzero(left >= length)
    words = np.lib.stride_tricks.sliding_window_view(data, word)
    mark = np.zeros(len(starts), np.uint64)
    for at in (0, (length - word) // 2, length - word):
        own = np.zeros((len(starts), 8), np.uint8)
        own[:, :word] = words[starts + at]
        mark = _mixed(mark ^ own.view(np.uint64)[:, 0])
    order = np.argsort(mark)
    same = mark[order[1:]] == mark[order[:-1]]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return np.unique(np.searchsorted(ends, starts[order[again]], side="right"))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Union of [from, to) rows as maximal runs."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], axis=1)


def _check(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(text, F.lit("check"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows under a key of their own: the id (without one, a hash of the text) and a check of the text.
    Rows that repeat both are occurrences of each other and share one result."""
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("key"), _check(text).alias("check"), text.cast("binary").alias("text"))


def _blocks(rows: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(key, check, offset, bytes) in lists that fit a block; longer texts in overlapping parts."""
    most, held, size = (1 << BLOCK_LOG2) - 1, [], 0
    for key, check, text in rows:
        if len(text) < length:
            continue
        for offset in range(0, max(1, len(text) - length + 1), most - length + 1):
            part = text[offset : offset + most]
            if size + len(part) > most // 2 and held:
                yield held
                held, size = [], 0
            held.append((key, check, offset, part))
            size += len(part)
    if held:
        yield held


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (value.as_py() for value in batch.column("text"))
            for block in _blocks(zip(batch.column("key").to_pylist(), batch.column("check").to_pylist(), texts), length):
                found = contexts([b[3] for b in block], length)
                key, check, offset = (np.array([b[k] for b in block], np.int64)[found["text"]] for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["anchor"], pa.int64()), pa.array(found["content"], pa.int64()), pa.array(key), pa.array(check), pa.array(found["start"] + offset, pa.int64()), pa.array(found["width"], pa.int32())],
                    ["anchor", "content", "key", "check", "start", "width"],
                )

    return rows.mapInArrow(run, "anchor long, content long, key long, check long, start long, width int")


def _context_texts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, content, copies, last, brief, size, text) of the wanted contexts, cut from their texts;
    where `brief`, text is their digest."""
    lists = wanted.groupBy("key", "check").agg(F.collect_list(F.struct("anchor", "content", "copies", "last", "brief", "start", "width")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wants in zip(batch.column("text"), batch.column("wanted")):
                text, wants = text.as_py(), wants.as_py()
                parts = [text[w["start"] : w["start"] + w["width"] + length - 1] for w in wants]
                bodies = [_digest(p) if w["brief"] else p for p, w in zip(parts, wants)]
                numbers = [pa.array([w[k] for w in wants], pa.int64()) for k in ("anchor", "content", "copies")]
                flags = [pa.array([w[k] for w in wants], pa.bool_()) for k in ("last", "brief")]
                yield pa.RecordBatch.from_arrays([*numbers, *flags, pa.array([len(p) for p in parts], pa.int64()), pa.array(bodies, pa.binary())], CONTEXT)

    return rows.join(lists, ["key", "check"]).select("text", "wanted").mapInArrow(run, "anchor long, content long, copies long, last boolean, brief boolean, size long, text binary")


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


#: A context as it reaches its bucket.
CONTEXT = ["anchor", "content", "copies", "last", "brief", "size", "text"]
Held = dict[tuple[int, int, bool], tuple]


def _parted(held: Held) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, int]]]:
    """((anchor, content, text) of contexts to index, (anchor, content, size) of those that occur again).

    Equal hashes count as a repeat only where the digests of the first and last occurrence agree; a row
    that comes twice has one occurrence only to look at, and repeats itself."""
    different, again = [], []
    for (anchor, content, last), (_, _, copies, _, brief, size, text) in held.items():
        if last:
            continue
        if not brief:
            different.append((anchor, content, text))
        other = held.get((anchor, content, True))
        if copies > 1 and (other is None or other[6] == (text if brief else _digest(text))):
            again.append((anchor, content, size))
    return different, again


def _spans(held: Held, length: int) -> pa.RecordBatch:
    """(anchor, content, low, high) that maximal repeats cover, as maximal runs of each context."""
    different, again = _parted(held)
    whole, out = {x[:2] for x in again}, [(*x[:2], 0, x[2]) for x in again]
    may = promising([x[2] for x in different], length)
    piece, low, high = SuffixIndex([different[k][2] for k in may.tolist()], length).covered()
    piece = may[piece]
    order = np.lexsort((low, piece))
    piece, low, high = piece[order], low[order], high[order]
    for k in np.split(np.arange(len(piece)), np.flatnonzero(np.diff(piece)) + 1) if len(piece) else []:
        own = different[piece[k[0]]][:2]
        if own not in whole:
            out += [(*own, a, b) for a, b in _merged(np.stack([low[k], high[k]], axis=1)).tolist()]
    return _longs(out, ["anchor", "content", "low", "high"])


def _groups(held: Held, length: int) -> pa.RecordBatch:
    """(anchor, content, low, high, lead, lead_low): each maximal repeat in each context that has it,
    named by its smallest content and place there."""
    different, again = _parted(held)
    out = [(anchor, content, 0, size, content, 0) for anchor, content, size in again]
    may = promising([x[2] for x in different], length)
    for pieces, places, size in SuffixIndex([different[k][2] for k in may.tolist()], length).groups():
        named = sorted((different[may[p]][1], at, different[may[p]][0]) for p, at in zip(pieces.tolist(), places.tolist()))
        out += [(anchor, content, at, at + size, *named[0][:2]) for content, at, anchor in named]
    return _longs(out, ["anchor", "content", "low", "high", "lead", "lead_low"])


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _indexed(bucketed: DataFrame, length: int, settle: Callable[[Held, int], pa.RecordBatch], schema: str) -> DataFrame:
    """What `settle` reads off the suffix indexes of whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = {}, 0, None  # a repeated row can bring a context twice
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in CONTEXT)):
                if size >= INDEXED and row[0] != last:
                    yield settle(held, length)
                    held, size = {}, 0
                held[row[0], row[1], row[3]] = row
                size += len(row[6])
                last = row[0]
        if held:
            yield settle(held, length)

    return bucketed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema)


def _counted(contexts_of: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size: their strings are spread by hash and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, copies, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "copies", "text"))):
                strings = _Rolling(np.frombuffer(text, np.uint8)).grams(length).view(np.int64)
                n = len(strings)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x), pa.int64()) for x in (anchor, content, copies)), pa.array(np.arange(n)), pa.array(strings)], ["anchor", "content", "copies", "low", "string"])

    strings = contexts_of.dropDuplicates(["anchor", "content"]).mapInArrow(run, "anchor long, content long, copies long, low long, string long")
    often = strings.groupBy("anchor", "string").agg(F.sum("copies").alias("times")).filter("times > 1").select("anchor", "string")
    return strings.join(often, ["anchor", "string"]).select("anchor", "content", "low", (F.col("low") + length).alias("high"), "string")


def _found(rows: DataFrame, length: int, bucket: int, settle: Callable[[Held, int], pa.RecordBatch], schema: str) -> tuple[DataFrame, DataFrame]:
    """(shared contexts, what repeats in them)."""
    anchors = _anchors(rows, length)
    # written first, so that both sides of the join are plain exchanges and a hot anchor can be split
    each = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("many"), F.min("content").alias("least"), F.max("content").alias("most")).filter("many > 1")
    buckets, _ = written(each.select("anchor", (F.col("least") == F.col("most")).alias("single")), "shared-anchors")
    shared, _ = written(anchors.join(buckets, "anchor"), "shared-contexts")
    place = F.struct("key", "check", "start", "width")
    different = shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.max("single").alias("single"), F.min(place).alias("first"), F.max(place).alias("final"))
    ends = F.when(F.col("first") == F.col("final"), F.array("first")).otherwise(F.array("first", "final"))
    both = different.select("anchor", "content", "copies", "single", F.posexplode(ends).alias("nth", "at"))
    last = F.col("nth") > 0
    wanted, _ = written(both.select("anchor", "content", "copies", last.alias("last"), (last | F.col("single")).alias("brief"), "at.*"), "wanted-contexts")
    large, _ = written(wanted.filter("NOT brief").groupBy("anchor").count().filter(F.col("count") > bucket).select("anchor"), "large-buckets")
    texts = _context_texts(rows, wanted, length)
    found = _indexed(texts.join(large, "anchor", "left_anti"), length, settle, schema)
    if large.limit(1).count():
        split = _counted(texts.join(large, "anchor").filter("NOT brief"), length)
        found = found.unionByName(split.drop("string") if settle is _spans else split.withColumnsRenamed({"string": "lead"}).withColumn("lead_low", F.lit(-1).cast("long")))
    return shared, found


def repeated_spans(rows: DataFrame, length: int, bucket: int = BUCKET) -> DataFrame:
    """(key, check, spans): spans [from, to) of each text that repeated strings cover, unmerged.

    rows: (key, check, text) as _keyed makes them."""
    shared, found = _found(rows, length, bucket, _spans, "anchor long, content long, low long, high long")
    parts = shared.join(found, ["anchor", "content"]).select("key", "check", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end"))
    return parts.groupBy("key", "check").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def repeat_groups(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(repeat_id, doc_id, start, length): maximal repeats of at least `length` bytes with all their
    occurrences, start counted in bytes.

    A repeat longer than a context comes as overlapping parts, and one of a bucket beyond `bucket`
    different contexts as its strings of `length` bytes. Null texts are empty; rows without an id are
    occurrences under a null doc_id; rows that repeat an id with the same text count once. An empty
    table gives no rows; other columns are ignored."""
    rows = _keyed(docs, id_col, text_col)
    shared, found = _found(rows, length, bucket, _groups, "anchor long, content long, low long, high long, lead long, lead_low long")
    placed = shared.join(found, ["anchor", "content"])
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_of(text_col))).alias("key"), _check(text_of(text_col)).alias("check")).distinct()
    found = placed.select(F.xxhash64("anchor", "lead", "lead_low", F.col("high") - F.col("low")).alias("repeat_id"), "key", "check", (F.col("start") + F.col("low")).alias("start"), (F.col("high") - F.col("low")).alias("length"))
    return found.distinct().join(named, ["key", "check"]).select("repeat_id", "doc_id", "start", "length")


def kept_bytes(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    runs = _merged(np.array([(s["start"], s["end"]) for s in spans or []], np.int64).reshape(-1, 2)).tolist()
    edges = [0, *(x for run in runs for x in run), len(text)]
    left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return left, len(text) - len(left), len(runs)


def dedup_report(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte is removed that a string of `length` bytes covers which starts anywhere else, in the
    same text or another; texts are judged as they came in. Null texts are empty. Rows that repeat
    an id with the same text are copies of each other and both go. An empty table gives no rows;
    other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length, bucket)
    # ids come back from keys only where there is one
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_of(text_col))).alias("key"), _check(text_of(text_col)).alias("check"), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                text = text.as_py()
                left, gone, many = kept_bytes(text, spans.as_py())
                sizes.append(len(text))
                removed.append(gone)
                runs.append(many)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return named.join(spans, ["key", "check"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """docs with what dedup_report removes cut out of their texts. A character that a cut splits goes
    whole; null texts stay null; every row and every other column stays."""
    spans = repeated_spans(_keyed(docs, id_col, text_col), length, bucket)

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([None if t is None else kept_bytes(t.encode(), list(s))[0].decode(errors="ignore") if s is not None and len(s) else t for t, s in zip(texts, spans)])

    names = {"key": "_lumispark_key", "check": "_lumispark_check", "spans": "_lumispark_spans"}
    marked = docs.withColumns({"_lumispark_key": F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_of(text_col))), "_lumispark_check": _check(text_of(text_col))})
    joined = marked.join(spans.withColumnsRenamed(names), ["_lumispark_key", "_lumispark_check"], "left")
    return joined.select(*(cut(F.col(c), F.col("_lumispark_spans")).alias(c) if c == text_col else F.col(c) for c in docs.columns))
