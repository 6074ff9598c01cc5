"""Best-fit packing of token sequences, improved by swaps.

Only lengths decide a packing, so documents are tokenised once into a table of pieces, and the plan
is made from its histogram: at most `size` counts, whatever the corpus. Bins with equal content are
one pattern with a multiplicity. Best fit over falling lengths makes the patterns; a local search
then moves documents between underfull bins, one for none, one for one, two for one or one for two,
always so that the sum of squared fills grows, until bins empty or nothing improves. Pieces take
the slots of their length in order; ranks within a length come from windows over buckets of bounded
size, so a very common length is spread over many tasks.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumispark.llm.shared import text_of, written
from lumispark.llm.tokens import ids_function

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, mix long"
#: Pieces of one length that one task ranks at most, give or take the spread of a hash.
PER_BUCKET = 100_000

Pattern = tuple[tuple[int, int], ...]  # (length, how many), falling


def best_fit(counts: dict[int, int], size: int) -> Counter[Pattern]:
    """Best fit over falling lengths: pattern to number of bins."""
    bins: dict[int, Counter[Pattern]] = defaultdict(Counter)  # by room left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in bins if r >= length):
            each = room // length
            for pattern, many in list(bins[room].items()):
                for take in (each, left % each if each else 0):
                    use = min(many, left // take) if take else 0
                    if use and (take == each or left < each):
                        bins[room][pattern] -= use
                        bins[room - take * length][(*pattern, (length, take))] += use
                        left -= use * take
                        many -= use
                bins[room] = +bins[room]
                if not left:
                    break
            if not left:
                break
        each = size // length
        if left // each:
            bins[size - each * length][((length, each),)] += left // each
        if left % each:
            bins[size - left % each * length][((length, left % each),)] += 1
    return sum((bins[r] for r in sorted(bins)), Counter())


def _fill(pattern: Pattern) -> int:
    return sum(n * k for n, k in pattern)


def _changed(pattern: Pattern, gone: tuple[int, ...], come: tuple[int, ...]) -> Pattern:
    items = Counter(dict(pattern))
    items.subtract(gone)
    items.update(come)
    return tuple(sorted((+items).items(), reverse=True))


def _exchanges(giver: Pattern, taker: Pattern, most: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The exchange that brings the taker the largest net length up to most: (net, given, returned)."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
    singles = [n for n, _ in giver]
    back = [n for n, _ in taker]
    pairs = lambda p: sorted({(a, b) for i, (a, k) in enumerate(p) for j, (b, _) in enumerate(p) if i < j or i == j and k > 1})
    for given, returned in (
        *(((x,), ()) for x in singles),
        *(((x,), (y,)) for x in singles for y in back),
        *((xs, (y,)) for xs in pairs(giver) for y in back),
        *(((x,), ys) for x in singles for ys in pairs(taker)),
    ):
        net = sum(given) - sum(returned)
        if best[0] < net <= most:
            best = (net, given, returned)
    return best


def _offers(takers: list[Pattern], size: int) -> np.ndarray:
    """What each taker can give back: rows (taker, its fill, its room, how many lengths, their sum)."""
    rows = []
    for at, taker in enumerate(takers):
        fill, lengths = _fill(taker), [n for n, _ in taker]
        back = {(0, 0), *((1, n) for n in lengths), *((2, a + b) for i, (a, k) in enumerate(taker) for b in (lengths[i + (k == 1) :]))}
        rows += [(at, fill, size - fill, many, total) for many, total in sorted(back)]
    return np.array(rows, np.int64).reshape(-1, 5)


def _gainers(giver: Pattern, offers: np.ndarray) -> list[int]:
    """Takers with which the giver has an exchange that makes the sum of squared fills grow, the last first."""
    taker, fill, room, many, back = offers.T
    least = np.maximum(_fill(giver) - fill, 0)  # the squares grow by 2 * net * (net - least) if fuller than the taker
    lengths = [n for n, _ in giver]
    pairs = {a + b for i, (a, k) in enumerate(giver) for b in lengths[i + (k == 1) :]}
    found = np.zeros(len(offers), bool)
    for given, fits in (*((n, many <= 2) for n in lengths), *((n, many == 1) for n in sorted(pairs))):
        net = given - back
        found |= fits & (net > least) & (net <= room)
    return np.unique(taker[found])[::-1].tolist()


def local_search(packing: Counter[Pattern], size: int) -> Counter[Pattern]:
    """Exchanges between underfull bins until no pair of them has one that makes the sum of squared
    fills grow, or bins are as few as the tokens need. Each giver looks only at takers that gain by
    it; every packing on the way is whole."""
    packing = Counter(packing)
    need = math.ceil(sum(_fill(p) * k for p, k in packing.items()) / size)
    improved = True
    while improved and sum(packing.values()) > need:
        improved = False
        under = sorted((p for p in packing if _fill(p) < size), key=lambda p: (_fill(p), p))
        offers = _offers(under, size)
        for giver in under:
            if not packing[giver]:
                continue
            for at in _gainers(giver, offers):
                taker = under[at]
                many = min(packing[giver], packing[taker]) if giver != taker else packing[giver] // 2
                if not many:
                    continue
                net, given, returned = _exchanges(giver, taker, size - _fill(taker))
                if net <= 0 or net <= _fill(giver) - _fill(taker):  # the squares grow by 2 * net * (b - a + net)
                    continue
                packing[giver] -= many
                packing[taker] -= many
                packing[_changed(taker, returned, given)] += many
                if rest := _changed(giver, given, returned):
                    packing[rest] += many
                improved = True
                break
        packing = +packing
    return packing


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids followed by end_id, cut into pieces of `size` where longer; the first
    piece takes what is over. mix tells pieces with equal ids of documents apart from each other."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_function(tokenizer)
        for batch in batches:
            out = []
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(value.as_py()), end_id).astype("<u4")
                stops = list(range(len(ids), 0, -size))[::-1]
                for piece, (start, stop) in enumerate(zip([0, *stops], stops)):
                    crc = zlib.crc32(ids[start:stop].tobytes())
                    out.append((doc, piece, start, stop - start, crc, zlib.crc32(b"%a %d" % (doc, piece))))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "mix"])

    return rows.mapInArrow(run, PIECES)


def slots(packing: Counter[Pattern]) -> dict[str, np.ndarray]:
    """Runs of slots: pieces of `length` numbered from `first` on go `each` to a sequence, from
    sequence `sequence` on, beginning at `offset` in it."""
    runs, seen, sequence = [], Counter(), 0
    for pattern, many in sorted(packing.items()):
        offset = 0
        for length, each in pattern:
            runs.append((length, seen[length], each, sequence, offset))
            seen[length] += each * many
            offset += length * each
        sequence += many
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T))


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Repeated rows are packed each. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces, _ = written(token_pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = slots(local_search(best_fit(counts, size), size))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("of_length") / PER_BUCKET))
    sizes = spark.createDataFrame(sorted(counts.items()), "length long, of_length long")
    spread = pieces.join(F.broadcast(sizes), "length").withColumn("bucket", F.pmod("mix", buckets))  # at most `size` rows
    per = spread.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = per.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begins"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = spread.withColumn("nth", nth).join(begins, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") - 1 + F.col("begins")).alias("rank")
    )
    shared = spark.sparkContext.broadcast(runs)  # a few runs for each of at most `size` lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = shared.value
        keys = run["length"] << 48 | run["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            beyond, each = rank - run["first"][at], run["each"][at]
            sequence = run["sequence"][at] + beyond // each
            offset = run["offset"][at] + beyond % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
