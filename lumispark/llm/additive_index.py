"""Approximate nearest neighbours by additive quantisation.

A unit vector is coded as the sum of one codeword from each of several full-dimensional codebooks,
trained stage by stage on residuals of a bounded sample. Codes come from a beam search that keeps
the best partial sums at each stage; the norm of the decoded sum is stored with the code. A query
scores codes with lookup tables of its inner products with the codewords. How far such scores are off
depends on the rows: 24 codewords say little of 256 even directions, or of rows unlike the sample. So
what the sum of a row lacks is kept too, as one byte a dimension with the row's scale, a last term of
the sum. Every row whose score, less than a margin, could reach the best is scored again with it; the
margin follows from the error of each row and from how such errors show along the query at hand. The
best rows over all blocks are then joined with their vectors once, and ranked by exact cosines in
double precision.

The stated queries meet all rows, in blocks: a block of queries and a block of the index meet by an
equi-join on the block's number. Blocks hold codes of 36 bytes a row and one more a dimension, never vectors, so they
are large and their meetings few; ids are spread over blocks by hash, so a block need only give the
share of the best rows that can fall to it. No vector is collected and nothing that grows with the
data is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.llm.shared import hash_sample, scratch, written

#: Vectors that the codebooks are trained on, at most.
SAMPLE = 8192
STAGES, CODEWORDS, BEAM = 24, 256, 4
#: Rows of an index block, queries of a query block, and candidates of a query ranked exactly.
BLOCK, QUERY_BLOCK, RERANK = 1 << 18, 1 << 12, 100
#: Standard deviations of a row's error by which its score may fall short and still be looked at again.
MARGIN = 4.0
#: Bytes of an index block, at most about.
BLOCK_BYTES = 1 << 26
#: Rows of a block up to which it isn't split for the sake of idle cores.
LEAST = 1 << 12


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps squares in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def _centres(points: np.ndarray, many: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), many, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=many)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points[rng.choice(len(points), many)])
    return centres


@dataclass
class AdditiveCodes:
    """codebooks: stages x codewords x dimensions."""

    codebooks: np.ndarray
    beam: int = BEAM

    @classmethod
    def train(cls, vectors: np.ndarray, stages: int = STAGES, codewords: int = CODEWORDS, beam: int = BEAM, seed: int = 5) -> AdditiveCodes:
        rng, left, books = np.random.default_rng(seed), unit(vectors).astype(np.float32), []
        for _ in range(stages):
            book = _centres(left, min(codewords, len(left)), rng)
            left = left - book[_nearest(left, book)]
            books.append(book)
        return cls(np.stack(books).astype(np.float32), beam)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms of the decoded sums) of unit vectors, by beam search."""
        books, n = self.codebooks, len(vectors)
        stages, words, dims = books.shape
        vectors = np.asarray(vectors, np.float32)
        left = vectors[:, None, :]  # what each partial sum still lacks
        paths, row = np.zeros((n, 1, 0), np.int32), np.arange(n)[:, None]
        for stage in range(stages):
            width = left.shape[1]
            gain = (books[stage] ** 2).sum(axis=1) - 2 * (left.reshape(-1, dims) @ books[stage].T)
            total = ((left * left).sum(axis=2)[:, :, None] + gain.reshape(n, width, words)).reshape(n, -1)
            keep = min(self.beam if stage + 1 < stages else 1, total.shape[1])
            best = np.empty((n, keep), np.int64)
            for k in range(keep):  # a few minima are faster than a partition
                best[:, k] = total.argmin(axis=1)
                total[row[:, 0], best[:, k]] = np.inf
            parent, word = best // words, best % words
            left = left[row, parent] - books[stage][word]
            paths = np.concatenate([paths[row, parent], word[:, :, None].astype(np.int32)], axis=2)
        codes = paths[:, 0]
        return codes.astype(np.uint8 if words <= 256 else np.uint16), np.sqrt((self.decode(codes) ** 2).sum(axis=1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.codebooks[s][codes[:, s].astype(np.int64)] for s in range(len(self.codebooks)))

    def lacking(self, vectors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, scales, lengths) of what the decoded sums lack of the vectors: about bytes * scale."""
        left = np.asarray(vectors, np.float32) - self.decode(codes)
        scales = np.maximum(np.abs(left).max(axis=1), np.float32(1e-30)) / np.float32(127)
        return np.rint(left / scales[:, None]).astype(np.int8), scales, np.sqrt((left * left).sum(axis=1))

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines (codes x queries) from lookup tables and stored norms."""
        tables = [np.ascontiguousarray((queries @ book.T).T) for book in self.codebooks]
        out = np.empty((len(codes), len(queries)), np.float32)
        for at in range(0, len(codes), 1 << 12):
            own, part = out[at : at + (1 << 12)], codes[at : at + (1 << 12)]
            np.take(tables[0], part[:, 0], axis=0, out=own)
            for stage in range(1, len(tables)):
                own += tables[stage][part[:, stage]]
            own /= np.maximum(norms[at : at + (1 << 12)], 1e-12).astype(np.float32)[:, None]
        return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact cosines of rows in double precision; each is computed in the same way whatever stands beside it."""
    return (unit(a) * unit(b)).sum(axis=1)


def best_rows(scores: np.ndarray, many: int) -> np.ndarray:
    """Places of the `many` highest scores; of equal ones at the edge, the first."""
    if many >= len(scores):
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - many)[len(scores) - many]
    above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([above, level[: many - len(above)]])


def promising(rough: np.ndarray, query: np.ndarray, norms: np.ndarray, errors: np.ndarray, scales: np.ndarray, fine: np.ndarray, many: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the `many` rows of a block with the highest scores by all terms.

    rough: approximate cosines of the sums. Looked at are the best of them, and whichever other row comes
    within the margin of the k-th best score found in those."""
    sums = rough * norms
    whole = lambda rows: sums[rows] + scales[rows] * (fine[rows].astype(np.float32) @ query)
    some = np.arange(0, len(rough), max(1, len(rough) // 256))
    off = (whole(some) - sums[some]) / np.maximum(errors[some], np.float32(1e-30))
    first = best_rows(rough, many)
    known = whole(first)
    bound = np.partition(known, max(0, len(known) - k))[max(0, len(known) - k)]
    may = sums + np.float32(MARGIN * math.sqrt(float((off * off).mean()))) * errors >= bound
    may[first] = True
    rows = np.flatnonzero(may)
    scores = whole(rows)
    best = best_rows(scores, many)
    return rows[best], scores[best]


def share_of(many: int, blocks: int) -> int:
    """How many of the best `many` rows one of `blocks` blocks may hold: six standard deviations over its share."""
    return min(many, math.ceil(many / blocks + 6 * math.sqrt(many / blocks)) + 10) if blocks > 1 else many


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _gathered(rows: DataFrame, key: str, columns: dict[str, np.dtype]) -> DataFrame:
    """One row for each value of `key`: the columns' values, in order of vec_id, as bytes."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = {c: [] for c in names}, None

        def give() -> pa.RecordBatch:
            blobs = [b"".join(held[c]) for c in names]
            for c in names:
                held[c].clear()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], [key, *names])

        for batch in batches:
            keys = batch.column(key).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(edges, edges[1:]):
                if current is not None and keys[a] != current:
                    yield give()
                current = int(keys[a])
                for c, kind in columns.items():
                    part = batch.column(c).slice(a, b - a)
                    held[c].append(b"".join(part.to_pylist()) if kind is None else part.to_numpy().astype(kind).tobytes())
        if current is not None:
            yield give()

    sorted_rows = rows.repartition(key).sortWithinPartitions(key, "vec_id")
    return sorted_rows.select(key, *names).mapInArrow(run, f"{key} int, " + ", ".join(f"{c} binary" for c in names))


def _block_of(rows: int, most: int, cores: int) -> tuple[Column, int]:
    """(number of a row's block by a hash of its id, how many blocks): blocks of at most about `most`
    rows, and as many as there are cores while they stay larger than LEAST."""
    many = max(1, -(-rows // most), min(cores, rows // LEAST))
    return F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int"), many


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    rerank: int = RERANK,
    sample: int = SAMPLE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k nearest other rows: query_id, rank (from 1), vec_id, score (exact cosine).

    is_query: a condition on the rows of `vectors`. Ties go to the smaller vec_id; a query with fewer
    candidates gets them all. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do rows without an id, nor vectors whose length isn't the commonest one (of lengths
    that are equally common, the smallest). Of rows that repeat an id the smallest vector counts, and
    it asks if any of them does. An empty table gives no rows; other columns are ignored. The index is
    trained on the `sample` rows first in a fixed hash order and holds every row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], result)
    one = rows.filter(F.size("vector") == lengths[0]["size"]).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    with scratch(spark) as hold:
        rows, _ = written(one, "vectors")
        first = hash_sample(rows.select("vec_id", "vector"), "vec_id", sample).collect()
        model = spark.sparkContext.broadcast(AdditiveCodes.train(np.array([r.vector for r in first], np.float64)))
        counts = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("asking")).first()
        most = min(BLOCK, max(LEAST, BLOCK_BYTES // (lengths[0]["size"] + STAGES + 20)))
        block, blocks = _block_of(counts["all"], most, spark.sparkContext.defaultParallelism)
        query_block, query_blocks = _block_of(counts["asking"], QUERY_BLOCK, 1)
        give = share_of(rerank + 1, blocks)  # the query itself may be among them

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    plain = unit(_matrix(part.column("vector"))).astype(np.float32)
                    codes, norms = model.value.encode(plain)
                    fine, scales, errors = model.value.lacking(plain, codes)
                    blobs, floats = (pa.array([c.tobytes() for c in x], pa.binary()) for x in (codes, fine)), (pa.array(x, pa.float32()) for x in (norms, scales, errors))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("block"), *blobs, *floats], ["vec_id", "block", "codes", "fine", "norms", "scales", "errors"])

        def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    plain = unit(_matrix(part.column("vector"))).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("query_block"), pa.array([v.tobytes() for v in plain], pa.binary())], ["vec_id", "query_block", "units"])

        coded = rows.select("vec_id", "vector", block.alias("block")).mapInArrow(encode, "vec_id long, block int, codes binary, fine binary, norms float, scales float, errors float")
        index, _ = written(_gathered(coded.withColumn("ids", F.col("vec_id")), "block", {"ids": np.int64, "codes": None, "fine": None, "norms": np.float32, "scales": np.float32, "errors": np.float32}), "index")
        asking = rows.filter("asks").select("vec_id", "vector", query_block.alias("query_block")).mapInArrow(units, "vec_id long, query_block int, units binary")
        asked, _ = written(_gathered(asking.withColumn("asked", F.col("vec_id")), "query_block", {"asked": np.int64, "units": None}), "queries")
        # numbers of partitions of our own: the blocks are few and small, but a meeting is much work
        meetings = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(2 * blocks * query_blocks, "block", "query_block").join(index, "block")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for meeting in range(batch.num_rows):
                    ids, query_ids, codes, fine = (np.frombuffer(batch.column(c)[meeting].as_buffer(), k) for c, k in (("ids", np.int64), ("asked", np.int64), ("codes", np.uint8), ("fine", np.int8)))
                    norms, scales, errors, plain = (np.frombuffer(batch.column(c)[meeting].as_buffer(), np.float32) for c in ("norms", "scales", "errors", "units"))
                    codes, fine, plain = codes.reshape(len(ids), -1), fine.reshape(len(ids), -1), plain.reshape(len(query_ids), -1)
                    step = max(1, (1 << 23) // max(1, len(ids)))
                    for at in range(0, len(query_ids), step):
                        rough = model.value.scores(plain[at : at + step], codes, norms)
                        for query, vector, column in zip(query_ids[at : at + step].tolist(), plain[at : at + step], np.ascontiguousarray(rough.T)):
                            # ids rise within a block, so equal scores keep the smaller ones; the query itself may be among them
                            best, score = promising(column, vector, norms, errors, scales, fine, give, k + 1)
                            other = ids[best] != query
                            best, score = best[other], score[other]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query)), pa.array(ids[best]), pa.array(score)], ["query_id", "vec_id", "rough"])

        found = meetings.select("asked", "units", "ids", "codes", "fine", "norms", "scales", "errors").mapInArrow(search, "query_id long, vec_id long, rough float")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rough"), "vec_id"))
        best, _ = written(found.withColumn("place", place).filter(F.col("place") <= rerank).select("query_id", "vec_id"), "candidates")
        pairs = best.join(rows.select("vec_id", "vector"), "vec_id").join(rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked")), "query_id")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(cosines(_matrix(part.column("asked")), _matrix(part.column("vector"))))], ["query_id", "vec_id", "score"])

        exact = pairs.select("query_id", "vec_id", "asked", "vector").mapInArrow(measure, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        ranked, path = written(exact.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
        hold(path)
    return ranked
