"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

Units are bytes, so the model needs no vocabulary and its tables grow with what a language's spelling
allows. Bytes alone don't see that a word is said over and over, so a word that repeats the one
before it is one unit of its own, which is rare in trusted texts.

n-grams of trusted texts are counted in their tasks, then summed by key; all lower orders,
continuation counts, context totals, discounts and probabilities are group-bys and equi-joins of
these count tables, sharded by key. Scoring joins the same tables, at every size of model and input:
tasks write their texts in compressed chunks of bounded size, each with its distinct n-grams, as a
table bucketed by chunk; the distinct n-grams of all chunks are joined with the sharded tables, order
by order; the bits found go back to the chunks that asked, and meet the chunk's texts there. What is
joined are distinct n-grams of chunks, not occurrences, and texts aren't shuffled.

Thresholds are quantiles, by language, of what trusted texts score under a model that was not trained
on them: texts fall into folds by a hash, and beside the model of all trusted texts there is one
without each fold. All of them are columns of the same tables, so they cost no further join.

An n-gram of bytes b1..bn is the integer of those bytes, highest first; texts begin after n - 1
zero bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispark.llm.shared import new_path, scratch, text_of, written

ORDER = 5
#: Texts with a perplexity above this quantile of their language's trusted texts are rejected.
QUANTILE = 0.995
#: Folds of the trusted texts, by a hash of the text; each is judged by a model without it.
FOLDS = 2
#: Bytes of text in a chunk and in one of its packets; a longer text is a packet of its own.
CHUNK, PACKET = 32 << 20, 1 << 19
#: Labelled ids up to which they are broadcast (8 bytes each) to find their texts.
BROADCAST_IDS = 2_000_000
UNIFORM = 1 / 256
#: The unit that stands for white space and the word before it once more.
AGAIN = b"\x01"
_REPEATS = re.compile(rb"(?<!\S)(\S+)((?:\s+\1)+)(?!\S)")


def units(text: bytes) -> bytes:
    """The text's units: its bytes, with a word's repetitions right after it as AGAIN each."""
    words = text.split()
    if not any(map(bytes.__eq__, words, words[1:])):
        return text
    return _REPEATS.sub(lambda m: m[1] + AGAIN * len(m[2].split()), text)


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, first n-gram of each text and the end): one n-gram for each unit."""
    pad = b"\0" * (order - 1)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(max(0, len(data) - order + 1), np.int64)
    for k in range(order):
        out = (out << 8) | data[k : len(data) - order + 1 + k]
    # the n-gram that ends at byte i of text t starts i bytes after the text's padding
    at = np.arange(begins[-1]) + np.repeat(np.arange(len(texts)) * (order - 1), sizes)
    return out[at], begins


def gram_blocks(texts: list[bytes], order: int, most: int = PACKET) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, n-grams, begins) of blocks of texts; a text longer than `most` comes in several
    blocks of its own, each but the first led by the units before it."""
    held, first, size = [], 0, 0
    for at, text in enumerate(texts):
        if held and size + len(text) > most:
            yield first, *grams_of(held, order)
            held, size = [], 0
        if len(text) > most:
            for start in range(0, len(text), most):
                led = text[max(0, start - order + 1) : start + most]
                grams, _ = grams_of([led], order)
                grams = grams[min(start, order - 1) :]
                yield at, grams, np.array([0, len(grams)])
            continue
        if not held:
            first = at
        held.append(text)
        size += len(text)
    if held:
        yield first, *grams_of(held, order)


def _slices(rows: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text, or of one longer text."""
    for batch in rows:
        start, size = 0, 0
        for at, value in enumerate(batch.column(text)):
            size += len(value.as_buffer()) if value.is_valid else 0
            if size >= most:
                yield batch.slice(start, at + 1 - start)
                start, size = at + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def fold_of(text: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(text, F.lit(folds)), F.lit(folds)).cast("int")


def count_grams(texts: DataFrame, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """(gram, c0, c1, ...) of all texts (one column, text): c0 counts all, the others all but a fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {f: [] for f in range(folds)}

        def merge(fold: int) -> tuple[np.ndarray, np.ndarray]:
            grams, counts = (np.concatenate(x) for x in zip(*held[fold]))
            unique, inverse = np.unique(grams, return_inverse=True)
            held[fold] = [(unique, np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64))]
            return held[fold][0]

        def flush(fold: int) -> pa.RecordBatch:
            grams, counts = merge(fold)
            held[fold] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), fold, np.int32)), pa.array(grams), pa.array(counts)], ["fold", "gram", "c"])

        for part in _slices(batches, "text", PACKET):
            of = part.column("fold").to_numpy()
            for fold in range(folds):
                own = [units(t.as_py()) for t in part.column("text").filter(pa.array(of == fold))]
                for _, grams, _ in gram_blocks(own, order):
                    held[fold].append(np.unique(grams, return_counts=True))
                if sum(len(g) for g, _ in held[fold]) > 1_000_000 and len(merge(fold)[0]) > 500_000:
                    yield flush(fold)
        for fold in range(folds):
            if held[fold]:
                yield flush(fold)

    text = text_of(texts.columns[0])
    counted = texts.select(fold_of(text, folds).alias("fold"), text.cast("binary").alias("text")).mapInArrow(run, "fold int, gram long, c long")
    without = (F.coalesce(F.sum(F.when(F.col("fold") != f, F.col("c"))), F.lit(0)).alias(f"c{f + 1}") for f in range(folds))
    return counted.groupBy("gram").agg(F.sum("c").alias("c0"), *without)


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))


def _discounts(counts: DataFrame, models: int = 1) -> list[list[float]]:
    """D1, D2, D3+ of the modified method, for each model, from the counts of counts."""
    n = counts.agg(*(F.coalesce(F.sum((F.col(f"c{k}") == c).cast("long")), F.lit(0)) for k in range(models) for c in (1, 2, 3, 4))).first()
    out = []
    for k in range(models):
        n1, n2, n3, n4 = n[4 * k : 4 * k + 4]
        if not n1 or not n2 or not n3:
            out.append([0.5, 0.75, 0.9])
            continue
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        out.append([min(max(d, 0.05), j - 0.05) for j, d in enumerate(found, 1)])
    return out


@dataclass
class KneserNey:
    """seen: (gram_order, gram, p0, p1, ...), the probability of each seen gram's last byte after the
    others; backoff: (gram_order, context, w0, w1, ...), what a context leaves to the order below.
    Column 0 is the model of all texts, the others are those without a fold, null where unseen."""

    order: int
    folds: int
    seen: DataFrame
    backoff: DataFrame

    @classmethod
    def train(cls, texts: DataFrame, order: int = ORDER, folds: int = FOLDS) -> KneserNey:
        models = range(folds + 1)
        counts, _ = written(count_grams(texts, order, folds), "ngram-counts")
        tables = {order: counts}
        for n in range(order - 1, 0, -1):  # continuation counts: how many bytes stand before a gram
            below = tables[n + 1].groupBy(_suffix(n).alias("gram")).agg(*(F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"c{k}") for k in models))
            tables[n], _ = written(below, "ngram-counts")
        seen, backoff, lower = [], [], None
        for n in range(1, order + 1):
            keyed = tables[n].withColumn("context", F.shiftright("gram", 8))
            for k, (d1, d2, d3) in enumerate(_discounts(tables[n], len(models))):
                c = F.col(f"c{k}")
                keyed = keyed.withColumn(f"d{k}", F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3))
            sums = (F.sum(f"{kind}{k}").alias(f"{name}{k}") for k in models for kind, name in (("c", "total"), ("d", "freed")))
            totals = keyed.groupBy("context").agg(*sums)
            joined = keyed.join(totals, "context")
            rest = [F.lit(UNIFORM)] * len(models)
            if lower is not None:
                below = lower.select(F.col("gram").alias("suffix"), *(F.col(f"p{k}").alias(f"below{k}") for k in models))
                joined = joined.withColumn("suffix", _suffix(n - 1)).join(below, "suffix")
                rest = [F.col(f"below{k}") for k in models]
            p = (F.when(F.col(f"c{k}") > 0, (F.col(f"c{k}") - F.col(f"d{k}") + F.col(f"freed{k}") * rest[k]) / F.col(f"total{k}")).alias(f"p{k}") for k in models)
            lower, _ = written(joined.select("gram", *p), "ngram-probabilities")
            seen.append(lower.select(F.lit(n).alias("gram_order"), "gram", *(f"p{k}" for k in models)))
            weights = (F.when(F.col(f"total{k}") > 0, F.col(f"freed{k}") / F.col(f"total{k}")).alias(f"w{k}") for k in models)
            backoff.append(totals.select(F.lit(n).alias("gram_order"), "context", *weights))
        union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
        return cls(order, folds, written(union(seen), "ngram-model")[0], written(union(backoff), "ngram-model")[0])

    def bits(self, grams: DataFrame) -> DataFrame:
        """(gram, b0, b1, ...) of distinct grams: -log2 of the probability of the last byte under each
        model. Each order joins the distinct suffixes asked for with its sharded tables and with the
        order below."""
        models, below = range(self.folds + 1), None
        for n in range(1, self.order + 1):
            asked = grams.select(_suffix(n).alias("gram")).distinct()
            seen = self.seen.filter(F.col("gram_order") == n).drop("gram_order")
            backoff = self.backoff.filter(F.col("gram_order") == n).drop("gram_order")
            found = asked.join(seen, "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(backoff, "context", "left")
            rest = [F.lit(UNIFORM)] * len(models)
            if below is not None:
                found, rest = found.withColumn("suffix", _suffix(n - 1)).join(below, "suffix"), [F.col(f"below{k}") for k in models]
            p = (F.coalesce(f"p{k}", F.coalesce(f"w{k}", F.lit(1.0)) * rest[k]).alias(f"below{k}") for k in models)
            below, _ = written(found.select(F.col("gram").alias("suffix"), *p), "gram-probabilities")
        return below.select(F.col("suffix").alias("gram"), *((-F.log2(f"below{k}")).alias(f"b{k}") for k in models))


def _packed(rows: DataFrame, order: int, chunk: int) -> DataFrame:
    """(chunk, seq, payload): rows (doc_id, others, text) in compressed packets, and, with seq -1, the
    distinct n-grams of each chunk. A chunk is what one task read, or about `chunk` bytes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        base, number, seq, size = TaskContext.get().partitionId() << 24, 0, 0, 0
        asked: list[np.ndarray] = []

        def row(at: int, payload: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([at], pa.int32()), pa.array([payload], pa.binary())], ["chunk", "seq", "payload"])

        def merge() -> np.ndarray:
            asked[:] = [np.unique(np.concatenate(asked))] if asked else [np.zeros(0, np.int64)]
            return asked[0]

        def questions() -> pa.RecordBatch:
            return row(-1, pack.compress(np.diff(merge(), prepend=0).tobytes()))

        for part in _slices(batches, "text", PACKET):
            texts = [units(t.as_py()) for t in part.column("text")]
            for _, grams, _ in gram_blocks(texts, order):
                asked.append(np.unique(grams))
                if len(asked) > 15:
                    merge()
            sink = pa.BufferOutputStream()
            names = [c for c in part.schema.names if c != "text"]
            sizes = pc.binary_length(part.column("text")).cast(pa.int64())
            own = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sizes, pa.array(texts, pa.large_binary())], [*names, "n_bytes", "units"])
            with pa.ipc.new_stream(sink, own.schema) as stream:
                stream.write_batch(own)
            yield row(seq, pack.compress(sink.getvalue()))
            seq, size = seq + 1, size + sum(map(len, texts))
            if size >= chunk:
                yield questions()
                number, seq, size = number + 1, 0, 0
                asked.clear()
        if seq:
            yield questions()

    return rows.mapInArrow(run, "chunk long, seq int, payload binary")


def _unpacked(payload: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(payload.as_py())


def _asked(packed: DataFrame) -> DataFrame:
    """(chunk, gram): the distinct n-grams of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload")):
                grams = np.cumsum(np.frombuffer(_unpacked(payload), np.int64))
                for at in range(0, len(grams), 1 << 16):
                    own = grams[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.array(own)], ["chunk", "gram"])

    return packed.filter("seq = -1").select("chunk", "payload").mapInArrow(run, "chunk long, gram long")


def _answers(found: DataFrame, models: int) -> DataFrame:
    """(chunk, answer): rows (chunk, gram, b0, ...), sorted by chunk in their partitions, as compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            grams, bits = batch.column("gram").to_numpy(), [batch.column(f"b{k}").to_numpy().astype(np.float32) for k in range(models)]
            edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)] if len(chunks) else []
            out = [pack.compress(b"".join([np.diff(grams[a:b], prepend=0).tobytes(), *(x[a:b].tobytes() for x in bits)])) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(chunks[edges[:-1]] if edges else chunks), pa.array(out, pa.binary())], ["chunk", "answer"])

    return found.mapInArrow(run, "chunk long, answer binary")


class _Answers:
    """The bits of a chunk's n-grams under each model, found by hash: entries of a slot stand in a row,
    and every n-gram looked up is among them."""

    def __init__(self, answers: pa.ChunkedArray, models: int):
        grams, bits = [np.zeros(0, np.int64)], [np.zeros((models, 0), np.float32)]
        for answer in answers:
            data = _unpacked(answer)
            many = len(data) // (8 + 4 * models)
            grams.append(np.cumsum(np.frombuffer(data, np.int64, many)))
            bits.append(np.frombuffer(data, np.float32, offset=8 * many).reshape(models, many))
        found = np.concatenate(grams)
        self.shift = np.uint64(64 - max(8, len(found).bit_length() + 1))
        slots = self._slots(found)
        by_slot = np.argsort(slots, kind="stable")
        self.grams, self.bits = found[by_slot], np.concatenate(bits, axis=1)[:, by_slot].astype(np.float64)
        self.heads = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << int(64 - self.shift)))]).astype(np.int32)

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int32)

    def at(self, asked: np.ndarray) -> np.ndarray:
        place = self.heads[self._slots(asked)]
        wrong = np.flatnonzero(self.grams[place] != asked)
        while len(wrong):
            place[wrong] += 1
            wrong = wrong[self.grams[place[wrong]] != asked[wrong]]
        return place


def _chunks_of(packed: DataFrame, buckets: int) -> DataFrame:
    """packed, written as a table bucketed by chunk, so that reading it for a join by chunk moves nothing.
    The table leaves the catalog at once; its files stay in the work folder."""
    spark = packed.sparkSession
    path = new_path(spark, "text-chunks")
    name = "lumispark_" + path.rsplit("-", 1)[1]
    packed.write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def perplexities(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """(doc_id, *keep, n_bytes, perplexity, without) of each row; perplexity is per unit, null for empty
    texts, without the same under the models without each fold.

    Tasks read about `chunk` bytes each where there is enough to keep all cores busy."""
    spark, models, order = docs.sparkSession, range(model.folds + 1), model.order
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, text_of(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(-(-total // chunk), spark.sparkContext.defaultParallelism)
    packed = _chunks_of(_packed(rows.coalesce(tasks), order, chunk), 4 * tasks)  # more buckets, so that few hold two chunks
    asked = _asked(packed)
    distinct, _ = written(asked.select("gram").distinct(), "distinct-grams")
    found = asked.join(model.bits(distinct), "gram").select("chunk", "gram", *(f"b{k}" for k in models)).sortWithinPartitions("chunk", "gram")
    names = ["doc_id", *keep, "n_bytes"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    schema = f"{kinds}, n_bytes long, units long, " + ", ".join(f"s{k} double" for k in models)

    def score(packets: pa.Table, answers: pa.Table) -> pa.Table:
        known, out = _Answers(answers.column("answer"), len(models)), []
        for payload in packets.column("payload"):
            part = pa.ipc.open_stream(_unpacked(payload)).read_next_batch()
            texts = part.column("units").to_pylist()
            total = np.zeros((len(models), part.num_rows))
            for first, own, begins in gram_blocks(texts, order):
                some, place = np.flatnonzero(np.diff(begins)), known.at(own)
                for k in models if len(some) else ():
                    total[k, first + some] += np.add.reduceat(known.bits[k][place], begins[some])
            columns = [*part.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), *(pa.array(total[k]) for k in models)]
            out.append(pa.RecordBatch.from_arrays(columns, [*names, "units", *(f"s{k}" for k in models)]))
        return pa.Table.from_batches(out) if out else pa.table({})

    texts = packed.filter("seq >= 0").groupBy("chunk")
    scored = texts.cogroup(_answers(found, len(models)).groupBy("chunk")).applyInArrow(score, schema)
    of = lambda k: F.when(F.col("units") > 0, F.pow(F.lit(2.0), F.col(f"s{k}") / F.col("units")))
    return scored.select(*names, of(0).alias("perplexity"), F.array(*(of(k) for k in models[1:])).alias("without"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id): ids labelled of good quality and not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()


def of_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Rows of docs whose id is among ids: these are broadcast if no more than broadcast_ids, else
    both sides are sorted by id."""
    small = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(ids.select(F.col("id").alias(id_col)).hint("broadcast" if small else "merge"), id_col, "left_semi")


def quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_bytes, perplexity, threshold, keep.

    Trusted rows are those labelled of good quality and not toxic. threshold: the quantile of what the
    trusted rows of the language score (null and unknown languages are each a language) under the
    model without their fold; where a language has none, of all trusted rows. keep: the perplexity
    under the model of all trusted texts is at most the threshold, so a tie is kept.

    Empty and null texts have no perplexity and aren't kept; without any trusted text there is no
    threshold and all others are kept. Very long texts are counted and scored whole, block by block.
    Repeated rows each get their row. An empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as hold:
        ids, _ = written(trusted_ids(labels), "trusted-ids")
        named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        model = KneserNey.train(of_ids(named, ids, "doc_id", broadcast_ids).select("text"), order)
        folded = named.withColumn("fold", fold_of(text_of("text"), model.folds))
        scored, path = written(perplexities(folded, model, keep=("lang", "fold")), "perplexities")
        hold(path)
        judged = of_ids(scored, ids, "doc_id", broadcast_ids).select("lang", F.get("without", "fold").alias("perplexity")).filter("perplexity IS NOT NULL")
        of = F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")
        by_lang, path = written(judged.groupBy(F.col("lang").alias("_lang")).agg(of), "thresholds")
        hold(path)
        overall = judged.agg(of).first()["threshold"]
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce(F.col("threshold"), F.lit(overall).cast("double"))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return joined.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
