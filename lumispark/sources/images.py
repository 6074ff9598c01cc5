"""Image files as DataFrames: one row per plane, or per pixel.

Files are found and read by Spark's binary reader, so any path Spark can open will do, and decoded
in Arrow batches. Channel, slice and frame are filters on page numbers: planes that a query leaves
out are not decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.functions.classify import movie_key, natural_key
from lumispark.sources import tiff

PLANE = "image_id string, path string, t int, z int, c int, height int, width int, samples int, dtype string, data binary, px_um double, py_um double, pz_um double, tags map<string,string>"
STATUS = "image_id string, path string, flag string, error string"
#: Bytes of planes, and pixels, that are handed on together.
HELD, SPREAD = 1 << 25, 1 << 18


def files(spark: SparkSession, root: str, pattern: str = "*.tif", recursive: bool = True) -> DataFrame:
    """(path, filename, content) of the files below a folder, or in it."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(root) if recursive else reader.load(f"{root.rstrip('/')}/{pattern}")
    return found.select("path", base_name(F.col("path")).alias("filename"), "content")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def axes_of(pages: list[tiff.Page], axes: str, sizes: dict[str, int]) -> tuple[int, int, int]:
    """(frames, slices, channels): given sizes, else those of the description, else what is left on the first axis."""
    note = tiff.settings(pages[0])
    known = {k: sizes.get(k) or int(note.get(name, 0) or 0) for k, name in (("t", "frames"), ("z", "slices"), ("c", "channels"))}
    left = len(pages)
    for k in axes[1:]:
        known[k] = known[k] or 1
        left //= known[k]
    known[axes[0]] = max(1, left)
    if known["t"] * known["z"] * known["c"] != len(pages):
        raise ValueError(f"{len(pages)} pages don't make {known}")
    return known["t"], known["z"], known["c"]


def planes(found: DataFrame, axes: str = "tzc", sizes: dict[str, int] | None = None, only: dict[str, set[int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(planes, status) of files(): one row per page, and one per file with flag "ok" or "IMAGE FAILED".

    axes: the order of pages, slowest first. only: frames, slices or channels to decode. A file of which a
    wanted page can't be decoded gives no plane, so nothing is measured on part of it."""
    sizes, only = sizes or {}, only or {}

    def pages_of(pages: list[tiff.Page]) -> Iterator[tuple[int, int, int, tiff.Page]]:
        shape = dict(zip("tzc", axes_of(pages, axes, sizes)))
        for number, page in enumerate(pages):
            at, place = {}, number
            for k in reversed(axes):
                at[k], place = place % shape[k], place // shape[k]
            if all(at[k] in wanted for k, wanted in only.items()):
                yield at["t"], at["z"], at["c"], page

    def rows_of(found: Iterator[tuple]) -> Iterator[dict]:
        for path, name, content in found:
            try:
                pages = tiff.read_pages(content)
                tags, (px, py, pz) = tiff.named_tags(pages[0]), tiff.spacing(pages[0])
                # all of a file before any of it: a file with one damaged page gives no plane at all
                whole = [(t, z, c, page.array()) for t, z, c, page in pages_of(pages)]
            except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error):
                continue  # the status table has the reason
            for t, z, c, plane in whole:
                yield {
                    "image_id": name, "path": path, "t": t, "z": z, "c": c, "height": plane.shape[0], "width": plane.shape[1], "samples": plane.shape[2] if plane.ndim > 2 else 1,
                    "dtype": plane.dtype.str, "data": plane.tobytes(), "px_um": px, "py_um": py, "pz_um": pz, "tags": tags,
                }

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for row in rows_of(batch.itertuples(index=False, name=None)):
                held.append(row)
                size += len(row["data"])
                if size >= HELD:
                    yield pd.DataFrame(held)
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, name, content in batch.itertuples(index=False, name=None):
                flag, error = "ok", None
                try:
                    for *_, page in pages_of(tiff.read_pages(content)):
                        page.array()
                except Exception as e:  # noqa: BLE001
                    flag, error = "IMAGE FAILED", f"{type(e).__name__}: {e}"
                out.append({"image_id": name, "path": path, "flag": flag, "error": error})
            if out:
                yield pd.DataFrame(out)

    return found.mapInPandas(decode, PLANE), found.mapInPandas(judge, STATUS)


def to_array(dtype: str, height: int, width: int, samples: int, data: bytes) -> np.ndarray:
    out = np.frombuffer(data, dtype).reshape(height, width, samples)
    return out[:, :, 0] if samples == 1 else out


def _stacked(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})


def pixels(planes_of: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per pixel and sample: (image_id, t, z, c, y, x, v) and the plane's carried columns of doubles;
    samples of one page count as channels."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size, shape = [], 0, None
            for row in batch.itertuples(index=False):
                plane = np.frombuffer(row.data, row.dtype).reshape(row.height, row.width, row.samples)
                if plane.shape != shape:
                    shape = plane.shape
                    y, x, s = (i.ravel() for i in np.indices(shape))
                many = plane.size
                head = {"image_id": np.full(many, row.image_id, object), "t": np.full(many, row.t), "z": np.full(many, row.z), "c": row.c + s if row.samples > 1 else np.full(many, row.c)}
                held.append(head | {"y": y, "x": x, "v": plane.ravel().astype(float)} | {k: np.full(many, getattr(row, k), float) for k in carried})
                size += many
                if size >= SPREAD:
                    yield _stacked(held)
                    held, size = [], 0
            if held:
                yield _stacked(held)

    kept = planes_of.select("image_id", "t", "z", "c", "height", "width", "samples", "dtype", "data", *carried)
    return kept.mapInPandas(spread, "image_id string, t int, z int, c int, y int, x int, v double" + "".join(f", {k} double" for k in carried))


def as_movies(planes_of: DataFrame, marker: str = "T") -> DataFrame:
    """Planes of single-frame files with image_id set to their movie and t to their place in it, in
    natural order of the number after the marker; equal names go by path. No pixel is moved."""
    named = planes_of.select("path").distinct().withColumn("_name", base_name(F.col("path")))
    keyed = named.withColumn("_movie", F.regexp_replace(movie_key(F.col("_name")), r"\.[^.]*$", ""))
    placed = keyed.withColumn("_t", (F.row_number().over(Window.partitionBy("_movie").orderBy(natural_key(F.col("_name"), marker), "_name", "path")) - 1).cast("int"))
    out = planes_of.join(placed.select("path", "_movie", "_t"), "path")
    return out.select(*(F.col("_movie").alias(c) if c == "image_id" else F.col("_t").alias(c) if c == "t" else F.col(c) for c in planes_of.columns))


def stack_files(planes_of: DataFrame, text: str = "") -> DataFrame:
    """(image_id, content): each image's planes as one multi-page file, in order of t, z, c.

    One stack must fit a task's memory. Store content with the writer of your choice."""

    def pack(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: (r["t"], r["z"], r["c"]))
        stack = np.stack([to_array(r["dtype"], r["height"], r["width"], r["samples"], r["data"]) for r in rows])
        frames, slices, channels = (len({r[k] for r in rows}) for k in "tzc")
        note = f"ImageJ=1.53\nimages={len(stack)}\nframes={frames}\nslices={slices}\nchannels={channels}\n{text}"
        px = rows[0]["px_um"]
        file = tiff.write_stack(stack, note, None if px is None or np.isnan(px) else float(px))
        return pa.table({"image_id": pa.array([rows[0]["image_id"]], pa.string()), "content": pa.array([file], pa.binary())})

    parts = planes_of.select("image_id", "t", "z", "c", "height", "width", "samples", "dtype", "data", "px_um")
    return parts.groupBy("image_id").applyInArrow(pack, "image_id string, content binary")
