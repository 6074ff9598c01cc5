"""TIFF as Spark data sources: spark.read.format("tiff_pages").load(path), a writer beside it, and
spark.readStream.format("tiff_pages") for folders that fill up.

A task reads a file's directories first and then only the samples of its own pages; large files are
split into ranges of pages. Which frames, slices or channels to read is an option of the load (only_t,
only_z, only_c), not a pushed filter: a reader keeps what was pushed to it, and a second query on the
same DataFrame would then miss pages. Files are opened through Python, so paths have to be mounted on
driver and executors; sources.images reads any path.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lumispark.sources import tiff
from lumispark.sources.images import axes_of, to_array

SCHEMA = "image_id string, path string, t int, z int, c int, height int, width int, samples int, dtype string, data binary"
STREAM = f"{SCHEMA}, flag string, error string"
#: Bytes of a file that a task takes, and files of a batch of the stream, unless options say otherwise.
SPLIT, FILES_A_BATCH = 1 << 27, 1000


class TiffPages(DataSource):
    """Options: axes ("tzc"), frames, slices, channels, pattern ("*.tif"), only_t, only_z, only_c ("0,2"),
    split_bytes; for streams log (a shared folder of the stream's own) and files_a_batch.

    A batch fails with a damaged file. A stream has flag and error beside each page: "ok", or one row
    with "IMAGE FAILED" and none of the pages; split it by the flag."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return STREAM if "log" in self.options else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TiffReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TiffStream(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TiffWriter(self.options["path"])


@dataclass
class Share(InputPartition):
    """Pages of a file whose number lies in one of `of` equal ranges; of = 1 is the whole file."""

    path: str
    nth: int = 0
    of: int = 1


class Pages:
    """What a load reads: files, and the pages of a share of one."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.only = {k: {int(v) for v in options[f"only_{k}"].split(",")} for k in "tzc" if options.get(f"only_{k}")}

    def found(self) -> list[str]:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        return [path] if os.path.isfile(path) else sorted(glob.glob(os.path.join(path, "**", self.options.get("pattern", "*.tif")), recursive=True))

    def rows(self, data: bytes | tiff.Ranges, share: Share) -> Iterator[tuple]:
        pages = tiff.read_pages(data)
        axes = self.options.get("axes", "tzc")
        given = {k: int(self.options.get(n, 0)) for k, n in (("t", "frames"), ("z", "slices"), ("c", "channels"))}
        shape = dict(zip("tzc", axes_of(pages, axes, given)))
        for number in range(share.nth * len(pages) // share.of, (share.nth + 1) * len(pages) // share.of):
            at, place = {}, number
            for k in reversed(axes):
                at[k], place = place % shape[k], place // shape[k]
            if all(at[k] in wanted for k, wanted in self.only.items()):
                plane = pages[number].array()
                yield (os.path.basename(share.path), share.path, at["t"], at["z"], at["c"], plane.shape[0], plane.shape[1], plane.shape[2] if plane.ndim > 2 else 1, plane.dtype.str, plane.tobytes())


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages = Pages(options)

    def partitions(self) -> Sequence[InputPartition]:
        split = int(self.pages.options.get("split_bytes", SPLIT))
        shares = [(p, max(1, -(-os.path.getsize(p) // split))) for p in self.pages.found()]
        return [Share(p, k, many) for p, many in shares for k in range(many)]

    def read(self, partition: Share) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            yield from self.pages.rows(tiff.Ranges(file), partition)


class TiffStream(DataSourceStreamReader):
    """A stream of the files that come into a folder, each once.

    An offset is a number of batches. Which files a batch has stands in the log folder, one file of names
    for each batch, written whole before its offset is handed out; so a restart plans the same batches
    again, reads no file twice and misses none, whatever times the files carry. Files have to appear whole
    (move them in); a file that is written again under its name isn't looked at again. The folder belongs
    to one stream and its checkpoint."""

    def __init__(self, options: dict[str, str]):
        self.pages, self.log = Pages(options), options["log"].removeprefix("file://").removeprefix("file:")

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def _batch(self, number: int) -> str:
        return os.path.join(self.log, f"{number:09d}.json")

    def _names(self, number: int) -> list[str]:
        with open(self._batch(number), encoding="utf-8") as file:
            return json.load(file)

    def latestOffset(self) -> dict:
        os.makedirs(self.log, exist_ok=True)
        many = len([n for n in os.listdir(self.log) if n.endswith(".json")])
        seen = {p for k in range(many) for p in self._names(k)}
        new = [p for p in self.pages.found() if p not in seen]
        step = int(self.pages.options.get("files_a_batch", FILES_A_BATCH))
        for low in range(0, len(new), step):
            part = os.path.join(self.log, f".{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8") as file:
                json.dump(new[low : low + step], file)
            os.replace(part, self._batch(many))
            many += 1
        return {"batches": many}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Share(p) for k in range(start["batches"], end["batches"]) for p in self._names(k)]

    def read(self, partition: Share) -> Iterator[tuple]:
        try:
            with open(partition.path, "rb") as file:
                rows = list(self.pages.rows(tiff.Ranges(file), partition))  # all of a file before any of it
        except Exception as e:  # noqa: BLE001
            rows, error = [], f"{type(e).__name__}: {e}"
            yield (os.path.basename(partition.path), partition.path, *[None] * 8, "IMAGE FAILED", error)
        for row in rows:
            yield (*row, "ok", None)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (place of the part, name that it is to have)."""

    parts: list[tuple[str, str]]


class TiffWriter(DataSourceWriter):
    """Writes one file for each image that a partition holds; repartition by image_id first.

    Tasks write parts under names of their own. They get their names once all tasks are done, so a
    task that runs twice leaves one file, and a failed write none; two tasks with one image fail it."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import numpy as np

        held: dict[str, list] = {}
        for row in iterator:
            held.setdefault(row.image_id, []).append(row)
        os.makedirs(self.path, exist_ok=True)
        parts = []
        for name, rows in held.items():
            rows.sort(key=lambda r: (r.t, r.z, r.c))
            stack = np.stack([to_array(r.dtype, r.height, r.width, r.samples, r.data) for r in rows])
            counts = [len({getattr(r, k) for r in rows}) for k in "tzc"]
            note = "ImageJ=1.53\nimages={}\nframes={}\nslices={}\nchannels={}\n".format(len(rows), *counts)
            part = os.path.join(self.path, f".{uuid.uuid4().hex}.part")
            with open(part, "wb") as file:
                file.write(tiff.write_stack(stack, note))
            parts.append((part, os.path.basename(name)))
        return Written(parts)

    def commit(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        parts = [p for m in messages if m for p in m.parts]
        names = [name for _, name in parts]
        if twice := sorted({n for n in names if names.count(n) > 1})[:5] if len(set(names)) < len(names) else []:
            self.abort(messages)
            raise ValueError(f"more than one task or folder has {twice}: repartition by image_id, one name an image")
        for part, name in parts:
            os.replace(part, os.path.join(self.path, name))

    def abort(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        for part, _ in (p for m in messages if m for p in m.parts):
            if os.path.exists(part):
                os.remove(part)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiffPages)
