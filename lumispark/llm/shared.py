"""What the corpus operators share: the work folder, written intermediates, id filters."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}
_open: ContextVar[list[str] | None] = ContextVar("open scratch", default=None)


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lumispark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint
    folder. Only a local master may go without either: it gets a temporary folder of its own."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folders.get(context.applicationId) or _own_folders.setdefault(context.applicationId, _own_folder())
    return base.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediates of this application."""
    return f"{shared_folder(spark)}/lumispark-{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Remove all intermediates of this application; frames that operators returned can't be read after it."""
    drop_path(spark, work_folder(spark))


def new_path(spark: SparkSession, tag: str) -> str:
    """A path for one intermediate; the scratch block it is asked for in removes it."""
    path = f"{work_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    if (held := _open.get()) is not None:
        held.append(path)
    return path


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df once as a Parquet table and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Remove what is written inside the block at its end, but for paths given to the function it
    yields; those belong to the block around it, if there is one."""
    outer, own, kept = _open.get(), [], set()
    token = _open.set(own)
    try:
        yield kept.add
    finally:
        _open.reset(token)
        for path in own:
            if path not in kept:
                drop_path(spark, path)
        if outer is not None:
            outer.extend(kept)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id occurs in ids (one column); rows without an id stay, as no decision names them."""
    known = docs.filter(F.col(id_col).isNotNull()).join(ids.select(id_col).distinct(), id_col, "left_semi")
    return known.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows that come first in a fixed hash order of their keys; all, if they are fewer.

    Rows far behind in that order are left out before the sort, so that what tasks send on stays
    near `most` rows in all, however many tasks there are.
    """
    many, space = rows.count(), 1 << 31
    if many > 4 * most:
        rows = rows.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(space)) < F.lit(int(space * 2 * most / many)))
    return rows.orderBy(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(space)), key).limit(most)
