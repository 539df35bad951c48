"""What several corpus operators need: lineage cuts, sizes and column intake."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that may be sent to every executor.
BROADCAST_BYTES = 4 << 20

#: ASCII letters; only these are changed by :func:`lower_ascii`.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a local master gets a temporary folder and
    any other master one below the warehouse, which its executors share too.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder and re.fullmatch(r"local(\[.*\])?", context.master):
        folder = tempfile.mkdtemp(prefix="panelweave-")
    elif not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/lineage"
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: rows, partitions and their
    order stay as they are, whatever executor is lost later."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that
    later readers prune columns and skip row groups."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a written table.

    A checkpoint would do, but it hands the constraints of its plan on to what
    is built on it; over the rounds of a loop they multiply until planning
    fills the driver.
    """
    return stored(df, "step")


def taken(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Only ``columns``, under the operator's own names: whatever else the
    input carries can then not clash with columns made later."""
    return df.select(*[value.alias(name) for name, value in columns.items()])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows fit :data:`BROADCAST_BYTES`
    at ``row_bytes`` each; otherwise leave the join to a shuffle."""
    limit = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Characters that a Python task works on at once.
SLICE_CHARS = 1 << 20


def text_slices(texts: Iterable[str], limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters together, at least one."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
