"""Uniform shuffle into shards of exact sizes.

How many rows each input partition sends to each shard is drawn first, from
the hypergeometric law that a uniform shuffle of all rows would follow.  The
rows of a partition are then dealt to shards in a random order with exactly
these counts, exchanged, and put into a random order again inside the shard.

The matrix of counts is never written down.  A draw splits the partitions in
two halves and decides how much of every shard the left half gets; a task
repeats the draws on the way from all partitions to its own, which are as many
as the partition count has binary digits.  Only the row counts of partitions
are sent to tasks: eight bytes a partition.

Inside a shard, rows are ordered by random numbers.  Buckets of their leading
bits, a few thousand rows each, are sorted on their own and follow one another
by their counts, so no task sees a whole shard.

Defined results: shard sizes differ by at most one row, the first shards being
larger.  A null text has zero bytes and the checksum of an empty text.  Rows
with null, equal or repeated ids are rows like any other; equal texts may go to
different shards.  With fewer rows than shards the last shards are empty; an
empty table gives an empty result.  Columns that the input has besides id and
text are carried along by :func:`shard_rows`, unless they bear the names
``shard`` or ``slot``, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pinned

#: Rows of a bucket inside a shard, on average.
BUCKET_ROWS = 5_000
#: Largest population that numpy draws from.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric number, for populations of any size.

    Beyond numpy's limit the distribution is inverted around its mode, over
    the range that holds all but 1e-30 of the mass.
    """
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    spread = math.sqrt(draws * share * (1 - share) * (total - draws) / max(total - 1, 1))
    reach = int(12 * spread) + 50
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    ends = np.cumsum(weights)
    return first + int(np.searchsorted(ends, rng.random() * ends[-1], side="right"))


def split_shards(rng: np.random.Generator, capacity: list[int], draws: int) -> list[int]:
    """How many of ``draws`` rows fall into shards of these free sizes."""
    left, taken = sum(capacity), []
    for size in capacity:
        left -= size
        got = hypergeometric(rng, size, left, draws)
        taken.append(got)
        draws -= got
    return taken


def partition_row(counts: np.ndarray, sizes: list[int], partition: int, seed: int) -> list[int]:
    """One row of the communication matrix: rows of ``partition`` by shard."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    low, high, held = 0, len(counts), list(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split_shards(rng, held, int(ends[middle] - ends[low]))
        if partition < middle:
            high, held = middle, left
        else:
            low, held = middle, [a - b for a, b in zip(held, left)]
    return held


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def shard_rows(df: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, its place in the shard from 0.

    The input is checkpointed first: the draws belong to its partitions and to
    the order of rows in them, which must be the same whenever a task reruns.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    rows = pinned(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]))
    counted = rows.groupBy(F.spark_partition_id().alias("partition")).count().collect()  # a row per partition
    counts = np.zeros(max([row["partition"] + 1 for row in counted], default=1), dtype=np.int64)
    for row in counted:
        counts[row["partition"]] = row["count"]
    total = int(counts.sum())
    sizes = shard_sizes(total, shards)
    held = spark.sparkContext.broadcast(counts)
    buckets = max(1, -(-total // (shards * bucket_rows)))
    kept = rows.schema.fields

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        if partition >= len(held.value):
            return
        rng = np.random.default_rng([seed, partition, 1])
        targets = np.repeat(np.arange(shards, dtype=np.int32), partition_row(held.value, sizes, partition, seed))
        rng.shuffle(targets)
        at = 0
        for batch in batches:
            n = batch.num_rows
            ticket = rng.integers(0, 1 << 62, n)
            made = (
                targets[at : at + n],
                ticket,
                ticket % buckets,
                np.full(n, partition, dtype=np.int32),
                np.arange(at, at + n),
            )
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], schema.names)

    added = [
        T.StructField("_shard", T.IntegerType()),
        T.StructField("_ticket", T.LongType()),
        T.StructField("_bucket", T.LongType()),
        T.StructField("_from", T.IntegerType()),
        T.StructField("_at", T.LongType()),
    ]
    schema = T.StructType([*kept, *added])
    dealt = rows.mapInArrow(deal, schema)
    own = Window.partitionBy("_shard", "_bucket").orderBy("_ticket", "_from", "_at")
    starts = (
        dealt.groupBy("_shard", "_bucket")
        .count()
        .select(
            F.col("_shard").alias("_s"),
            F.col("_bucket").alias("_b"),
            (F.sum("count").over(Window.partitionBy("_shard").orderBy("_bucket")) - F.col("count")).alias("_start"),
        )
    )
    placed = dealt.withColumn("_own", F.row_number().over(own).cast("long") - 1)
    return placed.join(starts, (F.col("_shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b"))).select(
        *[F.col(f.name).alias(name) for f, name in zip(kept, names)], F.col("_shard").alias("shard"), (F.col("_own") + F.col("_start")).alias("slot")
    )
