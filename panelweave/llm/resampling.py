"""Resampling of a corpus towards the distribution of a target.

Features are runs of words hashed into buckets.  Counting them in the corpus
and in the target gives an array of gains, one integer per bucket: how much
more common the bucket is in the target.  A document's weight is the mean gain
of its features, its score the weight plus Gumbel noise drawn from its id, and
the highest scores are a draw without replacement in proportion to the weights.

The draw sorts in parallel by regular sampling.  Every partition is a sorted
run that gives keys at regular places.  These samples are merged and thinned
in a tree, a bounded number of runs a task, into splitters; every run is cut at
the splitters, segments of one range meet in one partition and are merged
there, and the counts of the ranges before give exact ranks.  Ranges that lie
wholly behind the draw are not exchanged.  The key ends with a number of the
written row, so no two rows are equal and rows that repeat a third of the table
can be split; a range holds at most about twice its share of rows.

The driver receives the bucket counts (as many as there are buckets), the
splitters and the counts of the ranges, some :data:`RANGE_ROWS` rows each.

Defined results: A-Z are lower-cased and words are maximal runs of digits, a-z
and bytes beyond ASCII.  Null, empty and wordless texts have no features and a
weight of 0.  Mean and logarithms are floored.  A null id is drawn with the
noise of the text ``null`` and follows all ids at equal score; rows equal in
score and id are ordered by a hash of the text, and rows equal in that too are
interchangeable.  Repeated rows are rows of their own.  An empty corpus gives
an empty result; an empty target gives gains from the smoothing alone.  Columns
named in ``carry`` pass unchanged, whatever their names; all others are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import stored

#: Rows of a range of the sort, at most twice as many.
RANGE_ROWS = 1_000_000
#: Runs whose samples are merged in one task.
FAN_IN = 64
#: Bytes of a text that are cut into words at once.
PART_BYTES = 1 << 20
#: Letters become small, and what is not in a word becomes a space.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_KEY = ("score", "doc_id", "text_key", "row")


@dataclass(frozen=True)
class Options:
    run_words: int = 1  #: the longest run of words that is a feature
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20  #: a shorter document is never drawn
    percent: int = 10  #: of the documents that can be drawn


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, a bounded number of bytes at a time."""
    at = 0
    while at < len(raw):
        stop = at + PART_BYTES
        while stop < len(raw) and _TO_WORDS[raw[stop]] != 0x20:
            stop += 1
        yield raw[at:stop].translate(_TO_WORDS).split()
        at = stop


def feature_buckets(raw: bytes, options: Options) -> tuple[int, list[np.ndarray]]:
    """Number of words, and the buckets of all features in several arrays."""
    count, found, tail = 0, [], []
    for words in word_lists(raw):
        count += len(words)
        held = tail + words
        for size in range(1, options.run_words + 1):
            new = held[max(0, len(tail) - size + 1) :]  # runs that end in this part
            runs = new if size == 1 else [b" ".join(new[i : i + size]) for i in range(len(new) - size + 1)]
            found.append(np.fromiter(map(zlib.crc32, runs), dtype=np.int64, count=len(runs)) % options.buckets)
        tail = held[len(held) - options.run_words + 1 :] if options.run_words > 1 else []
    return count, found


def _raw(column: pa.Array) -> Iterable[bytes]:
    return (value.as_buffer().to_pybytes() if value.is_valid else b"" for value in column.cast(pa.binary()))


def bucket_counts(df: DataFrame, text_col: str, options: Options) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(options.buckets, dtype=np.int64)
        held, size = [], 0
        for batch in batches:
            for raw in _raw(batch.column(0)):
                held += feature_buckets(raw, options)[1]
                size += len(raw)
                if size >= PART_BYTES:
                    total += np.bincount(np.concatenate(held), minlength=options.buckets)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=options.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = df.select(F.col(text_col).alias("text")).mapInArrow(work, "bucket long, n long")
    total = np.zeros(options.buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored gain of each bucket, in thousandths."""
    all_s, all_t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source.tolist(), target.tolist())],
        dtype=np.int64,
    )


def score_documents(
    df: DataFrame, gains: np.ndarray, options: Options, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``,
    ``text_key`` and the carried columns as ``c0``, ``c1``, ..."""
    name = F.concat(F.lit(f"{options.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        noise.cast("long").alias("noise"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)],
    )
    made = ["n_words", "n_features", "weight", "score"]
    kept = ["doc_id", "text_key", *[f"c{i}" for i in range(len(carry))]]
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in made]])
    held = df.sparkSession.sparkContext.broadcast(gains)  # as long as there are buckets

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            out = []
            for raw in _raw(batch.column("text")):
                words, found = feature_buckets(raw, options)
                count = sum(map(len, found))
                out.append((words, count, int(sum(int(gain[f].sum()) for f in found)) // count if count else 0))
            words, counts, weights = (np.array([o[i] for o in out], dtype=np.int64) for i in range(3))
            scores = weights + batch.column("noise").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *map(pa.array, (words, counts, weights, scores))], schema.names
            )

    return rows.mapInArrow(work, schema)


def sort_keys(batch: pa.RecordBatch) -> list[tuple]:
    """Sort keys of rows: higher scores first, then ids, the null one last."""
    score, doc_id, text_key, row = (batch.column(c).to_pylist() for c in _KEY)
    return [(-s, d is None, d, t, r) for s, d, t, r in zip(score, doc_id, text_key, row)]


def _thinned(rows: Iterable[tuple], share: int) -> Iterator[tuple]:
    """Of rows in order with their counts, those that end a share of rows."""
    held = 0
    for row, count in rows:
        held += count
        if held >= share:
            yield row, held
            held = 0


def regular_splitters(runs: DataFrame, rows: int, ranges: int, fan_in: int = FAN_IN) -> list[tuple]:
    """Keys that cut the rows of all runs into about ``ranges`` equal parts.

    ``runs`` has the columns of the key, sorted within partitions.  A run gives
    one key for each :math:`1/(2 ranges)` of the rows of an average run.
    """
    if rows == 0 or ranges < 2:
        return []
    sample = T.StructType(
        [runs.schema[c] for c in _KEY] + [T.StructField("count", T.LongType()), T.StructField("run", T.IntegerType())]
    )
    count = max(1, runs.rdd.getNumPartitions())
    # A finer share at each level keeps what the levels blur below one range.
    share = max(1, rows // (4 * ranges * count))

    def batch_of(found: list[tuple], run: int) -> pa.RecordBatch:
        made = [[-k[0] for k, _ in found], [k[2] for k, _ in found], [k[3] for k, _ in found], [k[4] for k, _ in found]]
        types = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in sample.fields])
        columns = [*made, [c for _, c in found], [run] * len(found)]
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(columns, types)], sample.names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        held = [0]

        def keys() -> Iterator[tuple]:
            for batch in batches:
                yield from ((k, 1) for k in sort_keys(batch))

        yield batch_of(list(_thinned(keys(), share)), run // fan_in)

    samples = runs.select(*_KEY).mapInArrow(first, sample)
    width = 1
    while True:
        count = -(-count // fan_in)
        width *= fan_in
        level = max(1, share * width) if count > 1 else max(1, rows // ranges)

        def merge(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            found, run = [], 0
            for batch in batches:
                found += zip(sort_keys(batch), batch.column("count").to_pylist())
                run = batch.column("run")[0].as_py() if batch.num_rows else run
            found.sort()
            yield batch_of(list(_thinned(found, level)), run // fan_in)

        samples = samples.repartitionById(count, "run").mapInArrow(merge, sample)
        if count == 1:
            break
    ends = samples.select(*_KEY).collect()  # one key a range
    return sorted((-r["score"], r["doc_id"] is None, r["doc_id"], r["text_key"], r["row"]) for r in ends)


def rank_rows(scored: DataFrame, options: Options, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``scored`` with ``rank``, null for rows that are not drawn."""
    spark = scored.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_key").asc(), F.col("row").asc()]
    # The numbers are written with the rows, so they stay what they are.
    rows = stored(scored.withColumn("row", F.monotonically_increasing_id()).sortWithinPartitions(*order), "scores")
    able = rows.where(F.col("n_words") >= options.least_words)
    total = able.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_rows)) if total else 1
    runs = able.sortWithinPartitions(*order)  # a split may hold the files of several runs
    held = spark.sparkContext.broadcast(regular_splitters(runs, total, ranges))
    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())])
    least = options.least_words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = held.value
        for batch in batches:
            able = np.asarray(batch.column("n_words")) >= least
            found = [bisect.bisect_left(ends, k) if a else None for k, a in zip(sort_keys(batch), able)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], schema.names)

    placed = stored(rows.mapInArrow(cut, schema), "ranges")
    counts = np.zeros(len(held.value) + 1, dtype=np.int64)
    for row in placed.where("range is not null").groupBy("range").count().collect():  # a row a range
        counts[row["range"]] = row["count"]
    starts = np.concatenate([[0], np.cumsum(counts)])
    drawn = options.percent * total // 100
    last = int(np.searchsorted(starts, drawn)) if drawn else 0  # ranges from here on lie behind the draw
    plain = [f.name for f in scored.schema.fields]
    ranked = T.StructType([*scored.schema.fields, T.StructField("rank", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            own = np.asarray(batch.column("range"))
            rank = np.empty(len(own), dtype=np.int64)
            for k in np.unique(own).tolist():  # sorted by range, so these are runs
                at = np.flatnonzero(own == k)
                rank[at] = starts[k] + seen.get(k, 0) + np.arange(1, len(at) + 1)
                seen[k] = seen.get(k, 0) + len(at)
            column = pa.array(rank, mask=rank > drawn)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], column], ranked.names)

    within = F.coalesce(F.col("range") < last, F.lit(False))
    sent = placed.where(within).repartitionById(max(last, 1), "range").sortWithinPartitions("range", *order)
    rest = placed.where(~within).select(*plain, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(sent.mapInArrow(number, ranked))


def resample(
    df: DataFrame,
    target: DataFrame,
    options: Options = Options(),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    carry: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Every row of ``df`` as ``doc_id``, ``n_words``, ``n_features``,
    ``weight``, ``score``, ``rank`` (1 and up for drawn rows, else null), then
    the carried columns."""
    gains = bucket_gains(bucket_counts(df, text_col, options), bucket_counts(target, target_text_col, options))
    ranked = rank_rows(score_documents(df, gains, options, id_col, text_col, carry), options, range_rows)
    own = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return ranked.select(*own, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
