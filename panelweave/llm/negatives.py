"""Hard negatives for anchors, by pruned inner-product search.

All rows lie in blocks of similar length, longest first, and a block keeps for
each coordinate the list of its unit vectors sorted by that coordinate.  For an
anchor and a least score, the longest vector of a block gives a least cosine.
If it is above one, the block has no answer.  Otherwise a unit vector can reach
it only if, in each coordinate, it lies within an angle of the anchor's unit
vector that the cosine allows; for the anchor's largest coordinates (the focus)
these ranges are looked up in the sorted lists and intersected.  What is left is
verified by exact integer scores.

The least score rises as answers are found.  A task takes a block of anchors
through every ``strips``-th block of rows, longest first, one block in memory at
a time, and hands over the best few of each anchor; those of all strips are
merged by a grouped aggregate.  The first pass finds positives of the anchor's
own label, the second rows of other labels whose scores lie in the range that a
positive sets.  Anchors are a fixed share of the rows, so the work is that of
the asked search, blocks against blocks; what is sent is each block of rows once
for every block of anchors.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part.  Vectors of different lengths are compared as if the
shorter one went on with zeros.  Scores are exact; beyond the range of a long
they are held at its ends.  Rows with equal score are ordered by id, a null id
last, then by the place of the row in the table as written.  A row is
never its own positive, another row with the same id may be.  A null id is no
anchor.  An anchor without positives, or a positive without rows in its range,
gives no row.  Repeated anchors give their rows each.  Other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .resampling import regular_splitters, sort_keys
from .shared import stored

_LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Options:
    positives: int = 5  #: rows of the anchor's label that count as positives
    negatives: int = 3  #: rows returned for each of them
    least_percent: int = 50  #: of a positive's score that a negative reaches
    most_percent: int = 95  #: of a positive's score that a negative may reach
    focus: int = 5  #: coordinates of an anchor whose lists are intersected
    block_cells: int = 1 << 18  #: numbers in a block of rows
    anchor_cells: int = 1 << 17  #: numbers in a block of anchors


#: Of an anchor, the least and the highest score asked for each positive.
SPANS = T.ArrayType(T.ArrayType(T.LongType()))
BLOCK = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("rows", T.ArrayType(T.LongType())),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("width", T.IntegerType()),
        T.StructField("vectors", T.BinaryType()),
        T.StructField("spans", T.ArrayType(SPANS)),
    ]
)


def usable(df: DataFrame, label_col: str, vector_col: str) -> DataFrame:
    """The rows that take part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of whole numbers as rows, filled up with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, vector in zip(out, vectors):
        row[: len(vector)] = vector
    return out


def packed(rows: DataFrame, partition: str, size: int) -> DataFrame:
    """:data:`BLOCK` rows from partitions of ``row, id, label, vector, spans``;
    a partition gives blocks of at most ``size`` rows, numbered by ``part``."""

    def block(index: int, part: int, held: list[list]) -> pa.RecordBatch:
        matrix = _matrix(held[4])
        columns = [index, part, *held[:3], matrix.shape[1], matrix.tobytes(), held[3]]
        return pa.RecordBatch.from_arrays([pa.array([v], to_arrow_type(f.dataType)) for v, f in zip(columns, BLOCK)], BLOCK.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, part, held = 0, 0, [[] for _ in range(5)]
        for batch in batches:
            if not batch.num_rows:
                continue
            index = batch.column(partition)[0].as_py()
            for name, column in zip(("row", "id", "label", "spans"), held):
                column.extend(batch.column(name).to_pylist())
            held[4].extend(v.values.to_numpy(zero_copy_only=False) for v in batch.column("vector"))
            while len(held[0]) > size:
                yield block(index, part, [column[:size] for column in held])
                held, part = [column[size:] for column in held], part + 1
        if held[0]:
            yield block(index, part, held)

    return rows.mapInArrow(work, BLOCK)


def blocks_by_length(rows: DataFrame, count: int, size: int) -> DataFrame:
    """Blocks of rows of similar length; ``block`` 0 holds the longest.

    Lengths are cut at regular samples of sorted runs; equal ones are told
    apart by the row's number, so a vector that many rows share is dealt to as
    many blocks as it fills.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    keyed = rows.select(
        "row", "id", "label", "vector", F.lit(None).cast(SPANS).alias("spans"),
        F.least(length * 1024, F.lit(2.0**53)).cast("long").alias("score"),
        F.lit(0).alias("doc_id"),
        F.xxhash64("row").alias("text_key"),
    )
    order = [F.col("score").desc(), "doc_id", "text_key", "row"]
    keys = keyed.select("score", "doc_id", "text_key", "row").sortWithinPartitions(*order)
    held = rows.sparkSession.sparkContext.broadcast(regular_splitters(keys, count, max(1, -(-count // size))))
    schema = T.StructType([*keyed.schema.fields, T.StructField("range", T.IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect.bisect_left(held.value, k) for k in sort_keys(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], schema.names)

    ranged = keyed.mapInArrow(cut, schema).repartitionById(len(held.value) + 1, "range")
    return packed(ranged.sortWithinPartitions(*order), "range", size)


def blocks_of_anchors(asked: DataFrame, count: int, size: int) -> DataFrame:
    """Blocks of anchors, which need no order."""
    parts = max(1, -(-count // size))
    dealt = asked.withColumn("range", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).repartitionById(parts, "range")
    return packed(dealt.sortWithinPartitions("row"), "range", 2 * size)


class Rows:
    """One block of rows or anchors, unpacked."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.rows = np.array(batch.column("rows")[at].as_py(), dtype=np.int64)
        ids = batch.column("ids")[at].as_py()
        self.nameless = np.array([i is None for i in ids], dtype=bool)
        self.ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        self.labels = np.array(batch.column("labels")[at].as_py(), dtype=object)
        self.spans = batch.column("spans")[at].as_py()
        width = batch.column("width")[at].as_py()
        self.vectors = np.frombuffer(batch.column("vectors")[at].as_py()).reshape(len(self.rows), width)
        most = np.abs(self.vectors).max(axis=1, initial=0.0)
        scaled = self.vectors / np.where(most > 0, most, 1.0)[:, None]
        norm = np.sqrt((scaled * scaled).sum(axis=1))
        with np.errstate(over="ignore"):
            self.lengths = norm * most
        self.unit = scaled / np.where(norm > 0, norm, 1.0)[:, None]

    def sort_lists(self) -> None:
        """The coordinate lists: unit values in order, and whose they are."""
        self.whose = np.argsort(self.unit.T, axis=1, kind="stable")
        self.values = np.take_along_axis(self.unit.T, self.whose, axis=1)

    def candidates(self, unit: np.ndarray, focus: np.ndarray, least_cosine: float) -> np.ndarray:
        """Rows that can reach the cosine with ``unit``."""
        if least_cosine <= -1 or not len(focus):
            return np.arange(len(self.rows))
        # Who is within an angle of the anchor, which lies at some angle from an
        # axis, lies within that of the anchor's angle from the axis.
        wide = np.arccos(min(1.0, least_cosine)) + 1e-6
        angle = np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, angle + wide)) - 1e-9
        high = np.cos(np.maximum(0.0, angle - wide)) + 1e-9
        spans = [
            (np.searchsorted(self.values[f], a, "left"), np.searchsorted(self.values[f], b, "right"))
            for f, a, b in zip(focus, low, high)
        ]
        start = int(np.argmin([b - a for a, b in spans]))
        found = self.whose[focus[start], slice(*spans[start])]
        for k, f in enumerate(focus):
            if k != start and len(found):
                value = self.unit[found, f]
                found = found[(value >= low[k]) & (value <= high[k])]
        return found


def exact_scores(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, without rounding."""
    width = min(matrix.shape[1], len(vector))
    matrix, vector = matrix[:, :width], vector[:width]
    if not matrix.size:
        return np.zeros(len(matrix), dtype=np.int64)
    if float(np.abs(matrix).max()) * float(np.abs(vector).max()) * width < 2.0**53:
        return (matrix @ vector).astype(np.int64)
    whole = [int(x) for x in vector]
    sums = [sum(int(x) * y for x, y in zip(row, whole)) for row in matrix]
    return np.array([min(max(s, _LONG.min), _LONG.max) for s in sums], dtype=np.int64)


class Best:
    """The best ``size`` rows seen: higher score, then id, then row."""

    def __init__(self, size: int):
        self.size = size
        self.kept: list[tuple] = []

    def least(self) -> int | None:
        """The score that a row needs to enter; None while there is room."""
        return -self.kept[-1][0] if len(self.kept) == self.size else None

    def add(self, scores: np.ndarray, at: np.ndarray, block: Rows) -> None:
        if len(scores) > self.size:
            bound = np.partition(scores, len(scores) - self.size)[len(scores) - self.size]
            keep = scores >= bound  # with all ties of the last place
            scores, at = scores[keep], at[keep]
            order = np.lexsort((block.rows[at], block.ids[at], block.nameless[at], ~scores))[: self.size]
            scores, at = scores[order], at[order]
        new = [(-s, *tie) for s, *tie in zip(scores.tolist(), *(v[at].tolist() for v in (block.nameless, block.ids, block.rows)))]
        self.kept = sorted(self.kept + new)[: self.size]


def _need(least: int | None, length: float, longest: float) -> float:
    """The cosine that a score of ``least`` asks for; minus one if none."""
    if least is None or least <= 0:
        return -1.0
    return np.inf if length * longest == 0 else least / (length * longest) * (1 - 1e-9)


def _search(anchors: Rows, options: Options, ranged: bool, blocks: Iterator[Rows]) -> Iterator[tuple]:
    """Rows of :data:`FOUND`: the best rows of the anchor's label or, if
    ``ranged``, for each span the best rows of other labels inside it."""
    size = options.negatives if ranged else options.positives
    spans = anchors.spans if ranged else [[(_LONG.min, _LONG.max)]] * len(anchors.rows)
    best = [[Best(size) for _ in own] for own in spans]
    focus = np.argsort(-np.abs(anchors.unit), axis=1, kind="stable")[:, : options.focus]
    for block in blocks:
        block.sort_lists()
        longest = float(block.lengths.max())
        same: dict[str, np.ndarray] = {}
        for a in range(len(anchors.rows)):
            least = [low if held.least() is None else max(low, held.least()) for (low, _), held in zip(spans[a], best[a])]
            cosine = _need(min(least), float(anchors.lengths[a]), longest)
            if cosine > 1 + 1e-9:
                continue
            inside = focus[a][focus[a] < block.vectors.shape[1]]
            found = block.candidates(anchors.unit[a], inside, cosine)
            label = anchors.labels[a]
            if label not in same:
                same[label] = block.labels == label
            own = same[label][found]
            found = found[~own] if ranged else found[own & (block.rows[found] != anchors.rows[a])]
            if not len(found):
                continue
            scores = exact_scores(block.vectors[found], anchors.vectors[a])
            for floor, (_, high), held in zip(least, spans[a], best[a]):
                fit = (scores >= floor) & (scores <= high)
                if fit.any():
                    held.add(scores[fit], found[fit], block)
    for a, own in enumerate(best):
        for target, held in enumerate(own):
            for minus, nameless, doc_id, row in held.kept:
                yield int(anchors.rows[a]), target, -minus, None if nameless else doc_id, row


FOUND = T.StructType(
    [
        T.StructField("anchor_row", T.LongType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("score", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)


def _searched(anchors: DataFrame, blocks: DataFrame, groups: int, options: Options, ranged: bool) -> DataFrame:
    """Every block of anchors through every block of rows, the best of each
    strip of blocks merged: ``anchor_row, target, place, score, id``."""
    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strips = max(1, min(blocks.count(), -(-tasks // groups)))
    names = BLOCK.names[2:]

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = anchors.select(F.col("block").alias("group"), every(strips).alias("strip"), F.lit(-1).alias("turn"), "part", *names)
    right = blocks.select(
        every(groups).alias("group"), F.pmod(F.col("block") + F.col("part"), F.lit(strips)).alias("strip"),
        F.col("block").alias("turn"), "part", *names,
    )
    met = left.unionByName(right).repartitionById(groups * strips, F.col("group") * strips + F.col("strip"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch, at) for batch in batches for at in range(batch.num_rows))
        first = next(rows, None)
        if first is None or first[0].column("turn")[first[1]].as_py() >= 0:
            return  # no anchors
        found = list(zip(*_search(Rows(*first), options, ranged, (Rows(*row) for row in rows)))) or [[]] * len(FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(found, FOUND)], FOUND.names)

    found = met.sortWithinPartitions("turn", "part").mapInArrow(work, FOUND)
    item = F.struct((-F.col("score")).alias("minus"), F.col("id").isNull().alias("nameless"), "id", "row", "score")
    listed = found.groupBy("anchor_row", "target").agg(F.array_sort(F.collect_list(item)).alias("all"))  # a few a strip
    size = options.negatives if ranged else options.positives
    return listed.select("anchor_row", "target", F.posexplode(F.slice("all", 1, size)).alias("at", "best")).select(
        "anchor_row", "target", (F.col("at") + 1).alias("place"), "best.score", "best.id"
    )


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    options: Options = Options(),
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "vector",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for the rows of ``df`` where ``anchors`` holds.

    ``vector_col`` holds whole numbers as doubles.
    """
    rows = usable(df, label_col, vector_col).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        (F.coalesce(anchors, F.lit(False)) & F.col(id_col).isNotNull()).alias("anchor"),
    )
    rows = stored(rows, "vectors")  # the numbers of the rows are written with them
    sizes = rows.agg(
        F.count("*").alias("rows"), F.count_if("anchor").alias("asked"), F.max(F.size("vector")).alias("width")
    ).first()
    width = max(1, sizes["width"] or 1)
    asked = rows.where("anchor").select("row", "id", "label", "vector")
    per_group = max(1, options.anchor_cells // width)
    blocks = stored(blocks_by_length(rows, sizes["rows"], max(1, options.block_cells // width)), "blocks")
    groups = max(1, -(-sizes["asked"] // per_group))

    none = asked.withColumn("spans", F.lit(None).cast(SPANS))
    grouped = blocks_of_anchors(none, sizes["asked"], per_group)
    positives = stored(_searched(grouped, blocks, groups, options, False), "positives")
    # Scores are whole, so these bounds say the same as the asked fractions.
    wide = F.col("score").cast("decimal(38,0)")
    span = F.array(
        F.ceil(wide * options.least_percent / 100).cast("long"), F.floor(wide * options.most_percent / 100).cast("long")
    )
    listed = positives.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", span.alias("span")))).alias("all"))
    spanned = asked.join(listed, asked["row"] == listed["anchor_row"]).select(
        "row", "id", "label", "vector", F.col("all.span").alias("spans")
    )
    negatives = _searched(blocks_of_anchors(spanned, sizes["asked"], per_group), blocks, groups, options, True)
    own = positives.select("anchor_row", (F.col("place") - 1).alias("target"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    return (
        negatives.join(own, ["anchor_row", "target"])
        .join(asked.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
        .select(
            "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )
