"""Group statistics attached to rows, quantiles and dense codes.

A window partitioned by a group key puts the whole group in one task.  The
helpers here aggregate first (with map-side combine, so a hot key shrinks to
one row per task) and join the small result back.  The join type is left to
adaptive execution: a broadcast when the measured size is small, else a
shuffled join whose skewed partitions are split.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import is_missing


def attach_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add aggregates of each group to its rows; rows with a NULL key get NULL."""
    table = df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])
    return df.join(table, list(keys), "left").select(*df.columns, *stats)


def attach_totals(df: DataFrame, stats: Mapping[str, Column]) -> DataFrame:
    """Add aggregates over all rows; the joined table is a single row."""
    table = df.agg(*[c.alias(name) for name, c in stats.items()])
    return df.join(F.broadcast(table))


#: Right rows per key that one task should meet in a candidate join.
KEY_SHARE = 1000


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str], share: int = KEY_SHARE
) -> DataFrame:
    """Inner join whose frequent right keys are cut into shares.

    Skew splitting looks at bytes, but in a candidate join the work of a key
    is the product of both sides, and few bytes can make very many pairs.  The
    right rows of a frequent key are dealt to shares by a hash of
    ``spread_by``; its left rows visit every share.  Other keys have one share.
    """
    keys = list(keys)
    frequent = (
        right.groupBy(*keys)
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(share)).cast("int").alias("_shares"))
        .filter(F.col("_shares") > 1)
    )
    shares = F.coalesce("_shares", F.lit(1))
    dealt = right.join(frequent, keys, "left").withColumn("_share", F.pmod(F.xxhash64(*spread_by), shares).cast("int"))
    visiting = left.join(frequent, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return visiting.drop("_shares").join(dealt.drop("_shares"), [*keys, "_share"]).drop("_share")


def _with_coarse(table: DataFrame, bounds: str, width: int) -> DataFrame:
    """Add every ``width``-th of the sorted bounds as ``_coarse``."""
    return table.withColumn("_coarse", F.filter(bounds, lambda b, i: i % width == width - 1))


def _bucket_of(value: Column, bounds: str, width: int) -> Column:
    """How many sorted bounds are at or below a value, in two short looks."""
    coarse = F.size(F.filter("_coarse", lambda b: b <= value)) * width
    near = F.slice(bounds, coarse + 1, F.lit(width))
    return coarse + F.size(F.filter(near, lambda b: b <= value))


def _range_bounds(values: DataFrame, column: str, buckets: int) -> DataFrame:
    """One row with sorted bucket bounds of a distinct column of exact values.

    The bounds are the values with the ``buckets - 1`` smallest hashes.  They
    only decide how evenly the work is spread; every value keeps its bucket
    however they fall.  A sketch would not do: its result depends on the order
    in which parts arrive, and a plan that reads it twice must see one answer.
    """
    picked = values.orderBy(F.xxhash64(column), column).limit(max(buckets - 1, 1))
    bounds = picked.agg(F.sort_array(F.collect_list(column)).alias("_bounds"))
    return _with_coarse(bounds, "_bounds", math.isqrt(buckets))


def _range_buckets(values: DataFrame, column: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: an order-preserving bucket of a distinct column."""
    joined = values.join(F.broadcast(_range_bounds(values, column, buckets)))
    at = _bucket_of(F.col(column), "_bounds", math.isqrt(buckets))
    return joined.withColumn("_bucket", at).drop("_bounds", "_coarse")


def dense_codes(df: DataFrame, column: str, code: str, buckets: int = 256) -> DataFrame:
    """Table (column, code): 0-based rank of each distinct non-null value.

    Ranks are taken inside range buckets and shifted by the sizes of the
    buckets before, so no task sorts all distinct values.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    spread = _range_buckets(values, column, buckets)
    sizes = spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``buckets`` rows reach this window.
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(column)) - 1
    return (
        spread.withColumn("_rank", rank)
        .join(offsets, "_bucket")
        .select(column, (F.col("_rank") + F.col("_offset")).cast("long").alias(code))
    )


def _equal_width(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """Bucket of a value between two exact bounds; 0 when they coincide."""
    share = F.try_divide(value - low, high - low) * buckets
    return F.coalesce(F.least(F.floor(share), F.lit(buckets - 1)), F.lit(0)).cast("int")


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], keys: Sequence[str] = (), buckets: int = 4096
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    Equal values are counted together first.  A histogram between minimum and
    maximum finds the bucket of each wanted position, a second histogram
    inside those buckets narrows them, and only the values of the buckets left
    are ranked.  No task sees all values of a key.  Minimum and maximum do not
    depend on the order of rows, so every reading of the plan cuts alike.
    """
    keys = list(keys)
    counts = (
        df.filter(~is_missing(df, value))
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranges = counts.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_c").alias("_n"))
    spread = (counts.join(ranges, keys) if keys else counts.join(F.broadcast(ranges))).withColumn(
        "_b1", _equal_width(F.col("_v"), F.col("_low"), F.col("_high"), buckets)
    )
    positions = F.array(
        *[
            F.struct(F.lit(name).alias("_name"), ((F.col("_n") - 1) * F.lit(float(p))).alias("_at"))
            for name, p in probabilities.items()
        ]
    )
    # At most ``buckets`` rows per key reach each of the two running sums.
    first = spread.groupBy(*keys, "_b1").agg(
        F.sum("_c").alias("_size"), F.max("_n").alias("_n"), F.min("_v").alias("_low1"), F.max("_v").alias("_high1")
    )
    until = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_b1"))
    wanted = (
        first.withColumn("_until", until)
        .withColumn("_from", F.col("_until") - F.col("_size"))
        .select(*keys, "_b1", "_from", "_until", "_low1", "_high1", F.inline(positions))
        .filter(_reaches())
    )
    edges = wanted.select(*keys, "_b1", "_from", "_low1", "_high1").distinct()
    inside = spread.select(*keys, "_b1", "_v", "_c").join(edges, [*keys, "_b1"])
    narrowed = inside.withColumn("_b2", _equal_width(F.col("_v"), F.col("_low1"), F.col("_high1"), buckets))
    second = narrowed.groupBy(*keys, "_b1", "_b2").agg(F.sum("_c").alias("_size"), F.max("_from").alias("_start"))
    until = F.sum("_size").over(Window.partitionBy(*keys, "_b1").orderBy("_b2")) + F.col("_start")
    closer = (
        second.withColumn("_until", until)
        .withColumn("_from", F.col("_until") - F.col("_size"))
        .join(wanted.select(*keys, "_b1", "_name", "_at"), [*keys, "_b1"])
        .filter(_reaches())
        .select(*keys, "_b1", "_b2", "_from", "_name", "_at")
    )
    left = closer.select(*keys, "_b1", "_b2", F.col("_from").alias("_offset")).distinct()
    running = Window.partitionBy(*keys, "_b1", "_b2").orderBy("_v")
    ranked = (
        narrowed.select(*keys, "_b1", "_b2", "_v", "_c")
        .join(left, [*keys, "_b1", "_b2"])
        .withColumn("_last", F.sum("_c").over(running) + F.col("_offset") - 1)
        .withColumn("_first", F.col("_last") - F.col("_c") + 1)
    )
    hits = ranked.join(closer.drop("_from"), [*keys, "_b1", "_b2"])
    low = F.max(F.when(F.floor("_at").between(F.col("_first"), F.col("_last")), F.col("_v")))
    high = F.max(F.when(F.ceil("_at").between(F.col("_first"), F.col("_last")), F.col("_v")))
    picked = hits.groupBy(*keys, "_name").agg(low.alias("_lv"), high.alias("_hv"), F.first("_at").alias("_at"))
    share = F.col("_at") - F.floor("_at")
    solved = picked.withColumn("_q", F.col("_lv") + (F.col("_hv") - F.col("_lv")) * share)
    return solved.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probabilities]
    )


def _reaches() -> Column:
    """Whether a run of positions holds the floor or ceiling of ``_at``."""
    return (F.floor("_at") < F.col("_until")) & (F.ceil("_at") >= F.col("_from"))


def hash_ranked_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Exactly ``round(fraction * rows)`` rows, those with the smallest hashes.

    The hash text orders the rows.  Its first four hex digits form a bucket;
    buckets that fit entirely are kept as they are and only the one at the
    boundary is ranked.
    """
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    hashed = df.withColumn("_h", F.md5(text.cast("binary"))).withColumn("_b", F.substring("_h", 1, 4))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_size"))
    # At most 65,536 buckets reach this window.
    until = F.sum("_size").over(Window.orderBy("_b"))
    total = sizes.agg(F.round(F.sum("_size") * F.lit(fraction)).cast("long").alias("_take"))
    plan = (
        sizes.withColumn("_until", until)
        .join(F.broadcast(total))
        .withColumn("_room", F.col("_take") - (F.col("_until") - F.col("_size")))
        .filter(F.col("_room") > 0)
        .select("_b", "_room", (F.col("_room") >= F.col("_size")).alias("_whole"))
    )
    marked = hashed.join(plan, "_b")
    whole = marked.filter("_whole").select(*df.columns)
    order = Window.partitionBy("_b").orderBy("_h", *keys)
    edge = marked.filter("NOT _whole").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("_room"))
    return whole.unionByName(edge.select(*df.columns))


#: Pieces a timeline is cut into; one unit may hold a third of all rows.
TIME_CHUNKS = 64


def _chunked(df: DataFrame, time: str, chunks: int) -> DataFrame:
    """Add ``_chunk``: the same stretch of time for all units.

    Chunks hold about equally many distinct periods, so a unit with very many
    periods is cut evenly.
    """
    axis = df.select(time).filter(F.col(time).isNotNull()).distinct()
    joined = df.join(F.broadcast(_range_bounds(axis, time, chunks)))
    at = F.coalesce(_bucket_of(F.col(time), "_bounds", math.isqrt(chunks)), F.lit(-1))
    return joined.withColumn("_chunk", at).select(*df.columns, "_chunk")


def last_known(
    df: DataFrame, unit: str, time: str, columns: Sequence[str], chunks: int = TIME_CHUNKS
) -> DataFrame:
    """Fill each column with the last known value of its unit, in time order.

    Windows run inside chunks of a timeline.  What a chunk needs from before
    it comes from a table with one row per unit and chunk.
    """
    cut = _chunked(df, time, chunks)
    inside = Window.partitionBy(unit, "_chunk").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    ends = cut.groupBy(unit, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(f"_end_{i}") for i, c in enumerate(columns)]
    )
    # At most ``chunks`` rows per unit.
    before = Window.partitionBy(unit).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        unit, "_chunk", *[F.last(f"_end_{i}", ignorenulls=True).over(before).alias(f"_end_{i}") for i in range(len(columns))]
    )
    joined = filled.join(carried, [unit, "_chunk"], "left")
    return joined.withColumns({c: F.coalesce(c, f"_end_{i}") for i, c in enumerate(columns)}).select(*df.columns)


def previous_row(
    df: DataFrame, unit: str, time: str, columns: Mapping[str, str], chunks: int = TIME_CHUNKS
) -> DataFrame:
    """Add values of the row before within the unit; ``columns`` names them.

    Same route as :func:`last_known`: only the first row of a chunk looks at
    the chunk before.
    """
    cut = _chunked(df, time, chunks)
    inside = Window.partitionBy(unit, "_chunk").orderBy(time)
    sources, names = list(columns), list(columns.values())
    lagged = cut.withColumns(
        {"_first": F.row_number().over(inside) == 1} | {n: F.lag(c).over(inside) for c, n in columns.items()}
    )
    ends = cut.groupBy(unit, "_chunk").agg(*[F.max_by(c, time).alias(f"_end_{i}") for i, c in enumerate(sources)])
    # At most ``chunks`` rows per unit.
    order = Window.partitionBy(unit).orderBy("_chunk")
    carried = ends.select(unit, "_chunk", *[F.lag(f"_end_{i}").over(order).alias(f"_end_{i}") for i in range(len(sources))])
    joined = lagged.join(carried, [unit, "_chunk"], "left")
    return joined.withColumns(
        {n: F.when(F.col("_first"), F.col(f"_end_{i}")).otherwise(F.col(n)) for i, n in enumerate(names)}
    ).select(*df.columns, *names)
