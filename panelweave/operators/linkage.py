"""Exact record linkage and its diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import attach_group_stats

DEFAULT_KEY_COLUMNS = ("id",)


def _same(left: Column, right: Column, null_safe: bool) -> Column:
    return left.eqNullSafe(right) if null_safe else left == right


def _all_same(keys: Sequence[str], null_safe: bool) -> Column:
    return reduce(lambda a, b: a & b, [_same(F.col(f"l.{k}"), F.col(f"r.{k}"), null_safe) for k in keys])


def _suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]):
    """Rename non-key columns that both sides have."""
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}),
    )


def exact_match(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("", "_right"),
    null_safe: bool = False,
    validate_merge: str | None = None,
    source: str = "secondary",
    skewed_right: bool = True,
    compat_counts: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Link on equal keys; returns the linked rows and a one-row summary.

    ``validate_merge`` is ``"one_to_one"``, ``"one_to_many"``,
    ``"many_to_one"`` or ``None``; a violated rule fails the job that reads
    the result.  A left link is written as an inner join plus the rows without a
    partner, because adaptive execution can split a hot key of the right side
    only in an inner join; without ``skewed_right`` it is one left join.
    """
    keys = [on] if isinstance(on, str) else list(on)
    summary = link_summary(left, right, keys, how, null_safe, source, compat_counts)
    lhs, rhs = _suffixed(left, right, keys, suffixes)
    if validate_merge:
        lhs, rhs = _checked(lhs, rhs, keys, validate_merge)
    condition = _all_same(keys, null_safe)
    l_cols = [F.col(f"l.{c}") for c in lhs.columns]
    r_cols = [F.col(f"r.{c}") for c in rhs.columns if c not in keys]
    inner = lhs.alias("l").join(rhs.alias("r"), condition, "inner").select(*l_cols, *r_cols)
    if how == "inner":
        return inner, summary
    if how not in ("left", "outer"):
        raise ValueError(f"unknown link type: {how}")
    if skewed_right:
        alone = lhs.alias("l").join(rhs.select(*keys).distinct().alias("r"), condition, "left_anti")
        linked = inner.unionByName(alone, allowMissingColumns=True)
    else:
        linked = lhs.alias("l").join(rhs.alias("r"), condition, "left").select(*l_cols, *r_cols)
    if how == "outer":
        # A full outer join cannot be split on a hot key; the right rows
        # without a partner are added from an anti join on distinct keys.
        swapped = reduce(lambda a, b: a & b, [_same(F.col(f"r.{k}"), F.col(f"l.{k}"), null_safe) for k in keys])
        extra = rhs.alias("r").join(lhs.select(*keys).distinct().alias("l"), swapped, "left_anti")
        linked = linked.unionByName(extra, allowMissingColumns=True)
    return linked, summary


def _checked(left: DataFrame, right: DataFrame, keys: list[str], rule: str) -> tuple[DataFrame, DataFrame]:
    """Fail at run time when a side that must be unique has repeated keys."""
    unique = {"one_to_one": (True, True), "one_to_many": (True, False), "many_to_one": (False, True)}
    if rule not in unique:
        raise ValueError(f"unknown merge rule: {rule}")
    sides = []
    for frame, must, side in zip((left, right), unique[rule], ("left", "right")):
        if must:
            known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
            frame = attach_group_stats(frame, keys, {"_copies": F.count(F.lit(1))})
            message = F.lit(f"merge keys are not unique in the {side} table")
            broken = known & (F.col("_copies") > 1)
            frame = frame.filter(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
            frame = frame.drop("_copies")
        sides.append(frame)
    return sides[0], sides[1]


def link_summary(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    source: str = "secondary",
    compat_counts: bool = False,
) -> DataFrame:
    """One-row linkage diagnostics, computed from row counts per key.

    Both sides are counted by key before they meet, so a hot key is one row.
    ``n_matched`` counts left rows with a partner; ``n_rows`` is the size of
    the linked table.  ``compat_counts`` counts linked rows instead, for which
    ``n_unmatched`` may be negative.
    """
    keys = list(keys)
    counted_l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("nl"))
    counted_r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nr"))
    met = (
        counted_l.alias("l")
        .join(counted_r.alias("r"), _all_same(keys, null_safe), "full")
        .select(F.coalesce("nl", F.lit(0)).alias("nl"), F.coalesce("nr", F.lit(0)).alias("nr"))
    )
    pairs, lonely_l, lonely_r = F.col("nl") * F.col("nr"), F.col("nr") == 0, F.col("nl") == 0
    sums = met.agg(
        _long_sum(F.col("nl")).alias("n_left"),
        _long_sum(F.col("nr")).alias("n_source"),
        _long_sum(pairs).alias("pairs"),
        _long_sum(F.when(~lonely_l, F.col("nl"))).alias("with_partner"),
        _long_sum(F.when(lonely_l, F.col("nl"))).alias("left_only"),
        _long_sum(F.when(lonely_r, F.col("nr"))).alias("right_only"),
    )
    rows = F.col("pairs")
    if how in ("left", "outer"):
        rows = rows + F.col("left_only")
    if how == "outer":
        rows = rows + F.col("right_only")
    matched, unmatched = F.col("with_partner"), F.col("left_only")
    if compat_counts:
        matched = F.col("pairs") if how == "left" else rows
        unmatched = F.col("left_only") if how == "left" else F.col("n_left") - rows
    return _summary_row(sums, source, matched, unmatched, "exact", ",".join(keys), rows)


def _long_sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def _summary_row(sums, source, matched, unmatched, match_type, key_columns, rows) -> DataFrame:
    total = matched + unmatched
    return sums.select(
        F.lit(source).alias("source"),
        F.col("n_source"),
        matched.cast("long").alias("n_matched"),
        unmatched.cast("long").alias("n_unmatched"),
        F.when(total > 0, matched / total).otherwise(F.lit(0.0)).alias("match_rate"),
        F.lit(match_type).alias("match_type"),
        F.lit(key_columns).alias("key_columns"),
        rows.cast("long").alias("n_rows"),
    )


def match_summary(linked: DataFrame, n_source: DataFrame, match_column: str, source: str, match_type: str, keys: str):
    """Summary of a link whose rows already carry the matched value."""
    matched, total = F.count(match_column), F.count(F.lit(1))
    sums = linked.agg(matched.alias("m"), total.alias("t")).join(
        F.broadcast(n_source.agg(F.count(F.lit(1)).alias("n_source")))
    )
    return _summary_row(sums, source, F.col("m"), F.col("t") - F.col("m"), match_type, keys, F.col("t"))


def link_sources(
    primary: DataFrame, sources: Mapping[str, DataFrame], key_columns: Sequence[str] = DEFAULT_KEY_COLUMNS, **options
) -> tuple[DataFrame, DataFrame]:
    """Chain left joins over the sources that share key columns.

    Without any linkable source the rows pass through with two marker
    columns.  The summary has one row per link.
    """
    linked, summaries = primary, []
    for name, frame in sources.items():
        shared = [c for c in key_columns if c in frame.columns and c in linked.columns]
        if not shared:
            continue
        linked, summary = exact_match(linked, frame, shared, source=name, **options)
        summaries.append(summary)
    if not summaries:
        return pass_through(primary, key_columns)
    return linked, linkage_table(summaries)


def pass_through(df: DataFrame, key_columns: Sequence[str] = DEFAULT_KEY_COLUMNS) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumns({"source_file": F.lit("primary"), "link_status": F.lit("direct")})
    n = F.col("n_source")
    summary = _summary_row(
        df.agg(F.count(F.lit(1)).alias("n_source")), "passthrough", n, F.lit(0), "passthrough", ",".join(key_columns), n
    )
    return marked, summary


def linkage_table(summaries: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, summaries)


def calculate_match_rate(df: DataFrame, key_column: str, value_column: str) -> DataFrame:
    """One row: matched, unmatched, total, rate of a value column."""
    total, matched = F.count(F.lit(1)), F.count(value_column)
    return df.agg(
        matched.alias("matched"),
        (total - matched).alias("unmatched"),
        total.alias("total"),
        F.when(total > 0, matched / total).otherwise(F.lit(0.0)).alias("rate"),
    )


def map_group_value(df: DataFrame, unit: str, value: Column, name: str) -> DataFrame:
    """Bring one aggregate of each unit back to its rows."""
    return attach_group_stats(df, [unit], {name: value})
