"""The tables behind figures and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import is_missing

from ..plans.specs import PANEL, PanelSpec
from .grouping import exact_quantiles
from .panel import EVENT_WINDOW

# Fixed value: half-width of the plotted interval in standard errors.
BAND = 1.96


def event_profile(df: DataFrame, window: tuple[int, int] = EVENT_WINDOW, spec: PanelSpec = PANEL) -> DataFrame:
    """Outcome by event time: mean, deviation, count, error and band."""
    stats = (
        df.filter(F.col("event_time").between(*window))
        .groupBy("event_time")
        .agg(
            F.avg(spec.outcome).alias("mean"),
            F.stddev_samp(spec.outcome).alias("std"),
            F.count(spec.outcome).alias("count"),
        )
    )
    with_error = stats.withColumn("se", F.try_divide("std", F.sqrt("count")))
    return with_error.withColumns(
        {
            "band_lower": F.col("mean") - BAND * F.col("se"),
            "band_upper": F.col("mean") + BAND * F.col("se"),
        }
    )


def trend_means(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Mean outcome of both groups by period, and the first treated period."""

    def mean_of(value: int) -> Column:
        return F.avg(F.when(F.col("ever_treated") == value, F.col(spec.outcome)))

    by_period = df.groupBy(spec.time).agg(mean_of(0).alias("control"), mean_of(1).alias("treatment"))
    start = df.agg(F.min(F.when(F.col(spec.treatment) == 1, F.col(spec.time))).alias("treatment_start"))
    return by_period.join(F.broadcast(start))


def coefficient_intervals(results: DataFrame) -> DataFrame:
    reach = BAND * F.col("std_error")
    return results.select(
        "specification",
        "coefficient",
        (F.col("coefficient") - reach).alias("lower"),
        (F.col("coefficient") + reach).alias("upper"),
    )


def robustness_layout(results: DataFrame, order: Mapping[str, int]) -> DataFrame:
    """Plot position of each test: by type, then name, a half step between types.

    ``order`` ranks the test types.  The table has one row per test.
    """
    ranks = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])
    typed = results.withColumn("_type", ranks[F.col("test_type")])
    by_type = Window.orderBy("_type", "test_name")
    earlier = F.dense_rank().over(Window.orderBy("_type")) - 1
    reach = BAND * F.col("std_error")
    return typed.select(
        "test_name",
        "test_type",
        (F.row_number().over(by_type) - 1 + 0.5 * earlier).alias("position"),
        "coefficient",
        (F.col("coefficient") - reach).alias("lower"),
        (F.col("coefficient") + reach).alias("upper"),
        F.when(F.col("p_value") < 0.05, "significant").otherwise("not_significant").alias("class"),
    )


def histogram(df: DataFrame, value: str, bins: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over each group's own range; the last bin is closed.

    Every bin is listed, empty ones with a count of 0.
    """
    keys = list(keys)
    known = df.filter(~is_missing(df, value))
    if keys:
        known = known.dropna(subset=keys)
    ranges = known.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    # A single value is drawn in the middle of a unit-wide range.
    flat = F.col("_lo") == F.col("_hi")
    ranges = ranges.withColumns(
        {
            "_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
            "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")),
        }
    ).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    placed = known.join(ranges, keys) if keys else known.join(F.broadcast(ranges))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    axis = ranges.filter("_lo IS NOT NULL").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return axis.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def median_trend(df: DataFrame, value: str, time: str, group: str = "ever_treated") -> DataFrame:
    """Exact median by period and group."""
    return exact_quantiles(df, value, {"median": 0.5}, [time, group])


def group_summary(df: DataFrame, group: str, value: str, decimals: int = 4) -> DataFrame:
    return df.groupBy(group).agg(
        F.round(F.avg(value), decimals).alias("mean"),
        F.round(F.stddev_samp(value), decimals).alias("std"),
        F.count(value).alias("count"),
    )


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, deviation, min and max, in one pass."""
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[fn(F.col(c).cast("double")).alias(f"{name}{i}") for i, c in enumerate(columns) for name, fn in parts.items()])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), *[F.col(f"{name}{i}").alias(name) for name in parts])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def sample_construction(df: DataFrame, filters: Mapping[str, Column], first: str = "Initial records") -> DataFrame:
    """Rows left after each cumulative filter, counted in one pass."""
    names, kept = [first], [F.count(F.lit(1))]
    passed = F.lit(True)
    for name, condition in filters.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        names.append(name)
        kept.append(F.count_if(passed))
    counts = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(kept)])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("step"),
                F.lit(name).alias("stage"),
                F.col(f"c{i}").alias("observations"),
                F.coalesce(F.try_divide(F.col(f"c{i}") * 100.0, F.col("c0")), F.lit(0.0)).alias("percent_retained"),
            )
            for i, name in enumerate(names)
        ]
    )
    return counts.select(F.inline(rows))


def ordered(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Sort by unit and period; meant for the last step before a sink."""
    return df.orderBy(spec.unit, spec.time)
