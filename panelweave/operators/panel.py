"""Panel structure: diagnostics, balancing, codes, event time and changes.

Unit-level values (first treated period, ever treated, cohort) come from one
aggregate per unit that is joined back, so a unit with very many rows never
forms one window.  Ordered work (forward fill, differences, gaps) runs inside
stretches of a timeline, with the ends of earlier stretches carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.specs import PANEL, PanelSpec
from .grouping import attach_group_stats, attach_totals, dense_codes, last_known, previous_row

# Event-study window and the omitted reference period.
EVENT_WINDOW = (-12, 12)
REFERENCE_PERIOD = -1


def _require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def calculate_panel_diagnostics(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """One row describing the panel; without a treatment column all units are controls."""
    _require(df, spec.unit, spec.time)
    has_treatment = spec.treatment in df.columns
    treat = F.col(spec.treatment) if has_treatment else F.lit(None).cast("double")
    units = df.groupBy(spec.unit).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(treat).alias("top"),
        F.sum(treat).cast("double").alias("sum_t"),
        F.count(treat).alias("n_t"),
    )
    known = F.col(spec.unit).isNotNull()
    by_unit = units.agg(
        F.count_if(known).alias("n_units"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_observations"),
        F.coalesce(F.try_divide(F.sum("sum_t"), F.sum("n_t")), F.lit(0.0)).alias("treatment_share"),
        F.count_if(known & (F.col("top") > 0)).alias("n_treated_units"),
    )
    periods = df.agg(F.count_distinct(F.col(spec.time)).alias("n_periods"))
    expected = F.col("n_units") * F.col("n_periods")
    return by_unit.join(F.broadcast(periods)).select(
        "n_units",
        "n_periods",
        "n_observations",
        expected.alias("expected_if_balanced"),
        (F.col("n_observations") == expected).alias("is_balanced"),
        F.coalesce(F.try_divide(F.col("n_observations"), expected), F.lit(0.0)).alias("balance_rate"),
        "treatment_share",
        "n_treated_units",
        (F.col("n_units") - F.col("n_treated_units")).alias("n_control_units"),
    )


def _no_duplicates(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Same rows; a repeated (unit, period) fails the job."""
    rows = F.struct(*[c for c in df.columns if c not in (spec.unit, spec.time)])
    packed = df.groupBy(spec.unit, spec.time).agg(F.min(rows).alias("row"), F.count(F.lit(1)).alias("copies"))
    failure = F.raise_error(F.lit("duplicate unit and period rows")).cast("boolean")
    single = packed.filter(F.when(F.col("copies") > 1, failure).otherwise(F.lit(True)))
    return single.select(spec.unit, spec.time, "row.*").select(*df.columns)


def balance_panel(df: DataFrame, fill_method: str = "drop", spec: PanelSpec = PANEL) -> DataFrame:
    """Make every unit cover every period.

    ``drop`` keeps the units seen in all periods, ``ffill`` builds the full
    grid and carries values forward in period order, ``zero`` builds the grid
    and writes 0 into every missing numeric value.
    """
    _require(df, spec.unit, spec.time)
    if fill_method == "drop":
        return _complete_units(df, spec)
    if fill_method == "ffill":
        return forward_fill(full_grid(df, spec), spec)
    if fill_method == "zero":
        grid = full_grid(df, spec)
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        return grid.fillna(0, [c for c in numeric if c not in (spec.unit, spec.time)])
    raise ValueError(f"unknown fill method: {fill_method}")


def _complete_units(df: DataFrame, spec: PanelSpec) -> DataFrame:
    seen = df.groupBy(spec.unit).agg(F.count_distinct(spec.time).alias("_seen"))
    periods = df.agg(F.count_distinct(spec.time).alias("_all"))
    complete = seen.join(F.broadcast(periods), F.col("_seen") == F.col("_all")).select(spec.unit)
    return df.join(complete, spec.unit, "left_semi")


def full_grid(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """One row per unit and period; absent cells are NULL.

    The grid is the result itself.  The list of periods is one array on one
    row (a time axis, not data) and each unit unfolds it.
    """
    axis = df.select(spec.time).filter(F.col(spec.time).isNotNull()).distinct()
    axis = axis.agg(F.sort_array(F.collect_list(spec.time)).alias("_axis"))
    units = df.select(spec.unit).filter(F.col(spec.unit).isNotNull()).distinct()
    cells = units.join(F.broadcast(axis)).select(spec.unit, F.explode("_axis").alias(spec.time))
    return cells.join(_no_duplicates(df, spec), [spec.unit, spec.time], "left").select(*df.columns)


def forward_fill(df: DataFrame, spec: PanelSpec = PANEL, columns: Sequence[str] | None = None) -> DataFrame:
    """Carry the last known value of each unit forward in period order."""
    names = columns or [c for c in df.columns if c not in (spec.unit, spec.time)]
    return last_known(df, spec.unit, spec.time, names)


def create_fixed_effects(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Add ``unit_fe`` and ``time_fe``: dense codes from 0, -1 for NULL."""
    _require(df, spec.unit, spec.time)
    coded = df
    for column, code in ((spec.unit, "unit_fe"), (spec.time, "time_fe")):
        coded = coded.join(dense_codes(df, column, code), column, "left").withColumn(
            code, F.coalesce(code, F.lit(-1).cast("long"))
        )
    return coded.select(*df.columns, "unit_fe", "time_fe")


def _start(spec: PanelSpec) -> Column:
    return F.min(F.when(F.col(spec.treatment) == 1, F.col(spec.time)))


def create_event_time(
    df: DataFrame, spec: PanelSpec = PANEL, treatment_period_col: str | None = None
) -> DataFrame:
    """Add ``event_time``, and ``treatment_period`` when it is not given."""
    if treatment_period_col and treatment_period_col in df.columns:
        return df.withColumn("event_time", F.col(spec.time) - F.col(treatment_period_col))
    started = attach_group_stats(df, [spec.unit], {"treatment_period": _start(spec)})
    return started.withColumn("event_time", F.col(spec.time) - F.col("treatment_period"))


def _post(spec: PanelSpec) -> Column:
    return F.coalesce((F.col(spec.time) >= F.col("treatment_period")).cast("int"), F.lit(0))


def create_treatment_indicators(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Add ``ever_treated`` and, where starts are known, ``post_treatment``."""
    out = attach_group_stats(df, [spec.unit], {"ever_treated": F.max(spec.treatment)})
    return out.withColumn("post_treatment", _post(spec)) if "treatment_period" in df.columns else out


def add_treatment_columns(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Event time and indicators together, from a single unit aggregate."""
    stats = {"treatment_period": _start(spec), "ever_treated": F.max(spec.treatment)}
    out = attach_group_stats(df, [spec.unit], stats)
    return out.withColumns(
        {"event_time": F.col(spec.time) - F.col("treatment_period"), "post_treatment": _post(spec)}
    )


def dummy_name(k: int) -> str:
    return f"event_k{k}" if k >= 0 else f"event_km{-k}"


def event_dummies(
    df: DataFrame, window: tuple[int, int] = EVENT_WINDOW, reference: int | None = REFERENCE_PERIOD
) -> DataFrame:
    """Add one 0/1 column per period of the window except the reference."""
    periods = [k for k in range(window[0], window[1] + 1) if k != reference]
    return df.withColumns(
        {dummy_name(k): F.coalesce((F.col("event_time") == k).cast("int"), F.lit(0)) for k in periods}
    )


def event_bins(df: DataFrame, window: tuple[int, int] = EVENT_WINDOW, spec: PanelSpec = PANEL) -> DataFrame:
    """Endpoint-binned event time, treat x post, cohort label, unit-time id."""
    binned = F.greatest(F.least(F.col("event_time"), F.lit(window[1])), F.lit(window[0]))
    return df.withColumns(
        {
            "event_time_binned": F.when(F.col("event_time").isNotNull(), binned),
            "treat_x_post": F.col("ever_treated") * F.col("post_treatment"),
            "treatment_cohort": F.col("treatment_period").cast("string"),
            "fe_unit_time": F.concat_ws("_", spec.unit, spec.time),
        }
    )


def outcome_changes(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """First difference and percent change within units, z-score over all rows."""
    y, before = F.col(spec.outcome), F.col("_before")
    lagged = previous_row(df, spec.unit, spec.time, {spec.outcome: "_before"})
    totals = df.agg(F.avg(spec.outcome).alias("_mean"), F.stddev_samp(spec.outcome).alias("_sd"))
    scaled = lagged.join(F.broadcast(totals))
    return scaled.withColumns(
        {
            "outcome_change": y - before,
            "outcome_pct_change": F.try_divide(y - before, before) * 100,
            "outcome_zscore": F.try_divide(y - F.col("_mean"), F.col("_sd")),
        }
    ).drop("_mean", "_sd", "_before")


def time_gaps(df: DataFrame, spec: PanelSpec = PANEL, step: int = 1) -> DataFrame:
    """One row per gap: unit, last period before, first after, periods missing."""
    seen = df.select(spec.unit, spec.time).dropna().distinct()
    steps = previous_row(seen, spec.unit, spec.time, {spec.time: "gap_start"})
    gaps = steps.filter(F.col(spec.time) - F.col("gap_start") > step)
    missing = F.floor((F.col(spec.time) - F.col("gap_start")) / step) - 1
    return gaps.select(
        spec.unit, "gap_start", F.col(spec.time).alias("gap_end"), missing.cast("long").alias("n_missing")
    )


def flag_outliers(df: DataFrame, column: str, n_sd: float = 3.0) -> DataFrame:
    """Add ``is_outlier``: further than ``n_sd`` deviations from the mean."""
    scaled = attach_totals(df, {"_mean": F.avg(column), "_sd": F.stddev_samp(column)})
    far = F.abs(F.col(column) - F.col("_mean")) > F.lit(n_sd) * F.col("_sd")
    return scaled.withColumn("is_outlier", F.coalesce(far, F.lit(False))).drop("_mean", "_sd")


def timing_check(df: DataFrame, declared: str, spec: PanelSpec = PANEL) -> DataFrame:
    """One row per unit: declared start, first treated period, whether they agree."""
    units = df.groupBy(spec.unit).agg(
        F.min(declared).alias("declared_start"),
        F.max(declared).alias("_last_declared"),
        _start(spec).alias("first_treated"),
        F.count_if((F.col(spec.time) >= F.col(declared)) & (F.col(spec.treatment) == 0)).alias("n_untreated_after_start"),
    )
    steady = F.col("declared_start").eqNullSafe(F.col("_last_declared"))
    agrees = F.col("declared_start").eqNullSafe(F.col("first_treated")) & steady
    return units.select(
        spec.unit,
        "declared_start",
        "first_treated",
        "n_untreated_after_start",
        (agrees & (F.col("n_untreated_after_start") == 0)).alias("is_consistent"),
    )


def panel_skeleton(
    units: DataFrame,
    n_periods: int,
    treatment_period: int,
    treated: Column,
    start_date: str,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """Units by periods with calendar, post and treatment columns."""
    cells = units.withColumn(spec.time, F.explode(F.sequence(F.lit(0), F.lit(n_periods - 1))))
    post = (F.col(spec.time) >= treatment_period).cast("int")
    dated = cells.withColumns(
        {
            "date": F.add_months(F.to_date(F.lit(start_date)), F.col(spec.time)),
            "treated_unit": treated.cast("int"),
            "post": post,
        }
    )
    return dated.withColumns(
        {
            "year": F.year("date"),
            "month": F.month("date"),
            spec.treatment: F.col("treated_unit") * F.col("post"),
        }
    )


def panel_entry_exit(
    panel: DataFrame, exits: DataFrame, entrants: DataFrame, exit_period: str = "exit_period", spec: PanelSpec = PANEL
) -> DataFrame:
    """Drop the rows of a unit from its exit period on, then add later entrants."""
    known = panel.join(exits.select(spec.unit, exit_period), spec.unit, "left")
    kept = known.filter(F.col(exit_period).isNull() | (F.col(spec.time) < F.col(exit_period))).select(*panel.columns)
    return kept.unionByName(entrants, allowMissingColumns=True)
