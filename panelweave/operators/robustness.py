"""The robustness battery as one grouped estimation.

A row is tagged with every test whose sample it belongs to, together with the
regressor that test uses; one aggregate by test then yields all estimates.
Tests cost tags, not scans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import is_missing
from ..plans.specs import PANEL, PanelSpec
from .grouping import exact_quantiles, hash_ranked_sample
from .moments import combine, group_moments
from .regression import explained, finish, hash_uniform, run_ols, solve

# Defaults of the battery.
MIN_ROWS = 10
PRE_PERIOD_END = 11
N_PLACEBOS = 5
SUBSAMPLE = 0.8
TRIM = (0.01, 0.99)
COLUMNS = (
    "test_name", "test_type", "coefficient", "std_error", "p_value", "n_obs", "significant", "description", "reason",
)


def run_simple_ols(df: DataFrame, y: str, x: str, keys: Sequence[str] = (), method: str = "t") -> DataFrame:
    """One-regressor OLS; keys without an estimate have a ``reason``."""
    out = explained(run_ols(df, y, [x], keys=keys, method=method), MIN_ROWS)
    return out.select(*keys, "coefficient", "std_error", "t_stat", "p_value", "n_obs", "reason")


def _shape(df: DataFrame, name: Column, kind: str, description: Column) -> DataFrame:
    return df.select(
        name.alias("test_name"),
        F.lit(kind).alias("test_type"),
        "coefficient",
        "std_error",
        "p_value",
        "n_obs",
        (F.col("p_value") < 0.05).alias("significant"),
        description.alias("description"),
        "reason",
    )


def placebo_periods(df: DataFrame, n_placebos: int, pre_period_end: int, spec: PanelSpec = PANEL) -> DataFrame:
    """Fake start periods: the last ``n`` pre-treatment periods but one."""
    periods = df.select(F.col(spec.time).alias("placebo")).filter(F.col(spec.time) < pre_period_end).distinct()
    # Whether there are two more than asked for is all the count decides, so
    # the latest few periods tell everything.
    latest = periods.orderBy(F.desc("placebo")).limit(n_placebos + 2)
    count = F.count(F.lit(1)).over(Window.partitionBy())
    take = F.when(count < n_placebos + 2, F.greatest(F.lit(1), count - 2)).otherwise(n_placebos)
    ranked = latest.select("placebo", F.row_number().over(Window.orderBy(F.desc("placebo"))).alias("_r"), take.alias("_take"))
    return ranked.filter((F.col("_r") > 1) & (F.col("_r") <= F.col("_take") + 1)).select("placebo")


def run_placebo_time(
    df: DataFrame,
    n_placebos: int = N_PLACEBOS,
    pre_period_end: int = PRE_PERIOD_END,
    spec: PanelSpec = PANEL,
    method: str = "t",
) -> DataFrame:
    """Fake treatment at earlier periods, on pre-treatment rows only.

    The fake regressor depends on a row only through its period and group, so
    rows are first aggregated by (period, ever treated); the placebo periods
    then multiply that small table.
    """
    ever = F.col("ever_treated") == 1 if "ever_treated" in df.columns else F.lit(True)
    pre = df.filter((F.col(spec.time) <= pre_period_end) & ~is_missing(df, spec.outcome))
    cells = group_moments(pre.select(spec.time, ever.alias("_ever"), spec.outcome), [spec.outcome], [spec.time, "_ever"])
    fakes = placebo_periods(df, n_placebos, pre_period_end, spec)
    axis = fakes.agg(F.collect_list("placebo").alias("_fakes"))
    tagged = cells.join(F.broadcast(axis)).withColumn("placebo", F.explode("_fakes")).drop("_fakes")
    fake = (F.coalesce(F.col("_ever"), F.lit(False)) & (F.col(spec.time) >= F.col("placebo"))).cast("double")
    # A cell has one regressor value, so its inner co-moments with it are zero.
    widened = tagged.withColumns({"mu_1": fake, "s_0_1": F.lit(0.0), "s_1_1": F.lit(0.0)})
    fit = solve(combine(widened, 2, ["placebo"]), 2, ["placebo"])
    rows = explained(finish(fit, ["placebo"], ["placebo"], None, method, False), MIN_ROWS)
    label = F.col("placebo").cast("string")
    return _shape(
        rows,
        F.concat(F.lit("placebo_t"), label),
        "placebo",
        F.concat(F.lit("Placebo treatment at period "), label),
    )


def trim_endpoints(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows without the first and last period; empty with 4 periods or fewer."""
    axis = df.select(spec.time).distinct().agg(
        F.min(spec.time).alias("_first"), F.max(spec.time).alias("_last"), F.count(spec.time).alias("_n")
    )
    inner = (F.col(spec.time) > F.col("_first")) & (F.col(spec.time) < F.col("_last")) & (F.col("_n") > 4)
    return df.join(F.broadcast(axis)).filter(inner).select(*df.columns)


def trim_outliers(df: DataFrame, column: str, bounds: tuple[float, float] = TRIM) -> DataFrame:
    """Rows between two exact quantiles, both included."""
    limits = exact_quantiles(df, column, {"_lo": bounds[0], "_hi": bounds[1]})
    return df.join(F.broadcast(limits)).filter(F.col(column).between(F.col("_lo"), F.col("_hi"))).select(*df.columns)


def subsample(df: DataFrame, fraction: float = SUBSAMPLE, seed: int = 42, spec: PanelSpec = PANEL) -> DataFrame:
    return hash_ranked_sample(df, [spec.unit, spec.time], fraction, seed)


def first_covariate(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.startswith("covariate_")), None)


def run_alternative_specs(df: DataFrame, spec: PanelSpec = PANEL, method: str = "t") -> DataFrame:
    """The main estimate, and the one with the first covariate as control."""
    return _estimate_tags(_tag(df, _spec_tests(df, spec), spec), first_covariate(df), method)


def _spec_tests(df: DataFrame, spec: PanelSpec) -> dict[str, Column]:
    control = first_covariate(df)
    return {"main": F.lit(True)} | ({"with_control": F.col(control).isNotNull()} if control else {})


def _tag(df: DataFrame, tests: Mapping[str, Column], spec: PanelSpec) -> DataFrame:
    """One row per (test, row in its sample) with y, x and the control z."""
    tags = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in tests.items()]))
    control = first_covariate(df)
    z = F.coalesce(F.col(control), F.lit(0.0)) if control else F.lit(0.0)
    known = ~is_missing(df, spec.outcome) & ~is_missing(df, spec.treatment)
    return df.filter(known).select(
        F.explode(tags).alias("test_name"),
        F.col(spec.outcome).alias("y"),
        F.col(spec.treatment).alias("x"),
        z.alias("z"),
    )


def _estimate_tags(tagged: DataFrame, control: str | None, method: str, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Estimates of all tests from one moment table by test."""
    table = group_moments(tagged, ["y", "x", "z"], ["test_name"])
    narrow = table.filter(F.col("test_name") != "with_control")
    rows = finish(solve(narrow, 2), ["x"], ["test_name"], None, method, False)
    if control:
        wide = table.filter(F.col("test_name") == "with_control")
        rows = rows.unionByName(finish(solve(wide, 3), ["x", "z"], ["test_name"], None, method, False))
    notes = {
        "main": "Main specification (baseline)",
        "with_control": f"Including {control} as control",
        **SAMPLE_NOTES,
        **(extra or {}),
    }
    note = F.create_map(*[F.lit(v) for pair in notes.items() for v in pair])[F.col("test_name")]
    kept = explained(rows, MIN_ROWS)
    kind = F.when(F.col("test_name").isin("main", "with_control"), "specification").otherwise("sample")
    return kept.select(
        "test_name",
        kind.alias("test_type"),
        "coefficient",
        "std_error",
        "p_value",
        "n_obs",
        (F.col("p_value") < 0.05).alias("significant"),
        note.alias("description"),
        "reason",
    )


# The sample tests and what they say.
SAMPLE_NOTES = {
    "trim_endpoints": "Excluding first and last periods",
    "subsample_80": "Random 80% subsample",
    "trim_outliers": "Excluding 1st and 99th percentile outcomes",
}


def run_sample_restrictions(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    method: str = "t",
    extra: Mapping[str, Column] | None = None,
    seed: int = 42,
) -> DataFrame:
    """The main regression on restricted samples, in one grouped estimation.

    ``extra`` names further filters as conditions.  The subsample keeps the
    rows whose hash is below the exact 80 % quantile of the hashes, found by
    counting hash buckets.
    """
    wide, tests = _sample_conditions(df, spec, seed)
    tests |= dict(extra or {})
    notes = {name: f"Restricted to {name}" for name in (extra or {})}
    return _estimate_tags(_tag(wide, tests, spec), None, method, notes)


def _sample_conditions(df: DataFrame, spec: PanelSpec, seed: int) -> tuple[DataFrame, dict[str, Column]]:
    """The panel with one-row bounds joined on, and each sample as a condition."""
    text = F.concat_ws("-", F.col(spec.unit).cast("string"), F.col(spec.time).cast("string"), F.lit(str(seed)))
    hashed = df.withColumn("_h", F.md5(text.cast("binary")))
    limits = exact_quantiles(df, spec.outcome, {"_lo": TRIM[0], "_hi": TRIM[1]})
    axis = df.select(spec.time).distinct().agg(
        F.min(spec.time).alias("_first"), F.max(spec.time).alias("_last"), F.count(spec.time).alias("_n")
    )
    cut = _hash_cut(hashed, SUBSAMPLE)
    wide = hashed.join(F.broadcast(limits)).join(F.broadcast(axis)).join(F.broadcast(cut))
    inner = (F.col(spec.time) > F.col("_first")) & (F.col(spec.time) < F.col("_last")) & (F.col("_n") > 4)
    return wide, {
        "trim_endpoints": inner,
        "subsample_80": F.col("_h") <= F.col("_cut"),
        "trim_outliers": F.col(spec.outcome).between(F.col("_lo"), F.col("_hi")),
    }


def _hash_cut(hashed: DataFrame, fraction: float) -> DataFrame:
    """The largest hash text among the ``round(fraction * n)`` smallest."""
    sizes = hashed.groupBy(F.substring("_h", 1, 4).alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
    until = F.sum("_size").over(Window.orderBy("_b"))
    total = sizes.agg(F.round(F.sum("_size") * F.lit(fraction)).cast("long").alias("_take"))
    # At most 65,536 buckets; the boundary bucket holds a sliver of the rows.
    edge = (
        sizes.withColumn("_until", until)
        .join(F.broadcast(total))
        .filter((F.col("_until") >= F.col("_take")) & (F.col("_until") - F.col("_size") < F.col("_take")))
        .withColumn("_room", F.col("_take") - (F.col("_until") - F.col("_size")))
        .select("_b", "_room")
    )
    inside = hashed.select("_h", F.substring("_h", 1, 4).alias("_b")).join(F.broadcast(edge), "_b")
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h")))
    return ranked.filter(F.col("_r") == F.col("_room")).agg(F.max("_h").alias("_cut"))


def run_placebo_group(
    df: DataFrame, start: int, share: float = 0.5, seed: int = 42, spec: PanelSpec = PANEL, method: str = "t"
) -> DataFrame:
    """Treatment given to a hashed share of units from ``start`` on."""
    chosen = hash_uniform(F.col(spec.unit), F.lit("placebo"), F.lit(seed)) < share
    fake = (chosen & (F.col(spec.time) >= start)).cast("int")
    rows = run_simple_ols(df.withColumn("_fake", fake), spec.outcome, "_fake", method=method)
    return _shape(rows, F.lit("placebo_group"), "placebo", F.lit("Randomised treatment group"))


def run_placebo_outcome(df: DataFrame, outcome: str, spec: PanelSpec = PANEL, method: str = "t") -> DataFrame:
    """The treatment should not move an outcome it cannot affect."""
    rows = run_simple_ols(df, outcome, spec.treatment, method=method)
    return _shape(rows, F.lit("placebo_outcome"), "placebo", F.lit(f"Unaffected outcome {outcome}"))


def run_battery(
    df: DataFrame,
    n_placebos: int = N_PLACEBOS,
    pre_period_end: int = PRE_PERIOD_END,
    spec: PanelSpec = PANEL,
    method: str = "t",
    run_specs: bool = True,
    run_placebos: bool = True,
    run_samples: bool = True,
) -> DataFrame:
    """All robustness results in one table."""
    wide, tests = _sample_conditions(df, spec, 42) if run_samples else (df, {})
    if run_specs:
        tests = _spec_tests(df, spec) | tests
    parts = []
    if tests:
        control = first_covariate(df) if run_specs else None
        parts.append(_estimate_tags(_tag(wide, tests, spec), control, method))
    if run_placebos:
        parts.append(run_placebo_time(df, n_placebos, pre_period_end, spec, method))
    if not parts:
        raise ValueError("nothing to run")
    return reduce(DataFrame.unionByName, parts).select(*COLUMNS)


def placebo_results(battery: DataFrame) -> DataFrame:
    return battery.filter(F.col("test_type") == "placebo")

