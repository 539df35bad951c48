"""Row cleaning, typing, missing values and derived columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouping import attach_group_stats

# Type names accepted by the casts, and the codes for "missing".
TYPE_NAMES = {
    "int64": "bigint",
    "int": "bigint",
    "int32": "int",
    "float64": "double",
    "float": "double",
    "str": "string",
    "object": "string",
    "bool": "boolean",
    "datetime": "timestamp",
    "datetime64": "timestamp",
}
SENTINELS = (-999, "")


def clean_data(df: DataFrame, drop_duplicates: bool = True, observation: Observation | None = None) -> DataFrame:
    """Drop rows without any value, then exact duplicates (NULLs are equal).

    ``observation`` collects ``n_input`` and ``n_non_empty`` while the result
    is computed, so the counts cost no extra pass.
    """
    empty = F.lit(True)
    for name in df.columns:
        empty = empty & F.col(f"`{name}`").isNull()
    flagged = df
    if observation is not None:
        flagged = df.observe(
            observation,
            F.count(F.lit(1)).alias("n_input"),
            F.coalesce(F.sum((~empty).cast("long")), F.lit(0)).alias("n_non_empty"),
        )
    kept = flagged.filter(~empty)
    return kept.dropDuplicates() if drop_duplicates else kept


def cleaning_counts(df: DataFrame) -> DataFrame:
    """One row: input rows, empty rows, duplicate rows, rows kept.

    Rows are grouped by their full value, so copies collapse before the
    shuffle however many there are.
    """
    empty = F.lit(True)
    for name in df.columns:
        empty = empty & F.col(f"`{name}`").isNull()
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_empty", empty)
    copies = F.col("_copies")
    return groups.agg(
        F.coalesce(F.sum(copies), F.lit(0)).cast("long").alias("n_input"),
        F.coalesce(F.sum(F.when(F.col("_empty"), copies)), F.lit(0)).cast("long").alias("n_empty"),
        F.coalesce(F.sum(F.when(~F.col("_empty"), copies - 1)), F.lit(0)).cast("long").alias("n_duplicates"),
        F.coalesce(F.sum(F.when(~F.col("_empty"), 1)), F.lit(0)).cast("long").alias("n_kept"),
    )


def _cast_is_lossy(name: str, source: T.DataType, target: str) -> Column:
    """True for a value that stops the whole column from being cast."""
    value = F.col(f"`{name}`")
    lossy = value.isNotNull() & value.try_cast(target).isNull()
    if isinstance(source, (T.DoubleType, T.FloatType)) and target in ("bigint", "int"):
        # Missing and infinite floats have no integer form.
        lossy = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))) | lossy
    return lossy


def conversion_report(df: DataFrame, type_map: Mapping[str, str]) -> DataFrame:
    """One row per listed column: target type, values in the way, convertible."""
    names = [c for c in type_map if c in df.columns]
    targets = {c: TYPE_NAMES.get(type_map[c], type_map[c]) for c in names}
    counts = df.agg(
        *[
            F.coalesce(F.sum(_cast_is_lossy(c, df.schema[c].dataType, targets[c]).cast("long")), F.lit(0)).alias(c)
            for c in names
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(targets[c]).alias("target_type"),
                F.col(c).cast("long").alias("n_blocking"),
                (F.col(c) == 0).alias("converted"),
            )
            for c in names
        ]
    )
    return counts.select(F.inline(rows))


def convert_types(df: DataFrame, type_map: Mapping[str, str]) -> DataFrame:
    """Cast listed columns; a column that cannot be cast as a whole stays as is.

    One aggregate over all listed columns decides, and one small row of
    counts (a value per listed column) is read by the driver because the
    answer changes the result schema.
    """
    names = [c for c in type_map if c in df.columns]
    if not names:
        return df
    verdict = {r["column_name"]: r["converted"] for r in conversion_report(df, type_map).collect()}
    targets = {c: TYPE_NAMES.get(type_map[c], type_map[c]) for c in names}
    return df.withColumns({c: F.col(f"`{c}`").cast(targets[c]) for c in names if verdict[c]})


def clean_numeric(
    df: DataFrame, columns: Sequence[str], replace_inf: bool = True, fill_value: float | None = None
) -> DataFrame:
    """Infinite values become NULL, then missing values are optionally filled."""
    changed = {}
    for name in columns:
        if name not in df.columns:
            continue
        value = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
            if replace_inf:
                value = F.when(F.abs(value) != F.lit(float("inf")), value)
        if fill_value is not None:
            value = F.coalesce(value, F.lit(fill_value))
        changed[name] = value
    return df.withColumns(changed) if changed else df


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names with underscores."""

    def snake(name: str) -> str:
        spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip())
        return re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()

    return df.withColumnsRenamed({c: snake(c) for c in df.columns})


def complete_cases(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Rows where every listed variable has a value; NaN is not a value.

    One condition per column, so each can reach the scan on its own.
    """
    known = F.lit(True)
    for name in dict.fromkeys(variables):
        known = known & F.col(name).isNotNull()
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            known = known & ~F.isnan(name)
    return df.filter(known)


def recode_sentinels(df: DataFrame, columns: Sequence[str] | None = None, sentinels: Sequence = SENTINELS) -> DataFrame:
    """Codes that mean "missing" become NULL, numbers and text by their type."""
    changed = {}
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            codes = [str(s) for s in sentinels]
        elif isinstance(field.dataType, T.NumericType):
            codes = [s for s in sentinels if not isinstance(s, str)]
        else:
            continue
        changed[field.name] = F.when(~value.isin(*codes), value) if codes else value
    return df.withColumns(changed) if changed else df


def clip(value: Column | str, lower=None, upper=None) -> Column:
    """Bound a value; NULL stays NULL."""
    value = F.col(value) if isinstance(value, str) else value
    bounded = value
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(lower))
    if upper is not None:
        bounded = F.least(bounded, F.lit(upper))
    return F.when(value.isNotNull(), bounded)


def derive_columns(
    df: DataFrame,
    clips: Mapping[str, tuple] | None = None,
    logs: Sequence[str] = (),
    date: str | None = None,
) -> DataFrame:
    """Clip columns, add ``log_<name>`` for positive values, year and month."""
    if clips:
        df = df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in clips.items()})
    added = {f"log_{c}": F.when(F.col(c) > 0, F.log(F.when(F.col(c) > 0, F.col(c)))) for c in logs}
    if date is not None:
        added["year"] = F.year(date)
        added["month_period"] = F.trunc(date, "month")
    return df.withColumns(added) if added else df


def missing_policy(df: DataFrame, outcome: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Drop rows without an outcome; count missing identifiers and treatment.

    Returns the kept rows and a table (column_name, n_missing, is_error).
    """
    present = [c for c in required if c in df.columns]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).cast("long").alias("n_missing"),
                (F.col(c) > 0).alias("is_error"),
            )
            for c in present
        ]
    )
    return df.filter(F.col(outcome).isNotNull()), counts.select(F.inline(rows))


def impute_group_mean(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Missing values take the mean of their group."""
    means = {f"_mean_{i}": F.avg(c) for i, c in enumerate(columns)}
    joined = attach_group_stats(df, [group], means)
    filled = {c: F.coalesce(F.col(c), F.col(f"_mean_{i}")) for i, c in enumerate(columns)}
    return joined.withColumns(filled).drop(*means)


def column_coverage(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: required columns present and missing, the share present, and
    the rows that have a value in every present one."""
    present = [c for c in required if c in df.columns]
    missing = [c for c in required if c not in df.columns]
    rate = len(present) / len(required) if required else 1.0
    complete = F.lit(True)
    for name in present:
        complete = complete & F.col(f"`{name}`").isNotNull()

    def names(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(complete).alias("n_complete")).select(
        names(present).alias("present"), names(missing).alias("missing"), F.lit(rate).alias("coverage_rate"), "n_rows", "n_complete"
    )
