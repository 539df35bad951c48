"""Stages that hand parquet tables to each other.

Every stage reads the table the one before wrote and writes its own, so a run
can resume at any stage and a lost executor never costs more than one stage.
The panel is written once and then scanned by estimation and robustness with
only the columns they use.
"""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import cleaning, linkage, panel, regression, robustness, rules
from ..sources import files
from .specs import PANEL, PanelSpec

# Table names of the stages.
RAW, LINKED, PANEL_TABLE = "data_raw.parquet", "data_linked.parquet", "panel.parquet"
DIAGNOSTICS = "diagnostics"


class StageError(RuntimeError):
    """A stage whose checks failed."""


def _read(spark: SparkSession, work: str, name: str) -> DataFrame:
    return files.load_data(spark, posixpath.join(work, name))


def _write(spark: SparkSession, df: DataFrame, work: str, name: str) -> DataFrame:
    return files.load_data(spark, files.save_data(df, posixpath.join(work, name)))


def _report(df: DataFrame, work: str, name: str) -> None:
    files.save_diagnostic(df, posixpath.join(work, DIAGNOSTICS), name)


def _demand(validator: rules.DataValidator, df: DataFrame) -> None:
    report = validator.validate(df)
    if report.has_errors:
        raise StageError(report.format())


def ingest_data(
    spark: SparkSession,
    raw_dir: str,
    work: str,
    patterns: Sequence[str] | None = None,
    renames: Mapping[str, str] | None = None,
    types: Mapping[str, str] | None = None,
    required: Sequence[str] = ("id",),
) -> DataFrame:
    """Read all inputs, clean, cast, check and write the raw table."""
    found = files.find_input_files(spark, raw_dir, patterns)
    stacked, errors = files.load_all_sources(spark, found)
    if stacked is None:
        raise StageError(f"no readable input in {raw_dir}: {errors}")
    clean = cleaning.clean_data(cleaning.rename_columns(stacked, renames or {}))
    typed = cleaning.convert_types(clean, types or {"id": "int64"})
    _demand(rules.input_rules(typed, required), typed)
    return _write(spark, typed, work, RAW)


def link_records(
    spark: SparkSession,
    work: str,
    sources: Sequence[str] = (),
    key_columns: Sequence[str] = linkage.DEFAULT_KEY_COLUMNS,
) -> DataFrame:
    """Left-join further tables of the work folder on shared keys."""
    present = [s for s in sources if files.path_exists(spark, posixpath.join(work, s))]
    frames = {s: _read(spark, work, s) for s in present}
    linked, summary = linkage.link_sources(_read(spark, work, RAW), frames, key_columns)
    _report(summary, work, "linkage_summary")
    return _write(spark, linked, work, LINKED)


def build_panel(
    spark: SparkSession, work: str, balance: bool = False, fill_method: str = "drop", spec: PanelSpec = PANEL
) -> DataFrame:
    """Balance if asked, add codes and treatment columns, check and write."""
    df = _read(spark, work, LINKED)
    if balance:
        df = panel.balance_panel(df, fill_method, spec)
    df = panel.create_fixed_effects(df, spec)
    if spec.treatment in df.columns:
        df = panel.add_treatment_columns(df, spec)
    _demand(rules.panel_rules(spec.unit, spec.time), df)
    written = _write(spark, df, work, PANEL_TABLE)
    _report(panel.calculate_panel_diagnostics(written, spec), work, "panel_summary")
    return written


def run_estimation(
    spark: SparkSession,
    work: str,
    names: Sequence[str] = ("baseline",),
    sample: Column | None = None,
    spec: PanelSpec = PANEL,
    method: str = "t",
) -> tuple[DataFrame, dict[str, str]]:
    """Estimate named specifications; write results and coefficients."""
    data = _read(spark, work, PANEL_TABLE)
    missing = [c for c in (spec.outcome, spec.treatment) if c not in data.columns]
    if missing:
        raise StageError(f"Missing required columns: {missing}")
    results, skipped = regression.run_specifications(data, list(names), spec, sample=sample, method=method)
    if results is None:
        raise StageError(f"no specification could be run: {skipped}")
    _report(results, work, "estimation_results")
    written = files.load_diagnostic(spark, posixpath.join(work, DIAGNOSTICS), "estimation_results")
    _report(regression.coefficient_table(written), work, "coefficients")
    return written, skipped


def estimate_robustness(spark: SparkSession, work: str, spec: PanelSpec = PANEL, **options) -> DataFrame:
    """Run the battery; write all results and the placebo rows."""
    _report(robustness.run_battery(_read(spark, work, PANEL_TABLE), spec=spec, **options), work, "robustness_results")
    written = files.load_diagnostic(spark, posixpath.join(work, DIAGNOSTICS), "robustness_results")
    _report(robustness.placebo_results(written), work, "placebo_results")
    return written
