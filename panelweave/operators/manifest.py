"""Comparing column sets and file manifests; classifying files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.inventory import file_extension, source_hints

__all__ = ["classify_files", "compare_columns", "compare_manifests", "file_totals", "source_hints", "map_modules"]

# File categories by extension; the first category listing an
# extension wins.
CATEGORIES = {
    "code": (".py", ".r", ".jl", ".do", ".ado", ".m"),
    "data": (".csv", ".parquet", ".xlsx", ".xls", ".dta", ".sav", ".json", ".geojson", ".gpkg", ".shp", ".feather"),
    "doc": (".md", ".rst", ".txt", ".pdf", ".docx", ".tex", ".qmd"),
    "config": (".yml", ".yaml", ".toml", ".ini", ".cfg", ".json"),
    "output": (".png", ".jpg", ".jpeg", ".svg", ".eps", ".html"),
}
# Stages and the keywords that point to them, in order.
STAGE_KEYWORDS = {
    "s00_ingest": ("data", "loader", "ingest", "load", "import"),
    "s01_link": ("link", "merge", "join", "match"),
    "s02_panel": ("panel", "construct", "build", "prepare"),
    "s03_estimation": ("model", "estim", "regress", "fit", "sem"),
    "s04_robustness": ("robust", "sensitiv", "check", "valid"),
    "s05_figures": ("visual", "plot", "figure", "graph", "chart"),
    "s06_manuscript": ("manuscript", "report", "output"),
}
UTILITY_KEYWORDS = ("util", "helper")


def category_of(extension: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, extensions in CATEGORIES.items():
        chain = chain.when(extension.isin(*extensions), name)
    return chain.otherwise("other")


def classify_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Add extension and category; hidden and cache folders are left out."""
    visible = ~F.col(path).rlike(r"(^|/)(\.[^/]|__pycache__(/|$))")
    return files.filter(visible).withColumn("extension", file_extension(path)).withColumn(
        "category", category_of(F.col("extension"))
    )


def file_totals(classified: DataFrame, size: str = "size_bytes") -> DataFrame:
    return classified.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(size).cast("long").alias("total_bytes")
    )


def map_modules(modules: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """Add the stage of each module: by name, then by path, then utilities."""

    def first_stage(text: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for stage, words in STAGE_KEYWORDS.items():
            chain = chain.when(text.rlike("|".join(words)), stage)
        return chain

    by_name, by_path = first_stage(F.lower(name)), first_stage(F.lower(path))
    utility = F.when(F.lower(path).rlike("|".join(UTILITY_KEYWORDS)), "utils")
    return modules.withColumns(
        {
            "stage": F.coalesce(by_name, by_path, utility),
            "matched_by": F.when(by_name.isNotNull(), "name")
            .when(by_path.isNotNull(), "path")
            .when(utility.isNotNull(), "utility")
            .otherwise("none"),
        }
    )


def compare_columns(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """One row: row counts, their difference, columns added, removed, common."""
    cols_a, cols_b = set(a.columns), set(b.columns)
    counts = a.agg(F.count(F.lit(1)).alias("row_count_1")).join(
        F.broadcast(b.agg(F.count(F.lit(1)).alias("row_count_2")))
    )

    def names(values: set[str]) -> Column:
        return F.array(*[F.lit(v) for v in sorted(values)]).cast("array<string>")

    return counts.select(
        F.lit(name_a).alias("stage1"),
        F.lit(name_b).alias("stage2"),
        "row_count_1",
        "row_count_2",
        (F.col("row_count_2") - F.col("row_count_1")).alias("row_diff"),
        names(cols_b - cols_a).alias("columns_added"),
        names(cols_a - cols_b).alias("columns_removed"),
        names(cols_a & cols_b).alias("columns_common"),
    )


def compare_manifests(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, status) of every path that differs.

    ``changed`` compares digests when both sides have one, else size and time.
    """
    a, b = left.alias("a"), right.alias("b")
    both = F.col("a.path").isNotNull() & F.col("b.path").isNotNull()
    digests = F.col("a.sha256").isNotNull() & F.col("b.sha256").isNotNull()
    plain = ~(F.col("a.size_bytes").eqNullSafe(F.col("b.size_bytes")) & F.col("a.mtime").eqNullSafe(F.col("b.mtime")))
    changed = F.when(digests, F.col("a.sha256") != F.col("b.sha256")).otherwise(plain)
    status = (
        F.when(F.col("b.path").isNull(), "left_only")
        .when(F.col("a.path").isNull(), "right_only")
        .when(both & changed, "changed")
    )
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), status.alias("status")).filter("status IS NOT NULL")
