"""Stage audits: size, missing values, attrition and comparison."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.missing import is_missing
from ..sources.files import load_data, path_exists
from .manifest import compare_columns

# The stage files of a run, relative to its root.
DEFAULT_STAGES = {
    "s00_raw": "data_work/data_raw.parquet",
    "s01_linked": "data_work/data_linked.parquet",
    "s02_panel": "data_work/panel.parquet",
}
STAGE_SCHEMA = (
    "stage_no int, stage_name string, exists boolean, row_count long, column_count int, columns array<string>,"
    " file_size_mb double, modified_time timestamp, missing_by_column map<string,long>, notes string"
)


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_missing, percent_missing) for columns with any, in one pass."""
    total = F.count(F.lit(1))
    wide = df.agg(total.alias("_n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"m{i}").alias("n_missing"),
                F.coalesce(F.try_divide(F.col(f"m{i}") * 100.0, F.col("_n")), F.lit(0.0)).alias("percent_missing"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return wide.select(F.inline(rows)).filter("n_missing > 0")


def audit_frame(df: DataFrame, stage_no: int, name: str) -> DataFrame:
    """One row for a stage held as a DataFrame."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"m{i}").alias("value")) for i, c in enumerate(df.columns)])
    return wide.select(
        F.lit(stage_no).alias("stage_no"),
        F.lit(name).alias("stage_name"),
        F.lit(True).alias("exists"),
        F.col("_n").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.lit(None).cast("double").alias("file_size_mb"),
        F.lit(None).cast("timestamp").alias("modified_time"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0)).alias("missing_by_column"),
        F.lit("").alias("notes"),
    )


def audit_stage(spark: SparkSession, stage_no: int, name: str, path: str) -> DataFrame:
    """One row for a stage file; a missing or unreadable file is noted."""
    if not path_exists(spark, path):
        note = [(stage_no, name, False, 0, 0, [], 0.0, None, {}, "no file")]
        return spark.createDataFrame(note, STAGE_SCHEMA)
    try:
        df = load_data(spark, path, nan_as_null=True)
    except Exception as error:
        note = [(stage_no, name, True, 0, 0, [], 0.0, None, {}, f"Error reading file: {error}")]
        return spark.createDataFrame(note, STAGE_SCHEMA)
    meta = F.col("_metadata")
    files = df.select(meta["file_path"].alias("f"), meta["file_size"].alias("s"), meta["file_modification_time"].alias("t"))
    # File facts repeat on every row; grouping by file leaves one row each.
    facts = files.groupBy("f").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    sizes = facts.agg((F.sum("s") / 1048576.0).alias("_mb"), F.max("t").alias("_mt"))
    row = audit_frame(df, stage_no, name).drop("file_size_mb", "modified_time")
    return row.join(F.broadcast(sizes)).select(
        "stage_no", "stage_name", "exists", "row_count", "column_count", "columns",
        F.col("_mb").alias("file_size_mb"), F.col("_mt").alias("modified_time"), "missing_by_column", "notes",
    )


def attrition(stages: DataFrame) -> DataFrame:
    """Row change between consecutive stages that have rows."""
    order = Window.orderBy("stage_no")  # one row per stage
    filled = stages.filter(F.col("exists") & (F.col("row_count") > 0))
    steps = filled.select(
        F.lag("stage_name").over(order).alias("from_stage"),
        F.col("stage_name").alias("to_stage"),
        F.lag("row_count").over(order).alias("from_rows"),
        F.col("row_count").alias("to_rows"),
    ).filter("from_stage IS NOT NULL")
    change = F.col("to_rows") - F.col("from_rows")
    return steps.withColumns(
        {"difference": change, "percent_change": change * 100.0 / F.col("from_rows")}
    )


def stage_missing(stages: DataFrame) -> DataFrame:
    """(stage_name, column_name, n_missing, percent_missing) in long form."""
    long = stages.select("stage_name", "row_count", F.explode("missing_by_column").alias("column_name", "n_missing"))
    share = F.coalesce(F.try_divide(F.col("n_missing") * 100.0, F.col("row_count")), F.lit(0.0))
    return long.select("stage_name", "column_name", "n_missing", share.alias("percent_missing"))


class PipelineAudit:
    """Audit of the stage files below a root folder."""

    def __init__(self, spark: SparkSession, root: str = ".", stages: Mapping[str, str] | None = None) -> None:
        self.spark, self.root = spark, str(root).rstrip("/")
        self.stages = dict(stages or DEFAULT_STAGES)

    def _path(self, name: str) -> str:
        if name not in self.stages:
            raise ValueError(f"no such stage among {list(self.stages)}")
        return f"{self.root}/{self.stages[name]}"

    def audit_stage(self, name: str) -> DataFrame:
        return audit_stage(self.spark, list(self.stages).index(name), name, self._path(name))

    def run_full_audit(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.audit_stage(name) for name in self.stages])

    def compare_stages(self, first: str, second: str) -> DataFrame:
        frames = [load_data(self.spark, self._path(n)) for n in (first, second)]
        return compare_columns(*frames, first, second)

    def save(self, path: str) -> str:
        """Write stages as JSON lines next to their attrition."""
        stages = self.run_full_audit()
        stages.coalesce(1).write.mode("overwrite").json(f"{path}/stages.json")
        attrition(stages).coalesce(1).write.mode("overwrite").json(f"{path}/attrition.json")
        return path
