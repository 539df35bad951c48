"""Format-dispatching readers and writers.

Paths may live on any Hadoop file system; existence tests and globbing go
through the Hadoop client of the session, never through the local disk.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json"}
# The input patterns searched when none are given.
INPUT_PATTERNS = ("*.parquet", "*.csv", "*.json")
# Text that stands for "missing" in delimited files.
MISSING_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")


def _extension(path: str) -> str:
    return posixpath.splitext(path.rstrip("/"))[1].lower()


def _format(path: str) -> str:
    ext = _extension(path)
    if ext not in FORMATS:
        raise ValueError(f"no reader or writer for '{ext}' files")
    return FORMATS[ext]


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _hadoop_path(spark, str(path))
    return fs.exists(jpath)


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so there is one missing value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.name in floats else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_text_columns(spark: SparkSession, path: str, types: dict[str, str], **options) -> DataFrame:
    """Read delimited text with declared types.

    Every column is read as text, the missing tokens become NULL and the rest
    is cast with ``try_cast``; one odd token therefore cannot turn a numeric
    column into text, which is what schema inference would do.
    """
    raw = spark.read.options(**{"header": "true", **options}).csv(str(path))
    cols = []
    for name in raw.columns:
        text = F.when(~F.trim(name).isin(*MISSING_TOKENS), F.col(name))
        cols.append(text.try_cast(types.get(name, "string")).alias(name))
    return raw.select(*cols)


def load_data(
    spark: SparkSession, path: str, nan_as_null: bool = True, schema: T.StructType | str | None = None, **options
) -> DataFrame:
    """Read parquet, CSV or JSON, chosen by the extension of ``path``.

    A given ``schema`` saves CSV and JSON the pass that infers one.  Large CSV
    files are split between tasks unless ``multiLine="true"`` allows line
    breaks inside quotes.
    """
    path = str(path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    fmt = _format(path)
    if fmt == "csv":
        options = {"header": "true", "inferSchema": str(schema is None).lower(), **options}
    reader = spark.read.options(**options).format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    # Parquet keeps missing values as NULL; NaN only enters through text.
    return normalise_missing(df) if nan_as_null and fmt != "parquet" else df


def save_data(df: DataFrame, path: str, index: bool = False, **options) -> str:
    """Write parquet, CSV or JSON, chosen by the extension; overwrites.

    Spark creates the missing parent folders.  ``index`` is accepted for call
    compatibility; a Spark table has no row index to write.
    """
    path = str(path)
    fmt = _format(path)
    if fmt == "csv":
        options = {"header": "true", **options}
    df.write.mode("overwrite").options(**options).format(fmt).save(path)
    return path


def find_input_files(spark: SparkSession, raw_dir: str, patterns: Sequence[str] | None = None) -> list[str]:
    """Paths in ``raw_dir`` that match any of the glob ``patterns``, sorted."""
    found: set[str] = set()
    for pattern in patterns or INPUT_PATTERNS:
        jpath, fs = _hadoop_path(spark, posixpath.join(str(raw_dir), pattern))
        found.update(str(s.getPath().toString()) for s in fs.globStatus(jpath) or [])
    return sorted(p.removeprefix("file:") for p in found)


def load_all_sources(
    spark: SparkSession, files: Iterable[str], concat: bool = True, source_column: str | None = None
) -> tuple[DataFrame | dict[str, DataFrame] | None, dict[str, str]]:
    """Load many files; returns the data and the reading errors by path.

    With ``concat`` the sources are stacked on the union of their columns and
    absent columns become NULL; ``source_column`` holds the file's stem.
    Without it the frames are keyed by path, so equal names stay apart.
    """
    frames: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    for path in files:
        try:
            frames[str(path)] = load_data(spark, path)
        except (AnalysisException, FileNotFoundError, ValueError) as error:
            errors[str(path)] = str(error)
    if not concat:
        return frames, errors
    stacked = None
    for path, frame in frames.items():
        if source_column:
            stem = posixpath.splitext(posixpath.basename(path.rstrip("/")))[0]
            frame = frame.withColumn(source_column, F.lit(stem))
        stacked = frame if stacked is None else stacked.unionByName(frame, allowMissingColumns=True)
    return stacked, errors


def count_rows(spark: SparkSession, path: str, **options) -> int:
    """Row count; a parquet or JSON scan reads no column for it.

    A missing file has no rows.
    """
    return load_data(spark, path, nan_as_null=False, **options).count() if path_exists(spark, path) else 0


def save_diagnostic(df: DataFrame, directory: str, name: str, subdir: str = "") -> str:
    """Write a small result table as one CSV part under ``directory``."""
    path = posixpath.join(str(directory), subdir, f"{name}.csv")
    # Result tables hold one row per estimate or check, so one part is enough.
    return save_data(df.coalesce(1), path)


def load_diagnostic(spark: SparkSession, directory: str, name: str, subdir: str = "") -> DataFrame:
    path = posixpath.join(str(directory), subdir, f"{name}.csv")
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no result table at {path}")
    return load_data(spark, path)
