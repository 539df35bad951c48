"""File inventories: size, time, digest, category and provenance hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file that one row can hold; only larger ones have no digest.
ROW_BYTES = (1 << 31) - 1 - (1 << 10)


def file_name(path: str = "path"):
    return F.element_at(F.split(F.col(path), "/"), -1)


def file_extension(path: str = "path"):
    """Extension with its dot, lower case; empty for names without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def file_inventory(
    files: DataFrame,
    category: str | None = None,
    include_exts: Sequence[str] | None = None,
    exclude_names: Sequence[str] | None = None,
    max_hash_bytes: int = ROW_BYTES,
) -> DataFrame:
    """Manifest rows from a table shaped like Spark's ``binaryFile`` source.

    ``files`` has ``path``, ``length``, ``modificationTime`` and ``content``.
    """
    df = files
    if include_exts:
        df = df.filter(file_extension().isin(*[e.lower() for e in include_exts]))
    if exclude_names:
        df = df.filter(~file_name().isin(*exclude_names))
    digest = F.when(F.col("length") <= max_hash_bytes, F.sha2("content", 256))
    return df.select(
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
        F.lit(category).cast("string").alias("category"),
        digest.alias("sha256"),
    )


def collect_files(
    spark: SparkSession,
    directory: str,
    category: str | None = None,
    include_exts: Sequence[str] | None = None,
    exclude_names: Sequence[str] | None = None,
    max_hash_bytes: int = ROW_BYTES,
) -> DataFrame:
    """Recursive inventory of ``directory``.

    Every file that fits one row has its digest.  Larger ones come from a
    second scan that prunes the content column; their digest is NULL.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    small = base.load(str(directory)).filter(F.col("length") <= max_hash_bytes)
    large = (
        base.load(str(directory))
        .filter(F.col("length") > max_hash_bytes)
        .select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    )
    both = small.select("path", "modificationTime", "length", "content").unionByName(large)
    return file_inventory(both, category, include_exts, exclude_names, max_hash_bytes)


def source_hints(manifest: DataFrame, upstream: DataFrame) -> DataFrame:
    """Upstream files that carry the same file name as a manifest entry.

    The answer has one row per (entry, hint).  Entries without a hint keep one
    row with a NULL hint, so nothing is gathered into one group.
    """
    left = manifest.withColumn("_name", file_name("path"))
    right = upstream.select(file_name("path").alias("_name"), F.col("path").alias("source_hint"))
    return left.join(right, "_name", "left").drop("_name")
