"""A corpus in five stages: language, exact copies, near copies, benchmark
passages, token ids.

Every stage takes the documents its predecessor kept.  Filtering stages return
whole rows, so ids, texts and labels pass unchanged; the last returns the ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import bpe, decontamination, exact_dedup, language, near_dedup
from panelweave.llm.shared import stored

#: No SQL: languages are told apart by compression.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is clear; labels of ``docs`` teach it."""
    taken, mark = {name.lower() for name in docs.columns}, "_"
    while any(name.startswith(mark) for name in taken):
        mark += "_"
    names = (f"{mark}lang_pred", f"{mark}score", f"{mark}rejected")
    found = language.with_language(docs, language.learn(docs), names=names)
    return found.where(~F.col(names[2])).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return exact_dedup.unique_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies, by shingles of five
    words and a similarity of 0.8."""
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a passage of a benchmark item."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept document, with digests of ids and decoded text."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
