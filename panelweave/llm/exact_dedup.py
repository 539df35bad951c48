"""Exact dedup by content-defined chunk recipes.

A text is cut where its content says so, so equal passages give equal chunks
wherever they stand.  Chunks move once, already distinct per task, to turn
their hashes into verified identifiers; after that only ordered lists of
identifiers are compared, never whole documents.

Defined results: a null text counts as empty and an empty text has the empty
recipe, so all of them form one group.  A null id is a member like any other
and is kept only where no member has an id.  Rows repeated in both id and text
count in the group size and agree in all columns; :func:`unique_documents`
leaves one of them.  Other columns of the input are ignored, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, taken

#: A chunk ends after a line break or a sentence end, has at least the first
#: number of characters unless the text ends, and at most the second.
CHUNK_SIZES = (512, 8192)
BOUNDARY = r"\n|[.!?]\s|[。！？]"


def chunks_of(text: Column, sizes: tuple[int, int] = CHUNK_SIZES) -> Column:
    """The text as an array of chunks; their concatenation is the text."""
    low, high = sizes
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{low},{high}}}?(?:{BOUNDARY})|.{{1,{high}}}"), F.lit(0))


def _colliding(chunks: DataFrame) -> DataFrame | None:
    """One row per chunk for hashes that stand for more than one, or None.

    Such hashes are looked for first, so that where there are none, as good as
    always, the chunks have moved once.
    """
    distinct = chunks.select("hash", "chunk").distinct()
    twice = settle(distinct.groupBy("hash").count().where("count > 1").select("hash"))
    return None if twice.isEmpty() else settle(distinct.join(twice, "hash", "left_semi"))


def recipes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sizes: tuple[int, int] = CHUNK_SIZES,
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``text_sha256`` and ``recipe``, the
    ordered list of verified chunk identifiers.

    An identifier is the chunk's hash and its place among the chunks sharing
    that hash.  Whether any hash is shared is found by comparing the chunks
    themselves; where none is, every place is 0 and no text moves again.
    """
    docs = taken(df, {"doc_id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit(""))})
    cut = docs.withColumn("chunks", chunks_of(F.col("text"), sizes))
    pieces = cut.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("hash"), "chunk")
    hashed = F.transform("chunks", lambda c: F.struct(chunk_hash(c).alias("hash"), F.lit(0).alias("place")))
    plain = cut.select("doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), hashed.alias("recipe"))
    shared = _colliding(pieces)
    if shared is None:
        return plain
    return _with_places(cut, plain, shared, chunk_hash)


def _with_places(
    cut: DataFrame, plain: DataFrame, shared: DataFrame, chunk_hash: Callable[[Column], Column]
) -> DataFrame:
    """Replace the places of chunks whose hash other chunks share."""
    order = Window.partitionBy("hash").orderBy("chunk")
    places = shared.withColumn("place", F.row_number().over(order) - 1)
    members = cut.select(
        "doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), F.posexplode("chunks").alias("at", "chunk")
    ).withColumn("hash", chunk_hash(F.col("chunk")))
    placed = (
        members.distinct()
        .join(places, ["hash", "chunk"], "left")
        .groupBy("doc_id", "text_sha256")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("at", "hash", F.coalesce("place", F.lit(0)).cast("int").alias("place")))
            ).alias("placed")
        )
        .select(
            F.col("doc_id").alias("d"),
            F.col("text_sha256").alias("s"),
            F.transform("placed", lambda x: F.struct(x["hash"].alias("hash"), x["place"].alias("place"))).alias("exact"),
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("s"))
    return plain.join(placed, same, "left").select(
        "doc_id", "text_sha256", F.coalesce("exact", "recipe").alias("recipe")
    )


def group_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row with the row that stays of its group of copies.

    Returns ``doc_id``, ``keep_id`` (largest id of the group), ``group_size``,
    ``kept`` and ``text_sha256``.  Groups are counted per task before they are
    shuffled, and a group of any size is one row when it joins back, so that
    the rows of a hot group can be split over tasks.
    """
    lists = settle(recipes(df, id_col, text_col, **options))
    groups = lists.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Read from a table, both sides are shuffled for the join alone; only then
    # can adaptive execution split a hot recipe.
    return lists.join(settle(groups), "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def unique_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one row of each
    group of equal texts, the one with the largest id."""
    kept = group_copies(df, id_col, text_col).where("kept").select(_row_key("keep_id", "text_sha256").alias("_key"))
    mine = _row_key(id_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = df.withColumn("_key", mine).join(kept, "_key", "left_semi")
    return rows.dropDuplicates(["_key"]).drop("_key")


def _row_key(doc_id: str, digest: str | Column) -> Column:
    """One text for id and digest, so that join and dedup share a shuffle; no id
    differs from every id."""
    held = F.col(digest) if isinstance(digest, str) else digest
    return F.concat(held, F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("")))
