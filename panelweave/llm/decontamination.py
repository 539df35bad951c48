"""Benchmark decontamination by a distributed positional inverted index.

The index holds one posting (term, document, position) for each occurrence of
a term in the training text.  Like a segmented search index it is partitioned
by documents, not by terms, so a frequent term is spread over all tasks; each
segment is sorted by term and stored as a table, so that a lookup reads the
row groups of its terms only.  Terms no test item has can never be looked up
and get no postings.

A phrase is found from its rarest terms: postings of the rarest give candidate
starts, and the postings of the next rarest, moved by their offsets, are
intersected with them.  The few starts that are left are compared word by word
with the document.

Defined results: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z
are lower-cased; null and empty texts have none.  An item of fewer words than a
window is one window; an item without words never matches, and items with a
null id take part under the id null but are not named.  Documents sharing an id
(or having none) are told apart by a hash of their text, and repeated rows get
equal results.  Other columns are ignored, whatever their names.  Empty tables
give empty results or results without hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lower_ascii, settle, small_side, stored, taken

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def phrases_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item_id``, ``phrase`` (its words) for every window of every item."""
    held = taken(items, {"item_id": F.col(id_col), "words": words_of(F.col(text_col))}).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return held.select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("phrase")
    ).distinct()


@dataclass
class PositionalIndex:
    """Postings of the terms in question, and the documents they come from."""

    docs: DataFrame  #: doc_id, doc_key, text
    postings: DataFrame  #: term, doc_key, position; sorted by term in each segment
    frequencies: DataFrame  #: term, occurrences


def build_index(
    documents: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> PositionalIndex:
    """Index every occurrence of ``terms`` (one distinct column ``term``)."""
    docs = taken(
        documents,
        {
            "doc_id": F.col(id_col),
            "doc_key": F.xxhash64(F.col(id_col), F.col(text_col), F.length(F.col(text_col))),
            "text": F.col(text_col),
        },
    )
    spelled = docs.select("doc_key", F.posexplode(words_of(F.col("text"))).alias("position", "term"))
    postings = spelled.join(small_side(terms, 64), "term").select("term", "doc_key", "position")
    index = stored(postings.sortWithinPartitions("term"), "postings")
    return PositionalIndex(docs, index, index.groupBy("term").agg(F.count("*").alias("occurrences")))


def _ordered_terms(phrases: DataFrame, frequencies: DataFrame, whole: bool = True) -> DataFrame:
    """Each distinct phrase with its terms and offsets, rarest first.  Terms
    that no document has are left out, and if ``whole``, so are their phrases."""
    spelled = phrases.select("phrase").distinct().select("phrase", F.posexplode("phrase").alias("offset", "term"))
    counted = spelled.join(frequencies, "term")
    ordered = counted.groupBy("phrase").agg(
        F.sort_array(F.collect_list(F.struct("occurrences", "term", "offset"))).alias("terms")
    )
    if whole:
        ordered = ordered.where("size(terms) = size(phrase)")
    return ordered.withColumn("phrase_key", F.xxhash64("phrase"))


def candidate_starts(index: PositionalIndex, phrases: DataFrame, depth: int = 3) -> DataFrame:
    """Starts (``doc_key``, ``start``, ``phrase_key``) at which the ``depth``
    rarest terms of a phrase all stand at their offsets."""
    ordered = settle(_ordered_terms(phrases, index.frequencies))

    def rank(k: int) -> DataFrame:
        return ordered.where(f"size(terms) > {k}").select(
            "phrase_key", F.col("terms")[k]["term"].alias("term"), F.col("terms")[k]["offset"].alias("offset")
        )

    found = (
        index.postings.join(small_side(rank(0), 96), "term")
        .select("doc_key", (F.col("position") - F.col("offset")).alias("start"), "phrase_key")
        .where("start >= 0")
    )
    for k in range(1, depth):
        wanted = small_side(rank(k), 96)
        moved = index.postings.join(wanted, "term").select(
            "doc_key", (F.col("position") - F.col("offset")).alias("start"), "phrase_key"
        )
        longer = small_side(ordered.where(f"size(terms) > {k}").select("phrase_key"), 16)
        shorter = small_side(ordered.where(f"size(terms) <= {k}").select("phrase_key"), 16)
        found = (
            found.join(longer, "phrase_key", "left_semi")
            .join(moved, ["doc_key", "start", "phrase_key"], "left_semi")
            .unionByName(found.join(shorter, "phrase_key", "left_semi"))
        )
    return found


def phrase_matches(index: PositionalIndex, phrases: DataFrame, depth: int = 3) -> DataFrame:
    """Exact matches: ``doc_key``, ``start``, ``phrase`` (one row per place)."""
    phrases = settle(phrases.select("phrase").distinct())
    starts = settle(candidate_starts(index, phrases, depth).distinct())
    keyed = phrases.select(F.xxhash64("phrase").alias("phrase_key"), "phrase")
    docs = index.docs.join(starts.select("doc_key").distinct(), "doc_key", "left_semi")
    spelled = docs.dropDuplicates(["doc_key"]).select("doc_key", words_of(F.col("text")).alias("words"))
    told = starts.join(keyed, "phrase_key").select("doc_key", "start", "phrase")
    return (
        spelled.join(told, "doc_key")
        .where(F.slice("words", F.col("start") + 1, F.size("phrase")) == F.col("phrase"))
        .select("doc_key", "start", "phrase")
    )


def proximity_matches(
    index: PositionalIndex, phrases: DataFrame, slop: int = 5, missing: float = 0.1
) -> DataFrame:
    """Places where all terms of a phrase, but a share of at most ``missing``,
    stand within ``slop`` words of where the phrase would have them:
    ``doc_key``, ``start`` (of the phrase, as a term that is there places it),
    ``phrase``, ``shift`` (least difference to where another such term places
    it) and ``found`` (terms that stand there).

    If m terms may be missing, two of the m + 2 rarest that occur at all are
    there, so every pair of these gives candidates; they are confirmed on the
    words of the document.  A phrase of one word has no pair and never matches.
    Postings meet only inside blocks of ``2 * slop + 1`` positions, each looked
    up with its two neighbours, so a document never pairs all its positions.
    """
    ordered = _ordered_terms(phrases, index.frequencies, whole=False)
    allowed = F.floor(F.size("phrase") * F.lit(missing) + F.lit(1e-9)).cast("int")
    ordered = settle(ordered.withColumn("allowed", allowed).where("size(phrase) > 1 and size(terms) >= size(phrase) - allowed"))
    block = 2 * slop + 1
    ranked = ordered.select("phrase_key", F.posexplode(F.slice("terms", F.lit(1), F.col("allowed") + 2)).alias("rank", "held"))
    ranked = ranked.select("phrase_key", "rank", F.col("held.term").alias("term"), F.col("held.offset").alias("offset"))
    placed = settle(
        index.postings.join(small_side(ranked, 96), "term").select(
            "doc_key", "phrase_key", "rank", (F.col("position") - F.col("offset")).alias("start")
        )
    )
    left = placed.withColumn("block", F.floor(F.col("start") / block))
    right = placed.select("doc_key", "phrase_key", F.col("rank").alias("other_rank"), F.col("start").alias("other"))
    right = right.select("*", F.explode(F.array(*[F.floor(F.col("other") / block) + d for d in (-1, 0, 1)])).alias("block"))
    shift = F.col("other") - F.col("start")
    near = (
        left.join(right, ["doc_key", "phrase_key", "block"])
        .where((F.col("rank") < F.col("other_rank")) & (F.abs(shift) <= slop))
        .groupBy("doc_key", "phrase_key", "start")
        .agg(F.min_by(shift, F.struct(F.abs(shift), shift)).alias("shift"))
    )
    candidates = settle(near.join(small_side(ordered.select("phrase_key", "phrase", "allowed"), 512), "phrase_key"))
    docs = index.docs.join(candidates.select("doc_key").distinct(), "doc_key", "left_semi")
    spelled = docs.dropDuplicates(["doc_key"]).select("doc_key", words_of(F.col("text")).alias("words"))

    def stands(term: Column, i: Column) -> Column:
        first = F.col("start") + i - slop
        low = F.greatest(first, F.lit(0))
        return F.array_contains(F.slice("words", low + 1, F.greatest(first + block - low, F.lit(0))), term)

    there = F.filter(F.transform("phrase", lambda term, i: stands(term, i)), lambda x: x)
    return (
        spelled.join(candidates, "doc_key")
        .withColumn("found", F.size(there))
        .where("found >= size(phrase) - allowed")
        .select("doc_key", "start", "phrase", "shift", "found")
    )


def score_documents(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``doc_key``, ``n_words``, ``n_hit``
    (words inside any occurring window), ``n_items``, ``items``,
    ``contaminated``."""
    phrases = settle(phrases_of(items, item_id_col, item_text_col, window))
    terms = phrases.select(F.explode("phrase").alias("term")).distinct()
    index = build_index(documents, terms, id_col, text_col)
    matches = settle(phrase_matches(index, phrases))
    ends = F.max(F.col("start") + F.size("phrase"))
    spans = matches.groupBy("doc_key", "start").agg(ends.alias("end"))
    before = Window.partitionBy("doc_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0))).select(
        "doc_key", F.greatest(F.col("end") - F.greatest("start", "seen"), F.lit(0)).alias("fresh")
    )
    hits = covered.groupBy("doc_key").agg(F.sum("fresh").alias("hit"))
    named = (
        matches.select("doc_key", "phrase")
        .distinct()
        .join(phrases, "phrase")
        .groupBy("doc_key")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("found"))
    )
    n_words = F.regexp_count(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD)).cast("long")
    return (
        index.docs.select("doc_id", "doc_key", n_words.alias("n_words"))
        .join(hits.join(named, "doc_key"), "doc_key", "left")
        .select(
            "doc_id",
            "doc_key",
            "n_words",
            F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("found", F.array().cast("array<string>")).alias("items"),
            F.col("hit").isNotNull().alias("contaminated"),
        )
    )


def clean_documents(documents: DataFrame, items: DataFrame, window: int = WINDOW, **columns) -> DataFrame:
    """The rows of ``documents`` in which no window of any item occurs."""
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    scored = score_documents(documents, items, window, **columns)
    bad = scored.where("contaminated").select(F.col("doc_key").alias("_bad_key")).distinct()
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.length(F.col(text_col)))
    return documents.join(bad, key == F.col("_bad_key"), "left_anti")
