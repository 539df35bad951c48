"""Text compliance checks over a table of documents.

Every check is one projection over whole texts.  Checks that yield several
rows per document unfold an array, so no join is needed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits, sections and the marks looked for in a text.
MAX_ABSTRACT_WORDS = 250
REQUIRED_SECTIONS = ("Introduction", "Methods", "Results", "Discussion", "Conclusion")
REQUIRED_CONFIG = (
    "journal",
    "submission",
    "abstract",
    "keywords",
    "text_formatting",
    "references",
    "declarations",
    "tables",
    "artwork",
    "ethical_responsibilities",
    "authorship",
    "data_policy",
)
CITATION = r"(?U)@[\w-]+"
DONE_ITEM = r"(?i)- \[x\]"
OPEN_ITEM = r"- \[ \]"
ABSTRACT_LIMIT = r"(?i)abstract.*?(\d+)\s*(?:to|-)?\s*(\d+)?\s*words"
KEYWORD_LIMIT = r"(?i)(\d+)\s*(?:to|-)?\s*(\d+)?\s*keywords"
FRONT_ABSTRACT = r"(?sU)^---.*?abstract:\s*[|>]?\s*(.*?)(?:\n\w+:|---)"
SECTION_ABSTRACT = r"(?is)#+\s*Abstract\s*\n(.*?)(?:\n#+|\z)"
DISCIPLINE = r"(?U)\*\*Discipline\*\*:\s*(\w+)"
REVIEW_DATE = r"\*Review generated:\s*(\d{4}-\d{2}-\d{2})"
MAJOR_COMMENT = r"### Comment \d+:"
MINOR_COMMENT = r"### Minor \d+:"


def word_total(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def prose(text: Column) -> Column:
    """Text without front matter, code, link targets and images."""
    for pattern, kept in (
        (r"(?s)^---.*?---", ""),
        (r"(?s)```.*?```", ""),
        (r"`[^`]+`", ""),
        (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
        (r"!\[.*?\]\(.*?\)", ""),
    ):
        text = F.regexp_replace(text, pattern, kept)
    return text


def count_words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return word_total(prose(text)).cast("long")


def extract_abstract(text: Column | str) -> Column:
    """Front-matter abstract, else the abstract section, else NULL."""
    text = F.col(text) if isinstance(text, str) else text

    def found(pattern: str) -> Column:
        # All matches as a list: empty without one, else the first is meant.
        first = F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))
        return F.regexp_replace(first, r"(?U)^\s+|\s+$", "")

    return F.coalesce(found(FRONT_ABSTRACT), found(SECTION_ABSTRACT))


def _check(name, passed: Column, severity, actual: Column, expected) -> Column:
    return F.struct(
        (name if isinstance(name, Column) else F.lit(name)).alias("check_name"),
        passed.alias("passed"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        actual.cast("string").alias("actual_value"),
        F.lit(expected).cast("string").alias("expected_value"),
    )


def word_count_check(n_words: Column, max_words: int | None = None) -> Column:
    if max_words:
        return _check("Word Count", n_words <= max_words, "error", n_words, f"<= {max_words}")
    return _check("Word Count", F.lit(True), "info", n_words, None)


def abstract_check(n_abstract: Column, min_words: int | None = None, max_words: int | None = MAX_ABSTRACT_WORDS) -> Column:
    """``n_abstract`` is the word count of the abstract, NULL or 0 without one."""
    present = F.coalesce(n_abstract, F.lit(0)) > 0
    passed = present
    if min_words:
        passed = passed & (n_abstract >= min_words)
    if max_words:
        passed = passed & (n_abstract <= max_words)
    name = F.when(present, "Abstract Length").otherwise("Abstract")
    expected = f"{min_words}-{max_words}" if min_words and max_words else None
    return _check(name, F.coalesce(passed, F.lit(False)), "error", F.when(present, n_abstract), expected)


def has_section(text: Column, section: str) -> Column:
    return text.rlike(rf"(?i)#+\s*{re.escape(section)}")


def section_checks(text: Column, sections: Sequence[str] = REQUIRED_SECTIONS) -> list[Column]:
    return [_check(f"Section: {s}", has_section(text, s), "warning", F.lit(None), None) for s in sections]


def citation_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CITATION)).cast("long")


def references_check(text: Column) -> Column:
    return _check("References", F.contains(text, F.lit("bibliography:")), "warning", citation_count(text), None)


def check_documents(
    docs: DataFrame,
    doc: str,
    text: str,
    max_words: int | None = None,
    min_abstract: int | None = None,
    max_abstract: int | None = MAX_ABSTRACT_WORDS,
    sections: Sequence[str] = REQUIRED_SECTIONS,
) -> DataFrame:
    """One row per document and check."""
    t = F.col(text)
    # Measures are columns of their own: each pattern runs over a text once,
    # however often the checks refer to it.
    found = {f"_section_{i}": has_section(t, s) for i, s in enumerate(sections)}
    measured = docs.select(
        doc,
        count_words(t).alias("_words"),
        word_total(extract_abstract(t)).alias("_abstract"),
        citation_count(t).alias("_citations"),
        F.contains(t, F.lit("bibliography:")).alias("_bibliography"),
        *[c.alias(name) for name, c in found.items()],
    )
    checks = [
        word_count_check(F.col("_words"), max_words),
        abstract_check(F.col("_abstract"), min_abstract, max_abstract),
        *[_check(f"Section: {s}", F.col(name), "warning", F.lit(None), None) for name, s in zip(found, sections)],
        _check("References", F.col("_bibliography"), "warning", F.col("_citations"), None),
    ]
    return measured.select(doc, F.inline(F.array(*checks)))


def compliance_report(checks: DataFrame, doc: str) -> DataFrame:
    """Errors, warnings and the overall verdict of each document."""
    failed = ~F.col("passed")
    errors = F.count_if(failed & (F.col("severity") == "error"))
    return checks.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_checks"),
        errors.alias("n_errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("n_warnings"),
        (errors == 0).alias("passed"),
    )


def checklist_progress(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Done and open items of each document; percent is NULL without items."""
    done = F.regexp_count(text, F.lit(DONE_ITEM)).cast("long")
    todo = F.regexp_count(text, F.lit(OPEN_ITEM)).cast("long")
    total = done + todo
    return docs.select(
        doc, done.alias("n_done"), todo.alias("n_open"), F.try_divide(done * 100.0, total).alias("percent_done")
    )


def extract_limits(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Word and keyword limits; a single number is the maximum."""

    def limits(pattern: str) -> tuple[Column, Column]:
        first = F.regexp_extract(text, pattern, 1).try_cast("int")
        second = F.regexp_extract(text, pattern, 2).try_cast("int")
        return F.when(second.isNotNull(), first), F.coalesce(second, first)

    (a_min, a_max), (k_min, k_max) = limits(ABSTRACT_LIMIT), limits(KEYWORD_LIMIT)
    return docs.select(
        doc,
        a_min.alias("abstract_min_words"),
        a_max.alias("abstract_max_words"),
        k_min.alias("keywords_min"),
        k_max.alias("keywords_max"),
    )


def config_coverage(
    config: DataFrame, doc: str, required: Sequence[str] = REQUIRED_CONFIG, documents: DataFrame | None = None
) -> DataFrame:
    """(doc, key, present) for every required key of every document.

    ``documents`` lists documents that may have no entry at all; without it
    only those with entries are known.  A required key may be a nested one,
    its parts joined by dots.

    ``config`` is long: doc, key, value.  Empty values count as absent.
    Keys are reduced to required ones before they are grouped, so a group
    holds at most as many keys as are required.
    """
    filled = F.coalesce(F.length("value"), F.lit(0)) > 0
    wanted = F.col("key").isin(*required) & filled
    held = config.groupBy(doc).agg(F.collect_set(F.when(wanted, F.col("key"))).alias("_held"))
    if documents is not None:
        held = documents.select(doc).distinct().join(held, doc, "left")
    keys = F.array(*[F.lit(k) for k in required])
    return held.select(doc, "_held", F.explode(keys).alias("key")).select(
        doc, "key", F.coalesce(F.array_contains("_held", F.col("key")), F.lit(False)).alias("present")
    )


def effective_config(base: DataFrame, profile: DataFrame, keys: Sequence[str] = ("key",), merged: str = "format.") -> DataFrame:
    """Profile values override base values per key.

    A key under ``merged`` exists when either side has it, which the full
    join gives for every key.
    """
    b, p = base.withColumnRenamed("value", "_base"), profile.withColumnRenamed("value", "_profile")
    p = p.withColumn("_has", F.lit(True))
    joined = b.join(p, list(keys), "full")
    overridden = F.coalesce(F.col("_has"), F.lit(False))
    return joined.select(
        *keys,
        F.when(overridden, F.col("_profile")).otherwise(F.col("_base")).alias("value"),
        F.when(overridden, "profile").otherwise("base").alias("origin"),
        F.col(keys[-1]).startswith(merged).alias("is_merged"),
    )


def review_summary(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Discipline, date and comment counts of each review text."""

    def field(pattern: str) -> Column:
        return F.when(F.col(text).rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise("unknown")

    return docs.select(
        doc,
        field(DISCIPLINE).alias("discipline"),
        field(REVIEW_DATE).alias("review_date"),
        F.regexp_count(text, F.lit(MAJOR_COMMENT)).cast("long").alias("n_major"),
        F.regexp_count(text, F.lit(MINOR_COMMENT)).cast("long").alias("n_minor"),
    )


# What counts as a docstring, import, function or class in source text.
DOCSTRING = r"""(?s)^\s*["']['"]{2}(.*?)["']['"]{2}"""
IMPORT = r"(?m)^(?:from\s+(\S+)|import\s+(\S+))"
FUNCTION = r"(?m)^def\s+(\w+)\s*\("
CLASS = r"(?m)^class\s+(\w+)\s*[:\(]"


def code_symbols(sources: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, kind, name) of imports, functions and classes; imports once each."""

    def found(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    either = F.zip_with(found(IMPORT, 1), found(IMPORT, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    roots = F.array_distinct(F.transform(either, lambda m: F.split_part(m, F.lit("."), F.lit(1))))
    kinds: Mapping[str, Column] = {"import": roots, "function": found(FUNCTION, 1), "class": found(CLASS, 1)}

    def tagged(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    return sources.select(doc, F.inline(F.concat(*[tagged(k, names) for k, names in kinds.items()])))


def docstrings(sources: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, docstring): the whole docstring, NULL without one."""
    body = F.regexp_replace(F.regexp_extract(text, DOCSTRING, 1), r"(?U)^\s+|\s+$", "")
    return sources.select(doc, F.when(F.col(text).rlike(DOCSTRING), body).alias("docstring"))
