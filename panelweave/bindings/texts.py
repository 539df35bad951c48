"""Corpus checks, file manifests and configuration queries.

The driver's documents hold hardly any of the marks these checks look for,
so marked lines are added to each whole text by a fixed formula, written as
one SQL expression that both engines evaluate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifest, textcheck
from ..sources.inventory import file_inventory, source_hints
from .registry import query, r, rounded, table

_N = "chr(10)"
_ID = "cast(doc_id as varchar(20))"
MARKED = f"""case doc_id % 4
 when 0 then '---' || {_N} || 'title: Report ' || {_ID} || {_N} || 'abstract: ' || replace(text, {_N}, ' ') || {_N} || 'bibliography: refs.bib' || {_N} || '---' || {_N} || '# Introduction' || {_N} || text || {_N} || '## Methods' || {_N} || '## results' || {_N} || '# Discussion' || {_N} || '# Conclusion' || {_N} || 'as in @smith_2020 and @lee-99'
 when 1 then '# Introduction' || {_N} || text || {_N} || '## Abstract' || {_N} || text || {_N} || '# Results' || {_N} || 'see [the data](http://example.org/a?b=c) and ![plot](fig.png) by @kim2001'
 when 2 then text || {_N} || '```' || {_N} || 'x = compute(1)' || {_N} || '```' || {_N} || 'calls `run all` here' || {_N} || '# Methods'
 else text end"""
CHECKLIST = f"""text || {_N} || '- [x] first item' || {_N} || case when doc_id % 2 = 0 then '- [X] second item' || {_N} else '' end || case when doc_id % 3 = 0 then '- [ ] third item' || {_N} || '- [ ] fourth item' else '' end"""
GUIDE = f"""text || {_N} || case doc_id % 3 when 0 then 'The Abstract should hold 150 to ' || cast(200 + doc_id % 100 as varchar(20)) || ' words.' when 1 then 'Keep the abstract under 250 words.' else '' end || {_N} || case when doc_id % 2 = 0 then 'Give 4 to 6 keywords.' else 'At most 8 Keywords.' end"""
REVIEW = f"""text || {_N} || case when doc_id % 3 <> 0 then '**Discipline**: ' || lang || {_N} else '' end || case when doc_id % 4 <> 0 then '*Review generated: 2024-0' || cast(1 + doc_id % 9 as varchar(20)) || '-15*' || {_N} else '' end || '### Comment 1: ' || lang || {_N} || case when doc_id % 2 = 0 then '### Comment 2: ' || source || {_N} else '' end || '### Minor 1: ' || lang"""
CODE = f"""'\"\"\"' || text || '\"\"\"' || {_N} || 'import os' || {_N} || 'from pandas.core import frame' || {_N} || 'import numpy.linalg' || {_N} || 'from os import path' || {_N} || 'def load_' || {_ID} || '(path):' || {_N} || '    return path' || {_N} || 'class Table' || {_ID} || ':' || {_N} || 'def run(x):'"""


def _docs(spark, sf, expression: str, *more: str):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.expr(expression).alias("body"), *more)


def _sql(expression: str, *more: str) -> str:
    return f"d as (select doc_id, {expression} body{''.join(', ' + m for m in more)} from documents)"


def _prose_sql(text: str) -> str:
    out = f"regexp_replace({text}, '(?s)^---.*?---', '')"
    for pattern, kept in (
        ("(?s)```.*?```", ""),
        ("`[^`]+`", ""),
        (r"\[([^\]]+)\]\([^\)]+\)", r"\1"),
        (r"!\[.*?\]\(.*?\)", ""),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{kept}', 'g')"
    return out


_WORDS = f"len(regexp_extract_all({_prose_sql('body')}, '\\S+'))"
_WORD_CLASS = r"\p{L}\p{M}\p{N}\p{Pc}"
_FRONT = rf"(?s)^---.*?abstract:\s*[|>]?\s*(.*?)(?:\n[{_WORD_CLASS}]+:|---)"
_SECTION = r"(?is)#+\s*Abstract\s*\n(.*?)(?:\n#+|\z)"


def _trimmed(pattern: str) -> str:
    return f"case when regexp_matches(body, '{pattern}') then regexp_replace(regexp_extract(body, '{pattern}', 1), '^\\s+|\\s+$', '', 'g') end"


_ABSTRACT = f"coalesce({_trimmed(_FRONT)}, {_trimmed(_SECTION)})"


@query("doc_word_count", f"with {_sql(MARKED)} select doc_id, {_WORDS} n_words from d")
def doc_word_count(spark, sf):
    return _docs(spark, sf, MARKED).select("doc_id", textcheck.count_words("body").alias("n_words"))


@query(
    "doc_abstract",
    f"with {_sql(MARKED)}, a as (select doc_id, {_ABSTRACT} a from d) select doc_id, md5(a) abstract_md5, len(regexp_extract_all(a, '\\S+')) n_words from a",
)
def doc_abstract(spark, sf):
    found = _docs(spark, sf, MARKED).select("doc_id", textcheck.extract_abstract("body").alias("a"))
    return found.select(
        "doc_id", F.md5(F.col("a").cast("binary")).alias("abstract_md5"), textcheck.word_total(F.col("a")).cast("long").alias("n_words")
    )


@query(
    "doc_word_limit",
    f"with {_sql(MARKED)}, w as (select doc_id, {_WORDS} n from d) select doc_id, n <= 500 passed, 'error' severity, cast(n as varchar) actual_value, '<= 500' expected_value from w",
)
def doc_word_limit(spark, sf):
    counted = _docs(spark, sf, MARKED).select("doc_id", textcheck.count_words("body").alias("n_words"))
    check = textcheck.word_count_check(F.col("n_words"), 500)
    return counted.select("doc_id", F.inline(F.array(check))).drop("check_name")


_SECTIONS = " union all ".join(
    f"select doc_id, 'Section: {s}' check_name, regexp_matches(body, '(?i)#+\\s*{s}') passed from d" for s in textcheck.REQUIRED_SECTIONS
)


@query("doc_sections", f"with {_sql(MARKED)} {_SECTIONS}")
def doc_sections(spark, sf):
    rows = _docs(spark, sf, MARKED).select("doc_id", F.inline(F.array(*textcheck.section_checks(F.col("body")))))
    return rows.select("doc_id", "check_name", "passed")


@query(
    "page_sections",
    " union all ".join(f"select page_id, '{s}' section, regexp_matches(html, '(?i)<h[12][^>]*>[^<]*{s}') present from pages" for s in ("the", "que", "und")),
)
def page_sections(spark, sf):
    """The same presence check with heading tags for marks."""
    flags = [
        F.struct(F.lit(s).alias("section"), F.col("html").rlike(f"(?i)<h[12][^>]*>[^<]*{s}").alias("present"))
        for s in ("the", "que", "und")
    ]
    return table(spark, sf, "pages").select("page_id", F.inline(F.array(*flags)))


_CITES = f"len(regexp_extract_all(body, '@[{_WORD_CLASS}-]+'))"


@query("doc_citations", f"with {_sql(MARKED)} select doc_id, {_CITES} n_citations, contains(body, 'bibliography:') passed from d")
def doc_citations(spark, sf):
    check = textcheck.references_check(F.col("body"))
    rows = _docs(spark, sf, MARKED).select("doc_id", F.inline(F.array(check)))
    return rows.select("doc_id", F.col("actual_value").cast("long").alias("n_citations"), "passed")


@query(
    "doc_compliance",
    f"""with {_sql(MARKED)}, a as (select doc_id, {_WORDS} n, {_ABSTRACT} a, body from d),
k as (select doc_id, 'error' severity, n <= 2000 passed from a
 union all select doc_id, 'error', coalesce(length(a) > 0 and len(regexp_extract_all(a, '\\S+')) between 50 and 250, false) from a
 union all select doc_id, 'warning', passed from ({_SECTIONS})
 union all select doc_id, 'warning', contains(body, 'bibliography:') from a)
select doc_id, count(*) n_checks, count(*) filter (where severity = 'error' and not passed) n_errors, count(*) filter (where severity = 'warning' and not passed) n_warnings,
 count(*) filter (where severity = 'error' and not passed) = 0 passed from k group by 1""",
)
def doc_compliance(spark, sf):
    checks = textcheck.check_documents(_docs(spark, sf, MARKED), "doc_id", "body", 2000, 50, 250)
    return textcheck.compliance_report(checks, "doc_id")


_DONE, _OPEN = r"len(regexp_extract_all(body, '(?i)- \[x\]'))", r"len(regexp_extract_all(body, '- \[ \]'))"


@query(
    "checklist_progress",
    f"with {_sql(CHECKLIST)}, c as (select doc_id, {_DONE} a, {_OPEN} b from d) select doc_id, a n_done, b n_open, {r('a * 100.0 / nullif(a + b, 0)', 'percent_done')} from c",
)
def checklist_progress(spark, sf):
    return rounded(textcheck.checklist_progress(_docs(spark, sf, CHECKLIST), "doc_id", "body"))


def _limit_sql(pattern: str, a: str) -> str:
    first, second = (f"try_cast(nullif(regexp_extract(body, '{pattern}', {i}), '') as int)" for i in (1, 2))
    return f"case when {second} is not null then {first} end {a[0]}, coalesce({second}, {first}) {a[1]}"


@query(
    "extract_limits",
    f"with {_sql(GUIDE)} select doc_id, {_limit_sql(textcheck.ABSTRACT_LIMIT, ('abstract_min_words', 'abstract_max_words'))},"
    f" {_limit_sql(textcheck.KEYWORD_LIMIT, ('keywords_min', 'keywords_max'))} from d",
)
def extract_limits(spark, sf):
    return textcheck.extract_limits(_docs(spark, sf, GUIDE), "doc_id", "body")


@query(
    "review_summary",
    f"""with {_sql(REVIEW)}, f as (select doc_id, regexp_extract(body, '\\*\\*Discipline\\*\\*:\\s*([{_WORD_CLASS}]+)', 1) a, regexp_extract(body, '{textcheck.REVIEW_DATE}', 1) b,
 len(regexp_extract_all(body, '### Comment \\d+:')) n_major, len(regexp_extract_all(body, '### Minor \\d+:')) n_minor from d)
select doc_id, case when a = '' then 'unknown' else a end discipline, case when b = '' then 'unknown' else b end review_date, n_major, n_minor from f""",
)
def review_summary(spark, sf):
    return textcheck.review_summary(_docs(spark, sf, REVIEW), "doc_id", "body")


_CONFIG_KEYS = "[" + ", ".join(f"'{k}'" for k in textcheck.REQUIRED_CONFIG) + "]"
_CONFIG_SQL = f"""k as (select doc_id, lang, unnest({_CONFIG_KEYS}) as key, unnest(range(0, 12)) i from documents),
c as (select doc_id, key, case when (doc_id + i) % 3 = 0 then '' else lang end as value from k where (doc_id + i) % 5 <> 0 and doc_id % 7 <> 0)"""


@query(
    "config_coverage",
    f"with {_CONFIG_SQL} select k.doc_id, k.key, coalesce(c.value, '') <> '' present from k left join c on k.doc_id = c.doc_id and k.key = c.key",
)
def config_coverage(spark, sf):
    keys = F.array(*[F.lit(k) for k in textcheck.REQUIRED_CONFIG])
    long = table(spark, sf, "documents").select("doc_id", "lang", F.posexplode(keys).alias("i", "key"))
    config = long.filter(((F.col("doc_id") + F.col("i")) % 5 != 0) & (F.col("doc_id") % 7 != 0)).select(
        "doc_id", "key", F.when((F.col("doc_id") + F.col("i")) % 3 == 0, "").otherwise(F.col("lang")).alias("value")
    )
    return textcheck.config_coverage(config, "doc_id", documents=table(spark, sf, "documents"))


@query(
    "config_merge",
    """with b as (select doc_id, unnest(['csl', 'title', 'format.html']) as key, unnest([source, lang, 'toc']) as value from documents),
p as (select doc_id, unnest(['csl', 'format.pdf']) as key, unnest([case when quality = 1 then 'apa' end, 'a4']) as value from labels)
select coalesce(b.doc_id, p.doc_id) doc_id, coalesce(b.key, p.key) as key, case when p.key is not null then p.value else b.value end as value,
 case when p.key is not null then 'profile' else 'base' end origin, starts_with(coalesce(b.key, p.key), 'format.') is_merged from b full join p on b.doc_id = p.doc_id and b.key = p.key""",
)
def config_merge(spark, sf):
    def long(df, entries):
        rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])
        return df.select("doc_id", F.inline(rows))

    base = long(table(spark, sf, "documents"), {"csl": F.col("source"), "title": F.col("lang"), "format.html": F.lit("toc")})
    profile = long(table(spark, sf, "labels"), {"csl": F.when(F.col("quality") == 1, "apa"), "format.pdf": F.lit("a4")})
    return textcheck.effective_config(base, profile, ("doc_id", "key"))


_EXTENSIONS = (".py", ".csv", ".md", ".yml", ".png", ".json", ".bin", "", ".R")
_PATH = (
    "case when doc_id % 11 = 0 then '.cache/' when doc_id % 13 = 0 then 'src/__pycache__/' else source || '/' end || lang || '_' || "
    + _ID
    + " || case doc_id % 9 "
    + " ".join(f"when {i} then '{e}'" for i, e in enumerate(_EXTENSIONS))
    + " end"
)
_CATEGORY = (
    "case when e in ('.py', '.r') then 'code' when e in ('.csv', '.json') then 'data' when e = '.md' then 'doc'"
    " when e = '.yml' then 'config' when e = '.png' then 'output' else 'other' end"
)


@query(
    "classify_files",
    f"""with p as (select {_PATH} path, n_chars from documents), e as (select *, lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) e from p where not regexp_matches(path, '(^|/)(\\.[^/]|__pycache__(/|$))'))
select {_CATEGORY} category, count(*) n_files, cast(sum(n_chars) as bigint) total_bytes from e group by 1""",
)
def classify_files(spark, sf):
    paths = table(spark, sf, "documents").select(F.expr(_PATH).alias("path"), F.col("n_chars").alias("size_bytes"))
    return manifest.file_totals(manifest.classify_files(paths))


_MODULES = ("data_loader", "merge_rows", "make_panels", "fit_all", "sensitivity", "charts", "reporting", "string_utils", "misc")
_MODULE = "case doc_id % 9 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(_MODULES)) + " end"
_FOLDER = "case when doc_id % 2 = 0 then 'graphs/' when doc_id % 5 = 0 then 'helpers/' else 'core/' end"
_MATCH = " ".join(
    "when regexp_matches({0}, '" + "|".join(words) + f"') then '{stage}'" for stage, words in manifest.STAGE_KEYWORDS.items()
)


@query(
    "keyword_rules",
    f"""with m as (select doc_id, {_MODULE} as name, {_FOLDER} || {_MODULE} || '.py' path from documents),
s as (select doc_id, case {_MATCH.format('name')} end a, case {_MATCH.format('path')} end b, case when regexp_matches(path, 'util|helper') then 'utils' end c from m)
select doc_id, coalesce(a, b, c) stage, case when a is not null then 'name' when b is not null then 'path' when c is not null then 'utility' else 'none' end matched_by from s""",
)
def keyword_rules(spark, sf):
    modules = table(spark, sf, "documents").select(
        "doc_id", F.expr(_MODULE).alias("name"), F.expr(f"{_FOLDER} || {_MODULE} || '.py'").alias("path")
    )
    return manifest.map_modules(modules).select("doc_id", "stage", "matched_by")


@query(
    "code_symbols",
    f"""with {_sql(CODE)}, m as (select doc_id, unnest(regexp_extract_all(body, '{textcheck.IMPORT}', 1)) a, unnest(regexp_extract_all(body, '{textcheck.IMPORT}', 2)) b from d)
select distinct doc_id, 'import' kind, split_part(case when coalesce(a, '') <> '' then a else b end, '.', 1) as name from m
union all select doc_id, 'function', unnest(regexp_extract_all(body, '{textcheck.FUNCTION}', 1)) from d
union all select doc_id, 'class', unnest(regexp_extract_all(body, '{textcheck.CLASS}', 1)) from d""",
)
def code_symbols(spark, sf):
    return textcheck.code_symbols(_docs(spark, sf, CODE), "doc_id", "body")


_DOCSTRING = textcheck.DOCSTRING.replace("'", "''")


@query(
    "docstrings",
    f"with {_sql(CODE)} select doc_id, regexp_replace(regexp_extract(body, '{_DOCSTRING}', 1), '^\\s+|\\s+$', '', 'g') docstring from d",
)
def docstrings(spark, sf):
    return textcheck.docstrings(_docs(spark, sf, CODE), "doc_id", "body")


@query(
    "file_inventory",
    """select source || '/' || cast(doc_id as varchar) || '.md' path, strlen(text) size_bytes, 'manuscript' category,
sha256(text) sha256 from documents where lang <> 'de'""",
)
def file_inventory_query(spark, sf):
    """Documents as files of two kinds, one of which the inventory leaves out."""
    ext = F.when(F.col("lang") == "de", ".tex").otherwise(".md")
    files = table(spark, sf, "documents").select(
        F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
        F.col("text").cast("binary").alias("content"),
    )
    return file_inventory(files, "manuscript", [".md"]).drop("mtime")


_LEFT_MANIFEST = "a as (select 'm/' || cast(doc_id as varchar) path, strlen(text) size_bytes, lang mtime, case when lang <> 'de' then sha256(text) end sha256 from documents)"
_RIGHT_MANIFEST = """b as (select case when toxic = 1 then 'moved/' else 'm/' end || cast(d.doc_id as varchar) path, strlen(text) size_bytes, case when quality = 0 then 'later' else lang end mtime, sha256(case when quality = 0 then text || ' x' else text end) sha256
 from documents d left join labels l on d.doc_id = l.doc_id union all select 'p/' || cast(page_id as varchar), strlen(html), 'html', sha256(html) from pages)"""


@query(
    "manifest_diff",
    f"""with {_LEFT_MANIFEST}, {_RIGHT_MANIFEST}
select coalesce(a.path, b.path) path, case when b.path is null then 'left_only' when a.path is null then 'right_only' else 'changed' end status
from a full join b on a.path = b.path where a.path is null or b.path is null or (a.sha256 is not null and b.sha256 is not null and a.sha256 <> b.sha256)
 or ((a.sha256 is null or b.sha256 is null) and (a.size_bytes <> b.size_bytes or a.mtime <> b.mtime))""",
)
def manifest_diff(spark, sf):
    docs, labels, pages = (table(spark, sf, n) for n in ("documents", "labels", "pages"))

    def record(df, path, text, mtime, digest):
        return df.select(path.alias("path"), F.octet_length(text).alias("size_bytes"), mtime.alias("mtime"), digest.alias("sha256"))

    def sha(text):
        return F.sha2(text.cast("binary"), 256)

    text, lang = F.col("text"), F.col("lang")
    path = F.concat(F.lit("m/"), F.col("doc_id").cast("string"))
    left = record(docs, path, text, lang, F.when(lang != "de", sha(text)))
    labelled = docs.join(labels, "doc_id", "left")
    moved = F.concat(F.when(F.col("toxic") == 1, "moved/").otherwise("m/"), F.col("doc_id").cast("string"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    edited = F.when(bad, F.concat(text, F.lit(" x"))).otherwise(text)
    right = record(labelled, moved, text, F.when(bad, "later").otherwise(lang), sha(edited))
    html = F.col("html")
    added = record(pages, F.concat(F.lit("p/"), F.col("page_id").cast("string")), html, F.lit("html"), sha(html))
    return manifest.compare_manifests(left, right.unionByName(added))


@query(
    "provenance_hints",
    """select 'figures/' || cast(d.doc_id as varchar) || '.png' path, case when l.doc_id is not null then 'work/' || cast(l.doc_id as varchar) || '.png' end source_hint
from documents d left join labels l on d.doc_id = l.doc_id""",
)
def provenance_hints(spark, sf):
    def path(folder):
        return F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path")

    return source_hints(table(spark, sf, "documents").select(path("figures")), table(spark, sf, "labels").select(path("work")))
