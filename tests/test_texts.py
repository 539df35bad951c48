import re

import pytest

from panelweave.operators import textcheck

FRONT = "---\ntitle: A\nabstract: |\n  Two words\nbibliography: r.bib\n---\n# Introduction\nText with `code` and [a link](http://x.y) ![img](f.png)\n```\nblock of code\n```\n## Methods\nas in @smith_2020, @lee-99\n"
SECTION = "# Abstract\nthree short words\n# Results\nmore\n## Conclusion\n"
PLAIN = "nothing here"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, FRONT), (2, SECTION), (3, PLAIN), (4, None)], "id int, text string")


def count(text):
    """The same removal in plain Python."""
    for pattern, kept in ((r"(?s)\A---.*?---", ""), (r"(?s)```.*?```", ""), (r"`[^`]+`", ""), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"!\[.*?\]\(.*?\)", "")):
        text = re.sub(pattern, kept, text)
    return len(text.split())


def test_words_and_abstract(docs):
    rows = {r["id"]: r for r in docs.select("id", textcheck.count_words("text").alias("n"), textcheck.extract_abstract("text").alias("a")).collect()}
    assert [rows[i]["n"] for i in (1, 2, 3)] == [count(FRONT), count(SECTION), count(PLAIN)]
    assert [rows[i]["a"] for i in (1, 2, 3, 4)] == ["Two words", "three short words", None, None]


def test_compliance(docs):
    checks = textcheck.check_documents(docs.filter("id < 4"), "id", "text", max_words=10, min_abstract=3, max_abstract=250)
    got = {(r["id"], r["check_name"]): r["passed"] for r in checks.collect()}
    assert not got[1, "Word Count"] and got[3, "Word Count"]
    assert not got[1, "Abstract Length"] and got[2, "Abstract Length"] and not got[3, "Abstract"]
    assert got[1, "Section: Introduction"] and got[2, "Section: Conclusion"] and not got[3, "Section: Results"]
    assert got[1, "References"] and not got[2, "References"]
    report = {r["id"]: r for r in textcheck.compliance_report(checks, "id").collect()}
    assert (report[2]["n_checks"], report[2]["n_errors"], report[2]["passed"]) == (8, 0, True)
    assert report[1]["n_errors"] == 2 and not report[1]["passed"]


def test_other_extractors(spark):
    docs = spark.createDataFrame(
        [
            (1, "- [x] a\n- [X] b\n- [ ] c\nAbstract of 150 to 250 words, 4-6 keywords\n**Discipline**: econ\n*Review generated: 2024-01-02*\n### Comment 1: x\n### Minor 1: y\n### Minor 2: z"),
            (2, "abstract up to 300 words"),
        ],
        "id int, text string",
    )
    progress = {r["id"]: tuple(r)[1:] for r in textcheck.checklist_progress(docs, "id", "text").collect()}
    assert progress[1][:2] == (2, 1) and progress[1][2] == pytest.approx(66.6667, abs=1e-3) and progress[2] == (0, 0, None)
    limits = {r["id"]: tuple(r)[1:] for r in textcheck.extract_limits(docs, "id", "text").collect()}
    assert limits == {1: (150, 250, 4, 6), 2: (None, 300, None, None)}
    reviews = {r["id"]: tuple(r)[1:] for r in textcheck.review_summary(docs, "id", "text").collect()}
    assert reviews == {1: ("econ", "2024-01-02", 1, 2), 2: ("unknown", "unknown", 0, 0)}


def test_code(spark):
    source = '"""Doc string."""\nimport os.path\nfrom os import x\nimport numpy as np\n\ndef go(a):\n    def inner():\n        pass\nclass Box:\n    pass\nclass Item(Box):\n    pass\n'
    df = spark.createDataFrame([("m", source), ("n", "x = 1")], "name string, text string")
    # The keyed column is called doc so that it does not clash with the symbol name.
    df = df.withColumnRenamed("name", "doc")
    got = {(r["kind"], r["name"]) for r in textcheck.code_symbols(df, "doc", "text").collect()}
    assert got == {("import", "os"), ("import", "numpy"), ("function", "go"), ("class", "Box"), ("class", "Item")}
    assert {r["doc"]: r["docstring"] for r in textcheck.docstrings(df, "doc", "text").collect()} == {"m": "Doc string.", "n": None}


def test_config(spark):
    config = spark.createDataFrame([("d", "journal", "x"), ("d", "abstract", ""), ("d", "other", "y")], "doc string, key string, value string")
    rows = {r["key"]: r["present"] for r in textcheck.config_coverage(config, "doc").collect()}
    assert len(rows) == 12 and rows["journal"] and not rows["abstract"] and not rows["tables"]
    base = spark.createDataFrame([("csl", "a"), ("title", "t"), ("format.html", "x")], "key string, value string")
    profile = spark.createDataFrame([("csl", None), ("format.pdf", "p")], "key string, value string")
    got = {r["key"]: (r["value"], r["origin"]) for r in textcheck.effective_config(base, profile).collect()}
    assert got == {"csl": (None, "profile"), "title": ("t", "base"), "format.html": ("x", "base"), "format.pdf": ("p", "profile")}
