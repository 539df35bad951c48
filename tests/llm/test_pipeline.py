import hashlib

import corpus_pipeline
from corpus import CLASHES, messy, sentence
from test_language import text

from panelweave.llm import queries


def test_stages_and_their_effects(spark, tmp_path):
    clean = {i: text(lang, i, 60) for i, lang in enumerate(["aa", "bb", "cc"] * 20)}
    rows = [(i, t, "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2], "s", len(t)) for i, t in clean.items()]
    near = clean[9].split()
    near[50] = "changed"
    leak = text("bb", 999, 30)
    rows += [
        (100, clean[7], "bb", "s", 1),  # exact copy: the larger id stays
        (101, " ".join(near), "aa", "s", 1),  # near copy: the smaller id stays
        (102, text("bb", 998, 40) + " " + leak, "bb", "s", 1),  # benchmark passage
        (103, "1234 5678 !!!", None, "s", 1),  # no language
        (104, None, None, None, None),
    ]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    gone = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = {r["doc_id"] for r in docs.collect()}, stage(spark, docs, path).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        gone.append(before - {r["doc_id"] for r in docs.collect()})
    assert gone == [{103, 104}, {7}, {101}, {102}]
    encoded = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(encoded) == set(clean) - {7} | {100}
    for doc_id, row in encoded.items():
        kept = clean[7] if doc_id == 100 else clean[doc_id]
        assert row["decoded_sha256"] == hashlib.sha256(kept.encode()).hexdigest() and len(row["ids"]) == row["n_tokens"]
    assert sentence(1, 2) and len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_one_query_for_each_operator():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_clashing_columns_pass_unchanged(spark):
    langs = ["aa", "bb", "cc"] * 12
    rows = [(i, text(lang, i, 60), lang, f"p{i}", i, f"r{i}", i * 2, "u") for i, lang in enumerate(langs)] + [(99, "1 2", None, "p", 1, "r", 2, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int, rejected string, _score long, _Rejected string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == rows[:-1]
    clashing = messy(spark, [r[:2] for r in rows]).join(docs.select("doc_id", "lang"), "doc_id")
    assert corpus_pipeline.identify_language(spark, clashing, "").select(*CLASHES).distinct().collect() == [tuple(range(len(CLASHES)))]
