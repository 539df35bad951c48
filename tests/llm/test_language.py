import random

import pytest
from corpus import empty, messy
from pyspark.sql import functions as F

from panelweave.llm import language, queries

SYLLABLES = {"aa": ["the", "ing", "tion", "and", "er"], "bb": ["sch", "ung", "der", "ein", "lich"], "cc": ["que", "eau", "ment", "les", "ou"]}


def text(lang: str, seed: int, size: int = 40) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(size))


def labelled(spark, n: int = 60):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(sorted(SYLLABLES) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    df = labelled(spark)
    content = language.learn(df.where(~language.held_out(F.col("doc_id"))))
    assert set(content) == set(SYLLABLES)
    found = language.classify(df, content).join(df.select("doc_id", "lang"), "doc_id")
    held = found.where(language.held_out(F.col("doc_id")))
    assert held.count() > 30 and held.where("lang_pred <> lang").count() == 0
    assert found.where("score < 0 or score > 1 or rejected").count() == 0
    shouted = df.select("doc_id", F.upper("text").alias("text"))
    assert language.classify(shouted, content).join(df, "doc_id").where("lang_pred <> lang").count() == 0


def test_awkward_texts(spark):
    content = language.learn(labelled(spark))
    rows = language.classify(messy(spark), content).collect()
    unknown = [r for r in rows if r["lang_pred"] == language.UNKNOWN]
    assert {r["doc_id"] for r in unknown} == {2, 3, 4, 13, None} and all(r["rejected"] and r["score"] == 0 for r in unknown)
    assert language.classify(empty(spark), content).count() == 0
    kept = language.with_language(messy(spark).withColumn("rejected", F.lit("x")), content)
    assert kept.columns[-3:] == ["lang_pred", "score", "rejected"] and kept.count() == len(rows)


def test_without_labels_or_with_one(spark):
    none = spark.createDataFrame([(1, "words", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert language.learn(none) == {}
    assert language.classify(none, {}).where("lang_pred <> 'und'").count() == 0
    one = language.classify(none, {"aa": b"words"}).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in one} == {1: "aa", 2: "und"}


def test_ties_and_bounds(spark):
    tied = language.Classifier({"zz": b"same text here", "aa": b"same text here"}, language.Options())
    assert tied.predict("other words") == ("zz", 0.5, True)
    options = language.Options(sample_texts=5, piece_chars=20)
    content = language.learn(labelled(spark), options=options)
    assert all(len(c) <= 5 * 20 for c in content.values())
    with pytest.raises(ValueError, match="labels"):
        language.learn(labelled(spark), options=language.Options(max_languages=2))


def test_query_never_uses_labels_of_the_row(spark, tmp_path):
    df = labelled(spark)
    wrong = df.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "cc").otherwise(F.col("lang")))
    out = []
    for name, frame in (("right", df), ("wrong", wrong)):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out.append(sorted(map(tuple, queries.op7_language(spark, f"{tmp_path}/{name}").collect())))
    assert out[0] == out[1]


def test_copies_teach_once(spark):
    texts = [text("aa", i) for i in range(40)]
    once = spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string")
    options = language.Options(sample_texts=8, piece_chars=30)
    wanted = language.learn(once, options=options)
    for hot in (texts[0], texts[1], min(texts, key=lambda t: t in wanted["aa"].decode())):
        copies = once.unionByName(spark.createDataFrame([(hot, "aa")] * 600, once.schema))
        assert language.learn(copies, options=options) == wanted


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ", "12 !? _", "٣"])
def test_numbers_are_no_letters(text):
    held = language.Classifier({"en": b"the and of " * 20, "fr": b"le et de " * 20}, language.Options())
    assert not language.normalise(text).strip()
    assert held.predict(text) == (language.UNKNOWN, 0.0, True)
