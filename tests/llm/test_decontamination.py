import random

from corpus import CLASHES, empty, messy, messy_rows, sentence

from panelweave.llm import decontamination


def words(text):
    out, held = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            out, held = out + ([held] if held else []), ""
        else:
            held += c
    return out + ([held] if held else [])


def brute(rows, items, size):
    out = []
    for doc_id, text in rows:
        own = words(text)
        hit, names = set(), set()
        for item_id, item in items:
            spelled = words(item)
            length = min(size, len(spelled))
            windows = {tuple(spelled[i : i + length]) for i in range(len(spelled) - length + 1)} if spelled else set()
            for i in range(len(own) - length + 1):
                if length and tuple(own[i : i + length]) in windows:
                    hit.update(range(i, i + length))
                    names.add(item_id)
        names = sorted(str(n) for n in names if n is not None)
        out.append((doc_id, len(own), len(hit), len(names), names, bool(hit)))
    return sorted(out, key=repr)


def score(spark, rows, items, size=10):
    given = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as phrase", "2 as term")
    out = decontamination.score_documents(messy(spark, rows), given, size).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], list(r["items"]), r["contaminated"]) for r in out], key=repr)


ITEMS = [
    (1, sentence(6, 80)),
    (2, " ".join(sentence(1, 60).split()[20:30])),
    (3, "Word"),
    (4, None),
    (5, "..."),
    (6, "nowhere to be found at all in any of these texts"),
    (7, "a1"),
    (None, sentence(8, 30)),
    (2, sentence(9, 40)),
]


def test_messy_corpus(spark):
    assert score(spark, messy_rows(), ITEMS) == brute(messy_rows(), ITEMS, 10)


def test_random_passages(spark):
    rng = random.Random(9)
    items = [(i, sentence(300 + i, rng.randint(1, 25))) for i in range(30)]
    rows = []
    for i in range(60):
        spelled = items[rng.randrange(30)][1].upper().split()
        cut = spelled[rng.randrange(len(spelled)) :]
        rows.append((i, sentence(i, 20) + " - " + "  ".join(cut) + "!" + sentence(500 + i, 10)))
    for size in (10, 3):
        assert score(spark, rows, items, size) == brute(rows, items, size)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.score_documents(empty(spark), items).count() == 0
    none = decontamination.score_documents(messy(spark), items.limit(0)).collect()
    assert len(none) == len(messy_rows()) and not any(r["contaminated"] for r in none)


def test_clean_documents(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    kept = decontamination.clean_documents(messy(spark), items)
    assert set(kept.columns) == {"doc_id", "text", *CLASHES}
    wanted = [r[:1] for r in brute(messy_rows(), ITEMS[:1], 10) if not r[5]]
    assert sorted([(r["doc_id"],) for r in kept.collect()], key=repr) == sorted(wanted, key=repr)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare x y term z"), (2, "term rare"), (3, "rare a b c d e f g h term")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare term")], "item_id long, text string")
    phrases = decontamination.phrases_of(items, "item_id", "text", 10)
    terms = phrases.selectExpr("explode(phrase) as term").distinct()
    index = decontamination.build_index(docs, terms)
    found = decontamination.proximity_matches(index, phrases, slop=3).join(index.docs, "doc_key")
    assert {(r["doc_id"], abs(r["shift"])) for r in found.collect()} == {(1, 2), (2, 2)}
    assert decontamination.phrase_matches(index, phrases).count() == 0


def test_no_python_in_the_plan(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontamination.score_documents(messy(spark), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_proximity_of_windows_with_a_replaced_word(spark):
    """Nine of ten words have to stand there, whichever is missing; two are not enough."""
    window = "alpha bravo carol delta eager fancy giant happy inner joker".split()
    texts = [" ".join(["pad", *window[:i], "other", *window[i + 1 :], "end"]) for i in range(10)]
    texts += ["alpha bravo " + sentence(70, 20), " ".join([*window[:2], "x", "y", *window[4:]]), " ".join([*window[:5], "one", "more", *window[5:]])]
    texts += [" ".join(window[::-1]), " ".join(window[:5] + ["far"] * 9 + window[5:])]
    for known in (True, False):  # whether the last word occurs anywhere
        told = [t if known else t.replace("joker", "other") for t in texts]
        docs = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
        items = spark.createDataFrame([(1, " ".join(window))], "item_id long, text string")
        phrases = decontamination.phrases_of(items, "item_id", "text", 10)
        index = decontamination.build_index(docs, phrases.selectExpr("explode(phrase) as term").distinct())
        found = decontamination.proximity_matches(index, phrases, slop=3).join(index.docs, "doc_key").collect()
        assert {r["doc_id"] for r in found} == ({*range(10), 12} if known else {9, 12})
        assert all(r["found"] >= 9 for r in found)
