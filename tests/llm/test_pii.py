import random
import re

from corpus import empty, messy, sentence
from pyspark.sql import functions as F

from panelweave.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    """Base spans by Python's re."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 1, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 2, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 3, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 4, m.end(), "phone"))
    return sorted(out)


def base_spans(rows):
    return [[(s["start"], s["order"], s["end"], s["kind"]) for s in r["spans"] if s["base"]] for r in rows]


def test_base_spans_of_random_texts(spark):
    rng = random.Random(11)
    parts = ["@", ".", "a", "b.c", "x@y.z", "1", "22", "255", "256", "007", ".", "-", " ", "+", "(", ")", "é", "🎉", "4111 1111 1111 1111", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (2) 3-4 56789 ", "x" * 30_000, "a." * 20_000 + "@b.c", "1-" * 20_000, "+" + "1 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(pii.find_spans(df).collect(), key=lambda r: r["doc_id"])
    assert base_spans(rows) == [brute(t) for t in texts]


def announced(i):
    """Announced spans of every kind, base and loose, and look-alikes of no kind, in any order."""
    parts = [
        f"call me tel +1 (807) 555-{6000 + i}", f"mail jo{i}@site.org", "card 4111-1111-1111-1111", f"ip 10.0.0.{i}",
        f'token = "{i:04d}f0e1d2c3b4a5968778{i:04d}"', f"seen jo{i}@home then", f"some {i + 1000000000000000}9 units",
        "of 4111-1111-1111-1112 in all", f"see 300.1.1.{i} there", "for this_was_a_plain_word so",
        f"call me tel {200 + i} 555 {1000 + i}", f"mail jo{i} (at) site.org",
    ]
    random.Random(i).shuffle(parts)
    return "\n".join(f"{sentence(i * 20 + k, 5)} {part} {sentence(i * 20 + k + 9, 5)}" for k, part in enumerate(parts))


def test_method_adds_spans_and_keeps_clean_texts(spark):
    rows = [(i, announced(i)) for i in range(200)] + [(1000 + i, sentence(i, 60)) for i in range(40)]
    found = {r["doc_id"]: r["spans"] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = wrong = 0
    for doc_id, text in rows[:200]:
        added = {text[s["start"] : s["end"]] for s in found[doc_id] if not s["base"]}
        wanted = {f"{200 + doc_id} 555 {1000 + doc_id}", f"jo{doc_id} (at) site.org", f"{doc_id:04d}f0e1d2c3b4a5968778{doc_id:04d}"}
        right, wrong = right + len(added & wanted), wrong + len(added - wanted)
    assert right >= 0.9 * 600 and wrong <= 0.02 * right
    assert not any(found[1000 + i] for i in range(40))
    for doc_id, text in rows:
        spans = sorted((s["start"], s["end"]) for s in found[doc_id])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and brute(text) == [
            (s["start"], s["order"], s["end"], s["kind"]) for s in found[doc_id] if s["base"]
        ]


def test_trees_decide_on_the_tables(spark):
    """On the driver's documents trees are trained on more than one kind; their spans are right by the text around them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    keyed = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    _, limits = pii._model(pii._labelled(pii._described(pii._proposals(keyed))).cache(), pii.Options())
    assert "secret" in limits
    found = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()}
    added = [(s["kind"], texts[i][max(s["start"] - 9, 0) : s["start"]]) for i, spans in found.items() for s in spans if not s["base"]]
    planted = sum(len(re.findall(r'token = "[0-9a-f]{40}"', t)) for t in texts.values())
    assert planted > 0 and sum(1 for kind, before in added if kind == "secret" and before.endswith('= "')) >= 0.95 * planted
    assert all(before.endswith('= "') for kind, before in added if kind == "secret")


def test_hot_and_one_class_tables(spark):
    """A text that most rows share, and tables whose spans all have one label."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "").otherwise("ip 10.0.0.1").alias("text"))
    assert sorted(len(r["spans"]) for r in pii.find_spans(docs).collect()) == [0] * 266 + [1] * 134
    loose = spark.createDataFrame([(1, "tel 200 555 1000")], "doc_id long, text string")
    assert pii.find_spans(loose).first()["spans"] == []


def test_awkward_tables(spark):
    rows = pii.find_spans(messy(spark)).collect()
    assert len(rows) == messy(spark).count() and all(not r["spans"] for r in rows if r["doc_id"] in (2, 3, 4, 11))
    assert pii.find_spans(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")], "doc_id long, text string")
    assert [len(r["spans"]) for r in pii.find_spans(twice).collect()] == [1, 1, 1]


def test_check_digit(spark):
    numbers = ["4111111111111111", "4111111111111112", "123", "", "0" * 12, "0" * 20]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert [r[0] for r in df.select(pii.luhn(F.col("n"))).collect()] == [True, False, False, False, True, False]


def test_context_separates_valid_look_alikes(spark):
    """Numbers of one format: announced, in lines like the announced ones, and in clean numeric text."""
    rows = [(i, f"{sentence(i, i % 7)}\nOffice tel: +1 ({200 + i % 700}) 555-{1000 + i}\n{sentence(i, 2)}") for i in range(300)]
    rows += [(1000 + i, f"{sentence(i, 2 + i)}\nOffice tel: ({300 + i}) 555 {2000 + i}\n{sentence(i, 2)}") for i in range(5)]
    rows += [(2000 + i, f"measured {300 + i} 441 {2000 + i} units and {400 + i} 442 {3000 + i} more of them") for i in range(150)]
    rows += [(3000 + i, f"{sentence(i, 4)} stay {sentence(i, 1).strip(',')} (at) home.now then {sentence(i, 2)}") for i in range(40)]
    rows += [(4000 + i, f"phases {10 + i % 40}:{20 + i % 30}:11:12:{13 + i % 9} of the run") for i in range(40)]
    found = {r["doc_id"]: r["spans"] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s["kind"] for s in found[i]] == ["phone"] for i, _ in rows if i < 2000)
    assert not any(found[i] for i, _ in rows if i >= 2000)


def test_no_feature_makes_the_label(spark):
    texts = [announced(i) for i in range(40)]
    docs = spark.createDataFrame([(t, t) for t in texts], "text_key string, text string")
    rows = pii._labelled(pii._described(pii._proposals(docs))).where("label is not null").collect()
    assert {(r["kind"], r["label"]) for r in rows} == {(k, x) for k in pii.ALL_KINDS for x in (0.0, 1.0)}
    assert not {"valid", "base", "has_check_digit", "n_digits", "n_chars"} & set(pii.FEATURES)
    assert not any(all(bool(r[f]) == bool(r["label"]) for r in rows) for f in pii.FEATURES)


def test_threshold_of_a_kind():
    held = [(0.9, 1.0)] * 18 + [(0.8, 1.0), (0.8, 0.0), (0.7, 0.0), (0.7, 0.0)]
    assert pii._limit(held, pii.Options()) == 0.8
    assert pii._limit([(0.9, 0.0), (0.4, 1.0)], pii.Options()) is None and pii._limit([], pii.Options()) is None


def test_chain_of_overlapping_spans(spark):
    """A span that only a dropped span overlaps stays."""
    spans = [("a", "card", 0, 10), ("a", "phone", 5, 15), ("a", "ip", 12, 20), ("a", "email", 18, 30), ("a", "phone", 20, 25), ("a", "phone", 40, 41), ("b", "phone", 7, 9)]
    df = spark.createDataFrame([(*s, False) for s in spans], "text_key string, kind string, start int, end int, base boolean")
    found = {(r["text_key"], r["start"], r["end"]) for r in pii._first_ones(df).collect()}
    assert found == {("a", 0, 10), ("a", 12, 20), ("a", 20, 25), ("a", 40, 41), ("b", 7, 9)}


def test_span_behind_a_dropped_one(spark):
    """The base span drops the first loose span, which must not drop the second."""
    schema = "text_key string, kind string, start int, end int, base boolean, valid boolean, has_check_digit boolean"
    rows = [("a", "ip", 0, 10, True), ("a", "phone", 5, 20, False), ("a", "card", 15, 30, False), ("a", "phone", 28, 35, False), ("a", "card", 30, 40, False)]
    described = spark.createDataFrame([(*r, True, True) for r in rows], schema)
    every = lambda df: df.withColumn("score", F.lit(1.0))
    limits = {kind: 0.5 for kind in pii.ALL_KINDS}
    labelled = pii._labelled(described)
    assert {(r["kind"], r["start"]) for r in pii._added(labelled, (every, limits)).collect()} == {("card", 15), ("card", 30)}
    assert pii._added(labelled, (every, {"phone": 0.5})).count() == 1 and pii._added(labelled, None).count() == 0


def test_every_span_teaches(spark, monkeypatch):
    """Weights of what the trees learn from add up to all labelled spans, far beyond a few thousand of a kind."""
    docs = spark.range(6000).select(
        F.md5(F.col("id").cast("string")).alias("text_key"),
        F.concat(F.lit("card 4111-1111-1111-111"), F.when(F.col("id") % 3 == 0, "1").otherwise("2"), F.lit(" of "), F.col("id")).alias("text"),
    )
    labelled = pii._labelled(pii._described(pii._proposals(docs))).cache()
    seen, taught = [], pii._taught

    def watched(known, options):
        seen.append({r["kind"]: r["w"] for r in known.groupBy("kind").agg(F.sum("weight").alias("w")).collect()})
        return taught(known, options)

    monkeypatch.setattr(pii, "_taught", watched)
    pii._model(labelled, pii.Options())
    wanted = {r["kind"]: r["n"] for r in labelled.where("label is not null").groupBy("kind").agg(F.sum("weight").alias("n")).collect()}
    assert wanted["card"] >= 6000
    first, second = seen[:2]
    assert {k: first[k] + second[k] for k in wanted} == wanted


def test_weighted_threshold():
    held = [(0.9, 1.0, 18.0), (0.8, 1.0, 1.0), (0.8, 0.0, 1.0), (0.7, 0.0, 2.0)]
    assert pii._limit(held, pii.Options()) == 0.8
    assert pii._limit([(0.9, 1.0, 1.0), (0.9, 0.0, 0.05)], pii.Options()) == 0.9
