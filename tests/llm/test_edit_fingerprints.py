import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpus import empty, messy, messy_rows, sentence
from pyspark.sql import functions as F

from panelweave.llm import edit_fingerprints as ef


def walked(text):
    """What the walk writes, step by step."""
    moves = np.random.default_rng(481).integers(0, 2, (ef.PERIOD, ef.CLASSES), dtype=np.uint8)
    moves[0] = 1
    classes = ef._classes(ef.code_points(text))
    at, step, out = 0, 0, []
    while at < len(text):
        out.append(text[at])
        at += int(moves[step % ef.PERIOD, classes[at]])
        step += 1
    return "".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def with_edits(rng, text, count):
    out = list(text)
    for _ in range(count):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyzü")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("xyzü"))
    return "".join(out)


@pytest.mark.parametrize("together", [1, 10**9])
def test_walk_step_by_step(monkeypatch, together):
    monkeypatch.setattr(ef, "SIDE_BY_SIDE", together)
    texts = [sentence(i, 1 + i * 7) for i in range(12)] + ["", "x", "\U0001f600é", "a" * 9000, sentence(3, 3000)]
    found = ef.walks([ef.code_points(t) for t in texts])
    for text, steps, made in zip(texts, found, ef.fingerprints(texts)):
        written = walked(text)
        assert steps[-1] == len(written) == made.steps and len(steps) == len(text) + 1
        assert "".join(text[np.searchsorted(steps, s, "right") - 1] for s in range(len(written))) == written
        assert 2 ** (made.level - 1) < len(text) <= 2**made.level or made.level == ef.LEAST_LEVEL


def test_likeness_follows_edits():
    rng = random.Random(4)
    near, far = [], []
    for i in range(60):
        text = sentence(i, rng.randrange(40, 600))
        a, b, c, d = ef.fingerprints([text, with_edits(rng, text, 2), text, sentence(1000 + i, 300)])
        assert ef.likeness(a, c) == 1 and str(a) == str(c)
        near.append(ef.likeness(a, b))
        far.append(ef.likeness(a, d))
        back = ef.Fingerprint.parse(str(a))
        assert (back.level, back.steps) == (a.level, a.steps) and np.array_equal(back.samples, a.samples)
    assert np.mean(near) > 0.8 and np.mean(far) < 0.15 and np.max(far) < 0.3
    none, one = ef.fingerprints(["", "a"])
    assert (ef.likeness(none, none), ef.likeness(none, one), ef.likeness(one, one)) == (1, 0, 1)
    halves = ef.fingerprints([sentence(1, 800), ef.edited(sentence(1, 800), sentence(2, 900))])
    assert 0.4 < ef.likeness(*halves) < 0.7


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(200):
        a = "".join(rng.choice("abcü") for _ in range(rng.randrange(0, 40)))
        b = with_edits(rng, a, rng.randrange(0, 8)) if len(a) > 9 and rng.random() < 0.8 else "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
        true = distance(a, b)
        assert ef.edit_distance(a, b) == true
        assert min(ef.edit_distance(a, b, 5), 6) == min(true, 6)


def brute(spark, rows):
    """Neighbours in one sorted list."""
    keyed = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id long, text string").withColumn("k", F.xxhash64("text")).collect()
    order = sorted(keyed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["k"]))
    out = []
    for k, row in enumerate(order):
        text, other = row["text"], order[k - 1]["text"]
        new = ef.edited(text, other)
        a, b, c = ef.fingerprints([text, new, other])
        digest = hashlib.sha256(new.encode()).hexdigest()
        out.append((row["doc_id"], len(text), digest, str(a), str(b), ef.likeness(a, b), ef.likeness(a, c), ef.Bands().shared(a, b)))
    return out


@pytest.mark.parametrize("rows", [messy_rows(), messy_rows()[:1], [(None, sentence(i % 9, 40)) for i in range(90)] + [(i, sentence(2, 20)) for i in range(60)]])
def test_neighbours(spark, rows):
    found = ef.compare_neighbours(messy(spark, rows)).collect()
    assert Counter(map(tuple, found)) == Counter(brute(spark, rows))


def test_empty_table(spark):
    assert ef.compare_neighbours(empty(spark)).collect() == []
    pairs, members = ef.search(empty(spark), F.col("doc_id") % 2 == 0)
    assert pairs.collect() == [] and members.collect() == []


def test_search(spark):
    """Exact distances only, no pair twice, and the close ones found; a hot
    bucket is larger than a block."""
    rng = random.Random(6)
    base = [sentence(i, 120) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, with_edits(rng, t, rng.randrange(1, 4))) for i, t in enumerate(base)]
    rows += [(200 + i, with_edits(rng, base[0], 1)) for i in range(40)] + [(300, base[0]), (301, None), (302, "")]
    options = ef.SearchOptions(block=16)
    pairs, members = ef.search(messy(spark, rows), F.col("doc_id") % 20 == 0, options)
    named = {bytes(r["text_digest"]): dict(rows)[r["doc_id"]] for r in members.collect() if r["doc_id"] is not None}
    found = [(named[bytes(r["asked"])], named[bytes(r["found"])], r["edits"]) for r in pairs.collect()]
    assert len(set(found)) == len(found)
    asked = {t for i, t in rows if i % 20 == 0 and t}
    texts = {t for _, t in rows if t}
    true = {(a, b, d) for a in asked for b in texts if a != b and (d := ef.edit_distance(a, b)) * 100 <= max(len(a), len(b))}
    assert set(found) <= true and len(found) >= 0.9 * len(true) > 80
