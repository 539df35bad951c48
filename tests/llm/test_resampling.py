import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from corpus import CLASHES, empty, messy, messy_rows, sentence

from panelweave.llm import resampling
from panelweave.llm.resampling import Options, feature_buckets, resample


def features(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(words[i : i + n]) for n in range(1, size + 1) for i in range(len(words) - n + 1)]
    return len(words), runs


def brute(rows, target, options):
    def bucket(run):
        return zlib.crc32(run.encode()) % options.buckets

    s = Counter(bucket(r) for _, text in rows for r in features(text, options.run_words)[1])
    t = Counter(bucket(r) for text in target for r in features(text, options.run_words)[1])
    n, m = s.total() + options.buckets, t.total() + options.buckets
    out = []
    for doc_id, text in rows:
        words, runs = features(text, options.run_words)
        gains = [math.floor(1000 * math.log((t[bucket(r)] + 1) * n / ((s[bucket(r)] + 1) * m))) for r in runs]
        weight = sum(gains) // len(gains) if gains else 0
        name = f"{options.seed}:{'null' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        out.append((doc_id, words, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= options.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: options.percent * len(able) // 100], len(able)


def check(found, rows, target, options):
    scored, drawn, _ = brute(rows, target, options)
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(scored, key=repr)
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked] == [(d[4], d[0]) for d in drawn]


@pytest.mark.parametrize("options", [Options(percent=60), Options(run_words=3, buckets=97, seed=7, least_words=1, percent=100)])
def test_messy_corpus(spark, options):
    target = [sentence(1, 40), None, "", sentence(77, 90)]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample(messy(spark), items, options, carry=("score", "node")).collect()
    check(found, messy_rows(), target, options)
    assert [len(r) for r in found] == [8] * len(found) and {r["node"] for r in found} == {CLASHES.index("node")}


def test_ranges_hold_equal_rows_apart(spark):
    """A third of the rows are the same, another third ties in score and id."""
    rows = [(5, sentence(1, 30))] * 400 + [(None, sentence(i, 30)) for i in range(400)] + [(i, sentence(3, 25)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(sentence(1, 30),)], "text string")
    found = resample(docs, items, Options(percent=50), range_rows=40).collect()
    check(found, rows, [sentence(1, 30)], Options(percent=50))


def test_splitters_are_regular(spark):
    """Through several levels of merging, no range exceeds twice its share."""
    keys = spark.range(20_000, numPartitions=9).selectExpr(
        "(id * 7919) % 1000 as score", "id % 10 as doc_id", "id % 3 as text_key", "id as row"
    )
    order = ["score desc", "doc_id asc nulls last", "text_key", "row"]
    runs = keys.selectExpr("*").sortWithinPartitions(*[resampling.F.expr(o.split(" ")[0]).desc() if "desc" in o else resampling.F.col(o.split(" ")[0]) for o in order])
    ends = resampling.regular_splitters(runs, 20_000, 20, fan_in=3)
    rows = sorted((-r["score"], False, r["doc_id"], r["text_key"], r["row"]) for r in keys.collect())
    import bisect

    sizes = Counter(bisect.bisect_left(ends, k) for k in rows)
    assert len(sizes) >= 10 and max(sizes.values()) <= 2 * 20_000 / 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(empty(spark), none).collect() == []
    options = Options(percent=100)
    check(resample(messy(spark), none, options).collect(), messy_rows(), [], options)


def test_parts_of_a_long_text(monkeypatch):
    text = (sentence(4, 900) + " Ünd-so_WEITER 12") * 2
    whole = feature_buckets(text.encode(), Options(run_words=2))
    monkeypatch.setattr(resampling, "PART_BYTES", 50)
    parts = feature_buckets(text.encode(), Options(run_words=2))
    assert whole[0] == parts[0] and Counter(x for f in whole[1] for x in f.tolist()) == Counter(x for f in parts[1] for x in f.tolist())
