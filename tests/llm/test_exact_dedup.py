import collections
import hashlib

import pytest
from corpus import CLASHES, empty, messy, messy_rows
from pyspark.sql import functions as F

from panelweave.llm import exact_dedup


def brute(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_hash", [F.xxhash64, lambda c: F.length(c) % 3, lambda c: F.lit(1)])
def test_groups(spark, chunk_hash):
    """Also under hashes that many chunks share."""
    rows = messy_rows() + [(30, messy_rows()[9][1]), (31, messy_rows()[9][1] + " "), (32, messy_rows()[9][1].replace("ba", "Ba", 1))]
    out = exact_dedup.group_copies(messy(spark, rows), sizes=(20, 200), chunk_hash=chunk_hash)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert exact_dedup.group_copies(empty(spark)).count() == 0
    assert exact_dedup.unique_documents(empty(spark)).count() == 0


def test_unique_documents(spark):
    kept = exact_dedup.unique_documents(messy(spark))
    assert set(kept.columns) == {"doc_id", "text", *CLASHES}
    found = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert set(found.values()) == {1}
    texts = [text or "" for _, text in found]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in messy_rows()})
    assert (5, messy_rows()[0][1]) in found and (3, "") in found


def test_chunks_follow_content(spark):
    text = messy_rows()[9][1].replace("x, ", "x. ")
    df = spark.createDataFrame([(0, text), (1, "inserted words. " + text), (2, "y" * 50_000)], "i int, text string")
    rows = {r["i"]: r["c"] for r in df.select("i", exact_dedup.chunks_of(F.col("text"), (64, 1000)).alias("c")).collect()}
    assert "".join(rows[0]) == text and "".join(rows[2]) == "y" * 50_000
    assert max(map(len, rows[0])) <= 1000 and len(set(rows[0]) & set(rows[1])) >= len(rows[0]) - 3


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.group_copies(messy(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_id_differs_from_an_id_of_any_name(spark):
    rows = [(None, "x"), ("none", "y"), ("", "z"), (None, "y"), ("none", "x"), ("", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    kept = exact_dedup.unique_documents(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [("", "z"), ("none", "x"), ("none", "y")]
