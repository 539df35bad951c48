import collections
import zlib

import numpy as np
import pytest
from corpus import CLASHES, empty, messy, messy_rows

from panelweave.llm import sharding


def test_exact_sizes_and_gapless_slots(spark):
    df = messy(spark)
    rows = sharding.shard_rows(df, 5, bucket_rows=2).collect()
    assert len(rows) == len(messy_rows())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [3, 3, 3, 3, 4]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    held = collections.Counter((r["doc_id"], r["text"]) for r in rows)
    assert held == collections.Counter(messy_rows())
    assert {c for c in rows[0].asDict()} == {"doc_id", "text", *CLASHES} | {"shard", "slot"}


def test_same_draw_again_and_another_by_seed(spark):
    df = spark.range(200).selectExpr("id as doc_id", "cast(id as string) as text").coalesce(3)
    one, two, other = (
        [(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(df, 4, seed=s).orderBy("doc_id").collect()]
        for s in (1, 1, 2)
    )
    assert one == two and one != other


def test_few_rows_and_none(spark):
    assert sharding.shard_rows(empty(spark), 3).count() == 0
    few = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r["shard"] for r in sharding.shard_rows(few, 40).collect()) == [0, 1]


def test_matrix_has_exact_margins():
    counts = np.array([5, 0, 17, 3, 11])
    sizes = sharding.shard_sizes(36, 7)
    matrix = [sharding.partition_row(counts, sizes, i, seed=3) for i in range(len(counts))]
    assert [sum(row) for row in matrix] == counts.tolist()
    assert [sum(column) for column in zip(*matrix)] == sizes


def test_draws_are_uniform():
    hits = np.zeros((2, 3))
    for seed in range(3000):
        hits += [sharding.partition_row(np.array([4, 8]), [6, 3, 3], i, seed) for i in range(2)]
    assert hits / 3000 == pytest.approx(np.array([[2, 1, 1], [4, 2, 2]]), abs=0.1)


def test_large_populations():
    rng = np.random.default_rng(1)
    drawn = [sharding.hypergeometric(rng, 6 * 10**9, 4 * 10**9, 10**9) for _ in range(20)]
    mean, spread = 6e8, (1e9 * 0.6 * 0.4 * 0.9) ** 0.5
    assert abs(np.mean(drawn) - mean) < 2 * spread and np.std(drawn) < 3 * spread
    assert sharding.hypergeometric(rng, 2 * 10**9, 0, 5) == 5


def test_query_columns(spark, tmp_path):
    from panelweave.llm import queries

    rows = [(i, None if i == 3 else "té" * i) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op1_sharding(spark, str(tmp_path)).collect()}
    assert len(out) == 90 and collections.Counter(r["shard"] for r in out.values()).most_common()[0][1] == 3
    for i, text in rows:
        raw = (text or "").encode()
        assert (out[i]["size"], out[i]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
