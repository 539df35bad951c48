import math
import random

import numpy as np
import pytest
from corpus import CLASHES
from pyspark.sql import functions as F

from panelweave.llm import negatives
from panelweave.llm.negatives import Options, hard_negatives

BOUND = 2**63


def brute(rows, options, anchor):
    """Every pair, in Python's integers."""
    rows = [
        (i, label, [int(x) for x in v])
        for i, label, v in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a, b)), -BOUND), BOUND - 1)

    def order(item):
        return -item[0], item[1] is None, item[1] or 0

    out = []
    for k, (i, label, v) in enumerate(rows):
        if not anchor(i):
            continue
        scored = [(score(v, w), j, m == label) for n, (j, m, w) in enumerate(rows) if n != k]
        for s, p, _ in sorted((x for x in scored if x[2]), key=order)[: options.positives]:
            fit = [x for x in scored if not x[2] and options.least_percent * s <= 100 * x[0] <= options.most_percent * s]
            out += [(i, p, r, n, s, t) for r, (t, n, _) in enumerate(sorted(fit, key=order)[: options.negatives], 1)]
    return sorted(out, key=repr)


def run(spark, rows, options, anchor="vec_id % 5 = 0", kind="string"):
    df = spark.createDataFrame(rows, f"vec_id long, label {kind}, vector array<double>")
    clash = [c for c in (*CLASHES, "row", "id", "vectors", "block", "turn") if c != "label"]
    df = df.selectExpr("*", *[f"{i} as `{name}`" for i, name in enumerate(clash)]).repartition(3)
    return sorted((tuple(r) for r in hard_negatives(df, F.expr(anchor), options).collect()), key=repr)


def whole(rng, size, spread=256):
    return [float(math.floor(rng.gauss(0, spread))) for _ in range(size)]


def clustered(count, seed=5, width=8):
    rng = random.Random(seed)
    centres = [whole(rng, width) for _ in range(4)]
    return [
        (i, "abc"[i % 3], [float(math.floor(c * rng.choice((0.3, 1, 1, 2)) + rng.gauss(0, 60))) for c in centres[rng.randrange(4)]])
        for i in range(count)
    ]


@pytest.mark.parametrize("options", [Options(block_cells=160, anchor_cells=96), Options(), Options(focus=1, positives=2, negatives=9, block_cells=400, least_percent=1, most_percent=100)])
def test_matches_all_pairs(spark, options):
    rows = clustered(300)
    assert run(spark, rows, options) == brute(rows, options, lambda i: i % 5 == 0)


def test_messy_rows(spark):
    """Ties, repeated ids and rows, zeros, other lengths, nulls and infinities."""
    rng = random.Random(9)
    rows = [(i, "ab"[i % 2], [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(60)]
    rows += [(10, "a", [1.0, 2.0, 0.0, 1.0]), (10, "b", [1.0, 2.0, 0.0, 1.0]), (None, "a", [2.0, 2.0, 1.0, 1.0]), (None, "b", [2.0, 2.0, 1.0, 1.0])]
    rows += [(15, "a", [0.0] * 4), (20, "a", []), (25, "b", [3.0, 1.0]), (30, "a", [1.0] * 6)]
    rows += [(35, None, [1.0] * 4), (40, "a", None), (45, "a", [1.0, None]), (50, "b", [math.inf, 1.0]), (55, "b", [1.0, math.nan])]
    options = Options(block_cells=60, anchor_cells=24)
    assert run(spark, rows, options) == brute(rows, options, lambda i: i is not None and i % 5 == 0)


def test_equal_vectors_fill_several_blocks(spark):
    rows = [(i, str(i % 2), [3.0, 4.0, 1.0]) for i in range(120)] + [(200 + i, str(i % 3), [2.0, float(i % 5), 1.0]) for i in range(60)]
    options = Options(block_cells=30, anchor_cells=30, least_percent=20)
    assert run(spark, rows, options) == brute(rows, options, lambda i: i % 5 == 0)


def test_large_numbers_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [float(rng.randrange(-(2**40), 2**40)) for _ in range(3)]) for i in range(40)]
    rows += [(i, i % 2, [1e200, 1.0, -1e30]) for i in (40, 41, 42)]
    assert run(spark, rows, Options(), kind="int") == brute(rows, Options(), lambda i: i % 5 == 0)


def test_no_rows_and_no_anchors(spark):
    assert run(spark, [], Options()) == []
    assert run(spark, clustered(20), Options(), anchor="cast(null as boolean)") == []


def test_lists_prune_before_scores():
    """Far fewer rows are verified than there are, and none that counts is lost."""
    rng = np.random.default_rng(1)
    matrix = np.floor(rng.normal(size=(4000, 16)) * 64 + 256 * np.eye(16)[rng.integers(0, 16, 4000)] * 4)

    class Block(negatives.Rows):
        def __init__(self):
            self.lengths = np.linalg.norm(matrix, axis=1)
            self.unit, self.rows = matrix / self.lengths[:, None], np.arange(len(matrix))

    block = Block()
    block.sort_lists()
    kept = 0
    for anchor in matrix[::200]:
        scores = matrix @ anchor
        least = np.sort(scores)[-8]
        unit = anchor / np.linalg.norm(anchor)
        focus = np.argsort(-np.abs(unit))[:5]
        found = block.candidates(unit, focus, least / np.linalg.norm(anchor) / block.lengths.max())
        assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
        kept += len(found)
    assert kept < 0.5 * len(matrix) * len(matrix[::200])
