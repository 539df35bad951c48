"""Counts, means and co-moments of groups of rows, and how groups combine.

A row set enters estimation only through its moments, and moments of disjoint
groups add up.  Estimation therefore scans rows once, groups them by the
finest key it needs (test, cluster), and derives everything else (totals,
cluster scores, leave-one-out, bootstrap replicates) from that small table.

For variables ``v0 .. v{p-1}`` a moment table has ``n``, ``mu_i`` and ``s_i_j``
(``i <= j``): the sum over rows of ``(v_i - mu_i)(v_j - mu_j)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def moment_columns(p: int) -> list[str]:
    return ["n"] + [f"mu_{i}" for i in range(p)] + [f"s_{i}_{j}" for i, j in pairs(p)]


def group_moments(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Moment table of ``variables`` by ``keys``; rows must be complete cases."""
    p = len(variables)
    doubles = df.select(*keys, *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(variables)])
    count = F.count(F.lit(1))
    aggs = [count.alias("n")] + [F.avg(f"v{i}").alias(f"mu_{i}") for i in range(p)]
    # Spark's running covariance does not subtract large sums of squares.
    aggs += [
        ((F.var_pop(f"v{i}") if i == j else F.covar_pop(f"v{i}", f"v{j}")) * count).alias(f"s_{i}_{j}")
        for i, j in pairs(p)
    ]
    return doubles.groupBy(*keys).agg(*aggs)


def matrix_moments(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row (n, mu, s) for many variables, ``s`` being the upper triangle in
    the order of :func:`pairs`.

    The same moments as :func:`group_moments`, by matrix products: each Arrow
    batch is centred on its own means, and two sets of moments are merged with
    the gap between their means, first inside a task and then over one row per
    task.  No raw sum of squares is formed, so values far from zero keep their
    digits.
    """
    p = len(variables)
    upper = np.triu_indices(p)

    def merge(
        one: tuple[float, np.ndarray, np.ndarray], other: tuple[float, np.ndarray, np.ndarray]
    ) -> tuple[float, np.ndarray, np.ndarray]:
        n = one[0] + other[0]
        if not other[0] or not n:
            return one
        gap = other[1] - one[1]
        return n, one[1] + gap * (other[0] / n), one[2] + other[2] + np.outer(gap, gap) * (one[0] * other[0] / n)

    def packed(held: tuple[float, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        n, mean, inner = held
        arrays = [pa.array([n]), pa.array([mean.tolist()]), pa.array([inner[upper].tolist()])]
        return pa.RecordBatch.from_arrays(arrays, names=["n", "mu", "s"])

    nothing = (0.0, np.zeros(p), np.zeros((p, p)))

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = nothing
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                mean = x.mean(axis=0)
                held = merge(held, (float(len(x)), mean, (x - mean).T @ (x - mean)))
        yield packed(held)

    def reduce_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = nothing
        for batch in batches:
            for n, mean, triangle in zip(*(c.to_pylist() for c in batch.columns)):
                inner = np.zeros((p, p))
                inner[upper] = triangle
                held = merge(held, (n, np.array(mean), inner + np.triu(inner, 1).T))
        yield packed(held)

    schema = "n double, mu array<double>, s array<double>"
    doubles = df.select(*[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(variables)])
    # A row of moments per task meets in one.
    return doubles.mapInArrow(reduce_rows, schema).repartition(1).mapInArrow(reduce_tasks, schema)


def product_sums(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row (n, products): sums of products, not centred."""
    n = F.col("n")
    rows, columns = (F.expr(f"array({', '.join(str(x[side]) for x in pairs(len(variables)))})") for side in (0, 1))
    raw = F.transform("s", lambda v, k: v + n * F.get(F.col("mu"), F.get(rows, k)) * F.get(F.col("mu"), F.get(columns, k)))
    return matrix_moments(df, variables).select("n", raw.alias("products"))


def combine(table: DataFrame, p: int, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Moment table of the union of groups; ``weight`` repeats a group."""
    w = F.lit(1.0) if weight is None else weight
    n = w * F.col("n")
    total = F.sum(n)
    mean = {i: F.sum(n * F.col(f"mu_{i}")) / total for i in range(p)}
    aggs = [total.alias("n"), F.sum(F.when(n > 0, w)).alias("n_groups")]
    aggs += [mean[i].alias(f"mu_{i}") for i in range(p)]
    for i, j in pairs(p):
        inside = F.sum(w * F.col(f"s_{i}_{j}") + n * F.col(f"mu_{i}") * F.col(f"mu_{j}"))
        aggs.append((inside - total * mean[i] * mean[j]).alias(f"s_{i}_{j}"))
    return table.groupBy(*keys).agg(*aggs)


def remove(p: int, whole: str = "all_", part: str = "") -> dict[str, Column]:
    """Moments of a whole without one of its groups, from columns of both."""
    n_all, n_out = F.col(f"{whole}n"), F.col(f"{part}n")
    left = n_all - n_out
    mean = {
        i: F.try_divide(n_all * F.col(f"{whole}mu_{i}") - n_out * F.col(f"{part}mu_{i}"), left) for i in range(p)
    }
    out = {"n": left} | {f"mu_{i}": mean[i] for i in range(p)}
    for i, j in pairs(p):
        gap = (F.col(f"{part}mu_{i}") - mean[i]) * (F.col(f"{part}mu_{j}") - mean[j])
        out[f"s_{i}_{j}"] = F.col(f"{whole}s_{i}_{j}") - F.col(f"{part}s_{i}_{j}") - gap * n_out * left / n_all
    return out
