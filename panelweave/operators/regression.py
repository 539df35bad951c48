"""Least squares from moment tables: plain, fixed-effect, clustered, robust.

Everything is one lazy plan per call.  With one regressor the solution is
plain column arithmetic.  With more, the k x k system of each result row is
solved by NumPy in an Arrow batch; those rows are estimates, not data.
A design without full rank gives NULL estimates and ``identified = false``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.inference import critical_value, f_p_value, p_value
from ..plans.specs import PANEL, SPECIFICATIONS, PanelSpec, Specification
from ..session import cut_lineage
from .cleaning import complete_cases
from .grouping import attach_group_stats
from .moments import combine, group_moments, matrix_moments, pairs, product_sums, remove
from .panel import EVENT_WINDOW, REFERENCE_PERIOD, dummy_name, event_dummies

#: A scaled design with a larger condition number counts as rank deficient.
MAX_CONDITION = 1e12
#: Standard errors below this share of the estimate are an exact fit.
EXACT_FIT = 1e-10
#: Variance below which a single regressor counts as constant.
MIN_VARIANCE = 1e-24

_SOLUTION = T.StructType(
    [
        T.StructField("b", T.ArrayType(T.DoubleType())),
        T.StructField("inv", T.ArrayType(T.DoubleType())),
        T.StructField("rss", T.DoubleType()),
    ]
)


@F.pandas_udf(_SOLUTION)
def _solve_system(packed: pd.Series) -> pd.DataFrame:
    """Solve each packed upper triangle of the co-moments of (y, x1..xk)."""
    rows = []
    for values in packed:
        triangle = np.asarray(values, dtype=float)
        p = int((np.sqrt(8 * len(triangle) + 1) - 1) / 2)
        full = np.zeros((p, p))
        full[np.triu_indices(p)] = triangle
        full = full + np.triu(full, 1).T
        sxx, sxy, syy = full[1:, 1:], full[0, 1:], full[0, 0]
        scale = np.sqrt(np.diag(sxx))
        if not np.isfinite(full).all() or (scale <= 0).any():
            rows.append((None, None, None))
            continue
        scaled = sxx / np.outer(scale, scale)
        if np.linalg.cond(scaled) > MAX_CONDITION:
            rows.append((None, None, None))
            continue
        inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
        beta = inverse @ sxy
        rows.append((beta.tolist(), inverse.ravel().tolist(), float(syy - beta @ sxy)))
    return pd.DataFrame(rows, columns=["b", "inv", "rss"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _sandwich_diagonal(inverse: pd.Series, meat: pd.Series) -> pd.Series:
    out = []
    for flat, triangle in zip(inverse, meat):
        if flat is None or triangle is None:
            out.append(None)
            continue
        k = int(np.sqrt(len(flat)))
        bread = np.asarray(flat, dtype=float).reshape(k, k)
        filling = np.zeros((k, k))
        filling[np.triu_indices(k)] = np.asarray(triangle, dtype=float)
        filling = filling + np.triu(filling, 1).T
        out.append(np.diag(bread @ filling @ bread).tolist())
    return pd.Series(out)


def solve(totals: DataFrame, p: int, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``b`` (k), ``inv`` (k x k, flat) and ``rss`` to a moment table."""
    if p == 2:
        ok = (F.col("n") > 1) & (F.col("s_1_1") > F.col("n") * F.lit(MIN_VARIANCE))
        slope = F.when(ok, F.try_divide("s_0_1", "s_1_1"))
        return totals.withColumns(
            {
                "b": F.when(ok, F.array(slope)),
                "inv": F.when(ok, F.array(F.try_divide(F.lit(1.0), F.col("s_1_1")))),
                "rss": F.greatest(F.col("s_0_0") - slope * F.col("s_0_1"), F.when(ok, F.lit(0.0))),
            }
        )
    if p == 3:
        return _solve_pair(totals)
    packed = F.array(*[F.col(f"s_{i}_{j}") for i, j in pairs(p)])
    solved = totals.withColumn("_sol", _solve_system(packed))
    return solved.withColumns({c: F.col(f"_sol.{c}") for c in ("b", "inv", "rss")}).drop("_sol")


def _solve_pair(totals: DataFrame) -> DataFrame:
    """Two regressors by Cramer's rule."""
    s = {(i, j): F.col(f"s_{i}_{j}") for i, j in pairs(3)}
    sized = totals.withColumn("_det", s[1, 1] * s[2, 2] - s[1, 2] * s[1, 2])
    # The determinant over s11 s22 is one minus the squared correlation.
    ok = (F.col("n") > 2) & (F.col("_det") > s[1, 1] * s[2, 2] / F.lit(MAX_CONDITION))
    det = F.when(ok, F.col("_det"))
    first = F.try_divide(s[0, 1] * s[2, 2] - s[0, 2] * s[1, 2], det)
    second = F.try_divide(s[0, 2] * s[1, 1] - s[0, 1] * s[1, 2], det)
    cross = F.try_divide(-s[1, 2], det)
    solved = sized.withColumns(
        {
            "b": F.when(ok, F.array(first, second)),
            "inv": F.when(ok, F.array(F.try_divide(s[2, 2], det), cross, cross, F.try_divide(s[1, 1], det))),
        }
    )
    rss = s[0, 0] - F.get("b", F.lit(0)) * s[0, 1] - F.get("b", F.lit(1)) * s[0, 2]
    return solved.withColumn("rss", rss).drop("_det")


def _with_solution(table: DataFrame, solution: DataFrame, p: int, keys: Sequence[str]) -> DataFrame:
    """Bring the solution of each key (or the single one) to a finer table."""
    slim = solution.select(*keys, F.col("b").alias("_b"), *[F.col(f"mu_{i}").alias(f"_m{i}") for i in range(p)])
    return table.join(slim, list(keys)) if keys else table.join(F.broadcast(slim))


def cluster_scores(table: DataFrame, solution: DataFrame, p: int, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of (x - mean x) * residual for each group of a moment table."""
    joined = _with_solution(table, solution, p, keys)

    def about_total(i: int, j: int) -> Column:
        gap = (F.col(f"mu_{i}") - F.col(f"_m{i}")) * (F.col(f"mu_{j}") - F.col(f"_m{j}"))
        return F.col(f"s_{min(i, j)}_{max(i, j)}") + F.col("n") * gap

    scores = []
    for i in range(1, p):
        fitted = about_total(i, 1) * F.element_at("_b", 1)
        for j in range(2, p):
            fitted = fitted + about_total(i, j) * F.element_at("_b", j)
        scores.append((about_total(0, i) - fitted).alias(f"score_{i}"))
    extra = [c for c in table.columns if not c.startswith(("mu_", "s_")) and c != "n"]
    return joined.select(*extra, *scores)


def _triangle(k: int, name: str) -> list[tuple[str, str]]:
    return [(f"{name}_{i}", f"{name}_{j}") for i in range(1, k + 1) for j in range(i, k + 1)]


def score_meat(scores: DataFrame, k: int, by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Meat of the sandwich: outer products of the scores summed per ``by``."""
    sums = scores.groupBy(*keys, *by).agg(*[F.sum(f"score_{i}").alias(f"score_{i}") for i in range(1, k + 1)])
    return sums.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in _triangle(k, "score")]).alias("meat"),
        F.count(F.lit(1)).alias("n_clusters"),
    )


def _row_scores(
    cases: DataFrame, variables: Sequence[str], solution: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """Residual ``u`` and centred regressors ``x_i`` of every row."""
    p = len(variables)
    named = cases.select(
        *dict.fromkeys([*keys, *carry]), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(variables)]
    )
    joined = _with_solution(named, solution, p, keys)
    kept = list(dict.fromkeys([*keys, *carry]))
    # Two projections: an expression that contains the others of its own
    # projection makes Catalyst list every mixture of them as a constraint.
    centred = joined.select(*kept, "_b", *[(F.col(f"v{i}") - F.col(f"_m{i}")).alias(f"x_{i}") for i in range(p)])
    residual = F.col("x_0")
    for j in range(1, p):
        residual = residual - F.col(f"x_{j}") * F.element_at("_b", j)
    return centred.select(*kept, residual.alias("u"), *[f"x_{i}" for i in range(1, p)])


def _row_meat(cases: DataFrame, variables: Sequence[str], solution: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Meat with every row as its own cluster."""
    rows = _row_scores(cases, variables, solution, keys)
    squared = F.col("u") * F.col("u")
    return rows.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(a) * F.col(b) * squared) for a, b in _triangle(len(variables) - 1, "x")]).alias("meat"),
        F.count(F.lit(1)).alias("n_clusters"),
    )


def _wide_solution(cases: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Solution row by matrix products."""
    solved = matrix_moments(cases, variables).withColumn("_sol", _solve_system("s"))
    means = {f"mu_{i}": F.get("mu", F.lit(i)) for i in range(len(variables))}
    parts = {c: F.col(f"_sol.{c}") for c in ("b", "inv", "rss")}
    return solved.withColumns(means | parts | {"s_0_0": F.get("s", F.lit(0))}).drop("_sol", "mu", "s")


def _wide_ols(cases: DataFrame, variables: Sequence[str], cluster: str | None, robust: bool, method: str, all_terms: bool):
    """Solve first, by matrix products, then take scores in a second pass.

    The second pass sums k scores per cluster, where the one-pass route would
    sum k (k + 1) / 2 products per cluster.
    """
    k, terms = len(variables) - 1, list(variables[1:])
    solution = _wide_solution(cases, variables)
    if not cluster and not robust:
        return finish(solution, terms, [], None, method, all_terms)
    names = [f"score_{i}" for i in range(1, k + 1)]
    rows = _row_scores(cases, variables, solution, [], [cluster] if cluster else [])
    scores = {name: F.col("u") * F.col(f"x_{i}") for i, name in enumerate(names, 1)}
    if cluster:
        summed = rows.groupBy(cluster).agg(*[F.sum(c).alias(name) for name, c in scores.items()])
    else:
        summed = rows.select(*[c.alias(name) for name, c in scores.items()])
    meat = product_sums(summed, names).select(F.col("products").alias("meat"), F.col("n").alias("n_clusters"))
    return finish(solution.join(F.broadcast(meat)), terms, [], "meat", method, all_terms)


def _variances(fit: DataFrame, k: int, meat: str | None) -> Column:
    """Diagonal of the coefficient covariance as an array column."""
    n, dof = F.col("n"), F.col("n") - (k + 1)
    if meat is None:
        s2 = F.try_divide(F.col("rss"), F.when(dof > 0, dof))
        return F.array(*[s2 * F.element_at("inv", i * k + i + 1) for i in range(k)])
    groups = F.col("n_clusters")
    factor = F.try_divide(groups, groups - 1) * F.try_divide(n - 1, F.when(dof > 0, dof))
    if k == 1:
        inverse = F.element_at("inv", 1)
        diagonal = F.array(inverse * inverse * F.element_at(meat, 1))
    else:
        diagonal = _sandwich_diagonal("inv", meat)
    return F.transform(diagonal, lambda v: v * factor)


def inference_columns(coefficient: Column, std_error: Column, dof: Column, method: str = "t") -> dict[str, Column]:
    """t, p and 95 % interval; NULL where the fit is exact."""
    exact = std_error <= F.lit(EXACT_FIT) * F.abs(coefficient)
    t = F.when(~exact, F.try_divide(coefficient, std_error))
    interval = "t" if method == "power" else method
    reach = critical_value(dof, interval) * std_error
    return {
        "coefficient": coefficient,
        "std_error": F.when(exact, F.lit(0.0)).otherwise(std_error),
        "t_stat": t,
        "p_value": p_value(t, dof, method),
        "ci_lower": coefficient - reach,
        "ci_upper": coefficient + reach,
    }


ESTIMATES = ("coefficient", "std_error", "t_stat", "p_value", "ci_lower", "ci_upper", "r_squared")


def explained(rows: DataFrame, min_rows: int) -> DataFrame:
    """Rows with a ``reason`` where there is no estimate, NULL where there is."""
    reason = F.when(F.col("n_obs") < min_rows, f"fewer than {min_rows} rows").when(~F.col("identified"), "not identified")
    marked = rows.withColumn("reason", reason)
    kept = {c: F.when(F.col("reason").isNull(), F.col(c)) for c in ESTIMATES if c in rows.columns}
    return marked.withColumns(kept | {"identified": F.col("reason").isNull()})


def finish(fit: DataFrame, terms: Sequence[str], keys: Sequence[str], meat: str | None, method: str, all_terms: bool):
    """Estimation rows: one per key and term, or the first term only."""
    k = len(terms)
    clusters = F.col("n_clusters") if meat else F.lit(None).cast("long")
    base = fit.select(
        *keys,
        F.col("b"),
        _variances(fit, k, meat).alias("_v"),
        F.col("n").cast("long").alias("n_obs"),
        clusters.cast("long").alias("n_clusters"),
        F.when(F.col("b").isNotNull(), 1 - F.try_divide("rss", "s_0_0")).alias("r_squared"),
        F.col("b").isNotNull().alias("identified"),
    )
    if all_terms:
        picks = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(i + 1).alias("_at")) for i, t in enumerate(terms)])
        base = base.select("*", F.inline(picks))
        at = F.col("_at")
    else:
        base = base.withColumn("term", F.lit(terms[0]))
        at = F.lit(1)
    coefficient = F.get("b", at - 1)
    error = F.sqrt(F.greatest(F.get("_v", at - 1), F.when(coefficient.isNotNull(), F.lit(0.0))))
    plain = base.select(
        *keys, "term", coefficient.alias("_c"), error.alias("_e"), "n_obs", "n_clusters", "r_squared", "identified"
    )
    dof = F.col("n_obs") - (k + 1)
    columns = inference_columns(F.col("_c"), F.col("_e"), dof, method)
    return plain.select(
        *keys,
        "term",
        *[c.alias(name) for name, c in columns.items()],
        "n_obs",
        "n_clusters",
        "r_squared",
        "identified",
    )


def run_ols(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    cluster: str | None = None,
    robust: bool = False,
    keys: Sequence[str] = (),
    method: str = "t",
    all_terms: bool = False,
    complete: bool = False,
    centred: bool = False,
    matrix: bool = False,
) -> DataFrame:
    """OLS with intercept on complete cases, for each value of ``keys``.

    Rows are scanned once: plain and clustered fits need only the moments by
    key (and cluster).  ``robust`` adds a second pass for the residuals.
    ``complete`` says that incomplete rows are gone already, ``centred`` that
    all means are near zero, as after demeaning: totals are then added up from
    the clusters, which would lose digits on values far from zero.

    The number of regressors decides nothing.  A caller that knows its design
    to be wide, as one of many dummies, may take the same moments by ``matrix``
    products, without ``keys``; a clustered fit then has a second pass.
    """
    variables, keys = [y, *xs], list(keys)
    used = [*variables, *keys] + ([cluster] if cluster else [])
    cases = df if complete else complete_cases(df, used)
    p = len(variables)
    if matrix:
        if keys:
            raise ValueError("matrix products have no keys")
        return _wide_ols(cases, variables, cluster, robust, method, all_terms)
    if cluster:
        table = group_moments(cases, variables, [*keys, cluster])
        totals = combine(table, p, keys) if centred else group_moments(cases, variables, keys)
        solution = solve(totals, p, keys)
        meat = score_meat(cluster_scores(table, solution, p, keys), p - 1, [cluster], keys)
    else:
        solution = solve(group_moments(cases, variables, keys), p, keys)
        meat = _row_meat(cases, variables, solution, keys) if robust else None
    if meat is None:
        return finish(solution, list(xs), keys, None, method, all_terms)
    fit = solution.drop("n_clusters")
    fit = fit.join(meat, keys, "left") if keys else fit.join(F.broadcast(meat))
    return finish(fit, list(xs), keys, "meat", method, all_terms)


def two_way_ols(
    df: DataFrame, y: str, xs: Sequence[str], clusters: tuple[str, str], method: str = "t"
) -> DataFrame:
    """First coefficient with two-way clustering: V_a + V_b - V_ab.

    Moments are taken once by (a, b); scores of those cells add up to the
    scores by a and by b.
    """
    return _two_way_fit(complete_cases(df, [y, *xs, *clusters]), y, xs, clusters, method)


def _two_way_fit(cases: DataFrame, y: str, xs: Sequence[str], clusters: tuple[str, str], method: str) -> DataFrame:
    a, b = clusters
    variables = [y, *xs]
    p, k = len(variables), len(xs)
    table = group_moments(cases, variables, [a, b])
    solution = solve(group_moments(cases, variables), p)
    scores = cluster_scores(table, solution, p)
    parts = solution.drop("n_clusters")
    variance = None
    for name, by, sign in (("a", [a], 1), ("b", [b], 1), ("ab", [a, b], -1)):
        meat = score_meat(scores, k, by).withColumnsRenamed({"meat": f"meat_{name}", "n_clusters": f"g_{name}"})
        parts = parts.join(F.broadcast(meat))
    for name, sign in (("a", 1), ("b", 1), ("ab", -1)):
        part = F.element_at(_variances_for(k, f"meat_{name}", f"g_{name}"), 1) * sign
        variance = part if variance is None else variance + part
    sums = parts.select(
        F.element_at("b", 1).alias("_c"),
        variance.alias("_v"),
        F.col("n").cast("long").alias("n_obs"),
        F.col("g_a").cast("long").alias("n_clusters_a"),
        F.col("g_b").cast("long").alias("n_clusters_b"),
        (1 - F.try_divide("rss", "s_0_0")).alias("r_squared"),
    )
    error = F.sqrt(F.greatest(F.col("_v"), F.lit(0.0)))
    columns = inference_columns(F.col("_c"), error, F.col("n_obs") - (k + 1), method)
    return sums.select(
        F.lit(xs[0]).alias("term"),
        *[c.alias(name) for name, c in columns.items()],
        "n_obs",
        "n_clusters_a",
        "n_clusters_b",
        "r_squared",
    )


def _variances_for(k: int, meat: str, groups: str) -> Column:
    g, n = F.col(groups), F.col("n")
    factor = F.try_divide(g, g - 1) * F.try_divide(n - 1, n - (k + 1))
    if k == 1:
        inverse = F.element_at("inv", 1)
        return F.array(inverse * inverse * F.element_at(meat, 1) * factor)
    return F.transform(_sandwich_diagonal("inv", meat), lambda v: v * factor)


def demean_by_fe(
    df: DataFrame, variables: Sequence[str], fe: Sequence[str], iterations: int = 1
) -> DataFrame:
    """Subtract group means for each effect in turn.

    One round is the default.  More rounds approach the two-way estimator on
    unbalanced panels; their lineage is cut by a checkpoint per round.
    """
    present = [v for v in dict.fromkeys(variables) if v in df.columns]
    out = df
    for sweep in range(iterations):
        for effect in fe:
            means = {f"_fe_mean_{i}": F.avg(v) for i, v in enumerate(present)}
            joined = attach_group_stats(out, [effect], means)
            out = joined.withColumns({v: F.col(v) - F.col(f"_fe_mean_{i}") for i, v in enumerate(present)})
            out = out.drop(*means)
        if sweep + 1 < iterations:
            out = cut_lineage(out)
    return out


def demean_converged(
    df: DataFrame, variables: Sequence[str], fe: Sequence[str], tolerance: float = 1e-9, max_rounds: int = 1000
) -> DataFrame:
    """Subtract all effects at once: the residual from dummies of every effect.

    Rows are added up to cells of the effects.  Each round takes, on the cells,
    the mean of one effect's group less the other effects, for each effect in
    turn, until no value of the last effect moves by more than ``tolerance``
    standard deviations of its variable.  Only tables of the effects' values are
    kept between rounds, in the shared folder; the rows are read for the cells
    and rewritten once at the end.  Rows without a value of an effect get NULL.
    """
    present = [v for v in dict.fromkeys(variables) if v in df.columns]
    size = range(len(present))
    sums = [F.sum(F.col(v).cast("double")).alias(f"_s{i}") for i, v in enumerate(present)]
    keyed = df.select(*[F.col(e).alias(f"_e{k}") for k, e in enumerate(fe)], *present).dropna(subset=[f"_e{k}" for k in range(len(fe))])
    cells = cut_lineage(keyed.groupBy(*[f"_e{k}" for k in range(len(fe))]).agg(F.count(F.lit(1)).alias("_n"), *sums))
    spread = df.agg(*[F.stddev_pop(v).alias(f"d{i}") for i, v in enumerate(present)]).first()
    scale = [spread[f"d{i}"] or 1.0 for i in size]
    values: dict[int, DataFrame] = {}
    for _ in range(max_rounds):
        before = values.get(len(fe) - 1)
        for k in range(len(fe)):
            left = cells
            for other, table in values.items():
                if other != k:
                    left = left.join(table, f"_e{other}")
            taken = {i: sum((F.col(f"_a{o}_{i}") for o in values if o != k), F.lit(0.0)) for i in size}
            means = [(F.sum(F.col(f"_s{i}") - F.col("_n") * taken[i]) / F.sum("_n")).alias(f"_a{k}_{i}") for i in size]
            values[k] = left.groupBy(f"_e{k}").agg(*means)
        last = len(fe) - 1
        values[last] = cut_lineage(values[last])
        if before is not None:
            old = before.withColumnsRenamed({f"_a{last}_{i}": f"_b{i}" for i in size})
            moved = values[last].join(old, f"_e{last}").agg(
                *[F.max(F.abs(F.col(f"_a{last}_{i}") - F.col(f"_b{i}"))).alias(f"m{i}") for i in size]
            )
            change = moved.first()
            if all((change[f"m{i}"] or 0.0) <= tolerance * scale[i] for i in size):
                break
    else:
        raise RuntimeError(f"effects did not settle in {max_rounds} rounds")
    out = df
    for k, effect in enumerate(fe):
        out = out.join(values[k], F.col(effect) == F.col(f"_e{k}"), "left").drop(f"_e{k}")
    rest = {v: F.col(v) - sum(F.col(f"_a{k}_{i}") for k in range(len(fe))) for i, v in enumerate(present)}
    return out.withColumns(rest).select(*df.columns)


def _resolve(name: str | Specification) -> tuple[str, Specification]:
    if isinstance(name, Specification):
        return "custom", name
    if name not in SPECIFICATIONS:
        raise ValueError(f"Unknown specification: {name}")
    return name, SPECIFICATIONS[name]


def within_sample(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    fe: Sequence[str],
    cluster: str | None,
    carry: Sequence[str] = (),
    iterations: int = 1,
    tolerance: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Complete cases of a specification, and the same rows demeaned; to the end
    if there is a ``tolerance``."""
    needed = list(dict.fromkeys([y, *xs, *fe, *([cluster] if cluster else []), *carry]))
    valid = complete_cases(df, [y, *xs, *fe, *([cluster] if cluster else [])]).select(*needed)
    # Effects and clusters may be regressors' own columns only by name; the
    # demeaned values replace the outcome and the regressors.
    doubles = valid.withColumns({v: F.col(v).cast("double") for v in dict.fromkeys([y, *xs])})
    if tolerance is not None and len(fe) > 1:
        return valid, demean_converged(doubles, [y, *xs], fe, tolerance)
    return valid, demean_by_fe(doubles, [y, *xs], fe, iterations) if fe else doubles


def run_fe_estimation(
    df: DataFrame,
    specification: str | Specification = "baseline",
    spec: PanelSpec = PANEL,
    sample: Column | None = None,
    method: str = "t",
    iterations: int = 1,
    tolerance: float | None = None,
    se: str | None = None,
    clusters: tuple[str, str] | None = None,
    replicates: int = 200,
    seed: int = 42,
) -> DataFrame:
    """One result row for a named or given specification.

    ``sample`` is a filter condition on the panel.  ``tolerance`` takes the
    effects out to convergence instead of in ``iterations`` sweeps.  ``se`` is
    the error type after demeaning: None for the specification's own (clustered
    or plain), ``robust``, ``two_way`` (by ``clusters``, else the specification's
    cluster and time) or ``bootstrap`` (signs drawn by cluster for its score,
    ``replicates`` times; p-values as of the clustered fit).
    """
    if se not in (None, "robust", "two_way", "bootstrap"):
        raise ValueError(f"Unknown error type: {se}")
    name, chosen = _resolve(specification)
    y, x = chosen.outcome or spec.outcome, chosen.treatment or spec.treatment
    xs = [x, *chosen.controls]
    rows = df if sample is None else df.filter(sample)
    cluster = chosen.cluster or spec.unit
    pair = clusters or (cluster, spec.time)
    carry = [c for c in (spec.unit, spec.time) if c in df.columns]
    by = {"two_way": pair, "bootstrap": (cluster,)}.get(se, ())
    rows = rows.dropna(subset=list(by)) if by else rows
    valid, estimation = within_sample(rows, y, xs, chosen.fe, chosen.cluster, [*carry, *by], iterations, tolerance)
    if se == "two_way":
        result = _two_way_fit(estimation, y, xs, pair, method)
    elif se == "bootstrap":
        result = _score_bootstrap(estimation, y, xs, cluster, replicates, seed, method)
    else:
        own = None if se else chosen.cluster
        result = run_ols(estimation, y, xs, cluster=own, robust=se == "robust", method=method, complete=True, centred=bool(chosen.fe))
    label_of = {"robust": "robust", "two_way": ",".join(pair), "bootstrap": f"bootstrap {cluster}"}
    for column, label in ((spec.unit, "n_units"), (spec.time, "n_periods")):
        if column == chosen.cluster and se is None:
            result = result.withColumn(label, F.col("n_clusters"))
        elif column in carry:
            result = result.join(F.broadcast(valid.agg(F.count_distinct(column).alias(label))))
        else:
            result = result.withColumn(label, F.lit(0).cast("long"))
    return result.select(
        F.lit(name).alias("specification"),
        "coefficient",
        "std_error",
        "t_stat",
        "p_value",
        "ci_lower",
        "ci_upper",
        "n_obs",
        "n_units",
        "n_periods",
        "r_squared",
        F.lit(",".join(chosen.controls)).alias("controls"),
        F.lit(",".join(chosen.fe)).alias("fe"),
        F.lit(label_of.get(se, chosen.cluster or "none")).alias("cluster"),
        (F.col("p_value") < 0.05).alias("significant_05"),
        (F.col("p_value") < 0.01).alias("significant_01"),
    )


def run_specifications(
    df: DataFrame, names: Sequence[str] | None = None, spec: PanelSpec = PANEL, **options
) -> tuple[DataFrame, dict[str, str]]:
    """Results of several specifications, and why any was skipped."""
    results, skipped = None, {}
    for name in names or list(SPECIFICATIONS):
        chosen = SPECIFICATIONS[name]
        needed = [spec.outcome, spec.treatment, *chosen.controls, *chosen.fe, *([chosen.cluster] if chosen.cluster else [])]
        missing = [c for c in needed if c not in df.columns]
        if missing:
            skipped[name] = f"missing columns: {missing}"
            continue
        row = run_fe_estimation(df, name, spec, **options)
        results = row if results is None else results.unionByName(row)
    return results, skipped


def coefficient_table(results: DataFrame) -> DataFrame:
    return results.select("specification", "coefficient", "std_error", "p_value", "n_obs")


def run_rd_estimation(
    df: DataFrame, running: str, cutoff: float, bandwidth: float, y: str, keys: Sequence[str] = (), method: str = "t"
) -> DataFrame:
    """Local linear jump at the cutoff with a slope on each side."""
    centred = F.col(running) - F.lit(cutoff)
    local = df.filter(F.abs(centred) <= bandwidth).withColumns(
        {"running_centered": centred, "treated": (centred >= 0).cast("int")}
    )
    local = local.withColumn("running_x_treat", F.col("running_centered") * F.col("treated"))
    return run_ols(local, y, ["treated", "running_centered", "running_x_treat"], keys=keys, method=method)


def event_study_regression(
    df: DataFrame,
    window: tuple[int, int] = EVENT_WINDOW,
    reference: int = REFERENCE_PERIOD,
    fe: Sequence[str] = ("unit_fe", "time_fe"),
    cluster: str | None = "id",
    spec: PanelSpec = PANEL,
    method: str = "t",
) -> DataFrame:
    """One row per event period with its coefficient and clustered error."""
    periods = [k for k in range(window[0], window[1] + 1) if k != reference]
    xs = [dummy_name(k) for k in periods]
    with_dummies = event_dummies(df, window, reference)
    _, estimation = within_sample(with_dummies, spec.outcome, xs, fe, cluster)
    rows = run_ols(
        estimation, spec.outcome, xs, cluster=cluster, method=method, all_terms=True, complete=True, matrix=True
    )
    number = F.regexp_replace(F.substring("term", len("event_k") + 1, 10), "m", "-").cast("int")
    return rows.withColumn("event_time", number).drop("term")


def pretrend_f_test(
    df: DataFrame, leads: int = 12, fe: Sequence[str] = ("unit_fe", "time_fe"), spec: PanelSpec = PANEL
) -> DataFrame:
    """Joint F test that the coefficients of all leads are zero."""
    window = (-leads, -1)
    xs = [dummy_name(k) for k in range(window[0], 0)]
    with_dummies = event_dummies(df, window, reference=None)
    _, estimation = within_sample(with_dummies, spec.outcome, xs, fe, None)
    p = len(xs) + 1
    fit = _wide_solution(estimation, [spec.outcome, *xs])
    dof = F.col("n") - p
    f_stat = F.try_divide((F.col("s_0_0") - F.col("rss")) / leads, F.try_divide(F.col("rss"), dof))
    return fit.select(
        f_stat.alias("f_stat"),
        F.lit(leads).cast("long").alias("df1"),
        dof.cast("long").alias("df2"),
        f_p_value(f_stat, F.lit(leads), dof).alias("p_value"),
        F.col("s_0_0").alias("rss_restricted"),
        F.col("rss").alias("rss_unrestricted"),
        F.col("n").cast("long").alias("n_obs"),
    )


def balance_table(df: DataFrame, covariates: Sequence[str], group: str = "ever_treated") -> DataFrame:
    """Treated against control: means, deviations, standardised difference."""
    aggs = []
    for i, c in enumerate(covariates):
        for g, value in (("c", 0), ("t", 1)):
            inside = F.when(F.col(group) == value, F.col(c))
            aggs += [
                F.avg(inside).alias(f"m{g}{i}"),
                F.stddev_samp(inside).alias(f"d{g}{i}"),
                F.count(inside).alias(f"n{g}{i}"),
            ]
    wide = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("covariate"),
                F.col(f"mt{i}").alias("mean_treated"),
                F.col(f"mc{i}").alias("mean_control"),
                F.col(f"dt{i}").alias("sd_treated"),
                F.col(f"dc{i}").alias("sd_control"),
                F.col(f"nt{i}").alias("n_treated"),
                F.col(f"nc{i}").alias("n_control"),
            )
            for i, c in enumerate(covariates)
        ]
    )
    long = wide.select(F.inline(rows))
    gap = F.col("mean_treated") - F.col("mean_control")
    var_t, var_c = F.pow("sd_treated", F.lit(2)), F.pow("sd_control", F.lit(2))
    error = F.sqrt(F.try_divide(var_t, F.col("n_treated")) + F.try_divide(var_c, F.col("n_control")))
    t = F.try_divide(gap, error)
    return long.withColumns(
        {
            "difference": gap,
            "std_difference": F.try_divide(gap, F.sqrt((var_t + var_c) / 2)),
            "t_stat": t,
            "p_value": p_value(t, F.col("n_treated") + F.col("n_control") - 2),
        }
    )


#: Cumulative Poisson(1) probabilities, until the rest is below the 2^-32 that
#: :func:`hash_uniform` can tell apart.
POISSON_1 = tuple(round(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)), 12) for n in range(12))


def hash_uniform(*parts: Column) -> Column:
    """Number in [0, 1) from the md5 text of its parts."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_weight(u: Column) -> Column:
    weight = F.lit(0)
    for bound in POISSON_1:
        weight = weight + (u >= bound).cast("int")
    return weight


def bootstrap_se(
    df: DataFrame, y: str, xs: Sequence[str], cluster: str, replicates: int = 200, seed: int = 42
) -> DataFrame:
    """Bootstrap standard error of the first coefficient.

    Clusters are drawn with Poisson(1) weights from a hash, so a replicate is
    the same whichever task computes it.  Rows are aggregated to one moment
    row per cluster before they are multiplied by the replicates.
    """
    variables = [y, *xs]
    p = len(variables)
    table = group_moments(complete_cases(df, [*variables, cluster]), variables, [cluster])
    drawn = table.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = hash_uniform(F.col(cluster), F.col("replicate"), F.lit(seed))
    weighted = drawn.withColumn("_w", poisson_weight(u)).filter(F.col("_w") > 0)
    fits = solve(combine(weighted, p, ["replicate"], F.col("_w")), p, ["replicate"])
    point = solve(combine(table, p), p).select(
        F.element_at("b", 1).alias("coefficient"), F.col("n").cast("long").alias("n_obs")
    )
    first = F.element_at("b", 1)
    spread = fits.agg(F.stddev_samp(first).alias("std_error"), F.count(first).alias("n_replicates"))
    return point.join(F.broadcast(spread)).select(
        F.lit(xs[0]).alias("term"), "coefficient", "std_error", "n_replicates", "n_obs"
    )


def _score_bootstrap(
    cases: DataFrame, y: str, xs: Sequence[str], cluster: str, replicates: int, seed: int, method: str
) -> DataFrame:
    """Bootstrap error of the first coefficient from the clusters' scores.

    A replicate gives each cluster a sign from a hash and adds up what the
    clusters contribute to the coefficient; nothing is fitted again.
    """
    variables = [y, *xs]
    p, k = len(variables), len(xs)
    table = group_moments(cases, variables, [cluster])
    solution = solve(combine(table, p), p)
    scores = cluster_scores(table, solution, p).join(F.broadcast(solution.select(F.col("inv").alias("_inv"))))
    share = sum((F.element_at("_inv", j) * F.col(f"score_{j}") for j in range(1, k + 1)), F.lit(0.0))
    drawn = scores.select(F.col(cluster).alias("_c"), share.alias("_share"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r"))
    sign = F.when(hash_uniform(F.col("_c"), F.col("_r"), F.lit(seed)) < 0.5, -1.0).otherwise(1.0)
    sums = drawn.groupBy("_r").agg(F.sum(sign * F.col("_share")).alias("_d"))
    error = sums.agg(F.stddev_samp("_d").alias("_e"))
    clusters = table.agg(F.count(F.lit(1)).alias("n_clusters"))
    fit = solution.drop("n_clusters").join(F.broadcast(error)).join(F.broadcast(clusters))
    n = F.col("n").cast("long")
    columns = inference_columns(F.element_at("b", 1), F.col("_e"), n - (k + 1), method)
    return fit.select(
        F.lit(xs[0]).alias("term"),
        *[c.alias(name) for name, c in columns.items()],
        n.alias("n_obs"),
        "n_clusters",
        F.when(F.col("b").isNotNull(), 1 - F.try_divide("rss", "s_0_0")).alias("r_squared"),
        F.col("b").isNotNull().alias("identified"),
    )


def leave_one_cluster_out(df: DataFrame, y: str, x: str, cluster: str) -> DataFrame:
    """The slope without each cluster, from totals minus that cluster's moments."""
    cases = complete_cases(df, [y, x, cluster])
    table, whole = group_moments(cases, [y, x], [cluster]), group_moments(cases, [y, x])
    prefixed = whole.select(*[F.col(c).alias(f"all_{c}") for c in whole.columns])
    rest = table.join(F.broadcast(prefixed)).select(
        cluster, *[c.alias(name) for name, c in remove(2).items()]
    )
    fit = solve(rest, 2, [cluster])
    return finish(fit, [x], [cluster], None, "t", False).drop("term", "n_clusters")


def grouped_ols(df: DataFrame, y: str, x: str, group: str, min_rows: int = 10, method: str = "t") -> DataFrame:
    """One-regressor OLS for every value of a grouping column.

    A group without an estimate keeps its row, with NULL estimates and the
    ``reason``: fewer than ``min_rows`` complete rows, or a constant regressor.
    """
    rows = run_ols(df, y, [x], keys=[group], method=method)
    return explained(rows, min_rows).drop("term", "n_clusters")
