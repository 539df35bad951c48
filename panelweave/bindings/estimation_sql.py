"""SQL text generators for the estimation counterparts.

Regressions with several regressors are solved by sweeping the co-moment
matrix in long form, one common table expression per pivot.  That is a
different route from the library's, which is the point of a counterpart.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.inference import ERF_COEFFICIENTS, ERF_P, T_EXPANSION, Z_975


def p_sql(t: str, dof: str) -> str:
    """Two-sided p-value of t."""
    z = f"(abs({t}) * (1 - 1.0 / (4.0 * {dof})) / sqrt(1 + ({t}) * ({t}) / (2.0 * {dof})))"
    x = f"({z} / sqrt(2.0))"
    u = f"(1.0 / (1.0 + {ERF_P} * {x}))"
    poly = "0.0"
    for c in reversed(ERF_COEFFICIENTS):
        poly = f"(({poly} + ({c})) * {u})"
    return f"({poly} * exp(-{x} * {x}))"


def critical_sql(dof: str) -> str:
    small = " + ".join([f"{Z_975}", *[f"{c} / pow({dof}, {i})" for i, c in enumerate(T_EXPANSION, 1)]])
    return f"({small})"


def demean_sql(source: str, target: str, variables: Sequence[str], effects: Sequence[str], carry: Sequence[str]) -> str:
    """CTEs that subtract group means for each effect in turn."""
    steps, at = [], source
    for i, effect in enumerate(effects):
        name = target if i + 1 == len(effects) else f"{target}_{i}"
        columns = ", ".join(f"{v} - avg({v}) over (partition by {effect}) as {v}" for v in variables)
        steps.append(f"{name} as (select {', '.join(carry)}, {columns} from {at})")
        at = name
    return ",\n".join(steps)


def simple_cluster_sql(source: str, cluster: str, x: str = "treatment", y: str = "outcome") -> str:
    """CTE ``est``: slope, clustered error and fit of one regressor."""
    return f"""
mo as (select avg({x}) mx, avg({y}) my, regr_sxx({y}, {x}) sxx, regr_sxy({y}, {x}) sxy, regr_syy({y}, {x}) syy, count(*) n from {source}),
sc as (select {cluster} cl, sum(({x} - mx) * (({y} - my) - sxy / sxx * ({x} - mx))) s from {source}, mo group by 1),
est as (select any_value(sxy / sxx) b, any_value(n) n, count(*) g,
               sqrt(count(*) / (count(*) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 2.0) * sum(s * s)) / any_value(sxx) se,
               any_value(sxy * sxy / sxx / syy) r2 from sc, mo)"""


def sweep_sql(source: str, row: str, y: str, xs: Sequence[str], cluster: str | None = None) -> str:
    """CTEs ending in ``est(j, b, v, n, g, tss, rss)`` for regressors 1..k.

    ``row`` is an expression that identifies a row of ``source``.
    """
    k = len(xs)
    cl = cluster or row
    parts = [
        f"de as (select row_number() over (order by {row}) rid, {cl} cl, {y} y0, {', '.join(f'{x} x{i + 1}' for i, x in enumerate(xs))} from {source})",
        f"lo as (select rid, cl, unnest({list(range(k + 1))}) j, unnest([cast(y0 as double), {', '.join(f'cast(x{i + 1} as double)' for i in range(k))}]) v from de)",
        "mu as (select j, avg(v) m from lo group by j)",
        "ce as (select rid, cl, lo.j, v - m v from lo join mu on lo.j = mu.j)",
        "s0 as materialized (select a.j i, b.j j, sum(a.v * b.v) v from ce a join ce b on a.rid = b.rid group by 1, 2)",
    ]
    for p in range(1, k + 1):
        prev = f"s{p - 1}"
        parts.append(
            f"s{p} as materialized (select s.i, s.j, case when s.i = {p} and s.j = {p} then -1.0 / d.v"
            f" when s.i = {p} then w.v / d.v when s.j = {p} then c.v / d.v else s.v - c.v * w.v / d.v end v"
            f" from {prev} s join (select i, v from {prev} where j = {p}) c on s.i = c.i"
            f" join (select j, v from {prev} where i = {p}) w on s.j = w.j, (select v from {prev} where i = {p} and j = {p}) d)"
        )
    parts += [
        f"be as (select i j, v b from s{k} where j = 0 and i > 0)",
        f"iv as (select i, j, -v v from s{k} where i > 0 and j > 0)",
        f"fit as (select (select v from s0 where i = 0 and j = 0) tss, (select v from s{k} where i = 0 and j = 0) rss, (select count(*) from de) n)",
    ]
    if cluster:
        parts += [
            "re as (select rid, cl, sum(case when ce.j = 0 then v else -v * b end) u from ce left join be on ce.j = be.j group by 1, 2)",
            "sc as (select ce.cl, ce.j, sum(ce.v * re.u) s from ce join re on ce.rid = re.rid where ce.j > 0 group by 1, 2)",
            "me as (select a.j i, b.j j, sum(a.s * b.s) m from sc a join sc b on a.cl = b.cl group by 1, 2)",
            "gr as (select count(distinct cl) g from de)",
            f"va as (select x.i j, sum(x.v * me.m * z.v) * any_value(g / (g - 1.0) * (n - 1.0) / (n - {k + 1}.0)) v"
            " from iv x join me on x.j = me.i join iv z on me.j = z.i and z.j = x.i, gr, fit group by x.i)",
            "est as (select be.j, b, v, n, g, tss, rss from be join va on be.j = va.j, fit, gr)",
        ]
    else:
        parts.append(
            f"est as (select be.j, b, rss / (n - {k + 1}) * iv.v v, n, null g, tss, rss from be join iv on iv.i = be.j and iv.j = be.j, fit)"
        )
    return ",\n".join(parts)
