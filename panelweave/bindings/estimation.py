"""Estimation and robustness queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.formats import format_ci, format_coefficient, format_pvalue
from ..operators import regression as reg
from ..operators import robustness as rob
from ..plans.specs import Specification
from .estimation_sql import critical_sql, demean_sql, p_sql, simple_cluster_sql, sweep_sql
from .panel_tables import PANEL_SQL, PRE_PERIOD_END, TREATED_SQL, panel, treated_panel
from .registry import query, r, rounded, table

TWO_WAY = ("id", "period")
#: The named specifications with the raw keys as effects: demeaning by a key
#: and by its dense code is the same, and the raw key needs no code table.
BY_KEYS = {
    "baseline": Specification(fe=TWO_WAY, cluster="id"),
    "no_fe": Specification(),
    "with_controls": Specification(controls=("covariate_1", "covariate_2", "covariate_3"), fe=TWO_WAY, cluster="id"),
    "unit_fe_only": Specification(fe=("id",), cluster="id"),
}
CORE = ["coefficient", "std_error", "r_squared", "n_obs", "n_units", "n_periods"]


def _core(spark, sf, name):
    return rounded(reg.run_fe_estimation(panel(spark, sf), BY_KEYS[name]).select(*CORE))


def _core_sql(body: str, b: str = "b", se: str = "se", r2: str = "r2", where: str = "") -> str:
    return (
        f"with {body} select {r(b, 'coefficient')}, {r(se, 'std_error')}, {r(r2, 'r_squared')}, n n_obs,"
        f" (select count(distinct id) from panel) n_units, (select count(distinct period) from panel) n_periods from est {where}"
    )


def _unrounded(sql: str) -> str:
    return re.sub(r"round\((cast\(.*? as double\)) \+ 0\.0000000001, 6\) as", r"\1 as", sql)


_FE = {
    "baseline": _core_sql(
        PANEL_SQL + ",\n" + demean_sql("panel", "dm", ["outcome", "treatment"], TWO_WAY, ["id", "period"])
        + "," + simple_cluster_sql("dm", "id")
    ),
    "unit_fe_only": _core_sql(
        PANEL_SQL + ",\n" + demean_sql("panel", "dm", ["outcome", "treatment"], ["id"], ["id", "period"])
        + "," + simple_cluster_sql("dm", "id")
    ),
    "no_fe": _core_sql(
        PANEL_SQL + """,
mo as (select regr_sxx(outcome, treatment) sxx, regr_sxy(outcome, treatment) sxy, regr_syy(outcome, treatment) syy, count(*) n from panel),
est as (select sxy / sxx b, n, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) se, sxy * sxy / sxx / syy r2 from mo)"""
    ),
    "with_controls": _core_sql(
        PANEL_SQL + ",\n"
        + demean_sql(
            "panel", "dm", ["outcome", "treatment", "covariate_1", "covariate_2", "covariate_3"], TWO_WAY, ["id", "period"]
        )
        + ",\n"
        + sweep_sql("dm", "id * 1000 + period", "outcome", ["treatment", "covariate_1", "covariate_2", "covariate_3"], "id"),
        se="sqrt(v)",
        r2="1 - rss / tss",
        where="where j = 1",
    ),
}


@query("fe_baseline", _FE["baseline"])
def fe_baseline(spark, sf):
    """Flagship: lineitem to panel to two-way fixed effects with clustered errors."""
    return _core(spark, sf, "baseline")


_DM = PANEL_SQL + ",\n" + demean_sql("panel", "dm", ["outcome", "treatment"], TWO_WAY, ["id", "period"])
_DM_SCORES = f"""with {_DM},
mo as (select avg(treatment) mx, avg(outcome) my, regr_sxx(outcome, treatment) sxx, regr_sxy(outcome, treatment) sxy, count(*) n from dm),
ro as (select id, period, (treatment - mx) * ((outcome - my) - sxy / sxx * (treatment - mx)) s from dm, mo)"""
SE_COLUMNS = ["coefficient", "std_error", "n_obs"]


@query(
    "fe_robust",
    f"{_DM_SCORES} select {r('any_value(sxy / sxx)', 'coefficient')}, {r('sqrt(any_value(n) / (any_value(n) - 2.0) * sum(s * s)) / any_value(sxx)', 'std_error')}, any_value(n) n_obs from ro, mo",
)
def fe_robust(spark, sf):
    return rounded(reg.run_fe_estimation(panel(spark, sf), BY_KEYS["baseline"], se="robust").select(*SE_COLUMNS))


@query(
    "fe_two_way",
    f"""{_DM_SCORES},
a as (select count(*) / (count(*) - 1.0) * sum(s * s) v from (select id, sum(s) s from ro group by 1)),
b as (select count(*) / (count(*) - 1.0) * sum(s * s) v from (select period, sum(s) s from ro group by 1)),
ab as (select count(*) / (count(*) - 1.0) * sum(s * s) v from ro)
select {r('sxy / sxx', 'coefficient')}, {r('sqrt((a.v + b.v - ab.v) * (n - 1.0) / (n - 2.0)) / sxx', 'std_error')}, n n_obs from mo, a, b, ab""",
)
def fe_two_way(spark, sf):
    return rounded(reg.run_fe_estimation(panel(spark, sf), BY_KEYS["baseline"], se="two_way").select(*SE_COLUMNS))


@query(
    "fe_bootstrap",
    f"""{_DM_SCORES},
dr as (select rep, s * case when cast(cast('0x' || substr(md5(id || '-' || rep || '-42'), 1, 8) as bigint) as double) / 4294967296.0 < 0.5 then -1 else 1 end w
       from (select id, sum(s) s from ro group by id), (select unnest(range(1, 201)) rep)),
re as (select rep, sum(w) d from dr group by rep)
select {r('any_value(sxy / sxx)', 'coefficient')}, {r('stddev_samp(d) / any_value(sxx)', 'std_error')}, any_value(n) n_obs from re, mo""",
)
def fe_bootstrap(spark, sf):
    return rounded(reg.run_fe_estimation(panel(spark, sf), BY_KEYS["baseline"], se="bootstrap").select(*SE_COLUMNS))


@query(
    "fe_two_way_converged",
    _core_sql(
        f"""recursive {PANEL_SQL.lstrip()},
pe as (select 0 k, period, cast(0.0 as double) gy, cast(0.0 as double) gx from panel group by period
 union all
 select k + 1, period, avg(outcome - ay), avg(treatment - ax) from (
   select panel.*, k, avg(outcome - gy) over (partition by id) ay, avg(treatment - gx) over (partition by id) ax
   from panel join pe on panel.period = pe.period where k < 60) group by k, period),
la as (select * from pe where k = 60),
dm as (select panel.id, panel.period, outcome - gy - avg(outcome - gy) over (partition by panel.id) outcome,
       treatment - gx - avg(treatment - gx) over (partition by panel.id) treatment from panel join la on panel.period = la.period),"""
        + simple_cluster_sql("dm", "id")
    ),
)
def fe_two_way_converged(spark, sf):
    """Both effects taken out to the end, as dummies of both would."""
    return rounded(reg.run_fe_estimation(panel(spark, sf), BY_KEYS["baseline"], tolerance=1e-9).select(*CORE))


@query("unit_fe_only", _FE["unit_fe_only"])
def unit_fe_only(spark, sf):
    return _core(spark, sf, "unit_fe_only")


@query("ols_no_fe", _FE["no_fe"])
def ols_no_fe(spark, sf):
    return _core(spark, sf, "no_fe")


@query("fe_with_controls", _FE["with_controls"])
def fe_with_controls(spark, sf):
    return _core(spark, sf, "with_controls")


def _results(spark, sf):
    rows = None
    for name, spec in BY_KEYS.items():
        one = reg.run_fe_estimation(panel(spark, sf), spec).withColumn("specification", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _as_subquery(name: str) -> str:
    """The specification's SQL with inference columns, as a derived table."""
    k = 1 + len(BY_KEYS[name].controls)
    t, dof = "(coefficient / std_error)", f"(n_obs - {k + 1})"
    raw = _unrounded(_FE[name])
    return (
        f"select '{name}' specification, {r('coefficient')}, {r('std_error')}, {r(t, 't_stat')}, {r(p_sql(t, dof), 'p_value')},"
        f" {r(f'coefficient - {critical_sql(dof)} * std_error', 'ci_lower')},"
        f" {r(f'coefficient + {critical_sql(dof)} * std_error', 'ci_upper')}, n_obs from ({raw})"
    )


@query("all_specs", " union all ".join(_as_subquery(n) for n in BY_KEYS))
def all_specs(spark, sf):
    keep = ["specification", "coefficient", "std_error", "t_stat", "p_value", "ci_lower", "ci_upper", "n_obs"]
    return rounded(_results(spark, sf).select(*keep))


_INTERVALS = " union all ".join(
    f"select '{n}' specification, {r('coefficient')}, {r('coefficient - 1.96 * std_error', 'lower')},"
    f" {r('coefficient + 1.96 * std_error', 'upper')} from ({_unrounded(_FE[n])})"
    for n in BY_KEYS
)


@query("coef_intervals", _INTERVALS)
def coef_intervals(spark, sf):
    from ..operators.tables import coefficient_intervals

    return rounded(coefficient_intervals(_results(spark, sf)))


_CLUSTER_TREAT = simple_cluster_sql("dm", "id", "treat_x_post")


@query(
    "did_interaction",
    f"with {TREATED_SQL},\nwx as (select *, ever_treated * post_treatment treat_x_post from tpanel),\n"
    + demean_sql("wx", "dm", ["outcome", "treat_x_post"], TWO_WAY, ["id", "period"])
    + f",{_CLUSTER_TREAT} select {r('b', 'coefficient')}, {r('se', 'std_error')}, {r('r2', 'r_squared')}, n n_obs from est",
)
def did_interaction(spark, sf):
    data = treated_panel(spark, sf).withColumn("treat_x_post", F.col("ever_treated") * F.col("post_treatment"))
    spec = Specification(fe=TWO_WAY, cluster="id", treatment="treat_x_post")
    return rounded(reg.run_fe_estimation(data, spec).select("coefficient", "std_error", "r_squared", "n_obs"))


@query(
    "robust_se",
    f"""with {PANEL_SQL},
mo as (select avg(treatment) mx, avg(outcome) my, regr_sxx(outcome, treatment) sxx, regr_sxy(outcome, treatment) sxy, count(*) n from panel),
est as (select any_value(sxy / sxx) b, any_value(n) n, any_value(sxx) sxx,
        sum(power((treatment - mx) * ((outcome - my) - sxy / sxx * (treatment - mx)), 2)) m from panel, mo)
select {r('b', 'coefficient')}, {r('sqrt(n / (n - 2.0) * m) / sxx', 'std_error')}, n n_obs from est""",
)
def robust_se(spark, sf):
    rows = reg.run_ols(panel(spark, sf), "outcome", ["treatment"], robust=True)
    return rounded(rows.select("coefficient", "std_error", "n_obs"))


_RD_SQL = f"""with base as (select o_orderkey, o_totalprice y, cast(date_diff('day', date '1998-01-01', cast(o_orderdate as date)) as int) x1 from orders),
rd as (select *, case when x1 >= 0 then 1 else 0 end tr from base where abs(x1) <= 365),
{sweep_sql("rd", "o_orderkey", "y / 1000", ["tr", "x1", "x1 * tr"])}
select {r('b', 'coefficient')}, {r('sqrt(v)', 'std_error')}, {r('1 - rss / tss', 'r_squared')}, n n_obs from est where j = 1"""


@query("rd_local_linear", _RD_SQL)
def rd_local_linear(spark, sf):
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date"))
    data = table(spark, sf, "orders").select(day.alias("running"), (F.col("o_totalprice") / 1000).alias("y"))
    rows = reg.run_rd_estimation(data, "running", 0, 365, "y")
    return rounded(rows.select("coefficient", "std_error", "r_squared", "n_obs"))


def _dummies_sql(periods: list[int]) -> str:
    columns = ", ".join(f"case when event_time = {k} then 1.0 else 0.0 end d{i + 1}" for i, k in enumerate(periods))
    names = [f"d{i + 1}" for i in range(len(periods))]
    return (
        f"{TREATED_SQL},\ndu as (select id, period, outcome, {columns} from tpanel),\n"
        + demean_sql("du", "dm", ["outcome", *names], TWO_WAY, ["id", "period"])
    )


_ES_PERIODS = [k for k in range(-12, 13) if k != -1]
_ES_NUMBER = " ".join(f"when {i + 1} then {k}" for i, k in enumerate(_ES_PERIODS))


@query(
    "event_study_regression",
    f"with {_dummies_sql(_ES_PERIODS)},\n"
    + sweep_sql("dm", "id * 1000 + period", "outcome", [f"d{i + 1}" for i in range(len(_ES_PERIODS))], "id")
    + f" select case j {_ES_NUMBER} end event_time, {r('b', 'coefficient')}, {r('sqrt(v)', 'std_error')}, n n_obs from est",
)
def event_study_regression(spark, sf):
    rows = reg.event_study_regression(treated_panel(spark, sf), fe=TWO_WAY, cluster="id")
    return rounded(rows.select("event_time", "coefficient", "std_error", "n_obs"))


_LEADS = list(range(-12, 0))


@query(
    "pretrend_f",
    f"with {_dummies_sql(_LEADS)},\n"
    + sweep_sql("dm", "id * 1000 + period", "outcome", [f"d{i + 1}" for i in range(12)])
    + f" select {r('((tss - rss) / 12) / (rss / (n - 13))', 'f_stat')}, cast(12 as bigint) df1, n - 13 df2,"
    f" {r('tss', 'rss_restricted', 4)}, {r('rss', 'rss_unrestricted', 4)} from fit",
)
def pretrend_f(spark, sf):
    row = reg.pretrend_f_test(treated_panel(spark, sf), 12, TWO_WAY)
    return row.select(
        F.round("f_stat", 6).alias("f_stat"),
        "df1",
        "df2",
        F.round("rss_restricted", 4).alias("rss_restricted"),
        F.round("rss_unrestricted", 4).alias("rss_unrestricted"),
    )


_BALANCE = ["outcome", "covariate_1", "covariate_2", "covariate_3"]


@query(
    "balance_table",
    f"with {TREATED_SQL}, st as ("
    + " union all ".join(
        f"select '{c}' covariate, avg(case when ever_treated = 1 then {c} end) mt, avg(case when ever_treated = 0 then {c} end) mc,"
        f" stddev_samp(case when ever_treated = 1 then {c} end) st, stddev_samp(case when ever_treated = 0 then {c} end) sc,"
        f" count(case when ever_treated = 1 then {c} end) nt, count(case when ever_treated = 0 then {c} end) nc from tpanel"
        for c in _BALANCE
    )
    + f") select covariate, {r('mt', 'mean_treated')}, {r('mc', 'mean_control')}, {r('st', 'sd_treated')}, {r('sc', 'sd_control')},"
    f" nt n_treated, nc n_control, {r('mt - mc', 'difference')}, {r('(mt - mc) / sqrt((st * st + sc * sc) / 2)', 'std_difference')},"
    f" {r('(mt - mc) / sqrt(st * st / nt + sc * sc / nc)', 't_stat')},"
    f" {r(p_sql('((mt - mc) / sqrt(st * st / nt + sc * sc / nc))', '(nt + nc - 2)'), 'p_value')} from st",
)
def balance_table(spark, sf):
    return rounded(reg.balance_table(treated_panel(spark, sf), _BALANCE))


_POISSON = " + ".join(f"cast(u >= {b} as int)" for b in reg.POISSON_1)


@query(
    "bootstrap_se",
    f"""with {PANEL_SQL},
cl as (select id, count(*) n, sum(treatment) sx, sum(outcome) sy, sum(treatment * treatment) sxx, sum(treatment * outcome) sxy from panel group by id),
dr as (select cl.*, rep, cast(cast('0x' || substr(md5(id || '-' || rep || '-42'), 1, 8) as bigint) as double) / 4294967296.0 u
       from cl, (select unnest(range(1, 201)) rep)),
we as (select *, {_POISSON} w from dr),
mm as (select rep, sum(w * n) n, sum(w * sxy) - sum(w * sx) * sum(w * sy) / sum(w * n) cxy, sum(w * sxx) - sum(w * sx) * sum(w * sx) / sum(w * n) cxx from we where w > 0 group by rep),
fi as (select rep, case when cxx > 1e-9 then cxy / cxx end b from mm),
pt as (select regr_slope(outcome, treatment) b, count(*) n from panel)
select {r('any_value(pt.b)', 'coefficient')}, {r('stddev_samp(fi.b)', 'std_error')}, count(fi.b) n_replicates, any_value(pt.n) n_obs from fi, pt""",
)
def bootstrap_se(spark, sf):
    rows = reg.bootstrap_se(panel(spark, sf), "outcome", ["treatment"], "id", 200, 42)
    return rounded(rows.drop("term"))


@query(
    "grouped_ols",
    f"""with base as (select n_nationkey nation, l_extendedprice / 1000 y, l_quantity x
      from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
g as (select nation, count(*) n, regr_slope(y, x) b, regr_sxx(y, x) sxx, regr_sxy(y, x) sxy, regr_syy(y, x) syy from base group by 1)
select nation, {r('case when n >= 10 then b end', 'coefficient')}, {r('case when n >= 10 then sqrt((syy - b * sxy) / (n - 2) / sxx) end', 'std_error')}, n n_obs, {r('case when n >= 10 then b * sxy / syy end', 'r_squared')} from g""",
)
def grouped_ols(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey")
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity")
    data = (
        lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_nationkey").alias("nation"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"))
    )
    rows = reg.grouped_ols(data, "y", "x", "nation")
    return rounded(rows.select("nation", "coefficient", "std_error", "n_obs", "r_squared"))


@query(
    "grouped_ols_small",
    f"""with base as (select o_custkey customer, o_totalprice y, cast(date_part('month', o_orderdate) as double) x from orders),
g as (select customer, count(*) n, regr_slope(y, x) b, regr_sxx(y, x) sxx, regr_sxy(y, x) sxy, regr_syy(y, x) syy from base group by 1),
e as (select *, n >= 10 and sxx > n * 1e-24 ok from g)
select customer, {r('case when ok then b end', 'coefficient')}, {r('case when ok then sqrt((syy - b * sxy) / (n - 2) / sxx) end', 'std_error')}, n n_obs,
 case when n < 10 then 'fewer than 10 rows' when not ok then 'not identified' end reason from e""",
)
def grouped_ols_small(spark, sf):
    """Many customers have too few orders; their rows say so."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("y"), F.month("o_orderdate").cast("double").alias("x")
    )
    rows = reg.grouped_ols(orders, "y", "x", "customer")
    return rounded(rows.select("customer", "coefficient", "std_error", "n_obs", "reason"))


_CONTROLS = {
    "x0": "l_quantity",
    "x1": "l_extendedprice / 1000 + 1e6",
    "x2": "l_discount",
    "x3": "l_tax + 1e6",
    "x4": "cast(l_linenumber as double)",
    "x5": "cast(l_partkey % 97 as double) + 1e6",
    "x6": "cast(l_suppkey % 31 as double)",
    "x7": "cast(l_orderkey % 13 as double) + 1e6",
}
_WIDE_OUTCOME = (
    "2 * l_quantity - 30 * l_discount + l_extendedprice / 2000 + (l_partkey % 7) + 3 * l_linenumber"
    " - 0.25 * (l_orderkey % 13) + 10 * l_tax + 0.1 * (l_suppkey % 31) + 0.2 * (l_partkey % 97) + 1e6"
)
_WIDE_BASE = (
    f"base as (select l_orderkey * 10 + l_linenumber rid, cast({_WIDE_OUTCOME} as double) y, "
    + ", ".join(f"{sql} {name}" for name, sql in _CONTROLS.items())
    + ", l_returnflag flag from lineitem)"
)


def _wide_base(spark, sf):
    rows = table(spark, sf, "lineitem")
    y = F.expr(f"cast({_WIDE_OUTCOME} as double)").alias("y")
    return rows.select(y, *[F.expr(sql).alias(name) for name, sql in _CONTROLS.items()], F.col("l_returnflag").alias("flag"))


@query(
    "ols_many_controls",
    f"with {_WIDE_BASE},\n" + sweep_sql("base", "rid", "y", list(_CONTROLS))
    + f" select 'x' || (j - 1) term, {r('b', 'coefficient', 3)}, {r('sqrt(v)', 'std_error', 3)}, n n_obs from est",
)
def ols_many_controls(spark, sf):
    """Eight regressors, half of them far from zero."""
    fit = reg.run_ols(_wide_base(spark, sf), "y", list(_CONTROLS), all_terms=True)
    return rounded(fit.select("term", "coefficient", "std_error", "n_obs"), 3)


@query(
    "ols_many_controls_by_flag",
    " union all ".join(
        f"(with {_WIDE_BASE}, part as (select * from base where flag = '{flag}'),\n"
        + sweep_sql("part", "rid", "y", list(_CONTROLS))
        + f" select '{flag}' flag, 'x' || (j - 1) term, {r('b', 'coefficient', 3)}, n n_obs from est)"
        for flag in ("A", "N", "R")
    ),
)
def ols_many_controls_by_flag(spark, sf):
    fit = reg.run_ols(_wide_base(spark, sf), "y", list(_CONTROLS), keys=["flag"], all_terms=True)
    return rounded(fit.select("flag", "term", "coefficient", "n_obs"), 3)


def _r1(kind: str) -> str:
    """CTE ``g``: simple OLS by test from ``t(test_name, y, x)``."""
    return (
        "g as (select test_name, count(*) n, regr_slope(y, x) b, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x))"
        " / (count(*) - 2) / regr_sxx(y, x)) se from t where x is not null and y is not null group by 1)"
    )


def _r1_select(kind: str, name: str = "test_name") -> str:
    p = p_sql("(b / se)", "(n - 2)")
    return (
        f"select {name} test_name, '{kind}' test_type, {r('b', 'coefficient')}, {r('se', 'std_error')},"
        f" {r(p, 'p_value')}, n n_obs, {p} < 0.05 significant from g"
    )


_BATTERY_COLUMNS = ["test_name", "test_type", "coefficient", "std_error", "p_value", "n_obs", "significant"]

_PLACEBO_T = f"""pe as (select distinct period p from tpanel where period < {PRE_PERIOD_END}),
pr as (select p, row_number() over (order by p desc) rn, count(*) over () c from pe),
fk as (select p from pr where rn > 1 and rn <= 1 + case when c < 7 then greatest(1, c - 2) else 5 end),
t as (select 'placebo_t' || p test_name, outcome y, case when ever_treated = 1 and period >= p then 1 else 0 end x
      from tpanel, fk where period <= {PRE_PERIOD_END})"""
_PLACEBO_SQL = f"with {TREATED_SQL},\n{_PLACEBO_T},\n{_r1('placebo')} {_r1_select('placebo')}"


@query("placebo_time", _PLACEBO_SQL)
def placebo_time(spark, sf):
    rows = rob.run_placebo_time(treated_panel(spark, sf), pre_period_end=PRE_PERIOD_END)
    return rounded(rows.select(*_BATTERY_COLUMNS))


_ENDPOINT_T = "select 'trim_endpoints' test_name, outcome y, treatment x from panel where period > (select min(period) from panel) and period < (select max(period) from panel)"
_OUTLIER_T = "select 'trim_outliers' test_name, outcome y, treatment x from panel where outcome >= (select quantile_cont(outcome, 0.01) from panel) and outcome <= (select quantile_cont(outcome, 0.99) from panel)"
_SUBSAMPLE_T = "select 'subsample_80' test_name, outcome y, treatment x from (select *, row_number() over (order by md5(id || '-' || period || '-42')) rn, count(*) over () c from panel) where rn <= round(0.8 * c)"


def _sample_sql(*tables: str) -> str:
    return f"with {PANEL_SQL},\nt as ({' union all '.join(tables)}),\n{_r1('sample')} {_r1_select('sample')}"


def _restricted(df, name):
    row = rob.run_simple_ols(df, "outcome", "treatment")
    return rounded(
        row.select(
            F.lit(name).alias("test_name"),
            F.lit("sample").alias("test_type"),
            "coefficient",
            "std_error",
            "p_value",
            "n_obs",
            (F.col("p_value") < 0.05).alias("significant"),
        )
    )


@query("trim_endpoints", _sample_sql(_ENDPOINT_T))
def trim_endpoints(spark, sf):
    return _restricted(rob.trim_endpoints(panel(spark, sf)), "trim_endpoints")


@query("trim_outliers", _sample_sql(_OUTLIER_T))
def trim_outliers(spark, sf):
    return _restricted(rob.trim_outliers(panel(spark, sf), "outcome"), "trim_outliers")


@query("subsample_80", _sample_sql(_SUBSAMPLE_T))
def subsample_80(spark, sf):
    return _restricted(rob.subsample(panel(spark, sf)), "subsample_80")


_MAIN_T = "select 'main' test_name, outcome y, treatment x from panel"
_CONTROL_P = p_sql("(b / sqrt(v))", "(n - 3)")
_CONTROL_SQL = (
    f"with {PANEL_SQL},\n"
    + sweep_sql("panel", "id * 1000 + period", "outcome", ["treatment", "covariate_1"])
    + f" select 'with_control' test_name, 'specification' test_type, {r('b', 'coefficient')}, {r('sqrt(v)', 'std_error')},"
    f" {r(_CONTROL_P, 'p_value')}, n n_obs, {_CONTROL_P} < 0.05 significant from est where j = 1"
)
_SPECS_SQL = f"select * from (with {PANEL_SQL},\nt as ({_MAIN_T}),\n{_r1('specification')} {_r1_select('specification')}) union all select * from ({_CONTROL_SQL})"


@query("alternative_specs", _SPECS_SQL)
def alternative_specs(spark, sf):
    return rounded(rob.run_alternative_specs(panel(spark, sf)).select(*_BATTERY_COLUMNS))


_BATTERY_SQL = (
    f"{_SPECS_SQL} union all select * from ({_PLACEBO_SQL}) union all"
    f" select * from ({_sample_sql(_ENDPOINT_T, _OUTLIER_T, _SUBSAMPLE_T)})"
)


@query("robustness_all", _BATTERY_SQL)
def robustness_all(spark, sf):
    rows = rob.run_battery(treated_panel(spark, sf), pre_period_end=PRE_PERIOD_END)
    return rounded(rows.select(*_BATTERY_COLUMNS))


_LAYOUT_ORDER = {"specification": 0, "placebo": 1, "sample": 2}


@query(
    "robustness_layout",
    f"""with al as ({_BATTERY_SQL}),
ty as (select *, case test_type when 'specification' then 0 when 'placebo' then 1 else 2 end o from al)
select test_name, test_type, cast(row_number() over (order by o, test_name) - 1 + 0.5 * (dense_rank() over (order by o) - 1) as double) as position,
       case when p_value < 0.05 then 'significant' else 'not_significant' end class from ty""",
)
def robustness_layout(spark, sf):
    from ..operators.tables import robustness_layout as layout

    rows = layout(rob.run_battery(treated_panel(spark, sf), pre_period_end=PRE_PERIOD_END), _LAYOUT_ORDER)
    return rows.select("test_name", "test_type", F.col("position").cast("double").alias("position"), "class")


@query(
    "placebo_group",
    f"""with {PANEL_SQL},
t as (select 'placebo_group' test_name, outcome y,
      case when cast(cast('0x' || substr(md5(id || '-placebo-42'), 1, 8) as bigint) as double) / 4294967296.0 < 0.5 and period >= 36 then 1 else 0 end x from panel),
{_r1('placebo')} {_r1_select('placebo')}""",
)
def placebo_group(spark, sf):
    return rounded(rob.run_placebo_group(panel(spark, sf), 36).select(*_BATTERY_COLUMNS))


@query(
    "placebo_outcome",
    f"with {PANEL_SQL},\nt as (select 'placebo_outcome' test_name, covariate_3 y, treatment x from panel),\n{_r1('placebo')} {_r1_select('placebo')}",
)
def placebo_outcome(spark, sf):
    return rounded(rob.run_placebo_outcome(panel(spark, sf), "covariate_3").select(*_BATTERY_COLUMNS))


@query(
    "sample_filters",
    f"""with {PANEL_SQL},
t as (select 'late' test_name, outcome y, treatment x from panel where period >= 24
      union all select 'small_orders', outcome, treatment from panel where covariate_1 < 25
      union all {_ENDPOINT_T} union all {_OUTLIER_T} union all {_SUBSAMPLE_T}),
{_r1('sample')} {_r1_select('sample')}""",
)
def sample_filters(spark, sf):
    """Named filter registry: a time window and a covariate restriction."""
    extra = {"late": F.col("period") >= 24, "small_orders": F.col("covariate_1") < 25}
    return rounded(rob.run_sample_restrictions(panel(spark, sf), extra=extra).select(*_BATTERY_COLUMNS))


@query(
    "leave_one_cluster_out",
    f"""with {PANEL_SQL},
c as (select id, count(*) n, sum(treatment) sx, sum(outcome) sy, sum(treatment * treatment) sxx, sum(treatment * outcome) sxy, sum(outcome * outcome) syy from panel group by id),
a as (select sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy, sum(syy) syy from c),
o as (select id, a.n - c.n n, a.sx - c.sx sx, a.sy - c.sy sy, a.sxx - c.sxx sxx, a.sxy - c.sxy sxy, a.syy - c.syy syy from c, a),
m as (select id, n, sxx - sx * sx / n cxx, sxy - sx * sy / n cxy, syy - sy * sy / n cyy from o)
select id, {r('cxy / cxx', 'coefficient')}, {r('sqrt((cyy - cxy * cxy / cxx) / (n - 2) / cxx)', 'std_error')}, cast(n as bigint) n_obs from m""",
)
def leave_one_cluster_out(spark, sf):
    rows = reg.leave_one_cluster_out(panel(spark, sf), "outcome", "treatment", "id")
    return rounded(rows.select("id", "coefficient", "std_error", "n_obs"))


@query(
    "two_way_cluster",
    f"""with {PANEL_SQL},
mo as (select avg(treatment) mx, avg(outcome) my, regr_sxx(outcome, treatment) sxx, regr_sxy(outcome, treatment) sxy, count(*) n from panel),
ro as (select id, period, (treatment - mx) * ((outcome - my) - sxy / sxx * (treatment - mx)) s from panel, mo),
a as (select count(*) / (count(*) - 1.0) * sum(s * s) v, count(*) g from (select id, sum(s) s from ro group by 1)),
b as (select count(*) / (count(*) - 1.0) * sum(s * s) v, count(*) g from (select period, sum(s) s from ro group by 1)),
ab as (select count(*) / (count(*) - 1.0) * sum(s * s) v from ro)
select {r('sxy / sxx', 'coefficient')}, {r('sqrt((a.v + b.v - ab.v) * (n - 1.0) / (n - 2.0)) / sxx', 'std_error')}, n n_obs, a.g n_clusters_a, b.g n_clusters_b from mo, a, b, ab""",
)
def two_way_cluster(spark, sf):
    rows = reg.two_way_ols(panel(spark, sf), "outcome", ["treatment"], ("id", "period"))
    return rounded(rows.select("coefficient", "std_error", "n_obs", "n_clusters_a", "n_clusters_b"))


@query(
    "alternative_cluster",
    f"with {PANEL_SQL},\n"
    + demean_sql("panel", "dm", ["outcome", "treatment"], TWO_WAY, ["id", "period"])
    + f",{simple_cluster_sql('dm', 'period')} select {r('b', 'coefficient')}, {r('se', 'std_error')}, {r('r2', 'r_squared')}, n n_obs from est",
)
def alternative_cluster(spark, sf):
    spec = Specification(fe=TWO_WAY, cluster="period")
    row = reg.run_fe_estimation(panel(spark, sf), spec)
    return rounded(row.select("coefficient", "std_error", "r_squared", "n_obs"))


@query(
    "format_table",
    f"""with base as (select n_nationkey nation, l_extendedprice / 1000 y, l_discount x
      from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
g as (select nation, count(*) n, regr_slope(y, x) b, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) se from base group by 1),
f as (select nation, n, b, se, {p_sql('(b / se)', '(n - 2)')} p from (select nation, n, case when n >= 10 then b end b, case when n >= 10 then se end se from g))
select nation, printf('%.3f', b) || case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end || ' (' || printf('%.3f', se) || ')' coefficient_text,
       case when p < 0.001 then '<0.001' else printf('%.3f', p) end p_text,
       '[' || printf('%.2f', b - 1.96 * se) || ', ' || printf('%.2f', b + 1.96 * se) || ']' ci_text,
       'F(1, ' || (n - 2) || ') = ' || printf('%.2f', (b / se) * (b / se)) f_text,
       'N = ' || format('{{:,}}', n) n_text,
       printf('%.1f', case when abs(p) <= 1 then p * 100 else p end) || '%' percent_text,
       case when b > 0 then '+' else '' end || printf('%.3f', b) difference_text,
       p < 0.05 significant_05, p < 0.01 significant_01
from f""",
)
def format_table(spark, sf):
    from ..functions import formats as fmt

    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount")
    nations = table(spark, sf, "nation").select("n_nationkey")
    data = (
        lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_nationkey").alias("nation"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("x"))
    )
    rows = reg.grouped_ols(data, "y", "x", "nation")
    b, se, p = F.col("coefficient"), F.col("std_error"), F.col("p_value")
    return rows.select(
        "nation",
        format_coefficient(b, se, include_stars=True, pvalue=p).alias("coefficient_text"),
        format_pvalue(p).alias("p_text"),
        format_ci(b - 1.96 * se, b + 1.96 * se, 2).alias("ci_text"),
        fmt.format_fstat(F.col("t_stat") * F.col("t_stat"), F.lit(1), F.col("n_obs") - 2).alias("f_text"),
        fmt.format_sample_size("n_obs").alias("n_text"),
        fmt.format_percent(p).alias("percent_text"),
        fmt.format_difference(b).alias("difference_text"),
        fmt.significant_05(p).alias("significant_05"),
        fmt.significant_01(p).alias("significant_01"),
    )
