"""Panel construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import in_zone, planar_distance, seasonal_component, trend_component
from ..operators import cleaning
from ..operators import panel as ops
from ..operators.linkage import map_group_value
from .panel_tables import EPANEL_SQL, PANEL_SQL, TREATED_SQL, event_panel, panel, treated_panel
from .registry import query, r, rounded, table


@query(
    "panel_diagnostics",
    f"""with {PANEL_SQL},
u as (select id, max(treatment) t from panel group by id)
select count(distinct id) n_units, count(distinct period) n_periods, count(*) n_observations,
       count(distinct id) * count(distinct period) expected_if_balanced,
       count(*) = count(distinct id) * count(distinct period) is_balanced,
       {r('count(*) / (count(distinct id) * count(distinct period) * 1.0)', 'balance_rate')}, {r('avg(treatment)', 'treatment_share')},
       (select count(*) from u where t > 0) n_treated_units, (select count(*) from u where not t > 0) n_control_units from panel""",
)
def panel_diagnostics(spark, sf):
    return rounded(ops.calculate_panel_diagnostics(panel(spark, sf)))


@query(
    "fixed_effect_codes",
    f"""with {PANEL_SQL} select id, period, dense_rank() over (order by id) - 1 unit_fe, dense_rank() over (order by period) - 1 time_fe from panel""",
)
def fixed_effect_codes(spark, sf):
    return ops.create_fixed_effects(panel(spark, sf).select("id", "period"))


_VALUES = ["outcome", "covariate_1", "covariate_2", "covariate_3"]
_VALUES_SQL = ", ".join(r(v) for v in _VALUES)


@query(
    "balance_drop",
    f"""with {PANEL_SQL}, c as (select id from panel group by id having count(distinct period) = (select count(distinct period) from panel))
select id, period, {_VALUES_SQL}, treatment from panel where id in (select id from c)""",
)
def balance_drop(spark, sf):
    return rounded(ops.balance_panel(panel(spark, sf), "drop"))


_GRID = "gr as (select id, period from (select distinct id from {0}), (select distinct period from {0}))"
_ZEROES = ", ".join(r(f"coalesce({v}, 0)", v) for v in _VALUES)


@query(
    "balance_zero",
    f"""with {PANEL_SQL}, {_GRID.format('panel')}
select gr.id, gr.period, {_ZEROES}, coalesce(treatment, 0) treatment from gr left join panel on gr.id = panel.id and gr.period = panel.period""",
)
def balance_zero(spark, sf):
    return rounded(ops.balance_panel(panel(spark, sf), "zero"))


@query(
    "balance_ffill",
    f"""with {EPANEL_SQL}, {_GRID.format('epanel')},
j as (select gr.id, gr.period, outcome, n_events from gr left join epanel on gr.id = epanel.id and gr.period = epanel.period),
w as (select id, period, last_value(outcome ignore nulls) over h outcome, last_value(n_events ignore nulls) over h n_events
      from j window h as (partition by id order by period rows between unbounded preceding and current row))
select id, period, {r('outcome')}, n_events from w""",
)
def balance_ffill(spark, sf):
    return rounded(ops.balance_panel(event_panel(spark, sf), "ffill"))


@query(
    "event_time",
    f"with {TREATED_SQL} select id, period, treatment_period, event_time from tpanel",
)
def event_time(spark, sf):
    return ops.create_event_time(panel(spark, sf)).select("id", "period", "treatment_period", "event_time")


@query(
    "treatment_indicators",
    f"with {TREATED_SQL} select id, period, treatment, ever_treated, post_treatment from tpanel",
)
def treatment_indicators(spark, sf):
    timed = ops.create_event_time(panel(spark, sf))
    return ops.create_treatment_indicators(timed).select("id", "period", "treatment", "ever_treated", "post_treatment")


_WINDOW = [k for k in range(-12, 13) if k != -1]


@query(
    "event_dummies",
    f"with {TREATED_SQL} select id, period, "
    + ", ".join(f"case when event_time = {k} then 1 else 0 end {ops.dummy_name(k)}" for k in _WINDOW)
    + " from tpanel",
)
def event_dummies(spark, sf):
    wide = ops.event_dummies(treated_panel(spark, sf))
    return wide.select("id", "period", *[ops.dummy_name(k) for k in _WINDOW])


@query(
    "event_bins",
    f"""with {TREATED_SQL} select id, period, case when event_time is null then null else greatest(least(event_time, 12), -12) end event_time_binned,
    ever_treated * post_treatment treat_x_post, cast(treatment_period as varchar) treatment_cohort, id || '_' || period fe_unit_time from tpanel""",
)
def event_bins(spark, sf):
    names = ["event_time_binned", "treat_x_post", "treatment_cohort", "fe_unit_time"]
    return ops.event_bins(treated_panel(spark, sf)).select("id", "period", *names)


@query(
    "outcome_changes",
    f"""with {PANEL_SQL}, l as (select id, period, outcome, lag(outcome) over (partition by id order by period) b,
      avg(outcome) over () m, stddev_samp(outcome) over () s from panel)
select id, period, {r('outcome - b', 'outcome_change')}, {r('(outcome - b) / b * 100', 'outcome_pct_change')}, {r('(outcome - m) / s', 'outcome_zscore')} from l""",
)
def outcome_changes(spark, sf):
    wide = ops.outcome_changes(panel(spark, sf))
    return rounded(wide.select("id", "period", "outcome_change", "outcome_pct_change", "outcome_zscore"))


@query(
    "time_gaps",
    f"""with {EPANEL_SQL}, l as (select id, period gap_start, lead(period) over (partition by id order by period) gap_end from epanel)
select id, gap_start, gap_end, cast(gap_end - gap_start - 1 as bigint) n_missing from l where gap_end - gap_start > 1""",
)
def time_gaps(spark, sf):
    return ops.time_gaps(event_panel(spark, sf))


@query(
    "outliers_3sd",
    f"""with {PANEL_SQL} select id, period, {r('outcome')}, abs(outcome - avg(outcome) over ()) > 3 * stddev_samp(outcome) over () is_outlier from panel""",
)
def outliers_3sd(spark, sf):
    flagged = ops.flag_outliers(panel(spark, sf), "outcome", 3.0)
    return rounded(flagged.select("id", "period", "outcome", "is_outlier"))


@query(
    "timing_check",
    f"""with {PANEL_SQL},
d as (select *, case when id % 2 = 0 then 36 + 12 * cast(floor(id / 2) % 3 as int) + case when id % 10 = 0 then 1 else 0 end end declared from panel),
u as (select id, min(declared) declared_start, min(case when treatment = 1 then period end) first_treated,
      count(*) filter (where period >= declared and treatment = 0) n_untreated_after_start from d group by id)
select *, declared_start is not distinct from first_treated and n_untreated_after_start = 0 is_consistent from u""",
)
def timing_check(spark, sf):
    start = (36 + 12 * (F.floor(F.col("id") / 2) % 3)).cast("int") + F.when(F.col("id") % 10 == 0, 1).otherwise(0)
    declared = panel(spark, sf).withColumn("declared", F.when(F.col("id") % 2 == 0, start))
    return ops.timing_check(declared, "declared")


@query(
    "unit_value_map",
    f"with {PANEL_SQL} select id, period, {r('max(outcome) over (partition by id)', 'best_outcome')} from panel",
)
def unit_value_map(spark, sf):
    mapped = map_group_value(panel(spark, sf), "id", F.max("outcome"), "best_outcome")
    return rounded(mapped.select("id", "period", "best_outcome"))


@query(
    "panel_skeleton",
    """with c as (select s_suppkey id, s_nationkey % 2 treated_unit, cast(unnest(range(0, 24)) as int) period from supplier),
d as (select *, cast(date '2020-01-01' + to_months(period) as date) as date, case when period >= 12 then 1 else 0 end post from c)
select id, period, date, cast(treated_unit as int) treated_unit, post, cast(year(date) as int) as year, cast(month(date) as int) as month, cast(treated_unit * post as int) treatment from d""",
)
def panel_skeleton(spark, sf):
    units = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    wide = ops.panel_skeleton(units, 24, 12, F.col("s_nationkey") % 2, "2020-01-01")
    return wide.select("id", "period", "date", "treated_unit", "post", "year", "month", "treatment")


@query(
    "panel_entry_exit",
    f"""with {PANEL_SQL},
x as (select s_suppkey id, cast(s_suppkey % 83 as int) exit_period from supplier),
k as (select panel.id, panel.period, outcome, treatment from panel left join x on panel.id = x.id where exit_period is null or period < exit_period),
n as (select 1000000 + c_custkey id, cast(unnest(range(cast(c_nationkey as int), 26)) as int) period from customer)
select id, period, {r('outcome')}, treatment, cast(null as int) entry_period from k
union all select id, period, null, 0, cast(min(period) over (partition by id) as int) from n""",
)
def panel_entry_exit(spark, sf):
    suppliers, customers = table(spark, sf, "supplier"), table(spark, sf, "customer")
    exits = suppliers.select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 83).cast("int").alias("exit_period")
    )
    late = customers.select(
        (F.col("c_custkey") + 1000000).alias("id"),
        F.explode(F.sequence(F.col("c_nationkey"), F.lit(25))).alias("period"),
        F.lit(0).alias("treatment"),
        F.col("c_nationkey").alias("entry_period"),
    )
    base = panel(spark, sf).select("id", "period", "outcome", "treatment")
    return rounded(ops.panel_entry_exit(base, exits, late))


@query(
    "impute",
    f"""with {EPANEL_SQL}, m as (select id, period, case when n_events >= 2 then outcome end v from epanel)
select id, period, {r('coalesce(v, avg(v) over (partition by id))', 'v')} from m""",
)
def impute(spark, sf):
    holes = event_panel(spark, sf).select("id", "period", F.when(F.col("n_events") >= 2, F.col("outcome")).alias("v"))
    return rounded(cleaning.impute_group_mean(holes, ["v"], "id"))


@query(
    "impute_ffill",
    f"""with {EPANEL_SQL}, m as (select id, period, case when n_events >= 2 then outcome end v from epanel)
select id, period, {r('last_value(v ignore nulls) over (partition by id order by period rows between unbounded preceding and current row)', 'v')} from m""",
)
def impute_ffill(spark, sf):
    holes = event_panel(spark, sf).select("id", "period", F.when(F.col("n_events") >= 2, F.col("outcome")).alias("v"))
    return rounded(ops.forward_fill(holes))


@query(
    "missing_policy",
    f"""with {EPANEL_SQL}, m as (select nullif(id, 3) id, period, case when n_events >= 2 then outcome end v from epanel)
select 'id' column_name, count(*) filter (where id is null) n_missing, count(*) filter (where id is null) > 0 is_error, (select count(v) from m) n_kept from m
union all select 'period', count(*) filter (where period is null), count(*) filter (where period is null) > 0, (select count(v) from m) from m""",
)
def missing_policy(spark, sf):
    holes = event_panel(spark, sf).select(
        F.nullif("id", F.lit(3)).alias("id"), "period", F.when(F.col("n_events") >= 2, F.col("outcome")).alias("v")
    )
    kept, counts = cleaning.missing_policy(holes, "v", ["id", "period"])
    return counts.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("n_kept"))))


@query(
    "zone_flag",
    f"""with p as (select c_custkey id, (c_custkey % 1000) / 500.0 - 1 x, c_acctbal / 10000 y from customer)
select id, {r('sqrt((x - 0.1) * (x - 0.1) + (y - 0.4) * (y - 0.4))', 'dist_to_center')},
       case when sqrt((x - 0.1) * (x - 0.1) + (y - 0.4) * (y - 0.4)) < 0.5 then 1 else 0 end in_treatment_zone from p""",
)
def zone_flag(spark, sf):
    x, y = (F.col("c_custkey") % 1000) / 500.0 - 1, F.col("c_acctbal") / 10000
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), x.alias("x"), y.alias("y"))
    center = (0.1, 0.4)
    return rounded(
        points.select(
            "id",
            planar_distance("x", "y", center).alias("dist_to_center"),
            in_zone("x", "y", center, 0.5).alias("in_treatment_zone"),
        )
    )


@query(
    "seasonal_columns",
    f"with {PANEL_SQL} select id, period, {r('period * 0.01', 'trend')}, {r('0.2 * sin(2 * pi() * period / 12.0)', 'seasonal')} from panel",
)
def seasonal_columns(spark, sf):
    return rounded(
        panel(spark, sf).select(
            "id", "period", trend_component("period", 0.01).alias("trend"), seasonal_component("period", 12, 0.2).alias("seasonal")
        )
    )
