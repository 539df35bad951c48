"""Tables behind figures and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from .panel_tables import PANEL_SQL, TREATED_SQL, panel, treated_panel
from .registry import query, r, rounded


@query(
    "event_profile",
    f"""with {TREATED_SQL}, s as (select event_time, avg(outcome) m, stddev_samp(outcome) sd, count(outcome) n from tpanel where event_time between -12 and 12 group by 1)
select event_time, {r('m', 'mean')}, {r('sd', 'std')}, n as count, {r('sd / sqrt(n)', 'se')}, {r('m - 1.96 * sd / sqrt(n)', 'band_lower')}, {r('m + 1.96 * sd / sqrt(n)', 'band_upper')} from s""",
)
def event_profile(spark, sf):
    return rounded(tables.event_profile(treated_panel(spark, sf)))


@query(
    "trend_means",
    f"""with {TREATED_SQL} select period, {r('avg(outcome) filter (where ever_treated = 0)', 'control')}, {r('avg(outcome) filter (where ever_treated = 1)', 'treatment')},
 (select min(period) from tpanel where treatment = 1) treatment_start from tpanel group by period""",
)
def trend_means(spark, sf):
    return rounded(tables.trend_means(treated_panel(spark, sf)))


_ROUNDED = f"{PANEL_SQL}, v as (select treatment, round(outcome, 6) + 0 x from panel)"


def _histogram_sql(bins: int, group: str | None) -> str:
    g = f"{group}, " if group else ""
    key = f" and a.{group} = c.{group}" if group else ""
    join = f"v join b on v.{group} = b.{group}" if group else "v, b"
    pick = f"v.{group}, " if group else ""
    return f"""with {_ROUNDED}, b as (select {g}min(x) lo, max(x) hi, (max(x) - min(x)) / {bins} w from v {'group by ' + group if group else ''}),
c as (select {pick}cast(least(floor((x - lo) / w), {bins - 1}) as int) bin, count(*) n from {join} group by all),
a as (select *, cast(unnest(range(0, {bins})) as int) bin from b)
select {'a.' + group + ', ' if group else ''}a.bin, {r('lo + a.bin * w', 'bin_start')}, {r('lo + (a.bin + 1) * w', 'bin_end')}, coalesce(n, 0) as count from a left join c on a.bin = c.bin{key}"""


def _outcomes(spark, sf):
    return panel(spark, sf).select("treatment", F.round("outcome", 6).alias("x"))


@query("histogram", _histogram_sql(50, None))
def histogram(spark, sf):
    return rounded(tables.histogram(_outcomes(spark, sf), "x", 50))


@query("histogram_by_group", _histogram_sql(30, "treatment"))
def histogram_by_group(spark, sf):
    return rounded(tables.histogram(_outcomes(spark, sf), "x", 30, ["treatment"]))


@query("median_trend", f"with {TREATED_SQL} select period, ever_treated, {r('quantile_cont(outcome, 0.5)', 'median')} from tpanel group by 1, 2")
def median_trend(spark, sf):
    return rounded(tables.median_trend(treated_panel(spark, sf), "outcome", "period"))


@query("group_summary", f"with {PANEL_SQL} select treatment, {r('avg(outcome)', 'mean', 4)}, {r('stddev_samp(outcome)', 'std', 4)}, count(outcome) as count from panel group by 1")
def group_summary(spark, sf):
    return tables.group_summary(panel(spark, sf), "treatment", "outcome")


_STATS = ["outcome", "covariate_1", "covariate_2", "covariate_3"]


@query(
    "summary_stats",
    f"with {PANEL_SQL} " + " union all ".join(
        f"select '{c}' as variable, count({c}) n, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')} from panel"
        for c in _STATS
    ),
)
def summary_stats(spark, sf):
    return rounded(tables.summary_stats(panel(spark, sf), _STATS))


@query(
    "sample_construction",
    f"""with {PANEL_SQL}, c as (select count(*) n0, count(*) filter (where period >= 6) n1, count(*) filter (where period >= 6 and covariate_1 >= 20) n2,
 count(*) filter (where period >= 6 and covariate_1 >= 20 and treatment = 0) n3 from panel),
l as (select unnest([0, 1, 2, 3]) step, unnest(['Initial records', 'After start', 'Large orders', 'Never or not yet treated']) stage, unnest([n0, n1, n2, n3]) observations, n0 from c)
select cast(step as bigint) step, stage, observations, {r('observations * 100.0 / n0', 'percent_retained')} from l""",
)
def sample_construction(spark, sf):
    filters = {
        "After start": F.col("period") >= 6,
        "Large orders": F.col("covariate_1") >= 20,
        "Never or not yet treated": F.col("treatment") == 0,
    }
    return rounded(tables.sample_construction(panel(spark, sf), filters))


@query("ordered_panel", f"with {PANEL_SQL} select id, period, {r('outcome')} from panel order by id, period")
def ordered_panel(spark, sf):
    return tables.ordered(rounded(panel(spark, sf).select("id", "period", "outcome")))
