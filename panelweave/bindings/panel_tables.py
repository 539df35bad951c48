"""Panels derived from the driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import add_treatment_columns
from .registry import table

#: Last month before the first treatment of the supplier panel.
PRE_PERIOD_END = 35

PANEL_SQL = """
p0 as (select l_suppkey id,
              cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as int) period,
              avg(l_extendedprice) / 1000 outcome, avg(l_quantity) covariate_1,
              avg(l_discount) * 100 covariate_2, avg(l_tax) * 100 covariate_3
       from lineitem group by 1, 2),
panel as (select p0.*, case when id % 2 = 0 and period >= 36 + 12 * cast(floor(id / 2) % 3 as int)
                            then 1 else 0 end treatment from p0)"""

TREATED_SQL = PANEL_SQL + """,
started as (select panel.*, min(case when treatment = 1 then period end) over (partition by id) treatment_period,
                   max(treatment) over (partition by id) ever_treated from panel),
tpanel as (select *, period - treatment_period event_time,
                  case when period >= treatment_period then 1 else 0 end post_treatment from started)"""

EPANEL_SQL = """
epanel as (select user_id id, cast(datediff('day', date '2024-01-01', cast(ts as date)) as int) period,
                  avg(value) outcome, count(*) n_events from events group by 1, 2)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by month, nearly balanced; even suppliers start in one of three months."""
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("id"), month.alias("period"))
        .agg(
            (F.avg("l_extendedprice") / 1000).alias("outcome"),
            F.avg("l_quantity").alias("covariate_1"),
            (F.avg("l_discount") * 100).alias("covariate_2"),
            (F.avg("l_tax") * 100).alias("covariate_3"),
        )
    )
    return cells.withColumn("treatment", treatment())


def treatment():
    start = 36 + 12 * (F.floor(F.col("id") / 2) % 3)
    return F.when((F.col("id") % 2 == 0) & (F.col("period") >= start), 1).otherwise(0)


def treated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_treatment_columns(panel(spark, sf_dir))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by day with many gaps."""
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("int")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("id"), day.alias("period"))
        .agg(F.avg("value").alias("outcome"), F.count(F.lit(1)).alias("n_events"))
    )
