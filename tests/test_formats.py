import math

import pytest
from pyspark.sql import functions as F

from panelweave import functions as fn


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: fn.format_pvalue(0.0005), "<0.001"),
        (lambda: fn.format_pvalue(0.05), "0.050"),
        (lambda: fn.format_pvalue(0.123), "0.123"),
        (lambda: fn.format_pvalue(0.005, 0.01), "<0.01"),
        (lambda: fn.format_pvalue(0.015, 0.01), "0.015"),
        (lambda: fn.format_ci(0.1, 0.3), "[0.100, 0.300]"),
        (lambda: fn.format_ci(-0.5, 0.2), "[-0.500, 0.200]"),
        (lambda: fn.format_ci(0.1234, 0.5678, 2), "[0.12, 0.57]"),
        (lambda: fn.add_significance_stars(0.0005), "***"),
        (lambda: fn.add_significance_stars(0.005), "**"),
        (lambda: fn.add_significance_stars(0.03), "*"),
        (lambda: fn.add_significance_stars(0.05), ""),
        (lambda: fn.format_coefficient(0.123), "0.123"),
        (lambda: fn.format_coefficient(0.123, 0.045), "0.123 (0.045)"),
        (lambda: fn.format_coefficient(0.123, pvalue=0.005, include_stars=True), "0.123**"),
        (lambda: fn.format_coefficient(0.123, 0.045, include_stars=True, pvalue=0.005), "0.123** (0.045)"),
        (lambda: fn.format_fstat(12.34, 3, 100), "F(3, 100) = 12.34"),
        (lambda: fn.format_fstat(12.34, 3, 100, 0.001), "F(3, 100) = 12.34, p = 0.001"),
        (lambda: fn.format_sample_size(1234567), "N = 1,234,567"),
        (lambda: fn.format_sample_size(100, "n"), "n = 100"),
        (lambda: fn.format_percent(0.5), "50.0%"),
        (lambda: fn.format_percent(75), "75.0%"),
        (lambda: fn.format_percent(0.3333, 2), "33.33%"),
        (lambda: fn.format_percent(2.0, always_scale=True), "200.0%"),
        (lambda: fn.format_difference(0.5), "+0.500"),
        (lambda: fn.format_difference(-0.5), "-0.500"),
        (lambda: fn.format_difference(0.5, show_sign=False), "0.500"),
    ],
)
def test_text(spark, column, expected):
    assert value(spark, column()) == expected


@pytest.mark.parametrize("z", [0.0, 0.5, 1.0, 1.96, 3.0, 5.0])
def test_normal_p(spark, z):
    assert value(spark, fn.normal_two_sided_p(z)) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-7)


@pytest.mark.parametrize(
    "dof, t, expected", [(10, 2.228, 0.05), (30, 2.042, 0.05), (10, 3.169, 0.01), (1000, 1.96, 0.05)]
)
def test_t_p(spark, dof, t, expected):
    assert value(spark, fn.p_value(t, dof)) == pytest.approx(expected, abs=0.002)


@pytest.mark.parametrize("dof, expected", [(5, 2.571), (10, 2.228), (30, 2.042), (100, 1.984), (5000, 1.95996)])
def test_critical(spark, dof, expected):
    assert value(spark, fn.critical_value(dof)) == pytest.approx(expected, abs=0.003)


def test_historical_formulas(spark):
    t = 6.128514
    assert value(spark, fn.p_value(t, 10, "estimation")) == pytest.approx(0.203, abs=5e-4)
    assert value(spark, fn.p_value(t, 10, "power")) == pytest.approx(0.000411, abs=1e-6)
    assert value(spark, fn.p_value(60.0, 50, "power")) == pytest.approx(2e-5)
    assert value(spark, fn.critical_value(500, "estimation")) == pytest.approx(1.384, abs=1e-3)
    assert value(spark, fn.critical_value(10, "estimation")) == pytest.approx(1.96 * 1.05)


@pytest.mark.parametrize("f, d1, d2, expected", [(4.10, 2, 10, 0.05), (1.83, 10, 120, 0.0624), (0.5, 4, 60, 0.736)])
def test_f_tail(spark, f, d1, d2, expected):
    assert value(spark, fn.f_p_value(F.lit(f), F.lit(d1), F.lit(d2))) == pytest.approx(expected, abs=0.01)
