"""p-values and critical values as column expressions.

The default formulas are published approximations of the t and normal
distributions.  ``method`` selects two historical formulas instead:

``"estimation"``
    normal above 100 degrees of freedom; below, a power formula whose
    statistic is divided by the degrees of freedom twice.
``"power"``
    a power formula with a floor of 2e-5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import as_column

# Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# 97.5 % normal quantile and its inverse-erf stand-in without the
# factor sqrt(2), which is what the historical formula yields.
Z_975 = 1.959963984540054
# Abramowitz and Stegun 26.7.5: terms in 1/dof, 1/dof^2, ... of the t quantile.
T_EXPANSION = (
    (Z_975**3 + Z_975) / 4,
    (5 * Z_975**5 + 16 * Z_975**3 + 3 * Z_975) / 96,
    (3 * Z_975**7 + 19 * Z_975**5 + 17 * Z_975**3 - 15 * Z_975) / 384,
    (79 * Z_975**9 + 776 * Z_975**7 + 1482 * Z_975**5 - 1920 * Z_975**3 - 945 * Z_975) / 92160,
)
_WINITZKI_A = 8 * (math.pi - 3) / (3 * math.pi * (4 - math.pi))
# Fixed value: degrees of freedom above which "estimation" uses the normal.
LARGE_DOF = 100


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for coefficient in reversed(ERF_COEFFICIENTS):
        poly = (poly + F.lit(coefficient)) * t
    return poly * F.exp(-x * x)


def normal_two_sided_p(z) -> Column:
    return _erfc(F.abs(as_column(z)) / F.lit(math.sqrt(2.0)))


def _t_as_z(t: Column, dof: Column) -> Column:
    """Normal deviate with about the same tail area as t."""
    return t * (F.lit(1.0) - F.lit(1.0) / (4 * dof)) / F.sqrt(F.lit(1.0) + t * t / (2 * dof))


def _power_tail(t: Column, dof: Column, scale: Column) -> Column:
    return F.pow(F.lit(1.0) + t * t / scale, -dof / 2)


def p_value(t, dof, method: str = "t") -> Column:
    """Two-sided p-value of a t statistic."""
    t, dof = as_column(t), as_column(dof).cast("double")
    if method == "t":
        return normal_two_sided_p(_t_as_z(t, dof))
    if method == "estimation":
        return F.when(dof > LARGE_DOF, normal_two_sided_p(t)).otherwise(_power_tail(t, dof, dof * dof))
    if method == "power":
        return F.when(t.isNotNull(), F.greatest(F.lit(2e-5), _power_tail(t, dof, dof)))
    raise ValueError(f"unknown p-value method: {method}")


def critical_value(dof, method: str = "t") -> Column:
    """Two-sided 5 % critical value."""
    dof = as_column(dof).cast("double")
    if method == "t":
        small = F.lit(Z_975)
        for power, coefficient in enumerate(T_EXPANSION, 1):
            small = small + F.lit(coefficient) / F.pow(dof, power)
        return small
    if method == "estimation":
        log_term = math.log(1 - 0.95**2)
        inner = 2 / (math.pi * _WINITZKI_A) + log_term / 2
        narrow = math.sqrt(math.sqrt(inner**2 - log_term / _WINITZKI_A) - inner)
        return F.when(dof > LARGE_DOF, F.lit(narrow)).otherwise(F.lit(1.96) * (F.lit(1.0) + F.lit(0.5) / dof))
    raise ValueError(f"unknown critical-value method: {method}")


def f_p_value(f, df1, df2) -> Column:
    """Upper tail of F by Paulson's normal approximation."""
    f, d1, d2 = as_column(f), as_column(df1).cast("double"), as_column(df2).cast("double")
    a, b = F.lit(2.0) / (9 * d1), F.lit(2.0) / (9 * d2)
    root = F.pow(f, F.lit(1.0 / 3))
    z = ((F.lit(1.0) - b) * root - (F.lit(1.0) - a)) / F.sqrt(b * root * root + a)
    tail = normal_two_sided_p(z) / 2
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)
