"""Report text for estimates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Star levels, strictly below.
STAR_LEVELS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def as_column(value) -> Column:
    """Column names pass as columns, everything else as a literal."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _fixed(value, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", as_column(value).cast("double"))


def format_pvalue(p, threshold: float = 0.001) -> Column:
    p = as_column(p)
    return F.when(p < threshold, F.lit(f"<{threshold}")).when(p.isNotNull(), _fixed(p, 3))


def format_ci(lo, hi, decimals: int = 3) -> Column:
    return F.concat(F.lit("["), _fixed(lo, decimals), F.lit(", "), _fixed(hi, decimals), F.lit("]"))


def add_significance_stars(p) -> Column:
    p = as_column(p)
    chain = None
    for level, stars in STAR_LEVELS:
        chain = F.when(p < level, stars) if chain is None else chain.when(p < level, stars)
    return chain.otherwise("")


def format_coefficient(coef, se=None, decimals: int = 3, include_stars: bool = False, pvalue=None) -> Column:
    parts = [_fixed(coef, decimals)]
    if include_stars and pvalue is not None:
        parts.append(add_significance_stars(pvalue))
    if se is not None:
        parts += [F.lit(" ("), _fixed(se, decimals), F.lit(")")]
    return F.concat(*parts)


def format_fstat(f, df1, df2, p=None) -> Column:
    degrees = [as_column(d).cast("long").cast("string") for d in (df1, df2)]
    parts = [F.lit("F("), degrees[0], F.lit(", "), degrees[1], F.lit(") = "), _fixed(f, 2)]
    if p is not None:
        parts += [F.lit(", p = "), format_pvalue(p)]
    return F.concat(*parts)


def format_sample_size(n, label: str = "N") -> Column:
    return F.concat(F.lit(f"{label} = "), F.format_number(as_column(n).cast("long"), 0))


def format_percent(value, decimals: int = 1, always_scale: bool = False) -> Column:
    """Values within [-1, 1] are taken as shares; ``always_scale`` scales all."""
    value = as_column(value).cast("double")
    scaled = value * 100 if always_scale else F.when(F.abs(value) <= 1, value * 100).otherwise(value)
    return F.concat(_fixed(scaled, decimals), F.lit("%"))


def format_difference(value, decimals: int = 3, show_sign: bool = True) -> Column:
    value = as_column(value).cast("double")
    sign = F.when(value > 0, "+").otherwise("") if show_sign else F.lit("")
    return F.concat(sign, _fixed(value, decimals))


def significant_05(p="p_value") -> Column:
    return as_column(p) < 0.05


def significant_01(p="p_value") -> Column:
    return as_column(p) < 0.01
