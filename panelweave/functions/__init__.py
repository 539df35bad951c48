"""Column builders: text formats, inference, distances and string similarity."""

from .formats import (
    add_significance_stars,
    format_ci,
    format_coefficient,
    format_difference,
    format_fstat,
    format_percent,
    format_pvalue,
    format_sample_size,
    significant_01,
    significant_05,
)
from .geometry import haversine_m, in_zone, planar_distance, seasonal_component, trend_component
from .inference import critical_value, f_p_value, normal_two_sided_p, p_value
from .similarity import jaro_winkler, levenshtein_similarity

__all__ = [
    "add_significance_stars",
    "critical_value",
    "f_p_value",
    "format_ci",
    "format_coefficient",
    "format_difference",
    "format_fstat",
    "format_percent",
    "format_pvalue",
    "format_sample_size",
    "haversine_m",
    "in_zone",
    "jaro_winkler",
    "levenshtein_similarity",
    "normal_two_sided_p",
    "p_value",
    "planar_distance",
    "seasonal_component",
    "significant_01",
    "significant_05",
    "trend_component",
]
