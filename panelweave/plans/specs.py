"""Column roles and the specification registry."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelSpec:
    """Names of the columns that give a table its panel shape."""

    unit: str = "id"
    time: str = "period"
    treatment: str = "treatment"
    outcome: str = "outcome"


PANEL = PanelSpec()


@dataclass(frozen=True)
class Specification:
    """Regressors beside the treatment, absorbed effects and clustering."""

    controls: tuple[str, ...] = ()
    fe: tuple[str, ...] = ()
    cluster: str | None = None
    treatment: str | None = None
    outcome: str | None = None
    description: str = ""


# The named specifications.
SPECIFICATIONS = {
    "baseline": Specification(
        fe=("unit_fe", "time_fe"), cluster="id", description="Baseline specification with unit and time FE"
    ),
    "no_fe": Specification(description="Simple OLS without fixed effects"),
    "with_controls": Specification(
        controls=("covariate_1", "covariate_2", "covariate_3"),
        fe=("unit_fe", "time_fe"),
        cluster="id",
        description="Baseline with additional control variables",
    ),
    "unit_fe_only": Specification(fe=("unit_fe",), cluster="id", description="Unit fixed effects only"),
}
