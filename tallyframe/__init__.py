"""Design-weighted estimation from sample-survey microdata, on Spark DataFrames."""

from tallyframe.operators.calibration import RakingNotConverged, poststratify, rake
from tallyframe.operators.estimates import (
    weighted_crosstab,
    weighted_estimates,
    weighted_ratio,
)
from tallyframe.operators.panel import panel_flows, period_change
from tallyframe.operators.quantile import weighted_quantile
from tallyframe.operators.variance import (
    design_variance,
    ratio_variance,
    replicate_variance,
)
from tallyframe.sources.fixed_width import Field, malformed_counts, read_fixed_width

__all__ = [
    "Field",
    "RakingNotConverged",
    "design_variance",
    "malformed_counts",
    "panel_flows",
    "period_change",
    "poststratify",
    "rake",
    "ratio_variance",
    "read_fixed_width",
    "replicate_variance",
    "weighted_crosstab",
    "weighted_estimates",
    "weighted_quantile",
    "weighted_ratio",
]
