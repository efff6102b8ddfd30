from ladder.operators.aggregate import (
    cohort_rate,
    dedupe,
    group_order,
    mean_by,
    pivot_max,
    rate_by,
    share_of_rows,
    weighted_mean_by,
    weighted_mean_from_sums,
    weighted_sums,
)
from ladder.operators.change import change_between_endpoints, group_ratio_trend
from ladder.operators.filters import endpoints, latest_period, period_bounds
from ladder.operators.interpolate import interpolate_two_tiers, tier_means
from ladder.operators.joins import attach_scalar, label_of
from ladder.operators.metrics import (
    endpoint_values,
    extremes,
    first_last,
    gap_ratio,
    summary_kpis,
    transition_summary,
)
from ladder.operators.mobility import escape_and_retention, transition_matrix, upper_retention
from ladder.operators.reshape import dense_grid, dense_long, dense_pivot, dense_rows, ranked_keys, to_chart, to_long, to_matrix
from ladder.operators.shares import share_of_counts, share_of_total, share_within

__all__ = [
    "attach_scalar", "change_between_endpoints", "cohort_rate", "dedupe", "dense_grid", "dense_long", "dense_rows", "ranked_keys",
    "dense_pivot", "endpoint_values", "endpoints", "escape_and_retention", "extremes", "first_last",
    "gap_ratio", "group_order", "group_ratio_trend", "interpolate_two_tiers", "label_of",
    "latest_period", "mean_by", "period_bounds", "pivot_max", "rate_by", "share_of_counts",
    "share_of_rows", "share_of_total", "share_within", "summary_kpis", "tier_means", "to_chart",
    "to_long", "to_matrix", "transition_matrix", "transition_summary", "upper_retention", "weighted_mean_by",
    "weighted_mean_from_sums", "weighted_sums",
]
