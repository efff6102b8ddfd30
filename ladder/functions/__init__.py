from ladder.functions.columns import (
    col_of,
    count_when,
    first_digit,
    int_code,
    lenient_double,
    percent,
    rank_of,
)
from ladder.functions.exact import exact_mean, exact_state, exact_sum, merged_state, state_total

__all__ = [
    "col_of",
    "count_when",
    "exact_mean",
    "exact_state",
    "exact_sum",
    "first_digit",
    "int_code",
    "lenient_double",
    "merged_state",
    "percent",
    "rank_of",
    "state_total",
]
