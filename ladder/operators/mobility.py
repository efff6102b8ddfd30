"""Mobility operators: decile transition matrix, escape/retention rates, retention KPI (Q17, Q19, Q20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladder.functions.columns import int_code
from ladder.functions.labels import LOWER_MAX_DECILE, UPPER_MIN_DECILE
from ladder.operators.aggregate import rate_by, share_of_rows
from ladder.operators.filters import latest_period
from ladder.operators.shares import share_of_counts


def transition_matrix(df: DataFrame, entity: str = "household_id", period: str = "year",
                      prev: str = "prev_income_decile", cur: str = "h_incomeq", gap: str = "year_gap",
                      levels: int = 10, dedupe: bool = True, digits: int | None = 1,
                      prev_as: str = "prev_decile", cur_as: str = "cur_decile",
                      count_as: str = "n_households", share_as: str = "share", marker: str | None = None) -> DataFrame:
    """Transitions between consecutive periods: count per (previous, current) level and the share of
    each previous level's entities moving to each current level (A10, A2, W4).

    Keeps rows with ``gap = 1``, a non-NULL entity and both levels in ``[1, levels]`` (tested before the
    integer cast). With ``dedupe`` the person-grain rows are first reduced to one row per
    (entity, period, prev, cur), a high-cardinality shuffle, partially aggregated map-side. ``marker`` names a boolean
    column that is true in one row of each such combination: with it only the counts are shuffled.
    """
    base = (df if marker is None or not dedupe else df.where(marker)).where(
        (F.col(gap) == 1) & F.col(entity).isNotNull()
        & F.col(prev).between(1, levels) & F.col(cur).between(1, levels)
    ).select(entity, period, int_code(prev).alias(prev_as), int_code(cur).alias(cur_as))
    if dedupe and marker is None:
        base = base.distinct()
    counted = base.groupBy(prev_as, cur_as).agg(F.count(F.lit(1)).alias(count_as))
    return share_of_counts(counted, prev_as, count_as, share_as, digits)


def escape_and_retention(df: DataFrame, period: str = "year", prev: str = "prev_income_decile",
                         cur: str = "h_incomeq", gap: str = "year_gap", low: int = LOWER_MAX_DECILE,
                         high: int = UPPER_MIN_DECILE, digits: int | None = 1,
                         period_as: str = "year", escape_as: str = "lower_escape_rate",
                         retention_as: str = "upper_retention_rate") -> DataFrame:
    """Per period: share of the low group (prev <= low) that left it (cur > low) and share of the high
    group (prev >= high) that stayed (cur >= high); NULL when a group is empty (A6)."""
    p, c = F.col(prev), F.col(cur)
    base = df.where((F.col(gap) == 1) & p.isNotNull() & c.isNotNull())
    return rate_by(base, F.col(period).alias(period_as), {
        escape_as: ((p <= low) & (c > low), p <= low),
        retention_as: ((p >= high) & (c >= high), p >= high),
    }, digits)


def upper_retention(df: DataFrame, period: str = "year", prev: str = "prev_income_decile",
                    cur: str = "h_incomeq", gap: str = "year_gap", high: int = UPPER_MIN_DECILE,
                    digits: int | None = 1, value_as: str = "upper_retention",
                    periods: DataFrame | None = None) -> DataFrame:
    """Latest-period share of the high group that stayed high, over all its rows (A7); one row, 0 when
    there is no such row (the dashboard's KPI default). ``periods`` may hold the table's periods."""
    base = latest_period(df, period, source=periods).where(
        (F.col(gap) == 1) & (F.col(prev) >= high) & F.col(cur).isNotNull())
    share = share_of_rows(base, F.col(cur) >= high, value_as, digits)
    return share.select(F.coalesce(value_as, F.lit(0.0)).alias(value_as))
