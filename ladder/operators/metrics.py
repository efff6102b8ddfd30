"""One-row summary metrics over query results (K1-K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladder.functions.columns import col_of
from ladder.functions.exact import exact_mean


def gap_ratio(values: DataFrame, value: str, ignore_zero_min: bool = False, digits: int = 1) -> Column:
    """Aggregate Column: ``ROUND(MAX(v) / MIN(v), digits)``, 0 when empty or the minimum is 0/missing.

    With ``ignore_zero_min`` zeros are left out of the minimum (not of the maximum)."""
    v = F.col(value)
    low = F.min(F.nullif(v, F.lit(0.0))) if ignore_zero_min else F.min(v)
    return F.coalesce(F.round(F.try_divide(F.max(v), low), digits), F.lit(0.0))


def summary_kpis(income: DataFrame, income_col: str, asset: DataFrame, asset_col: str,
                 retention: DataFrame, retention_col: str, latest: DataFrame, latest_col: str) -> DataFrame:
    """One row: income gap (K1), asset gap ignoring zero minima (K2), upper retention, latest period."""
    asset_gap = asset.agg(gap_ratio(asset, asset_col, ignore_zero_min=True)).scalar()
    retention_v = retention.select(retention_col).scalar()
    latest_v = latest.select(latest_col).scalar()
    return income.agg(gap_ratio(income, income_col).alias("income_gap")).select(
        "income_gap",
        asset_gap.alias("asset_gap"),
        F.coalesce(retention_v, F.lit(0.0)).alias("upper_retention"),
        latest_v.alias("latest_year"),
    )


def transition_summary(matrix: DataFrame, levels: int = 10, digits: int = 1) -> DataFrame:
    """From a dense long matrix: mean of the diagonal, the first and the last diagonal cell (K5).
    No row when the matrix is empty."""
    diag = F.col("row_pos") == F.col("col_pos")
    cell = lambda i: F.max(F.when((F.col("row_pos") == i) & (F.col("col_pos") == i), F.col("value")))
    return matrix.agg(
        F.count(F.lit(1)).alias("_cells"),
        F.round(exact_mean(F.when(diag, F.col("value"))), digits).alias("avg_stay"),
        F.round(cell(1), digits).alias("lower_stay"),
        F.round(cell(levels), digits).alias("upper_stay"),
    ).where(F.col("_cells") > 0).drop("_cells")


def extremes(df: DataFrame, label: str, measure: str, order: str | Column,
             low_as: str = "lowest", high_as: str = "highest") -> DataFrame:
    """Label and value of the row with the smallest and the largest measure.

    Ties go to the row that comes first in ``order`` (NULL order first), as first-occurrence argmin/argmax
    over an ordered result does. No row for an empty input."""
    pos = F.coalesce(col_of(order).cast("double"), F.lit(float("-inf")))
    m = F.col(measure)
    return df.where(m.isNotNull()).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(F.col(label), F.struct(m, pos)).alias(f"{low_as}_label"),
        F.min(m).alias(f"{low_as}_value"),
        F.max_by(F.col(label), F.struct(m, -pos)).alias(f"{high_as}_label"),
        F.max(m).alias(f"{high_as}_value"),
    ).where(F.col("_rows") > 0).drop("_rows")


def first_last(df: DataFrame, order: str, measure: str, prefix: str, digits: int = 2) -> list[Column]:
    """Aggregate Columns: value at the first and last ``order`` key (O3; NULL as 0) and last/first ratio
    rounded to ``digits`` with a 0 guard (K3)."""
    first = F.coalesce(F.min_by(F.col(measure), F.col(order)), F.lit(0.0))
    last = F.coalesce(F.max_by(F.col(measure), F.col(order)), F.lit(0.0))
    ratio = F.coalesce(F.round(F.try_divide(last, F.nullif(first, F.lit(0.0))), digits), F.lit(0.0))
    return [first.alias(f"{prefix}_first"), last.alias(f"{prefix}_last"), ratio.alias(f"{prefix}_ratio")]


def endpoint_values(order: str, measures: dict[str, str]) -> list[Column]:
    """Aggregate Columns: each measure in the first and the last row of a result ordered by ``order``
    with NULLs first (O3), as ``<prefix>_first`` / ``<prefix>_last``; ``measures`` maps measure ->
    prefix. NULL measures stay NULL."""
    key = F.struct(F.col(order).isNotNull().alias("_known"), F.col(order).alias("_key"))
    cols = []
    for measure, prefix in measures.items():
        cols.append(F.min_by(F.col(measure), key).alias(f"{prefix}_first"))
        cols.append(F.max_by(F.col(measure), key).alias(f"{prefix}_last"))
    return cols
