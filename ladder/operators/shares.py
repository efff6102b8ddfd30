"""Shares (W1-W4): count first, then a window over the aggregated counts.

The window only ever sees the aggregated result (groups x categories rows), never the base table, so
its exchange moves a handful of rows however large the input is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladder.functions.columns import percent
from ladder.operators.aggregate import dedupe


def share_within(df: DataFrame, group: str | Column, category: str | Column, count_as: str = "n",
                 share_as: str = "share", digits: int | None = 1, dedupe_on: Sequence[str] | None = None) -> DataFrame:
    """``COUNT(*)``, and ``COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY group)``.

    ``group``/``category`` may be aliased Columns (e.g. an integer cast). Every observed category
    counts in the denominator. ``dedupe_on`` counts one row per key combination instead of per row.
    """
    df = dedupe(df, dedupe_on)
    counted = df.groupBy(group, category).agg(F.count(F.lit(1)).alias(count_as))
    gname = group if isinstance(group, str) else counted.columns[0]
    return share_of_counts(counted, gname, count_as, share_as, digits)


def share_of_counts(counted: DataFrame, group: str | None, count_col: str, share_as: str = "share",
                    digits: int | None = 1) -> DataFrame:
    """``n * 100.0 / SUM(n) OVER (PARTITION BY group)`` over pre-aggregated counts (W4);
    ``group=None`` is the grand total ``OVER ()`` (W3)."""
    w = Window.partitionBy(group) if group is not None else Window.partitionBy()
    return counted.withColumn(share_as, percent(F.col(count_col), F.sum(count_col).over(w), digits))


def share_of_total(df: DataFrame, category: str | Column, count_as: str = "n", share_as: str = "share",
                   digits: int | None = 1, dedupe_on: Sequence[str] | None = None) -> DataFrame:
    """``COUNT(*)`` and ``COUNT(*) * 100.0 / SUM(COUNT(*)) OVER ()`` per category.

    The empty window runs in one task over at most #categories rows."""
    df = dedupe(df, dedupe_on)
    counted = df.groupBy(category).agg(F.count(F.lit(1)).alias(count_as))
    return share_of_counts(counted, None, count_as, share_as, digits)
