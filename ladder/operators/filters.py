"""Period filters (F1, F2). The bounds come from uncorrelated scalar subqueries over the whole source,
executed once per query; on ``year``-partitioned storage the scan prunes to the selected periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_period(df: DataFrame, period: str = "year", source: DataFrame | None = None) -> DataFrame:
    """Rows of the latest period: ``period = (SELECT MAX(period) FROM source)``.

    The maximum is taken over the whole ``source`` (default: ``df``), before any other filter.
    """
    src = df if source is None else source
    return df.where(F.col(period) == src.select(F.max(period)).scalar())


def period_bounds(df: DataFrame, period: str = "year"):
    """(first, last) period as Columns read from one scalar subquery returning both bounds."""
    bounds = df.select(F.struct(F.min(period).alias("lo"), F.max(period).alias("hi"))).scalar()
    return bounds.getField("lo"), bounds.getField("hi")


def endpoints(df: DataFrame, period: str = "year", source: DataFrame | None = None) -> DataFrame:
    """Rows of the first and last period: ``period IN ((SELECT MIN ...), (SELECT MAX ...))``."""
    first, last = period_bounds(df if source is None else source, period)
    return df.where(F.col(period).isin(first, last))
