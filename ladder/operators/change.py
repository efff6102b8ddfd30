"""Change between the first and last period, and a top/bottom group ratio per period (Q14, Q15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladder.functions.columns import col_of, int_code
from ladder.functions.exact import exact_mean
from ladder.operators.aggregate import pivot_max
from ladder.operators.filters import endpoints, period_bounds


def change_between_endpoints(df: DataFrame, period: str, key: Column, measures: Mapping[str, str],
                             digits: int | None = 1, source: DataFrame | None = None) -> DataFrame:
    """Per key: ``(last - first) * 100.0 / NULLIF(first, 0)`` for each measure's group mean, where first
    and last are the means in the first and last period of ``source`` (default ``df``; pass the
    unfiltered table to take the bounds before other filters) (F2, A11, A8, J3, P8).

    ``key`` is an aliased Column (e.g. the integer decile); ``measures`` maps measure -> output name.
    Rows with a NULL measure must be filtered by the caller, as the reference does in its base CTE.
    """
    first, last = period_bounds(df if source is None else source, period)
    key_name = df.select(key).columns[0]
    means = endpoints(df, period, source).groupBy(F.col(period).alias("_p"), key).agg(
        *[exact_mean(m).alias(f"_m{i}") for i, m in enumerate(measures)])
    return change_of_means(means, key_name, list(measures.values()), first, last, digits)


def change_of_means(means: DataFrame, key_name: str, names: Sequence[str], first: Column, last: Column,
                    digits: int | None = 1) -> DataFrame:
    """``(last - first) * 100.0 / NULLIF(first, 0)`` per key from means ``_m0, _m1, ...`` per period ``_p`` and key."""
    ends = pivot_max(means, key_name, "_p", {
        f"_{side}{i}": (bound, f"_m{i}") for i in range(len(names)) for side, bound in (("s", first), ("e", last))})
    out = [key_name]
    for i, alias in enumerate(names):
        start, end = F.col(f"_s{i}"), F.col(f"_e{i}")
        ch = F.try_divide((end - start) * F.lit(100.0), start)
        out.append((F.round(ch, digits) if digits is not None else ch).alias(alias))
    return ends.select(*out)


def group_ratio_trend(df: DataFrame, period: str, key: str, measure: str, top: int = 10,
                      bottom: int = 1, digits: int | None = 2, period_as: str = "year",
                      ratio_as: str = "ratio") -> DataFrame:
    """Per period: mean of ``measure`` in group ``top`` over its mean in group ``bottom``
    (``NULLIF`` on a zero bottom), from a two-level aggregation (F4, A11, A8, P8).

    The raw ``key`` is filtered with ``IN (bottom, top)`` before the integer cast, so 10.5 is out;
    rows with a NULL measure are dropped.
    """
    base = df.where(F.col(key).isin(bottom, top) & F.col(measure).isNotNull())
    means = base.groupBy(F.col(period).alias(period_as), int_code(key).alias("_k")).agg(
        exact_mean(measure).alias("_m"))
    return ratio_of_means(means, period_as, top, bottom, digits, ratio_as)


def ratio_of_means(means: DataFrame, period_as: str, top: int, bottom: int, digits: int | None, ratio_as: str) -> DataFrame:
    """Per period the mean ``_m`` of group ``_k = top`` over that of ``bottom``; NULL for a zero or missing one."""
    pair = pivot_max(means, period_as, "_k", {"_top": (top, "_m"), "_bottom": (bottom, "_m")})
    r = F.try_divide(F.col("_top"), F.col("_bottom"))
    return pair.select(period_as, (F.round(r, digits) if digits is not None else r).alias(ratio_as))
