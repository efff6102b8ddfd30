"""Grouped aggregates (A1-A7, A12, A13). Every one is a plain ``groupBy().agg()``: Spark aggregates
partially on the map side, so only one row per group and task reaches the shuffle, whatever the skew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladder.functions.columns import col_of, count_when, percent
from ladder.functions.exact import exact_mean, exact_state, exact_sum, merged_state, state_total


def _keys(keys) -> list:
    if keys is None:
        return []
    if isinstance(keys, (str, Column)):
        return [keys]
    return list(keys)


def dedupe(df: DataFrame, dedupe_on: Sequence[str] | None) -> DataFrame:
    """Keep one row per ``dedupe_on`` combination (e.g. household x year for household attributes on a
    person-grain panel); ``None`` keeps the rows as they are. A partially aggregated hash aggregate."""
    return df.dropDuplicates(list(dedupe_on)) if dedupe_on else df


def mean_by(df: DataFrame, keys, measure: str | Column, mean_as: str, digits: int | None = 1,
            count_as: str | None = None, positive: bool = False, not_null: bool = True,
            dedupe_on: Sequence[str] | None = None) -> DataFrame:
    """``SELECT keys, [COUNT(*)], ROUND(AVG(measure), digits) GROUP BY keys``.

    ``not_null`` drops rows whose measure is NULL, ``positive`` also rows with measure <= 0.
    Keys may be Columns (e.g. ``int_code('x').alias('k')``) to group by an expression.
    ``dedupe_on`` switches grain first (see ``dedupe``); the default keeps every row (person grain).
    """
    df = dedupe(df, dedupe_on)
    m = col_of(measure)
    if not_null:
        df = df.where(m.isNotNull())
    if positive:
        df = df.where(m > 0)
    mean = exact_mean(m)
    aggs = []
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    aggs.append((F.round(mean, digits) if digits is not None else mean).alias(mean_as))
    return df.groupBy(*_keys(keys)).agg(*aggs)


def weighted_mean_by(df: DataFrame, keys, x: str | Column, weight: str | Column, mean_as: str = "mean",
                     digits: int | None = None) -> DataFrame:
    """``SUM(x*w) / SUM(w)`` per group (A3). A NULL ``x`` leaves the numerator but keeps its weight in the
    denominator; a NULL key is its own group; a zero total weight gives NULL."""
    x, w = col_of(x), col_of(weight)
    mean = F.try_divide(exact_sum(x * w), exact_sum(w))
    return df.groupBy(*_keys(keys)).agg((F.round(mean, digits) if digits is not None else mean).alias(mean_as))


def weighted_sums(df: DataFrame, keys, x: str | Column, weight: str | Column) -> DataFrame:
    """Partial state of a weighted mean per group: the exact sums ``_sxw`` of x*w and ``_sw`` of w (``exact_state``).

    States merge by addition to the same weighted mean, so the state can be aggregated below a join (fewer rows
    shuffled, and a hot key collapses map-side) and finished with ``weighted_mean_from_sums``."""
    x, w = col_of(x), col_of(weight)
    return df.groupBy(*_keys(keys)).agg(*exact_state(x * w, "_sxw"), *exact_state(w, "_sw"))


def weighted_mean_from_sums(sums: DataFrame, keys, mean_as: str = "mean", digits: int | None = None) -> DataFrame:
    """Finish ``weighted_sums`` states (possibly re-grouped by coarser keys) into the weighted mean."""
    merged = sums.groupBy(*_keys(keys)).agg(*merged_state(["_sxw", "_sw"]))
    mean = F.try_divide(state_total("_sxw"), state_total("_sw"))
    return merged.select(*[c for c in merged.columns if not c.startswith("_s")],
                         (F.round(mean, digits) if digits is not None else mean).alias(mean_as))


def rate_by(df: DataFrame, keys, rates: Mapping[str, tuple[Column, Column]], digits: int | None = 1,
            dedupe_on: Sequence[str] | None = None) -> DataFrame:
    """Safe conditional ratios per group (A4, A6): for each ``alias -> (hit, eligible)`` the value
    ``ROUND(COUNT_IF(hit) * 100.0 / NULLIF(COUNT_IF(eligible), 0), digits)``."""
    df = dedupe(df, dedupe_on)
    aggs = [percent(count_when(hit), count_when(eligible), digits).alias(alias)
            for alias, (hit, eligible) in rates.items()]
    return df.groupBy(*_keys(keys)).agg(*aggs)


def share_of_rows(df: DataFrame, hit: Column, share_as: str, digits: int | None = 1) -> DataFrame:
    """``ROUND(COUNT_IF(hit) * 100.0 / COUNT(*), digits)`` over the whole frame, one row; NULL on no rows."""
    return df.agg(percent(count_when(hit), F.count(F.lit(1)), digits).alias(share_as))


def cohort_rate(df: DataFrame, keys, cohort: str | Column, indicator: str | Column,
                cohorts: Mapping[str, str], digits: int | None = 1) -> DataFrame:
    """Per group and cohort tag: the row count and the mean of a 0/1 indicator in percent (A4, A5).

    ``cohorts`` maps a tag value to an output prefix; output columns ``<prefix>_n`` (rows of the tag)
    and ``<prefix>_rate`` (``ROUND(AVG(indicator) * 100, digits)`` over the tag's rows, NULL when none).
    Rows of tags outside ``cohorts`` count in neither.
    """
    c, ind = col_of(cohort), col_of(indicator)
    aggs = []
    for tag, prefix in cohorts.items():
        is_tag = c == F.lit(tag)
        rate = exact_mean(F.when(is_tag, ind)) * F.lit(100)
        aggs.append(count_when(is_tag).alias(f"{prefix}_n"))
        aggs.append((F.round(rate, digits) if digits is not None else rate).alias(f"{prefix}_rate"))
    return df.groupBy(*_keys(keys)).agg(*aggs)


def pivot_max(df: DataFrame, keys, selector: str | Column,
              cases: Mapping[str, tuple[object, str | Column]]) -> DataFrame:
    """Pivot by conditional max (A8): ``MAX(CASE WHEN selector = v THEN x END) AS alias`` per case."""
    sel = col_of(selector)
    aggs = [F.max(F.when(sel == (v if isinstance(v, Column) else F.lit(v)), col_of(x))).alias(alias)
            for alias, (v, x) in cases.items()]
    return df.groupBy(*_keys(keys)).agg(*aggs)


def group_order(df: DataFrame, *cols: str | Column) -> DataFrame:
    """ORDER BY with NULLs first, as the source SQL engine does on ascending keys (O1, O2)."""
    return df.orderBy(*[col_of(c).asc_nulls_first() for c in cols])
