"""Column -> Column helpers. All are built-in Spark expressions (JVM side, inside codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest numeric prefix after leading whitespace: sign, digits with optional fraction (or a bare
# fraction), optional exponent. Lets '68.5%' read as 68.5 and '1e2x' as 100.
_NUMERIC_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_code(c: str | Column) -> Column:
    """Integer code stored as a real: truncates toward zero like ``CAST(x AS INTEGER)``."""
    return col_of(c).cast("int")


def lenient_double(c: str | Column) -> Column:
    """Text to double the lenient way: the longest numeric prefix, 0.0 when there is none.

    NULL stays NULL. '68.5%' -> 68.5, '-' -> 0.0, 'abc' -> 0.0, ' 70 ' -> 70.0, '.5' -> 0.5,
    '\t5' -> 5.0 (any leading whitespace is skipped, as a C-style text-to-real cast does).
    """
    c = col_of(c)
    prefix = F.regexp_extract(c, _NUMERIC_PREFIX, 1)
    parsed = F.coalesce(F.nullif(prefix, F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(c.isNotNull(), parsed)


def rank_of(c: str | Column, domain: Sequence) -> Column:
    """1-based position of ``c`` in ``domain``; NULL for values outside it (a CASE without ELSE) (P10, O2)."""
    c = col_of(c)
    expr = None
    for pos, value in enumerate(domain, start=1):
        expr = F.when(c == F.lit(value), F.lit(pos)) if expr is None else expr.when(c == F.lit(value), F.lit(pos))
    return expr if expr is not None else F.lit(None).cast("int")


def percent(num: str | Column, den: str | Column, digits: int | None = 1) -> Column:
    """round(num * 100.0 / den, digits) as double; NULL when den is 0."""
    value = F.try_divide(col_of(num).cast("double") * F.lit(100.0), col_of(den))
    return F.round(value, digits) if digits is not None else value


def count_when(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as bigint (0 on no match, never NULL on rows) (A4)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def first_digit(c: str | Column) -> Column:
    """First character of the decimal text of an id: ``SUBSTR(CAST(id AS TEXT), 1, 1)``."""
    return F.substring(col_of(c).cast("string"), 1, 1)
