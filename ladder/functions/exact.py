"""Sums and means of doubles that don't depend on the order or the partitions of the rows.

A double is cut, towards zero, into whole multiples of 2**32, whole units and whole multiples of 2**-52. Each part is a
whole number, and parts are added as decimals, exactly, so any grouping of partial sums gives the same three totals, and
states of separate runs merge by addition. The cut loses nothing of a value of magnitude 1 or more (or of any multiple of
2**-52); of a smaller one what lies below 2**-52 is dropped, alike for every row. The value is rounded when it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladder.functions.columns import col_of

_BIG, _UNIT = float(2**32), float(2**52)
#: Values of at least this magnitude, NaN and infinities are added as doubles, in a part of their own.
LIMIT = float(2**90)
PARTS = ("big", "unit", "small", "wild")


def _cut(x: Column) -> dict[str, Column]:
    tame = F.abs(x) < LIMIT  # not for NaN, which is larger than any number here
    x = x.cast("double")
    big = (x / _BIG).cast("bigint")
    rest = x - big * F.lit(_BIG)
    unit = rest.cast("bigint")
    small = ((rest - unit) * _UNIT).cast("bigint")
    parts = {name: F.when(tame, part).cast("decimal(20,0)") for name, part in
             (("big", big), ("unit", unit), ("small", small))}
    return parts | {"wild": F.when(~tame, x)}


def exact_state(x: str | Column, name: str, when: Column | None = None) -> list[Column]:
    """The aggregates that make up the exact sum of ``x`` (over rows where ``when`` holds), named ``<name>_<part>``;
    NULLs don't count."""
    x = col_of(x)
    x = x if when is None else F.when(when, x)
    return [F.sum(part).alias(f"{name}_{kind}") for kind, part in _cut(x).items()]


def state_columns(names: Sequence[str]) -> list[str]:
    return [f"{name}_{kind}" for name in names for kind in PARTS]


def merged_state(names: Sequence[str]) -> list[Column]:
    """Aggregates that merge states: the parts added up, under their own names."""
    return [F.sum(c).alias(c) for c in state_columns(names)]


def _total(big: Column, unit: Column, small: Column, wild: Column) -> Column:
    tame = big.cast("double") * _BIG + unit.cast("double") + small.cast("double") / _UNIT
    return F.when(wild.isNull(), tame).otherwise(wild + F.coalesce(tame, F.lit(0.0)))


def state_total(name: str) -> Column:
    """The sum held in a state's columns; NULL if no value went in."""
    return _total(*[F.col(f"{name}_{kind}") for kind in PARTS])


def exact_sum(x: str | Column) -> Column:
    """Aggregate: the sum of ``x``; NULL over no values."""
    return _total(*[F.sum(part) for part in _cut(col_of(x)).values()])


def exact_mean(x: str | Column) -> Column:
    """Aggregate: the mean of ``x``; NULL over no values."""
    x = col_of(x)
    return F.try_divide(exact_sum(x), F.count(x))
