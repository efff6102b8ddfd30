"""Dictionary lookups and scalar attachment (J1-J5, P11, P12). No join here carries a broadcast hint: Spark picks the
strategy from the tables' sizes, at plan time or adaptively."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladder.functions.columns import col_of

def label_of(code: str | Column, mapping: Mapping, fallback: bool = False) -> Column:
    """Label of a code from a fixed dictionary, as a literal map lookup inside codegen.

    Unmapped codes give NULL, or with ``fallback`` the code's own text (``dict.get(k, k)``).
    """
    c = col_of(code)
    pairs = []
    for k, v in mapping.items():
        pairs.extend([F.lit(k), F.lit(v)])
    label = F.try_element_at(F.create_map(*pairs), c)
    return F.coalesce(label, c.cast("string")) if fallback else label


def literal_frame(spark: SparkSession, rows: list[tuple], names: list[str],
                  types: list[T.DataType] | None = None) -> DataFrame:
    """A few literal rows as a DataFrame built inside the JVM plan (no Python worker, no RDD)."""
    types = types or [None] * len(names)

    def cell(v, t):
        c = F.lit(v)
        return c.cast(t) if t is not None else c

    structs = [F.struct(*[cell(v, t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows]
    if not structs:
        schema = ", ".join(f"{n} {(t or T.StringType()).simpleString()}" for n, t in zip(names, types))
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.inline(F.array(*structs)))


def attach_scalar(df: DataFrame, one_row: DataFrame, prefix: str = "") -> DataFrame:
    """Attach the single row of ``one_row`` to every row of ``df``.

    Runs as one uncorrelated scalar subquery (no join). As with an inner join on a constant predicate,
    an empty ``one_row`` empties the result; more than one row is an error.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.where(packed.isNotNull()).select(
        "*", *[packed.getField(c).alias(prefix + c) for c in one_row.columns])
