"""Pivots over fixed or observed category domains and chart/matrix encodings.

Inputs are aggregated results (rows x categories cells), so every step here moves few rows.

* ``dense_pivot`` (wide): ``groupBy().pivot(col, values)``; a listed row domain is a literal frame
  of a handful of rows, broadcast and left-joined, so missing rows appear as zeros and
  unlisted rows drop out.
* ``dense_grid`` (one row of arrays, what the registered matrices and documents use): one pass over the input, then
  array functions on its cells; lazy, no pivot job, no join. ``to_long`` explodes it. For code domains.
* ``dense_rows`` (long form, any number of observed rows): ranked keys, a scaffold and a join.
* ``to_chart`` / ``to_matrix``: the emitted nested encodings of a grid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladder.functions.exact import exact_mean, exact_sum
from ladder.operators.joins import label_of, literal_frame

_AGG = {"sum": exact_sum, "mean": exact_mean, "max": F.max, "min": F.min}


def _type_of(values: Sequence) -> T.DataType:
    return T.IntegerType() if all(isinstance(v, int) for v in values) else T.StringType()


def dense_pivot(df: DataFrame, row: str, col: str, value: str, rows: Sequence | None = None,
                cols: Sequence | None = None, agg: str = "sum", fill: float = 0.0) -> DataFrame:
    """Wide matrix: one row per row key, one column per column key (named by the key's text).

    ``rows``/``cols`` fix the domains (missing keys filled with ``fill``, unlisted keys dropped); with
    ``cols=None`` the observed column keys are used in ascending order, with ``rows=None`` the
    observed row keys. NULL keys are dropped, as a spreadsheet-style pivot does. A ``_row_pos`` column
    gives the row order.
    """
    data = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    grouped = data.groupBy(row)
    wide = (grouped.pivot(col, list(cols)) if cols is not None else grouped.pivot(col)).agg(_AGG[agg](value))
    value_cols = [c for c in wide.columns if c != row]
    if rows is not None:
        dom = literal_frame(df.sparkSession, [(v, i) for i, v in enumerate(rows, start=1)],
                            [row, "_row_pos"], [_type_of(rows), T.IntegerType()])
        # The domain is a literal list (a handful of rows): broadcast it, keep its rows.
        wide = F.broadcast(dom).join(wide, on=row, how="left")
    else:
        # Observed row keys in ascending order; the pivot has one row per key (a few rows).
        wide = wide.withColumn("_row_pos", F.dense_rank().over(Window.orderBy(F.col(row))))
    return wide.select(row, "_row_pos", *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(fill))).alias(c)
                                          for c in value_cols])


def dense_grid(df: DataFrame, row: str, col: str, value: str, rows: Sequence | None = None,
               cols: Sequence | None = None, agg: str = "sum", fill: float = 0.0,
               row_labels: Mapping | None = None, col_labels: Mapping | None = None,
               digits: int | None = 1) -> DataFrame:
    """Dense matrix as one row: ``row_labels, col_labels, values`` (one array per row), ``n_cells`` (observed ones) and
    ``raw`` (the rows of ``df`` in order of their columns) (R1-R3, J5, P14).

    Fixed ``rows``/``cols`` lists (missing cells filled with ``fill``, unlisted keys dropped) or, where None, the observed
    keys in ascending order. NULL keys are dropped from the matrix, not from ``raw``. ``df`` is read once: it is reduced
    to its cells, and the observed keys, the fill and the order come from the array of cells. Its size is bounded by the
    key domains. Labels come from the dictionaries with the key's own text as fallback.
    """
    cells = df.groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(
        _AGG[agg](value).cast("double").alias("v"), F.collect_list(F.struct(*df.columns)).alias("members"))
    known = F.col("r").isNotNull() & F.col("c").isNotNull()
    one = cells.agg(F.collect_list(F.when(known, F.struct("r", "c", "v"))).alias("cells"),
                    F.sort_array(F.flatten(F.collect_list("members"))).alias("raw"))

    def keys(listed: Sequence | None, name: str, dtype: T.DataType) -> Column:
        if listed is None:
            return F.array_sort(F.array_distinct(F.transform("cells", lambda x: x[name])))
        return F.array(*[F.lit(v).cast(dtype) for v in listed])

    def labels(key: Column, mapping: Mapping | None) -> Column:
        return label_of(key, mapping, fallback=True) if mapping else key.cast("string")

    found = F.map_from_entries(F.transform("cells", lambda x: F.struct(F.struct(x["r"].alias("r"), x["c"].alias("c")), x["v"])))
    one = one.select("raw", F.size("cells").alias("n_cells"), found.alias("found"),
                     keys(rows, "r", df.schema[row].dataType).alias("rows"),
                     keys(cols, "c", df.schema[col].dataType).alias("cols"))

    def cell(r: Column, c: Column) -> Column:
        v = F.coalesce(F.try_element_at(F.col("found"), F.struct(r.alias("r"), c.alias("c"))), F.lit(float(fill)))
        return F.round(v, digits) if digits is not None else v

    return one.select(
        F.transform("rows", lambda r: labels(r, row_labels)).alias("row_labels"),
        F.transform("cols", lambda c: labels(c, col_labels)).alias("col_labels"),
        F.transform("rows", lambda r: F.transform("cols", lambda c: cell(r, c))).alias("values"), "n_cells", "raw")


def to_long(grid: DataFrame) -> DataFrame:
    """A grid in long form: ``row_pos, row_label, col_pos, col_label, value``, positions from 1."""
    by_row = grid.select("row_labels", "col_labels", F.posexplode("values").alias("r", "row"))
    by_cell = by_row.select("row_labels", "col_labels", "r", F.posexplode("row").alias("c", "value"))
    return by_cell.select(
        (F.col("r") + 1).alias("row_pos"), F.get("row_labels", F.col("r")).alias("row_label"),
        (F.col("c") + 1).alias("col_pos"), F.get("col_labels", F.col("c")).alias("col_label"), "value")


def dense_long(df: DataFrame, *args, **kwargs) -> DataFrame:
    """``dense_grid`` in long form."""
    return to_long(dense_grid(df, *args, **kwargs))


def ranked_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, row_pos): the distinct non-null keys with their positions from 1 in ascending order, without one task that
    sees them all: keys are range-partitioned and numbered per partition, and the partitions' sizes (one row each) give
    the offsets. The numbered keys are written once, so that the numbers hold."""
    from ladder.sources.store import write_scratch

    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    numbered = write_scratch(keys.repartitionByRange("key").sortWithinPartitions("key")
                             .withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = write_scratch(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")))
    return numbered.withColumn("part", part).join(offsets, "part").select(
        "key", (F.col("before") + place + 1).alias("row_pos"))


def dense_rows(df: DataFrame, row: str, col: str, value: str, cols: Sequence, agg: str = "sum", fill: float = 0.0,
               col_labels: Mapping | None = None, digits: int | None = 1) -> DataFrame:
    """A dense matrix with any number of observed row keys, in long form: ``row_pos, row_label, col_pos, col_label,
    value`` (R2, R3 beyond the code domains). ``cols`` is a fixed list; cells of other columns and of NULL keys are
    dropped, but not their rows.

    The scaffold is the ranked row keys times a literal list, and the aggregated cells are joined to it: no cell array,
    no pivot, nothing that grows with the keys in one task. ``dense_grid`` is the one-row form for code domains.
    """
    kind = df.schema[col].dataType
    cells = df.where(F.col(row).isNotNull() & F.col(col).isin(*cols)).groupBy(
        F.col(row).alias("key"), F.col(col).alias("c")).agg(_AGG[agg](value).cast("double").alias("v"))
    listed = F.array(*[F.lit(c).cast(kind) for c in cols])
    scaffold = ranked_keys(df, row).select("key", "row_pos", F.posexplode(listed).alias("j", "c"))
    full = scaffold.join(cells, ["key", "c"], "left")
    v = F.coalesce("v", F.lit(float(fill)))
    label = label_of("c", col_labels, fallback=True) if col_labels else F.col("c").cast("string")
    return full.select("row_pos", F.col("key").cast("string").alias("row_label"), (F.col("j") + 1).alias("col_pos"),
                       label.alias("col_label"), (F.round(v, digits) if digits is not None else v).alias("value"))


def _or_empty(grid: DataFrame, value: Column, only_observed: bool) -> Column:
    """``value``, or an empty array where the grid has no rows or no columns (``only_observed``: no observed cell)."""
    kind = grid.select(value.alias("x")).schema["x"].dataType
    full = (F.size("row_labels") > 0) & (F.size("col_labels") > 0)
    if only_observed:
        full = full & (F.col("n_cells") > 0)
    return F.when(full, value).otherwise(F.array().cast(kind))


def to_chart(grid: DataFrame, raw: bool = False, empty: bool = False) -> DataFrame:
    """A grid -> one row ``struct<labels, datasets: array<struct<label, data>>[, raw]>`` (R4): one dataset per column
    key, values in row order. ``empty``: without observed cells labels and datasets are empty, too."""
    datasets = F.transform("col_labels", lambda label, j: F.struct(
        label.alias("label"), F.transform("values", lambda row: F.get(row, j)).alias("data")))
    return grid.select(F.struct(_or_empty(grid, F.col("row_labels"), empty).alias("labels"),
                                _or_empty(grid, datasets, empty).alias("datasets"),
                                *([F.col("raw")] if raw else [])).alias("chart"))


def to_matrix(grid: DataFrame, raw: bool = False) -> DataFrame:
    """A grid -> one row ``struct<rows, columns, values: array<array<double>>[, raw]>``."""
    parts = {"rows": "row_labels", "columns": "col_labels", "values": "values"}
    return grid.select(F.struct(*[_or_empty(grid, F.col(c), False).alias(k) for k, c in parts.items()],
                                *([F.col("raw")] if raw else [])).alias("matrix"))
