"""The caller's own relations (S1): any DataFrames with these contents, whatever their column names and types.

Each relation has a fixed schema. The caller names the source column of each target column (``rate(%)``, ``학생ID``; the
target's own name by default). Source types are checked when the plan is made; values are checked row by row: a row with a
value that doesn't fit its column's type isn't used, but goes to a quarantine table with what is wrong with it. The rows
are read once, and those that fit are written to the shared folder, the panel by year, as the derived views are.

    run = own_relations(spark, {"panel": df, "parent_child": df2}, columns={"parent_child": {"student_id": "학생ID"}})
    QUERIES["income_by_decile"](spark, run)
    run.quarantine.show()
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladder.functions.columns import int_code
from ladder.sources.run import Run
from ladder.sources.store import write_scratch
from ladder.sources.views import PANEL_COLUMNS, PANEL_SCHEMA, PARENT_CHILD_SCHEMA

MARKER = "household_row"
EDU_SPEND_SCHEMA = T.StructType([
    T.StructField("income_band", T.IntegerType()), T.StructField("total_cost", T.DoubleType()),
    T.StructField("weight", T.DoubleType()), T.StructField("city", T.StringType())])
INSTITUTION_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("rate_text", T.StringType())])
RELATIONS = {
    "panel": T.StructType([f for f in PANEL_SCHEMA.fields if f.name != MARKER]),
    "parent_child": PARENT_CHILD_SCHEMA, "edu_spend": EDU_SPEND_SCHEMA, "institution": INSTITUTION_SCHEMA}
#: Columns that no statement reads; null where the source has none.
OPTIONAL = {"panel": {"person_no"}, "institution": {"name"}}
QUARANTINE = "relation string, misfits array<string>, record string"
_WHOLE = {"int": (-2.0**31, 2.0**31), "bigint": (-2.0**63, 2.0**63)}


class OwnRelations(Run):
    """A Run over the caller's relations. ``quarantine``: (relation, misfits, record) of the rows that don't fit."""

    quarantine: DataFrame


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _value(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """The source column as the target's type; null where it doesn't fit. A blank text is null for a number."""
    kind = target.simpleString()
    if isinstance(target, T.StringType):
        return c.cast("string")
    if isinstance(source, T.StringType):
        text = F.trim(c)
        number = F.when(text != "", text.try_cast("double"))
        exact = text.try_cast("bigint")  # a double has too few digits for long ids
    else:
        number = c.cast("double")
        exact = c.cast("bigint") if isinstance(source, T.IntegralType) else F.lit(None).cast("bigint")
    if kind not in _WHOLE:
        return number
    low, high = _WHOLE[kind]
    fits = (number >= low) & (number < high)
    whole = F.when(fits & (number == F.floor(F.when(fits, number))), F.when(fits, number).cast("bigint"))
    value = F.coalesce(F.when(fits, exact), whole)
    return value.cast(kind)


def _given(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Whether there is a value that has to fit."""
    if isinstance(source, T.StringType) and not isinstance(target, T.StringType):
        return c.isNotNull() & (F.trim(c) != "")
    return c.isNotNull()


def conform(df: DataFrame, relation: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with the relation's columns and types, ``_misfits`` (array of ``column: value``, empty where the row fits)
    and ``_record`` (the source row as JSON where it doesn't).

    Raises ``ValueError`` for an unknown relation or target column, a source column that isn't there, or a type that
    can't hold the values (a date for a number, say). No rows give no rows; repeated rows stay.
    """
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}; there are {sorted(RELATIONS)}")
    schema, columns = RELATIONS[relation], dict(columns or {})
    if unknown := set(columns) - set(schema.names):
        raise ValueError(f"{relation} has no columns {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: columns.get(f.name, f.name) for f in schema.fields}
    missing = {t: s for t, s in wanted.items() if s not in kinds and not (t in OPTIONAL.get(relation, ()) and t not in columns)}
    if missing:
        raise ValueError(f"{relation}: the source has no columns {missing}; it has {df.columns}")
    out, misfits = [], []
    for f in schema.fields:
        if wanted[f.name] not in kinds:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c, source = _quoted(wanted[f.name]), kinds[wanted[f.name]]
        if not isinstance(source, (T.StringType, T.NumericType, T.NullType)) or (
                isinstance(source, T.NullType) and f.name not in OPTIONAL.get(relation, ())):
            raise ValueError(f"{relation}.{f.name}: {source.simpleString()} column {wanted[f.name]!r} can't be "
                             f"{f.dataType.simpleString()}")
        value = _value(c, source, f.dataType)
        out.append(value.alias(f.name))
        misfits.append(F.when(_given(c, source, f.dataType) & value.isNull(),
                              F.concat(F.lit(f"{f.name}: "), c.cast("string"))))
    bad = F.array_compact(F.array(*misfits))
    record = F.when(F.size(bad) > 0, F.to_json(F.struct(*[_quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    return df.select(*out, bad.alias("_misfits"), record.alias("_record"))


def with_household_row(panel: DataFrame) -> DataFrame:
    """Adds the marker ``household_row``: true in one row of each household and year with the same deciles and gap (as
    the transition matrix counts them), false elsewhere and where the household is null.

    Done once, when a panel is stored. ``panel`` must be a written table: its rows are numbered in place. A household with
    very many rows is one row per task before it is shuffled, and the marks are joined by row number, which has no hot value.
    """
    cur, prev = F.col("h_incomeq"), F.col("prev_income_decile")
    numbered = panel.withColumn("_at", F.monotonically_increasing_id())
    first = numbered.where(F.col("household_id").isNotNull()).groupBy(
        "household_id", "year", int_code(prev).alias("p"), int_code(cur).alias("c"), prev.between(1, 10).alias("pv"),
        cur.between(1, 10).alias("cv"), "year_gap").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias(MARKER))
    return (numbered.join(first, "_at", "left").withColumn(MARKER, F.coalesce(MARKER, F.lit(False)))
            .select(*PANEL_COLUMNS))


def own_relations(spark: SparkSession, relations: Mapping[str, DataFrame],
                  columns: Mapping[str, Mapping[str, str]] | None = None, city: Any = None) -> OwnRelations:
    """A Run over the caller's relations, usable wherever a folder of input tables is: every statement whose relations
    were given works; the others raise. ``city`` is the value of the spend and institution relations' city (as text).

    The tables are scratch tables of the shared folder and go when the session ends.
    """
    columns = columns or {}
    if unknown := set(columns) - set(relations):
        raise ValueError(f"columns of relations that were not given: {sorted(unknown)}")
    good: dict[str, DataFrame] = {}
    bad = spark.createDataFrame([], QUARANTINE)
    for name, df in relations.items():
        checked = conform(df, name, columns.get(name)).withColumn("_fits", F.size("_misfits") == 0)
        stored = write_scratch(checked, ("_fits",))
        good[name] = stored.where("_fits").select(*RELATIONS[name].names)
        bad = bad.unionByName(stored.where("NOT _fits").select(F.lit(name).alias("relation"), F.col("_misfits").alias("misfits"),
                                                               F.col("_record").alias("record")))
    if "panel" in good:
        good["panel"] = write_scratch(with_household_row(good["panel"]), ("year",)).select(*PANEL_COLUMNS)
        good["panel_periods"] = write_scratch(good["panel"].select("year").distinct().coalesce(1))
    run = OwnRelations(f"own:{uuid.uuid4().hex}", relations=good, city=None if city is None else str(city))
    run.quarantine = bad
    return run
