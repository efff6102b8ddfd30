"""The four derived test views with the shape of the reference's relations (see FIXTURES.md).

``panel`` (person x year) and ``parent_child`` (one row per customer) are materialised once per input
fingerprint; ``edu_spend`` and ``institution`` are lazy joins that Catalyst plans into each query.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladder.sources.run import run_of
from ladder.sources.store import materialize, write_scratch
from ladder.sources.tables import read_table, table_path

PANEL_SCHEMA = T.StructType([
    T.StructField("household_id", T.LongType()),
    T.StructField("person_no", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("h_total_income", T.DoubleType()),
    T.StructField("h_total_asset", T.DoubleType()),
    T.StructField("h_total_debt", T.DoubleType()),
    T.StructField("h_net_asset", T.DoubleType()),
    T.StructField("h_incomeq", T.DoubleType()),
    T.StructField("prev_income_decile", T.DoubleType()),
    T.StructField("year_gap", T.IntegerType()),
    T.StructField("income_mobility_type", T.StringType()),
    T.StructField("education_group", T.StringType()),
    T.StructField("p_employment_type", T.DoubleType()),
    T.StructField("p_firm_size", T.DoubleType()),
    T.StructField("p_job_status", T.DoubleType()),
    T.StructField("generation", T.StringType()),
    T.StructField("p_monthly_wage", T.DoubleType()),
    # True in one row of each household and year (with the same deciles and gap): household grain without a distinct.
    T.StructField("household_row", T.BooleanType()),
])
PANEL_INPUTS = ("orders", "customer")
PANEL_COLUMNS = [f.name for f in PANEL_SCHEMA.fields]

PARENT_CHILD_SCHEMA = T.StructType([
    T.StructField("student_id", T.LongType()),
    T.StructField("parent_quintile", T.DoubleType()),
    T.StructField("child_edu", T.IntegerType()),
    T.StructField("is_grad", T.IntegerType()),
])

# Fixture rule: market segment -> education group.
SEGMENT_TO_EDUCATION = [
    ("AUTOMOBILE", "elementary"),
    ("BUILDING", "middle_school"),
    ("FURNITURE", "high_school"),
    ("HOUSEHOLD", "college"),
    ("MACHINERY", "university"),
]

_RID_BITS = 33  # monotonically_increasing_id(): partition id in the upper bits, row index in the lower 33

# Materialised views are keyed by their inputs and by this module's source, so a changed derivation
# never reuses a table written by an older one.
_SOURCE_SALT = hashlib.sha1(Path(__file__).read_bytes()).hexdigest()[:12]


def exact_ntile(df: DataFrame, buckets: int, order_by: list[str], partition_by: list[str] = (),
                out: str = "ntile") -> DataFrame:
    """``NTILE(buckets) OVER (PARTITION BY partition_by ORDER BY order_by)`` without one task per group.

    A window partitioned by a low-cardinality key (a year) or by nothing sends a whole group through one
    task. Here the rows are range-partitioned and sorted on (partition_by, order_by), numbered inside
    each partition, and written once (so the numbers are fixed and lineage is cut). The size of every
    (partition, group) block goes into a table with at most #partitions + #groups rows; a running sum
    over it gives each block's offset inside its group, hence every row's rank and group size, and the
    SQL-standard bucket follows in closed form (the first ``n % buckets`` buckets hold one row more).
    ``order_by`` must make the order total, as for a deterministic NTILE. Intended for few groups.
    The numbered rows are written once under the shared checkpoint folder (``write_scratch``).
    """
    partition_by = list(partition_by)
    keys = partition_by + list(order_by)
    numbered = write_scratch(
        df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
        .withColumn("_rid", F.monotonically_increasing_id())
    )
    numbered = (
        numbered.withColumn("_pid", F.shiftright("_rid", _RID_BITS))
        .withColumn("_idx", F.col("_rid").bitwiseAND(F.lit((1 << _RID_BITS) - 1)))
    )
    blocks = numbered.groupBy("_pid", *partition_by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    by_group = Window.partitionBy(*partition_by) if partition_by else Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "_pid", *partition_by, "_first",
        F.coalesce(F.sum("_n").over(by_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_n").over(by_group).alias("_total"),
    )
    # At most #partitions + #groups rows. Written, so that the planner joins by its real size: an estimate taken from
    # the inputs would shuffle the numbered rows.
    blocks = write_scratch(blocks)
    cond = numbered["_pid"] == blocks["_pid"]
    for k in partition_by:
        cond = cond & numbered[k].eqNullSafe(blocks[k])
    joined = numbered.join(blocks, cond).select(
        numbered["*"], blocks["_first"], blocks["_before"], blocks["_total"])
    rank = F.col("_before") + (F.col("_idx") - F.col("_first")) + F.lit(1)
    n = F.col("_total")
    q = F.floor(n / F.lit(buckets)).cast("bigint")
    m = n % F.lit(buckets)
    big = m * (q + F.lit(1))
    bucket = F.when(rank <= big, F.floor((rank - F.lit(1)) / (q + F.lit(1))) + F.lit(1)).otherwise(
        m + F.floor((rank - big - F.lit(1)) / F.greatest(q, F.lit(1))) + F.lit(1))
    return joined.withColumn(out, bucket.cast("int")).drop("_rid", "_pid", "_idx", "_first", "_before", "_total")


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person x year panel with household attributes (FIXTURES.md §2.1), not materialised."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    # Partial (map-side) aggregation first: a customer holding a third of all orders still
    # reaches the shuffle as one row per map task and year.
    spend = orders.groupBy(
        F.col("o_custkey").alias("hid"), F.year("o_orderdate").cast("int").alias("year")
    ).agg(
        F.sum(price).alias("inc"),
        F.sum(F.when(F.col("o_orderstatus") == F.lit("O"), price)).alias("debt"),
    )
    ranked = exact_ntile(spend, 10, order_by=["inc", "hid"], partition_by=["year"], out="dec")
    by_household = Window.partitionBy("hid").orderBy("year")
    history = ranked.select(
        "hid", "year", "inc", "debt", "dec",
        F.sum("inc").over(by_household.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("ast"),
        F.lag("dec").over(by_household).alias("prv"),
        (F.col("year") - F.lag("year").over(by_household)).alias("gap"),
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    hh = history.join(customer, history["hid"] == customer["c_custkey"]).drop("c_custkey")
    persons = hh.withColumn(
        "person_no", F.explode(F.sequence(F.lit(1), (F.col("hid") % 3 + 1).cast("int"))))

    hid, person = F.col("hid"), F.col("person_no")
    dec, prv = F.col("dec"), F.col("prv")
    acct = F.col("c_acctbal")
    education = F.when(hid % 29 == 0, F.lit(None).cast("string"))
    for segment, group in SEGMENT_TO_EDUCATION:
        education = education.when(F.col("c_mktsegment") == F.lit(segment), F.lit(group))
    return persons.select(
        F.when(hid % 41 != 0, hid).alias("household_id"),
        person.alias("person_no"),
        F.col("year"),
        F.col("inc").cast("double").alias("h_total_income"),
        F.col("ast").cast("double").alias("h_total_asset"),
        F.col("debt").cast("double").alias("h_total_debt"),
        acct.alias("h_net_asset"),
        dec.cast("double").alias("h_incomeq"),
        prv.cast("double").alias("prev_income_decile"),
        F.col("gap").cast("int").alias("year_gap"),
        F.when(prv.isNull(), F.lit(None).cast("string"))
        .when(dec > prv, F.lit("upward"))
        .when(dec < prv, F.lit("downward"))
        .otherwise(F.lit("stable")).alias("income_mobility_type"),
        education.alias("education_group"),
        F.when(hid % 31 == 0, F.lit(9)).otherwise((hid + person) % 3 + 1).cast("double").alias("p_employment_type"),
        (F.col("c_nationkey") % 6 + 1).cast("double").alias("p_firm_size"),
        ((hid + person) % 5 + 1).cast("double").alias("p_job_status"),
        F.when(hid % 37 == 0, F.lit("other")).when(acct < 0, F.lit("young"))
        .when(acct < 5000, F.lit("middle")).otherwise(F.lit("senior")).alias("generation"),
        F.when(person == 3, F.lit(None).cast("double")).when(hid % 7 == 0, F.lit(0.0))
        .otherwise(F.col("inc").cast("double") / F.lit(12) / person).alias("p_monthly_wage"),
        ((person == 1) & (hid % 41 != 0)).alias("household_row"),
    )


def _derived(spark: SparkSession, sf_dir: str, name: str, inputs: tuple[str, ...], build, **how) -> DataFrame:
    """A derived table of the Run's pinned inputs, built once per their contents; the caller's own relation if given."""
    run = run_of(sf_dir)

    def make() -> DataFrame:
        own = run.own(name)
        if own is not None:
            return own
        for table in inputs:
            read_table(spark, run, table)
        paths = [table_path(run, table) for table in inputs]
        return materialize(spark, lambda: build(spark, run), f"{name}-{_SOURCE_SALT}", paths, files=run.files(*paths), **how)

    return run.once(name, make)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel view, materialised as Parquet partitioned by ``year`` (latest-year filters prune)."""
    return _derived(spark, sf_dir, "panel", PANEL_INPUTS, build_panel, schema=PANEL_SCHEMA,
                    partition_by=("year",), columns=PANEL_COLUMNS)


def panel_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's distinct ``year`` values (a handful of rows), aggregated from the panel once and stored beside it.

    Period bounds (``MAX(year)``, ``MIN(year)``) read this instead of scanning the panel in every query."""
    return _derived(spark, sf_dir, "panel_periods", PANEL_INPUTS, build_periods,
                    schema=T.StructType([T.StructField("year", T.IntegerType())]))


def build_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("year").distinct().coalesce(1)


def build_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with a parent-income quintile and child education (FIXTURES.md §2.4)."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    ranked = exact_ntile(cust, 5, order_by=["c_acctbal", "c_custkey"], out="q")
    key, level = F.col("c_custkey"), F.col("c_nationkey") % 6 + 1
    return ranked.select(
        ((key % 3 + 1) * 1000000 + key).cast("bigint").alias("student_id"),
        F.col("q").cast("double").alias("parent_quintile"),
        F.when(key % 11 != 0, level).cast("int").alias("child_edu"),
        F.when(key % 13 == 0, F.lit(None).cast("int")).when(level >= 5, F.lit(1)).otherwise(F.lit(0))
        .cast("int").alias("is_grad"),
    )


def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "parent_child", ("customer",), build_parent_child, schema=PARENT_CHILD_SCHEMA,
                    columns=[f.name for f in PARENT_CHILD_SCHEMA.fields])


def city_suppliers(spark: SparkSession, sf_dir: str, city: int | None = None) -> DataFrame:
    """(s_suppkey, n_regionkey) of the suppliers in ``city`` (all when None)."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    if city is not None:
        nat = nat.where(F.col("n_regionkey") == F.lit(city))
    return sup.join(nat, sup["s_nationkey"] == nat["n_nationkey"]).select("s_suppkey", "n_regionkey")


def edu_spend(spark: SparkSession, sf_dir: str, city: int | None = None) -> DataFrame:
    """lineitem x supplier x nation: (income_band, total_cost, weight, city). Lazy; Spark picks the joins by the
    tables' sizes."""
    own = run_of(sf_dir).own("edu_spend")
    if own is not None:
        return own if city is None else own.where(F.col("city") == F.lit(city))
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
    sup_city = city_suppliers(spark, sf_dir, city)
    return li.join(sup_city, li["l_suppkey"] == sup_city["s_suppkey"]).select(
        F.col("l_linenumber").alias("income_band"),
        F.col("l_extendedprice").alias("total_cost"),
        F.col("l_quantity").alias("weight"),
        F.col("n_regionkey").alias("city"),
    )


def institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer x nation: (name, city, rate_text) with NULL, '' and '-' rates mixed in."""
    own = run_of(sf_dir).own("institution")
    if own is not None:
        return own
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    key = F.col("c_custkey")
    rate = (
        F.when(key % 19 == 0, F.lit(None).cast("string"))
        .when(key % 17 == 0, F.lit(""))
        .when(key % 23 == 0, F.lit("-"))
        .otherwise(F.round(F.col("c_acctbal") / F.lit(100), 1).cast("string"))
    )
    return cust.join(nat, cust["c_nationkey"] == nat["n_nationkey"]).select(
        F.col("c_name").alias("name"), F.col("n_regionkey").alias("city"), rate.alias("rate_text"))


def build_views(spark: SparkSession, sf_dir: str, workers: int = 2) -> None:
    """Materialise the panel and the parent/child view; the two are independent and are built
    concurrently when ``workers`` > 1."""
    from concurrent.futures import ThreadPoolExecutor

    tasks = [lambda: panel(spark, sf_dir), lambda: parent_child(spark, sf_dir)]
    if workers <= 1:
        for t in tasks:
            t()
        return
    with ThreadPoolExecutor(max_workers=min(workers, len(tasks))) as pool:
        for f in [pool.submit(t) for t in tasks]:
            f.result()


def register_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Register the input tables and the four derived views as temp views, so statements can also be
    written in Spark SQL (``spark.sql("SELECT ... FROM panel ...")``). Returns the registered frames."""
    from ladder.sources.tables import load_views

    frames = load_views(spark, sf_dir)
    derived = {
        "panel": panel(spark, sf_dir),
        "parent_child": parent_child(spark, sf_dir),
        "edu_spend": edu_spend(spark, sf_dir),
        "institution": institution(spark, sf_dir),
    }
    for name, df in derived.items():
        df.createOrReplaceTempView(name)
    frames.update(derived)
    return frames
