"""The latest-year statements from one pass, for a dashboard refresh.

Twelve statements read the latest-year slice of the panel, each with its own key and row filter. Run one by one, a
refresh scans that slice twelve times. Here one aggregate by the six codes keeps, per combination of codes, the count
and sum that each statement needs (its row filter sits inside its own conditional aggregates). The statements are
rolled up from that small table: a group exists for a statement only where its count is positive, exactly the groups
its filtered ``GROUP BY`` would form. Partial aggregation runs map-side, so hot keys collapse before the shuffle, and
the plan is the same at every size.

The registered queries keep their own lean plans (a single statement reads only its columns); a refresh is given
these results instead (``dashboard.shared_statements``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladder.functions.columns import count_when, int_code, percent
from ladder.functions.exact import exact_state, merged_state, state_total
from ladder.functions.labels import (
    EDU_LABELS,
    EMPLOYMENT_TYPE_LABELS,
    FIRM_SIZE_LABELS,
    JOB_STATUS_LABELS,
    MOBILITY_LABELS,
    UPPER_MIN_DECILE,
)
from ladder.operators.joins import label_of
from ladder.operators.shares import share_of_counts
from ladder.plans import queries as q

KEYS = ["decile", "education_group", "firm_size", "job_status", "employment_type", "mobility_type"]

# What each condition sums: counts alone need nothing.
MEASURES = {"income": "h_total_income", "asset": "h_total_asset", "edu_wage": "p_monthly_wage",
            "firm_wage": "p_monthly_wage", "status_wage": "p_monthly_wage", "status_asset": "h_net_asset"}


def _conditions() -> dict[str, Column]:
    c = F.col
    income, asset, wage = c("h_total_income"), c("h_total_asset"), c("p_monthly_wage")
    in_range = c("h_incomeq").between(1, 10)
    wage_ok = wage.isNotNull() & (wage > 0)
    return {
        "income": in_range & income.isNotNull() & (income > 0),
        "asset": in_range & asset.isNotNull(),
        "edu_wage": c("education_group").isNotNull() & wage_ok,
        "edu_emp": c("education_group").isNotNull() & c("p_employment_type").isNotNull(),
        "edu_firm": c("education_group").isNotNull() & c("p_firm_size").isNotNull(),
        "edu_status": c("education_group").isNotNull() & c("p_job_status").isNotNull(),
        "firm_wage": c("p_firm_size").isNotNull() & wage_ok,
        "status_wage": c("p_job_status").isNotNull() & wage_ok,
        "status_asset": c("p_job_status").isNotNull() & c("h_net_asset").isNotNull(),
        "emp_mobility": c("p_employment_type").isNotNull() & c("income_mobility_type").isNotNull(),
        "mobility": c("income_mobility_type").isNotNull(),
        "retention": (c("year_gap") == 1) & (c("prev_income_decile") >= UPPER_MIN_DECILE)
        & c("h_incomeq").isNotNull(),
    }


@q.query()
def latest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of every latest-year statement per combination of the six codes (one scan of the slice)."""
    return cells_of(q._latest(spark, sf_dir), KEYS, _conditions(), MEASURES)


def cells_of(rows: DataFrame, keys: list[str], cond: dict[str, Column], measures: dict[str, str]) -> DataFrame:
    """Per combination of ``keys``: ``n_<name>`` rows of each condition, the exact state ``s_<name>`` of its measure,
    and the retained of the retention condition."""
    base = rows.select(
        int_code("h_incomeq").alias("decile"), "education_group",
        int_code("p_firm_size").alias("firm_size"), int_code("p_job_status").alias("job_status"),
        int_code("p_employment_type").alias("employment_type"),
        F.col("income_mobility_type").alias("mobility_type"),
        *[c.alias(f"_c_{name}") for name, c in cond.items()],
        *[k for k in keys if k not in KEYS], *sorted({*measures.values(), "h_incomeq"}),
    )
    flag = {name: F.col(f"_c_{name}") for name in cond}
    aggs = [count_when(flag[name]).alias(f"n_{name}") for name in cond]
    for name, x in measures.items():
        aggs += exact_state(x, f"s_{name}", flag[name])
    aggs.append(count_when(flag["retention"] & (F.col("h_incomeq") >= UPPER_MIN_DECILE)).alias("hits_retention"))
    return base.groupBy(*keys).agg(*aggs)


def _part(cells: DataFrame, measure: str, *keys: str) -> DataFrame:
    """The cells rolled up to ``keys``: ``n_<measure>`` and, where it is summed, ``m_<measure>``."""
    n = F.sum(f"n_{measure}")
    aggs = [n.alias(f"n_{measure}")]
    if measure in MEASURES:
        aggs += merged_state([f"s_{measure}"])
    part = cells.groupBy(*keys).agg(*aggs).where(F.col(f"n_{measure}") > 0)
    if measure in MEASURES:
        part = part.withColumn(f"m_{measure}", F.try_divide(state_total(f"s_{measure}"), F.col(f"n_{measure}")))
    return part


def _mean(cells, measure, key, mean_as, count_as=None, labels=None, label_as=None):
    part = _part(cells, measure, key)
    cols = [key] + ([F.col(f"n_{measure}").alias(count_as)] if count_as else [])
    cols.append(F.round(F.col(f"m_{measure}"), 1).alias(mean_as))
    if labels is not None:
        cols.append(label_of(key, labels).alias(label_as))
    return part.select(*cols)


def _share(cells, measure, group, category, labels=None, label_key=None, label_as=None):
    part = _part(cells, measure, *([group] if group else []), category).select(
        *([group] if group else []), category, F.col(f"n_{measure}").alias("n_persons"))
    out = share_of_counts(part, group, "n_persons", "share", 1)
    return out.withColumn(label_as, label_of(label_key, labels)) if labels is not None else out


def fused_statements(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The twelve latest-year statements as roll-ups of ``latest_cells`` (unordered, with the same
    columns and values as the registered plans)."""
    return statements_of(latest_cells(spark, sf_dir))


def statements_of(cells: DataFrame) -> dict[str, DataFrame]:
    """The twelve latest-year statements from any rows of counts and states per codes, whole or partial ones."""
    retention = cells.agg(F.coalesce(
        percent(F.sum("hits_retention"), F.sum("n_retention"), 1), F.lit(0.0)).alias("upper_retention"))
    return {
        "income_by_decile": _mean(cells, "income", "decile", "avg_household_income"),
        "asset_by_decile": _mean(cells, "asset", "decile", "avg_total_asset"),
        "wage_by_education": _mean(cells, "edu_wage", "education_group", "avg_monthly_wage",
                                   "n_samples", EDU_LABELS, "education_label"),
        "education_employment_share": _share(cells, "edu_emp", "education_group",
                                             "employment_type", EDU_LABELS, "education_group", "education_label"),
        "education_firm_size_share": _share(cells, "edu_firm", "education_group",
                                            "firm_size", EDU_LABELS, "education_group", "education_label"),
        "education_job_status_share": _share(cells, "edu_status", "education_group",
                                             "job_status", EDU_LABELS, "education_group", "education_label"),
        "wage_by_firm_size": _mean(cells, "firm_wage", "firm_size", "avg_monthly_wage",
                                   "n_samples", FIRM_SIZE_LABELS, "firm_size_label"),
        "wage_by_job_status": _mean(cells, "status_wage", "job_status", "avg_monthly_wage",
                                    "n_samples", JOB_STATUS_LABELS, "job_status_label"),
        "net_asset_by_job_status": _mean(cells, "status_asset", "job_status", "avg_net_asset",
                                         "n_samples", JOB_STATUS_LABELS, "job_status_label"),
        "employment_mobility_share": _share(cells, "emp_mobility", "employment_type",
                                            "mobility_type", EMPLOYMENT_TYPE_LABELS, "employment_type",
                                            "employment_label"),
        "mobility_share": _share(cells, "mobility", None, "mobility_type", MOBILITY_LABELS,
                                 "mobility_type", "mobility_label"),
        "upper_retention_kpi": retention,
    }
