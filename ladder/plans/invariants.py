"""What must hold of a refresh's results, measured in the passes that write them.

``observed`` attaches the metrics to a result as observed metrics, so they come with the write and cost no job; ``problems``
says which don't hold. The same metrics are registered as a query of their own.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ladder.plans.queries import QUERIES as STATEMENTS
from ladder.sources.run import run_of

#: Share results and the column within whose values the shares add up to 100 (None: over all rows).
SHARES = {
    "child_education_share": "quintile", "education_employment_share": "education_group",
    "education_firm_size_share": "education_group", "education_job_status_share": "education_group",
    "employment_mobility_share": "employment_type", "income_transition_matrix": "prev_decile", "mobility_share": None}
#: Results and their label columns: a code without a label is dropped from the charts.
LABELS = {
    "wage_by_education": "education_label", "education_employment_share": "education_label",
    "education_firm_size_share": "education_label", "education_job_status_share": "education_label",
    "wage_by_firm_size": "firm_size_label", "wage_by_job_status": "job_status_label",
    "net_asset_by_job_status": "job_status_label", "employment_mobility_share": "employment_label",
    "mobility_share": "mobility_label"}
#: Results whose rows are keyed by an income decile, which must lie in 1..10.
DECILES = {"income_by_decile": "decile", "asset_by_decile": "decile", "income_asset_change_by_decile": "decile"}
#: The KPI and the trend's last point are the same number.
RETENTION = {"upper_retention_kpi": "max(upper_retention)", "escape_and_retention_trend": "max_by(upper_retention_rate, year)"}
#: How far rounded shares of one group may be from 100, per row of the group.
PER_ROW = 0.05


@dataclass(frozen=True)
class Problem:
    result: str
    metric: str
    value: float


def measured(df: DataFrame, name: str) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with what its metrics need (columns starting with ``_``), and the metrics as aggregates."""
    metrics = {"rows": F.count(F.lit(1))}
    if name in SHARES:
        group = Window.partitionBy(*([SHARES[name]] if SHARES[name] else []))  # over aggregated rows
        df = df.withColumn("_over", F.abs(F.sum("share").over(group) - 100) - PER_ROW * F.count(F.lit(1)).over(group))
        metrics["shares_off"] = F.count_if((F.col("_over") > 1e-6) | F.col("_over").isNull())
    if name in LABELS:
        metrics["unlabelled"] = F.count_if(F.col(LABELS[name]).isNull())
    if name in DECILES:
        metrics["deciles_off"] = F.count_if(~F.coalesce(F.col(DECILES[name]).between(1, 10), F.lit(False)))
    if name in RETENTION:
        metrics["retention"] = F.expr(RETENTION[name])
    return df, {k: v.cast("double") for k, v in metrics.items()}


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` whose next action also fills the observation with its metrics."""
    columns = df.columns
    extended, metrics = measured(df, name)
    watch = Observation(name)
    return extended.observe(watch, *[v.alias(k) for k, v in metrics.items()]).select(*columns), watch


def problems(metrics: Mapping[str, Mapping[str, float | None]]) -> list[Problem]:
    """The metrics that must be 0 and aren't, and a KPI that isn't the trend's last point. ``metrics``: by result."""
    found = [Problem(name, metric, value) for name, of in metrics.items() for metric, value in of.items()
             if metric in ("shares_off", "unlabelled", "deciles_off") and value]
    kpi, trend = (metrics.get(name, {}).get("retention") for name in RETENTION)
    if kpi is not None and trend is not None and abs(kpi - trend) > 1e-9:
        found.append(Problem("upper_retention_kpi", "retention", kpi - trend))
    return found


def refresh_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(result, metric, value) of every result with metrics, as a query."""
    run, out = run_of(sf_dir), None
    for name in dict.fromkeys([*SHARES, *LABELS, *DECILES, *RETENTION]):
        df, metrics = measured(STATEMENTS[name](spark, run, ordered=False), name)
        row = df.agg(*[v.alias(k) for k, v in metrics.items()])
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("m")
        rows = row.select(F.lit(name).alias("result"), pairs).select("result", "m.metric", "m.value")
        out = rows if out is None else out.unionAll(rows)
    return out


QUERIES = {"refresh_checks": refresh_checks}
