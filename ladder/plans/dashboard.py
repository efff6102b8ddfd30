"""One dashboard refresh: every registered result, with the statements computed once and shared.

The statements over the panel come from one pass over it (``incremental.stored_state``), kept beside it, instead of a scan
each. The statement results are small (bounded by the category domains), so they are persisted and every
derived output (dense matrices, chart documents, KPI rows) is planned on top of them: Spark's cache manager substitutes
the persisted result wherever an identical plan fragment appears. A lost block is recomputed from lineage, so the
refresh survives executor loss. The plans are the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ladder.plans.incremental import statements, stored_state
from ladder.plans.queries import QUERIES
from ladder.sources.run import Run

STATEMENTS = [
    "income_by_decile", "asset_by_decile", "expected_rate_by_income_band", "child_education_share",
    "graduate_rate_by_cohort", "wage_by_education", "education_employment_share",
    "education_firm_size_share", "education_job_status_share", "wage_by_firm_size", "wage_by_job_status",
    "net_asset_by_job_status", "employment_mobility_share", "income_asset_change_by_decile",
    "asset_gap_ratio_trend", "debt_by_generation", "escape_and_retention_trend", "mobility_share",
    "income_transition_matrix", "upper_retention_kpi", "latest_year",
]


@contextmanager
def shared_statements(spark: SparkSession, sf_dir: str) -> Iterator[Run]:
    """A ``Run`` over ``sf_dir`` whose statements are persisted for the duration of the block: queries called with it
    compute each statement once (the first to need one fills it) and share the pass over the panel. At the end of the block
    ``InputChanged`` is raised if an input file was replaced meanwhile."""
    base = Run(sf_dir, relations=sf_dir.relations, city=sf_dir.city) if isinstance(sf_dir, Run) else Run(sf_dir)
    held = []
    run = Run(sf_dir, given=statements(stored_state(spark, base)), relations=base.relations, city=base.city)
    run._built.update(base._built)  # the scans and derived tables found so far
    run._pinned = base._pinned
    try:
        held += [QUERIES[name](spark, run, ordered=False).persist(StorageLevel.MEMORY_AND_DISK) for name in STATEMENTS]
        yield run
        run.verify()
    finally:
        for df in held:
            df.unpersist()


def dashboard(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The registered results as DataFrames; with the ``Run`` of a ``shared_statements`` block as ``sf_dir`` planned to
    reuse its statement results, else computed independently."""
    return {name: QUERIES[name](spark, sf_dir) for name in (names or list(QUERIES))}


def run_all(actions, workers: int = 1) -> list:
    """Run zero-argument Spark actions, ``workers`` at a time; results in input order."""
    if workers <= 1:
        return [a() for a in actions]
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(lambda a: a(), actions))
