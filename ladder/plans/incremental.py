"""Results kept up to date from stored states: a refresh reads only the panel files that are new (S3).

The state is one small table of counts and exact sums per year and codes (and of household moves), which merge by
addition. Every refresh stores one batch: the state of the files it read. A manifest names the live batches and the files
of each, written last as one small file with the next number; of two refreshes at the same time one finds the number taken
and starts over with the other's batches. A file that was replaced or removed takes its batch with it: the batch's other
files are read again. Many batches are merged into one. Results are roll-ups of the state, with the same rows as a full
run over all files, whatever the order and the number of refreshes, as the sums are exact.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladder.functions.columns import percent
from ladder.functions.exact import merged_state, state_total
from ladder.functions.labels import LOWER_MAX_DECILE, UPPER_MIN_DECILE
from ladder.operators.change import change_of_means, ratio_of_means
from ladder.operators.shares import share_of_counts
from ladder.plans import fused
from ladder.sources import views
from ladder.sources.relations import conform
from ladder.sources.run import run_of
from ladder.sources.store import (
    delete_path,
    list_files,
    materialize,
    pinned_files,
    read_json,
    table_root,
    write_json,
    write_scratch,
)
from ladder.sources.tables import table_path
from ladder.sources.views import PANEL_SCHEMA

KEYS = ["year", *fused.KEYS, "generation"]
MEASURES = fused.MEASURES | {"both_income": "h_total_income", "both_asset": "h_total_asset", "end_asset": "h_total_asset",
                             "debt": "h_total_debt"}
#: Live batches beyond which a refresh merges them into one.
MOST_BATCHES = 16


def _conditions() -> dict[str, Column]:
    c = F.col
    both = c("h_incomeq").between(1, 10) & c("h_total_income").isNotNull() & c("h_total_asset").isNotNull()
    prev, cur = c("prev_income_decile"), c("h_incomeq")
    moved = (c("year_gap") == 1) & prev.isNotNull() & cur.isNotNull()
    return fused._conditions() | {
        "both_income": both, "both_asset": both,
        "end_asset": c("h_incomeq").isin(1, 10) & c("h_total_asset").isNotNull(),
        "debt": c("generation").isNotNull() & c("h_total_debt").isNotNull(),
        "moved": moved, "low": moved & (prev <= LOWER_MAX_DECILE), "left": moved & (prev <= LOWER_MAX_DECILE) & (cur > LOWER_MAX_DECILE),
        "high": moved & (prev >= UPPER_MIN_DECILE), "stayed": moved & (prev >= UPPER_MIN_DECILE) & (cur >= UPPER_MIN_DECILE),
    }


def state_of(panel: DataFrame) -> DataFrame:
    """The state of panel rows: per year and codes the counts and exact sums of every statement (``prev`` is null), and
    per previous decile and decile the marked household rows, ``n_moves`` (where there is a marker)."""
    cells = fused.cells_of(panel, KEYS, _conditions(), MEASURES).withColumn("prev", F.lit(None).cast("int"))
    if "household_row" not in panel.columns:
        return cells.withColumn("n_moves", F.lit(None).cast("long"))
    prev, cur = F.col("prev_income_decile"), F.col("h_incomeq")
    moves = panel.where(F.col("household_row") & (F.col("year_gap") == 1) & prev.between(1, 10) & cur.between(1, 10)).groupBy(
        "year", cur.cast("int").alias("decile"), prev.cast("int").alias("prev")).agg(F.count(F.lit(1)).alias("n_moves"))
    return cells.unionByName(moves, allowMissingColumns=True)


def merge(state: DataFrame) -> DataFrame:
    """States of several batches as one."""
    keys = [*KEYS, "prev"]
    counts = [c for c in state.columns if c.startswith(("n_", "hits_"))]
    merged = state.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], *merged_state([f"s_{m}" for m in MEASURES]))
    return merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in state.schema.fields])


def statements(state: DataFrame) -> dict[str, DataFrame]:
    """The statements over the panel as roll-ups of a state (unordered; columns and values of the registered plans)."""
    cells, moves = state.where("prev IS NULL"), state.where("prev IS NOT NULL")
    last = cells.select(F.max("year")).scalar()
    out = fused.statements_of(cells.where(F.col("year") == last))

    def means(name: str, *keys: str) -> DataFrame:
        part = cells.groupBy(*keys).agg(F.sum(f"n_{name}").alias("n"), *merged_state([f"s_{name}"])).where("n > 0")
        return part.select(*keys, F.try_divide(state_total(f"s_{name}"), F.col("n")).alias("m"))

    ends = cells.select(F.struct(F.min("year").alias("lo"), F.max("year").alias("hi"))).scalar()
    both = means("both_income", "year", "decile").withColumnRenamed("m", "_m0").join(
        means("both_asset", "year", "decile").withColumnRenamed("m", "_m1"), ["year", "decile"])
    out["income_asset_change_by_decile"] = change_of_means(
        both.withColumnRenamed("year", "_p"), "decile", ["income_change_pct", "asset_change_pct"], ends["lo"], ends["hi"])
    out["asset_gap_ratio_trend"] = ratio_of_means(
        means("end_asset", "year", "decile").select("year", F.col("decile").alias("_k"), F.col("m").alias("_m")), "year", 10, 1, 2,
        "asset_gap_ratio")
    out["debt_by_generation"] = means("debt", "year", "generation").select(
        "year", "generation", F.round("m", 1).alias("avg_debt"))
    trend = cells.groupBy("year").agg(*[F.sum(f"n_{n}").alias(n) for n in ("low", "left", "high", "stayed")],
                                      F.sum("n_moved").alias("moved"))
    out["escape_and_retention_trend"] = trend.where("moved > 0").select(
        "year", percent("left", "low").alias("lower_escape_rate"), percent("stayed", "high").alias("upper_retention_rate"))
    counted = moves.groupBy(F.col("prev").alias("prev_decile"), F.col("decile").alias("cur_decile")).agg(
        F.sum("n_moves").alias("n_households"))
    out["income_transition_matrix"] = share_of_counts(counted, "prev_decile", "n_households")
    out["latest_year"] = cells.agg(F.max("year").alias("latest_year"))
    return out


_SALT = hashlib.sha1(b"".join(Path(m.__file__).read_bytes() for m in (fused, views)) + Path(__file__).read_bytes()).hexdigest()[:12]


def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a Run's whole panel, built in one pass and kept beside it like the panel itself."""
    run = run_of(sf_dir)

    def build() -> DataFrame:
        panel = views.panel(spark, run)
        if run.relations is not None:
            return write_scratch(state_of(panel))
        schema = state_of(panel).schema
        paths = [table_path(run, t) for t in views.PANEL_INPUTS]
        return materialize(spark, lambda: state_of(panel), f"panel_state-{_SALT}", paths, schema=schema, files=run.files(*paths))

    return run.once("panel_state", build)


class StoredPanel:
    """A panel kept as files in one folder, to which files are added; its results come from stored states.

    ``columns`` names the source's columns as ``own_relations`` does; rows that don't fit are left out and counted in
    ``quarantined`` of the last refresh's batch. Files hold whole household-years if the transition matrix is wanted, which
    needs a ``household_row`` column.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, columns: Mapping[str, str] | None = None):
        self.spark, self.folder, self.columns = spark, folder, columns
        self.root = f"{table_root(spark)}/states/{name}"
        #: Files to go by in place of all that are there.
        self.only: list[tuple[str, int, int]] | None = None

    def _manifest(self) -> tuple[int, list[dict]]:
        numbers = [int(p.rpartition("/")[2][:-5]) for p, _, _ in list_files(self.spark, self.root) if p.endswith(".json")]
        for number in sorted(numbers, reverse=True):
            found = read_json(self.spark, f"{self.root}/{number:08d}.json")
            if found is not None:
                return max(numbers), found["batches"]
        return max(numbers, default=0), []

    def refresh(self) -> DataFrame:
        """Read the files that no live batch holds, store their state, and return the whole state."""
        while True:
            rows = self.spark.read.parquet(self.folder)
            files = [list(f) for f in pinned_files(rows) if self.only is None or f in self.only]
            number, batches = self._manifest()
            there = set(map(tuple, files))
            live = [b for b in batches if there.issuperset(map(tuple, b["files"]))]
            known = {tuple(f) for b in live for f in b["files"]}
            new = [f for f in files if tuple(f) not in known]
            if not new and len(live) == len(batches) and batches:
                return self.state(live)
            data = uuid.uuid4().hex
            if new or not live:
                self._read(rows, [f[0] for f in new]).write.parquet(f"{self.root}/{data}")
                live = [*live, {"data": data, "files": new}]
            if len(live) > MOST_BATCHES:
                whole = uuid.uuid4().hex
                merge(self.state(live)).write.parquet(f"{self.root}/{whole}")
                live = [{"data": whole, "files": [f for b in live for f in b["files"]]}]
            if write_json(self.spark, f"{self.root}/{number + 1:08d}.json", {"batches": live}):
                self._forget(number + 1, batches, live)
                return self.state(live)

    def _read(self, rows: DataFrame, paths: list[str]) -> DataFrame:
        # The folder's own schema, partition columns included; only the new files are listed and read.
        df = self.spark.read.schema(rows.schema).option("basePath", self.folder).parquet(*paths) if paths else rows.limit(0)
        good = conform(df, "panel", self.columns).where(F.size("_misfits") == 0)
        if "household_row" in df.columns:
            checked = conform(df.withColumn("_mark", F.col("household_row").cast("int")), "panel",
                              dict(self.columns or {}) | {"person_no": "_mark"})
            good = checked.where(F.size("_misfits") == 0).withColumn("household_row", F.col("person_no") == 1)
        return state_of(good)

    def state(self, batches: list[dict] | None = None) -> DataFrame:
        """The whole state: the live batches' rows (a roll-up adds them up). No batches: an empty state."""
        batches = self._manifest()[1] if batches is None else batches
        paths = [f"{self.root}/{b['data']}" for b in batches]
        schema = state_of(self.spark.createDataFrame([], PANEL_SCHEMA)).schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _forget(self, number: int, before: list[dict], live: list[dict]) -> None:
        """Data that neither this manifest nor the one before names, and manifests before that, have no readers to come."""
        named = {b["data"] for b in [*before, *live]}
        keep = {f"{n:08d}.json" for n in (number, number - 1)}
        for path in {p.removeprefix(self._absolute()).lstrip("/").split("/")[0] for p, _, _ in list_files(self.spark, self.root)}:
            if path.endswith(".json") and path not in keep and path < f"{number:08d}.json":
                delete_path(self.spark, f"{self.root}/{path}")
            elif not path.endswith((".json", ".crc")) and path not in named and self._old(path):
                delete_path(self.spark, f"{self.root}/{path}")

    def _absolute(self) -> str:
        from ladder.sources.store import _absolute

        return _absolute(self.spark, self.root)

    def _old(self, data: str) -> bool:
        """Whether a data folder was named by an earlier manifest that is still there (another refresh's is not)."""
        return any(b["data"] == data for p, _, _ in list_files(self.spark, self.root) if p.endswith(".json")
                   for b in (read_json(self.spark, p) or {"batches": []})["batches"])

    def statements(self) -> dict[str, DataFrame]:
        """Refresh, then every statement over the panel from the state."""
        return statements(self.refresh())


#: Statements registered from stored states, in two refreshes of the derived panel's files.
REGISTERED = ("income_by_decile", "wage_by_education", "employment_mobility_share", "income_asset_change_by_decile",
              "debt_by_generation", "escape_and_retention_trend", "income_transition_matrix", "upper_retention_kpi")


def _in_two_refreshes(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = StoredPanel(spark, "", f"query-{uuid.uuid4().hex}")
        panel = views.panel(spark, sf_dir)
        # The panel's folder is one of its files' year folders up; the last year's files come in the second refresh.
        files = pinned_files(panel)
        if files:
            stored.folder = files[0][0].rpartition("/year=")[0]
            last = max(f[0] for f in files).rpartition("/")[0]
            stored.only = [f for f in files if not f[0].startswith(last)]
            stored.refresh()
            stored.only = None
            state = stored.refresh()
        else:
            state = stored.state([])
        return statements(state)[name]

    run.__name__ = f"incremental_{name}"
    return run


QUERIES = {f"incremental_{name}": _in_two_refreshes(name) for name in REGISTERED}
