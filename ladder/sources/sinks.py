"""Sinks (S2, S3): results as JSON records, and every result written as its own dataset by Spark."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Columns whose text is a JSON document of its own.
DOCUMENT_COLUMNS = ("record", "chart", "matrix", "document")


def to_records(df: DataFrame, column: str = "record") -> DataFrame:
    """One JSON object per row, NULLs kept as ``null`` and non-ASCII text kept as is."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias(column))


def _save(df: DataFrame, target: str, fmt: str) -> str:
    """One dataset. JSON keeps NULL fields; a result that is one JSON document per row is written as it is, a line each,
    not as text inside another document."""
    writer = df.write.mode("overwrite")
    if fmt == "json" and len(df.columns) == 1 and df.columns[0] in DOCUMENT_COLUMNS:
        writer.text(target)
    elif fmt == "json":
        writer.option("ignoreNullFields", "false").json(target)
    else:
        writer.format(fmt).save(target)
    return target


def write_all(results: Mapping[str, DataFrame], path: str, fmt: str = "parquet", workers: int = 1) -> dict[str, str]:
    """Write each named result to ``<path>/<name>`` (S3). Executors write; the driver only commits.
    ``workers`` > 1 submits the independent writes concurrently."""
    from ladder.plans.dashboard import run_all

    targets = {name: f"{path.rstrip('/')}/{name}" for name in results}
    run_all([lambda name=name: _save(results[name], targets[name], fmt) for name in results], workers)
    return targets


def write_dashboard(spark: SparkSession, sf_dir: str, path: str,
                    queries: Mapping[str, Callable[[SparkSession, str], DataFrame]] | None = None,
                    fmt: str = "json", workers: int = 4) -> dict[str, str]:
    """Compute every registered result over ``sf_dir`` and write one dataset per result (S3).

    With the default query set the statements are computed once and shared by the derived outputs, and what must hold of
    them (``plans.invariants``) is measured by the writes themselves: ``<path>/_checks.json`` has the metrics by result and
    the problems found."""
    from ladder.plans.dashboard import run_all, shared_statements
    from ladder.plans.queries import QUERIES

    def write(selected, source):
        # Each worker plans and writes one result, so planning overlaps the other writes.
        targets = run_all([lambda name=name, fn=fn: _save(fn(spark, source), f"{path.rstrip('/')}/{name}", fmt)
                           for name, fn in selected.items()], workers)
        return dict(zip(selected, targets, strict=True))

    if queries is not None:
        return write(dict(queries), sf_dir)
    from ladder.plans import invariants
    from ladder.sources.store import write_json

    watches = {}

    def watched(name, fn):
        def result(spark, source):
            df, watches[name] = invariants.observed(fn(spark, source), name)
            return df

        return result

    checked = {*invariants.SHARES, *invariants.LABELS, *invariants.DECILES, *invariants.RETENTION}
    with shared_statements(spark, sf_dir) as run:
        paths = write({n: watched(n, fn) if n in checked else fn for n, fn in QUERIES.items()}, run)
    metrics = {name: dict(watch.get) for name, watch in sorted(watches.items())}
    found = [vars(p) for p in invariants.problems(metrics)]
    write_json(spark, f"{path.rstrip('/')}/_checks.json", {"metrics": metrics, "problems": found}, replace=True)
    return paths
