"""Reading the input Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ladder.sources.run import run_of

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a lazy DataFrame; Catalyst prunes columns and pushes filters into the scan.
    Within a ``Run`` the file listing and schema read happen once, and the listing is kept (``Run.pin``)."""
    run, path = run_of(sf_dir), table_path(sf_dir, name)
    return run.once(("table", name), lambda: run.pin(path, spark.read.parquet(path)))


def load_views(spark: SparkSession, sf_dir: str, names=("region", "nation", "customer", "supplier",
                                                         "part", "orders", "lineitem")) -> dict[str, DataFrame]:
    """Register input tables as temp views (the counterpart of opening the source databases)."""
    frames = {}
    for name in names:
        df = read_table(spark, sf_dir, name)
        df.createOrReplaceTempView(name)
        frames[name] = df
    return frames
