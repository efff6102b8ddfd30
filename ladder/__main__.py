"""Command line: refresh the whole dashboard and write every result as its own dataset.

    python -m ladder <sf_dir> <out_dir> [--format json|parquet] [--workers N] [--master local[*]]

On a cluster, submit this module with the cluster's master and a ``spark.checkpoint.dir`` on shared
storage; locally a temporary checkpoint folder is used when none is configured.
"""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None, spark=None) -> dict[str, str]:
    """Run the refresh; with ``spark`` given, use that session and leave it running."""
    from pyspark.sql import SparkSession

    from ladder.sources import write_dashboard

    ap = argparse.ArgumentParser(prog="python -m ladder", description=__doc__.splitlines()[0])
    ap.add_argument("sf_dir", help="folder with the input Parquet tables")
    ap.add_argument("out_dir", help="folder to write one dataset per result into")
    ap.add_argument("--format", default="json", choices=["json", "parquet"])
    ap.add_argument("--workers", type=int, default=4, help="results submitted concurrently")
    ap.add_argument("--master", default=None, help="Spark master (default: from spark-submit / local[*])")
    args = ap.parse_args(argv)

    own = spark is None
    if own:
        builder = SparkSession.builder.appName("ladder-dashboard").config("spark.ui.enabled", "false")
        if args.master:
            builder = builder.master(args.master)
        spark = builder.getOrCreate()
    try:
        paths = write_dashboard(spark, args.sf_dir, args.out_dir, fmt=args.format, workers=args.workers)
    finally:
        if own:
            spark.stop()
    print(json.dumps(paths, ensure_ascii=False, indent=1))
    return paths


if __name__ == "__main__":
    main()
