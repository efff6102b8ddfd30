"""Write PLANS.md: a compact summary of every registered query's executed physical plan.

Usage: python tests/plan_report.py [sf_dir] [out_file]

For each query: the exchanges (shuffles and broadcasts), join strategies, scans with their read
schema, pushed filters and partition filters, and the number of whole-stage-codegen stages.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from ladder.plans.queries import QUERIES  # noqa: E402


def _final_only(plan: str) -> str:
    """Drop the "Initial Plan" blocks that adaptive (sub)plans print next to their final plan."""
    out, skip_deeper_than = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :|+-"))
        if skip_deeper_than is not None:
            if depth > skip_deeper_than:
                continue
            skip_deeper_than = None
        if "== Initial Plan ==" in line:
            skip_deeper_than = depth
            continue
        out.append(line)
    return "\n".join(out)


def _bracket(line: str, key: str) -> str:
    """The balanced ``[...]`` value after ``key: `` on a plan line, without expression ids."""
    i = line.find(key + ": [")
    if i < 0:
        return ""
    i += len(key) + 3
    depth, j = 1, i
    while j < len(line) and depth:
        depth += {"[": 1, "]": -1}.get(line[j], 0)
        j += 1
    return re.sub(r"#\d+L?", "", line[i:j - 1])


def summarize(plan: str) -> dict:
    plan = _final_only(plan)
    own = "\n".join(line for line in plan.splitlines() if "ReusedExchange" not in line)
    exchanges = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)"
                           r"(?:\(([^)]*)\))?", own)
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)",
                       plan)
    scans = []
    for line in plan.splitlines():
        if "FileScan parquet" not in line:
            continue
        loc = re.search(r"Location: \w+\([^)]*\)\[(.*?)(?:\]|\.\.\.)", line)
        table = loc.group(1).rstrip("/").split("/")[-1] if loc else "?"
        table = re.sub(r"-[0-9a-f]{12}-[0-9a-f]*$", "", table)
        schema = re.search(r"ReadSchema: (struct<[^>]*>)", line)
        scans.append((table, schema.group(1) if schema else "", _bracket(line, "PushedFilters"),
                      _bracket(line, "PartitionFilters")))
    return {
        "exchanges": [kind + (f"({re.sub(r'#[0-9]+L?', '', keys)})" if keys else "") for kind, keys in exchanges],
        "reused": len(re.findall(r"ReusedExchange|ReusedSubquery", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "joins": joins,
        "scans": scans,
        "codegen_stages": len(set(re.findall(r"\*\((\d+)\)", plan))),
    }


def main(sf_dir: str, out: str) -> None:
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.maxMetadataStringLength", "2000")
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    lines = ["# PLANS", "",
             f"Executed physical plans (AQE final plans) of every registered query at `{sf_dir}`, summarised by",
             "`tests/plan_report.py`. Scans list read schema, pushed filters and partition filters; shuffle",
             "keys are shown without expression ids. Regenerate after plan changes.", "",
             "Reading guide: every query scans the materialised `panel` (or `parent_child`, or the TPC-H-style",
             "inputs for the spend statement) with only its columns and pushed filters; latest-year queries",
             "carry a `year = Subquery` partition filter. The first aggregate (or the `distinct` of the",
             "transition matrix) is the only exchange that moves data-sized rows, and it is partially",
             "aggregated map-side. Every later exchange (windows, pivots, ORDER BY, `SinglePartition`",
             "for global aggregates) moves aggregated rows bounded by the category domains. Broadcasts are",
             "Spark's choice by the tables' sizes. `n x scan` counts the scans that the final plan prints: a",
             "subquery at each of its uses though it runs once, reused exchanges not at all. The last section shows the",
             "same plans with broadcasts off.",
             ""]
    from ladder.plans.fused import latest_cells

    entries = list(QUERIES.items()) + [("latest_cells (refresh only, all latest-year statements)", latest_cells)]
    for name, fn in entries:
        df = fn(spark, sf_dir)
        df.collect()
        s = summarize(df._jdf.queryExecution().executedPlan().executedPlan().toString())
        lines.append(f"## {name}")
        lines.append("")
        lines.append(f"- shuffles (own, incl. subqueries): {len(s['exchanges'])} — "
                     + (", ".join(s["exchanges"]) or "none"))
        lines.append(f"- broadcasts: {s['broadcasts']}; joins: " + (", ".join(s["joins"]) or "none")
                     + f"; reused exchanges/subqueries: {s['reused']}")
        lines.append(f"- whole-stage-codegen stages: {s['codegen_stages']}")
        for (table, schema, pushed, part), n in sorted(Counter(s["scans"]).items()):
            extra = f"; partition filters `{part}`" if part else ""
            lines.append(f"- {n} x scan `{table}`: `{schema}`; pushed `{pushed}`{extra}")
        lines.append("")
    lines += _cluster_scale_section(spark, sf_dir)
    open(out, "w").write("\n".join(lines))
    print("wrote", out)


def _cluster_scale_section(spark, sf_dir: str) -> list[str]:
    """The plans as Spark makes them when every side is large (automatic broadcast joins off)."""
    from ladder.plans.queries import expected_rate_by_income_band
    from ladder.sources import views

    lines = ["# Without broadcasts", "", "The same plans with automatic broadcast joins off, as when the sides are large.", ""]
    old_auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for title, df in [("expected_rate_by_income_band", expected_rate_by_income_band(spark, sf_dir)),
                          ("panel build (orders aggregation, exact ntile, household window, customer join)",
                           views.build_panel(spark, sf_dir))]:
            df.collect()
            s = summarize(df._jdf.queryExecution().executedPlan().executedPlan().toString())
            lines.append(f"## {title}")
            lines.append("")
            lines.append(f"- shuffles (own, incl. subqueries): {len(s['exchanges'])} — "
                         + (", ".join(s["exchanges"]) or "none"))
            lines.append(f"- broadcasts: {s['broadcasts']}; joins: " + (", ".join(s["joins"]) or "none"))
            for (table, schema, pushed, _), n in sorted(Counter(s["scans"]).items()):
                lines.append(f"- {n} x scan `{table}`: `{schema}`; pushed `{pushed}`")
            lines.append("")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_auto)
    return lines


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01",
         sys.argv[2] if len(sys.argv) > 2 else "PLANS.md")
