"""Uniform shuffle into shards of exact sizes (operator 9).

The rows lie in units (runs of at most ``UNIT`` rows of an input partition); shards are cut into blocks of at most
``BLOCK`` slots. A communication matrix says how many rows of each unit go to each block. Given the sizes of units
and blocks, a uniform permutation's matrix is multivariate hypergeometric. It is drawn from that law by splitting: how
many rows of each group of units go to each shard (on the driver: groups times shards), how a shard's are divided among
its blocks (a task per shard), how a group's are divided among its units (a task per group, unit by unit). Then each unit
is permuted, cut by its row of the matrix, exchanged, and each block is permuted again. Sizes are exact at any input; no
task holds more than a unit, a block, or a row and a column sum of the matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladder.llm.common import Scratch, ship

SHARDS = 16
UNIT = 1 << 16
BLOCK = 1 << 20
#: Partitions to a group of units, and units of one partition.
GROUP = 64
SEED = 20240229


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good + bad`` without replacement are good. numpy's sampler ends below
    10**9 rows; beyond, the distribution is inverted from its mode outwards."""
    if not good or not n:
        return 0
    if not bad:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    logs = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    p = math.exp(logs(good, mode) + logs(bad, n - mode) - logs(good + bad, n))
    left = rng.random() - p
    down = up = mode
    p_down = p_up = p
    while left > 0 and (down > low or up < high):
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            if (left := left - p_down) <= 0:
                return down
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            if (left := left - p_up) <= 0:
                return up
    return mode


def draw_rows(rng: np.random.Generator, rows: Iterable[int], columns: np.ndarray) -> Iterator[np.ndarray]:
    """Row by row a matrix with these row and column sums, as a uniform permutation has them: each row from what the
    columns have left."""
    left = np.array(columns, dtype=np.int64)
    for n in rows:
        others, row = int(left.sum()), np.zeros(len(left), dtype=np.int64)
        for j in np.flatnonzero(left):
            if not n:
                break
            others -= int(left[j])
            row[j] = hypergeometric(rng, int(left[j]), others, n)
            n -= int(row[j])
        left -= row
        yield row


def uniform_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, unit: int = UNIT, block: int = BLOCK,
                   group: int = GROUP) -> DataFrame:
    """``rows``, all columns, with ``shard`` (0 to shards - 1) and ``slot`` (0 to the shard's size - 1) after them;
    columns of these names in the input are replaced. Shards differ by one row at most; the permutation is decided by
    the seed and the order of the input. Nulls and repeated rows are rows like any other. With no rows there are none.

    The input is written once with each row's place, so every later step and every retry sees the same units.
    """
    ship(rows.sparkSession)
    spark = rows.sparkSession
    scratch = Scratch(spark, "sharding")
    keep = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    placed = rows.select(F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"),
                         F.monotonically_increasing_id().alias("at"))
    placed = scratch.table(placed)
    # A place is the partition in the upper bits and the row's number in it in the lower 33.
    unit_of = F.concat_ws("-", F.shiftright("at", 33), F.expr(f"(at & {(1 << 33) - 1}) div {unit}"))
    # Groups by place, so that nothing has to be numbered: neighbouring partitions, and units of a partition.
    part, place = F.shiftright("at", 33), F.expr(f"(at & {(1 << 33) - 1}) div {unit}")
    units = scratch.table(
        placed.groupBy(part.alias("part"), place.alias("no")).count()
        .withColumn("unit", F.concat_ws("-", "part", "no"))
        .withColumn("grp", F.concat_ws("-", F.expr(f"part div {group}"), F.expr(f"no div {group}"))))
    totals = [(r["grp"], r["n"]) for r in units.groupBy("grp").agg(F.sum("count").alias("n")).orderBy("grp").collect()]
    blocks = _blocks(sum(x for _, x in totals), shards, block)
    sizes = np.zeros(shards, dtype=np.int64)
    for s, _, size in blocks:
        sizes[s] += size
    drawn = draw_rows(np.random.default_rng([seed, 0]), [x for _, x in totals], sizes)
    by_shard = spark.createDataFrame([(s, i, g, int(row[s])) for i, ((g, _), row) in enumerate(zip(totals, drawn, strict=True))
                                      for s in range(shards)], "shard int, at int, grp string, n long")

    def to_blocks(frame: pd.DataFrame) -> pd.DataFrame:
        frame, shard = frame.sort_values("at"), int(frame["shard"].iloc[0])
        numbers = np.array([k for k, b in enumerate(blocks) if b[0] == shard])
        rng, parts = np.random.default_rng([seed, 1, shard]), []
        for g, row in zip(frame["grp"], draw_rows(rng, frame["n"], [blocks[k][2] for k in numbers]), strict=True):
            j = np.flatnonzero(row)
            parts.append(pd.DataFrame({"grp": g, "block": numbers[j], "n": row[j]}))
        return pd.concat(parts)

    by_block = by_shard.groupBy("shard").applyInPandas(to_blocks, "grp string, block int, n long")

    def to_units(own: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        own, sums = own.sort_values(["part", "no"]), sums.sort_values("block")
        key = [int(x) for x in own["grp"].iloc[0].split("-")] if len(own) else []
        numbers, parts = sums["block"].to_numpy(), [pd.DataFrame({"unit": [], "block": [], "rank": []})]
        for u, row in zip(own["unit"], draw_rows(np.random.default_rng([seed, 2, *key]), own["count"], sums["n"]), strict=True):
            j = np.flatnonzero(row)
            parts.append(pd.DataFrame({"unit": u, "block": numbers[j], "rank": (np.cumsum(row) - row)[j]}))
        return pd.concat(parts[1:] or parts)

    cuts = units.groupBy("grp").cogroup(by_block.groupBy("grp")).applyInPandas(to_units, "unit string, block int, rank long")
    # Permute each unit, and let every row find the last cut at or before its rank.
    random = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "at")
    ranked = placed.withColumn("unit", unit_of).withColumn(
        "rank", F.row_number().over(Window.partitionBy("unit").orderBy(random(1), "at")) - F.lit(1).cast("long"))
    both = ranked.select("unit", "rank", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("block"), "row", "at")
    marks = cuts.select("unit", "rank", F.lit(0).alias("kind"), "block", F.lit(None).cast(placed.schema["row"].dataType)
                        .alias("row"), F.lit(None).cast("long").alias("at"))
    sent = (both.unionByName(marks)
            .withColumn("block", F.last("block", True).over(Window.partitionBy("unit").orderBy("rank", "kind")))
            .where("kind = 1"))
    places = spark.createDataFrame([(i, s, start) for i, (s, start, _) in enumerate(blocks)],
                                   "block int, shard int, start long")
    slot = F.col("start") + F.row_number().over(Window.partitionBy("block").orderBy(random(2), "at")) - 1
    return sent.join(places, "block").withColumn("slot", slot).select("row.*" if keep else "at", "shard", "slot")


def _blocks(n: int, shards: int, block: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, slots) of every block: shards as even as can be, cut into even blocks."""
    out = []
    for s in range(shards):
        size = n // shards + (s < n % shards)
        parts = max(1, -(-size // block))
        edges = [size * i // parts for i in range(parts + 1)]
        out += [(s, a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row: size is the text's UTF-8 bytes plus 1 (null: 1), the checksum
    of a null text that of the empty one. ``uniform_shards`` moves whole rows; here only these columns move."""
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.length(data) + 1).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"))
    return uniform_shards(rows, **settings)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows by slot within a file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
