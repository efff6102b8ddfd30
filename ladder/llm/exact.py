"""Exact duplicates by progressive refinement (operator 12), built-in functions only.

1. One scan groups the texts by length and, within a length, by the hash of their first ``PREFIX`` bytes (one aggregation
   for both, as both come with the scan), partly aggregated by every task: a hot group is one row a task. A text alone in
   its group has no copy.
2. The groups of two or more mark the bits of a filter of fixed size (``FILTER_BITS``), whatever their number.
3. A second scan digests the texts whose bit is marked, and only those, in full (SHA-256). Texts never move: only ids and
   digests do. A bit shared by chance costs a digest and changes no result; a table with more groups than bits has more
   texts digested.
4. Rows are counted by (digest, doc_id), then by digest: copies collapse before each exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladder.llm.common import Scratch

PREFIX = 256
FILTER_BITS = 1 << 24


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def _keys(data: Column, prefix: int) -> list[Column]:
    return [F.length(data).alias("length"), F.xxhash64(F.substring(data, 1, prefix)).alias("prefix")]


def refined(docs: DataFrame, text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """(length, prefix, n): the groups by length and prefix hash with more than one row."""
    return (docs.select(*_keys(_bytes(text), prefix)).groupBy("length", "prefix").agg(F.count("*").alias("n"))
            .where("n > 1"))


def _place(length: Column, prefix: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(bits))


def _filter(groups: DataFrame, bits: int) -> DataFrame:
    """One row: ``marks``, all bits of the filter as an array of longs, whatever the input."""
    at = _place(F.col("length"), F.col("prefix"), bits)
    words = (groups.select(at.alias("at"))
             .groupBy(F.expr("at div 64").alias("id")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("word")))
    every = groups.sparkSession.range(0, -(-bits // 64), 1, 1).join(words, "id", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word"))))["word"]
                     .alias("marks"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX,
                     filter_bits: int = FILTER_BITS, digest_all: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row. Texts are equal when identical; null counts as empty.

    Of equal texts the row with the largest doc_id stays; of several such rows one does (they are interchangeable). A null
    doc_id is smaller than any other. ``text_sha256`` is null for texts settled without a digest, unless ``digest_all``
    asks for it. Very long texts are hashed where they are read; other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    marks = scratch.table(_filter(refined(docs, text, prefix), filter_bits))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _bytes(text).alias("_data"),
                       _place(*_keys(_bytes(text), prefix), filter_bits).alias("_at"))
    word = F.get(marks.select("marks").scalar(), F.expr("int(_at div 64)"))
    rows = rows.select("doc_id", "_data", (F.call_function("getbit", word, F.expr("int(_at % 64)")) == 1).alias("_open"))
    digest = F.sha2("_data", 256)
    digest = digest if digest_all else F.when(F.col("_open"), digest)
    settled = scratch.table(rows.select("doc_id", "_open", digest.alias("text_sha256")))
    alone = settled.where("NOT _open").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "text_sha256")
    # Written first, so that both sides of the join are plain rows: a hot digest's can then be split among tasks.
    counted = scratch.table(settled.where("_open").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n")))
    groups = scratch.table(counted.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"),
                                                              F.sum("n").alias("group_size")))
    # Equal rows come out one by one; the first of the largest doc_id's stays.
    copies = counted.join(groups, "text_sha256").select("*", F.explode(F.expr("sequence(1L, n)")).alias("i"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return alone.unionByName(copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))
