"""The corpus pipeline: language ID, quality rules, SimHash near-dedup, best-fit packing, in this order.

Each stage takes the documents that the one before it kept and returns what it keeps; the last returns the packed
pieces. ``run`` writes every stage's result to the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ladder.llm import langid, packing, quality, simhash
from ladder.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells; those it rejects go."""
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's and source's thresholds; those the rules reject go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into training sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup),
          ("best_fit_packing", best_fit_packing)]

#: SQL can't compress with zstandard or run the tokeniser; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep.

    Null, empty and letterless texts go with the first stage, texts of few words with the second. Of repeated rows one stays
    (third stage), as of near copies; of rows without a doc_id the same. Very long texts are judged and packed whole. Other
    columns pass through until the last stage, whatever their names. An empty table gives no rows.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
