"""A corpus pipeline: language ID, quality, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import pyarrow  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbench.llm import decontam, langid, minmax, packing, quality
from graphbench.llm._common import materialize

#: A language score under this is a rejection, as is no language at all.
LEAST_LANG_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is unclear, go. Rows are judged where they are read.

    Null, empty and letterless texts go; a null id is a training row; repeated rows are judged alike; ties of languages go to the first
    by name. Where no language can be learned all go; an empty table stays empty."""
    found = langid.with_language(docs, docs.columns, "__lang", "__lang_score")
    return found.where((F.col("__lang") != "und") & (F.col("__lang_score") >= LEAST_LANG_SCORE)).select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 0 go. Rows are judged where they are read.

    Null, empty and wordless texts share one verdict; a null id is never labelled; repeated rows are judged alike; a score of
    exactly 0.5 stays, so all stay where nothing is labelled; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.with_quality(docs, labels, docs.columns, "__quality").where(F.col("__quality") >= 0.5).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    The one of the smallest id stays. Where ids are null or repeat, rows are compared by a key of their own, so rows of one id go only
    if their texts are near-duplicates, and of equal rows one stays. Null, empty and wordless texts all stay; an empty table stays empty."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    key = "__row" if odd else "doc_id"
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows") if odd else docs
    gone = minmax.near_duplicates(rows, size=5, num=80, den=100, id_col=key).where("not kept").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a test item, or a whole shorter item, go. Rows are scanned where they are read.

    Null, empty and wordless texts and rows of a null id stay like other clean ones; repeated rows share one verdict; an empty table stays empty."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.with_hits(docs, items, docs.columns, with_spans=False, prefix="__").where("__n_hit = 0").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, with their sequence and offset.

    A null or empty text is one piece of one token; rows of a null or repeated id are packed each; long texts are cut; an empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("quality", good_quality), ("near_dedup", without_near_duplicates), ("decontamination", without_benchmark), ("packing", packed)]

#: Learned stages have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
