"""Scores of answers: recall, judged accuracy, judged qualities, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import json_object, token_recall

QUALITIES = ("comprehensiveness", "diversity", "empowerment")


def first_text(*names: str) -> Column:
    """The first of the columns that isn't blank."""
    return F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.col(n)) for n in names])


ANALYTIC = "subgraph-deep-analytics"


def scoring_reference() -> Column:
    """Which column of an item its answer is held against: the reference answer of analytic items, else the ground truth."""
    return F.when(F.col("complexity") == ANALYTIC, F.lit("answer")).otherwise(F.lit("ground_truth"))


def reference(always_truth: bool = False) -> Column:
    """That text, trimmed; items: complexity, ground_truth, answer (the reference answer)."""
    truth = F.coalesce(F.trim("ground_truth"), F.lit(""))
    return truth if always_truth else F.when(scoring_reference() == "answer", F.coalesce(F.trim("answer"), F.lit(""))).otherwise(truth)


def recall_rows(items: DataFrame, truth: str = "ground_truth", answer: str = "answer") -> DataFrame:
    return items.withColumn("recall", token_recall(F.col(truth), F.col(answer)))


def recall_summary(rows: DataFrame, digits: int | None = 4) -> DataFrame:
    """n and mean of the (rounded) recalls, 0 without rows."""
    r = F.col("recall") if digits is None else F.round("recall", digits)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(r), F.lit(0.0)).alias("mean_recall"))


def recall_note(recall: Column) -> Column:
    """The recall with four decimals for a judge's prompt, or nothing."""
    return F.when(recall.isNull(), F.lit("")).otherwise(F.concat(F.lit("recall = "), F.format_string("%.4f", recall)))


def accuracy_verdict(reply: Column) -> Column:
    """struct(correct, error) from a judge's reply: correct must be a JSON boolean."""
    v = F.try_variant_get(F.try_parse_json(json_object(reply)), "$.correct", "boolean")
    raw = F.get_json_object(json_object(reply), "$.correct")
    ok = raw.isin("true", "false") & v.isNotNull() & json_object(reply).rlike(r'"correct"\s*:\s*(true|false)')
    return F.struct(F.when(ok, v).alias("correct"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("no boolean verdict")).alias("error"))


def quality_verdict(reply: Column) -> Column:
    """struct of the three qualities and an error: whole numbers from 1 to 5, else all null."""
    obj = F.try_parse_json(json_object(reply))
    vals = {q: F.try_variant_get(obj, f"$.{q}", "int") for q in QUALITIES}
    ok = F.lit(True)
    for v in vals.values():
        ok = ok & F.coalesce(v.between(1, 5), F.lit(False))
    return F.struct(*[F.when(ok, v.cast("double")).alias(q) for q, v in vals.items()], F.when(~ok, F.lit("invalid scores")).alias("error"))


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """n_judged, n_correct, n_skipped, accuracy (null if none was judged) over column correct."""
    return rows.agg(F.count("correct").alias("n_judged"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("correct").isNull()).alias("n_skipped"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def quality_summary(rows: DataFrame) -> DataFrame:
    """Means of the three qualities over rows without error, null if none, and n_errors."""
    ok = F.col("error").isNull()
    return rows.agg(F.count_if(ok).alias("n_scored"), F.count_if(~ok).alias("n_errors"), *[F.avg(F.when(ok, F.col(q))).alias(q) for q in QUALITIES])


def counts_by_complexity(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("complexity", F.lit("unknown")).alias("complexity")).agg(F.count("*").alias("n"))
