"""Runs of benchmark items: retrieve, answer, score, judge, sum up; all rows at once, as plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions import score
from .functions.retrieval import VectorStore
from .functions.text import join_context
from .sources.client import ACCURACY, OPEN_RULE, QUALITY, Client, complete_rows
from .tables import written

MODES = ("naive", "local", "global", "hybrid")


def query_mode(name: str | None) -> str:
    """A known mode, else hybrid."""
    return name.lower() if name and name.lower() in MODES else "hybrid"


def contexts(store: VectorStore, questions: DataFrame, k: int = 5) -> DataFrame:
    """query_id, context: the k nearest chunks of each question, nearest first, joined."""
    near = store.retrieve(questions, k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("c"))  # k a question
    return near.select("query_id", join_context(F.transform("c", lambda x: x["chunk"])).alias("context"))


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Answer from this context alone; if it holds no answer, say so.\n\nCONTEXT:\n"), context, F.lit("\n\nQUESTION: "), question, F.lit("\n\nANSWER:"))


def answered(items: DataFrame, store: VectorStore, make: Callable[[], Client], k: int = 5, mode: str = "naive") -> DataFrame:
    """items (index, question, ...) with rag_answer. Only the naive mode, by vectors, is defined without the external graph engine; an error becomes the answer's text and is scored."""
    if query_mode(mode) != "naive":
        raise NotImplementedError(f"mode {query_mode(mode)} needs the external graph engine")
    asked = items.join(contexts(store, items.select(F.col("index").alias("query_id"), "question"), k).withColumnRenamed("query_id", "index"), "index", "left")
    asked = asked.withColumn("__prompt", answer_prompt(F.coalesce("context", F.lit("")), F.coalesce("question", F.lit(""))))
    return complete_rows(asked, make, "", "__prompt", "rag_answer", tell=True).drop("__prompt")


def scored(rows: DataFrame, always_truth: bool = False) -> DataFrame:
    """Result rows: index, complexity, scoring_reference, recall_on_ground_truth_tokens (four digits), question, ground_truth, answer, ideal_for_scoring."""
    ref = F.lit("ground_truth") if always_truth else score.scoring_reference()
    x = rows.withColumn("ideal_for_scoring", score.reference(always_truth)).withColumn("scoring_reference", ref)
    recall = F.round(score.token_recall(F.col("ideal_for_scoring"), F.col("rag_answer")), 4)
    return x.select("index", F.coalesce("complexity", F.lit("")).alias("complexity"), "scoring_reference", recall.alias("recall_on_ground_truth_tokens"), "question", "ground_truth", F.col("rag_answer").alias("answer"), "ideal_for_scoring")


def judge_prompt(row_hint: Column | None = None) -> Column:
    base = F.concat(F.lit("QUESTION:\n"), F.coalesce("question", F.lit("")), F.lit("\n\nEXPECTED:\n"), F.coalesce("ideal_for_scoring", F.lit("")), F.lit("\n\nGIVEN:\n"), F.coalesce("answer", F.lit("")), F.lit("\n\nVERDICT:"))
    return base if row_hint is None else F.concat(row_hint, base)


def judged_accuracy(results: DataFrame, make: Callable[[], Client], open_rule: bool = True) -> DataFrame:
    """results with llm_accuracy_correct and llm_accuracy_error; rows without a reference are not judged and have neither."""
    x = results.withColumn("__prompt", F.when(F.trim("ideal_for_scoring") != "", judge_prompt()))
    x = complete_rows(x, make, ACCURACY + (OPEN_RULE if open_rule else ""), "__prompt", "__reply", 0.0)
    v = score.accuracy_verdict(F.coalesce("__reply", F.lit("")))
    asked = F.col("__prompt").isNotNull()
    return x.withColumn("llm_accuracy_correct", F.when(asked, v["correct"])).withColumn("llm_accuracy_error", F.when(asked, v["error"])).drop("__prompt", "__reply")


def judged_quality(results: DataFrame, make: Callable[[], Client]) -> DataFrame:
    """index, comprehensiveness, diversity, empowerment, error of each result."""
    hint = F.when(F.col("recall_on_ground_truth_tokens").isNotNull(), F.concat(score.recall_note(F.col("recall_on_ground_truth_tokens")), F.lit("\n\n"))).otherwise(F.lit(""))
    x = complete_rows(results.withColumn("__prompt", judge_prompt(hint)), make, QUALITY, "__prompt", "__reply", 0.0)
    return x.withColumn("v", score.quality_verdict(F.coalesce("__reply", F.lit("")))).select("index", "v.*")


def summary(results: DataFrame, config: EngineConfig | None = None, **known: str) -> DataFrame:
    """One row: what was run, n, mean recall, and of judged results their accuracy and counts."""
    r = F.col("recall_on_ground_truth_tokens")
    agg = [F.count("*").alias("n"), F.round(F.coalesce(F.avg(r), F.lit(0.0)), 4).alias("mean_recall_on_ground_truth_tokens")]
    if "llm_accuracy_correct" in results.columns:
        ok, blank = F.col("llm_accuracy_correct"), F.coalesce(F.trim("ideal_for_scoring"), F.lit("")) == ""
        agg += [F.round(F.avg(ok.cast("int")), 4).alias("mean_accuracy"), F.count(ok).alias("n_judged"), F.count_if(ok).alias("n_correct"), F.count_if(blank).alias("n_skipped")]
    shown = {k: v for k, v in asdict(config).items() if k in ("chunk_size", "chunk_overlap", "retrieval_k", "query_mode")} if config else {}
    return results.agg(*agg).select(*[F.lit(v).alias(k) for k, v in (shown | known).items()], "*")


def run(items: DataFrame, store: VectorStore, make: Callable[[], Client], config: EngineConfig | None = None, always_truth: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of all items: answered, scored and judged. Answers are written once, so that summing up asks no model again."""
    config = config or EngineConfig()
    rows = written(scored(answered(items, store, make, config.retrieval_k, config.query_mode), always_truth), "answers")
    results = written(judged_accuracy(rows, make, not always_truth), "results")
    return results, summary(results, config)
