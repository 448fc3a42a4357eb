"""Summaries of human scores, and the diagnostic of answers with and without retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.schemas import REVIEW_FIELDS

SCORES = REVIEW_FIELDS[:3]


def invalid_scores(review: DataFrame) -> DataFrame:
    """(answer_id, field, value) of scores that aren't 0, 1 or 2."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in SCORES)
    long = review.select("answer_id", F.expr(f"stack({len(SCORES)}, {pairs}) as (field, value)"))
    return long.where(~F.coalesce(F.trim("value").try_cast("int").isin(0, 1, 2), F.lit(False)))


def validate(review: DataFrame) -> None:
    bad = invalid_scores(review).orderBy("answer_id", "field").collect()
    if bad:
        raise ValueError("; ".join(f"{r.answer_id}: {r.field} is {r.value!r}" for r in bad))


def _scored(review: DataFrame) -> DataFrame:
    return review.withColumns({f: F.trim(F.col(f).cast("string")).try_cast("int") for f in SCORES})


def summary(review: DataFrame) -> DataFrame:
    """(arm, count, three means, three counts of full scores)."""
    names = ("correctness", "groundedness", "completeness")
    full = ("fully_correct_count", "fully_grounded_count", "fully_complete_count")
    return _scored(review).groupBy("arm").agg(
        F.count("*").cast("bigint").alias("count"), *(F.avg(f).alias(f"mean_{n}_0_to_2") for f, n in zip(SCORES, names, strict=True)), *(F.count_if(F.col(f) == 2).alias(n) for f, n in zip(SCORES, full, strict=True)))


def naive_status(correctness: Column, completeness: Column) -> Column:
    """Correct but not complete counts as incorrect."""
    return F.when((correctness == 2) & (completeness == 2), "fully correct").when(correctness == 1, "partially correct").otherwise("incorrect")


def diagnostic(review: DataFrame) -> DataFrame:
    """(question_id, question_type, each arm's scores, naive_status, best_rag_score, best_rag_system,
    retrieval_improved_answer) of the answerable questions, from arms naive, rag_bm25 and rag_dense: one
    aggregation by question instead of joins."""
    r = _scored(review.where(F.col("question_type") != "unanswerable"))
    pick = lambda arm, f: F.max(F.when(F.col("arm") == arm, F.col(f)))
    short = {"naive": "naive", "rag_bm25": "bm25", "rag_dense": "dense"}
    cols = [pick(arm, f"manual_{s}_0_to_2").alias(f"{n}_{s}_0_to_2") for arm, n in short.items() for s in ("correctness", "groundedness", "completeness")]
    wide = r.groupBy("question_id", "question_type").agg(*cols)
    naive, bm25, dense = (F.col(f"{n}_correctness_0_to_2") for n in short.values())
    return wide.select(
        "*", naive_status(naive, F.col("naive_completeness_0_to_2")).alias("naive_status"), F.greatest(bm25, dense).alias("best_rag_score"),
        F.when(dense > bm25, "dense").when(bm25 > dense, "bm25").otherwise("tie").alias("best_rag_system"), (F.greatest(bm25, dense) > naive).alias("retrieval_improved_answer"))


def diagnostic_summary(rows: DataFrame) -> DataFrame:
    """One row of counts and rates; rates over no question are null."""
    n = F.count("*")
    rate = lambda c: F.count_if(c) / F.nullif(n, F.lit(0))
    status, bm25, dense = F.col("naive_status"), F.col("bm25_correctness_0_to_2") == 2, F.col("dense_correctness_0_to_2") == 2
    improved = F.col("retrieval_improved_answer")
    return rows.agg(
        n.cast("bigint").alias("questions"), F.count_if(F.col("question_type") == "factoid").alias("factoid"), F.count_if(F.col("question_type") == "multi-hop").alias("multi_hop"),
        F.count_if(status == "fully correct").alias("naive_fully_correct"), F.count_if(status == "partially correct").alias("naive_partially_correct"), F.count_if(status == "incorrect").alias("naive_incorrect"),
        rate(status == "fully correct").alias("naive_fully_correct_rate"), F.count_if(bm25).alias("bm25_fully_correct"), rate(bm25).alias("bm25_fully_correct_rate"),
        F.count_if(dense).alias("dense_fully_correct"), rate(dense).alias("dense_fully_correct_rate"), F.count_if(improved).alias("improved"), rate(improved).alias("improved_rate"))


def conclusion(s: dict) -> str:
    return f"Without retrieved context {s['naive_fully_correct']} of {s['questions']} questions were answered fully correctly. Retrieval improved {s['improved']} of {s['questions']} answers."


def markdown(rows: DataFrame) -> str:
    """The report as Markdown, rendered from a few collected rows."""
    s = diagnostic_summary(rows).first().asDict()
    n = max(1, s["questions"])
    lines = ["# No-Context Diagnostic Analysis", "", "## Diagnostic composition", "", f"- {s['questions']} answerable questions", f"- {s['factoid']} factoid questions", f"- {s['multi_hop']} multi-hop questions", "", "## Summary", "", "| System | Fully correct | Rate |", "|---|---:|---:|"]
    for name, key in (("Naive, no context", "naive"), ("BM25 RAG", "bm25"), ("Dense RAG", "dense")):
        lines.append(f"| {name} | {s[f'{key}_fully_correct']}/{s['questions']} | {s[f'{key}_fully_correct'] / n:.0%} |")
    lines += ["", "## Per-question results", "", "| Q | Type | Naive status | Naive score | BM25 score | Dense score |", "|---:|---|---|---:|---:|---:|"]
    for r in rows.orderBy("question_id").collect():
        lines.append(f"| {r.question_id} | {r.question_type} | {r.naive_status} | {r.naive_correctness_0_to_2}/2 | {r.bm25_correctness_0_to_2}/2 | {r.dense_correctness_0_to_2}/2 |")
    return "\n".join([*lines, "", "## Conclusion", "", conclusion(s), ""])
