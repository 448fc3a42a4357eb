"""Scores of generated answers: overlap, refusals, support and citations, per answer and per arm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.rag import REFUSAL
from lodestone.schemas import REVIEW_FIELDS


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def evaluate(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """A row per answer (schemas.ANSWERS) with its question (schemas.QUESTIONS). Answers to unknown questions
    are left to ``unknown_questions``. Columns about support are null for answers without retrieval."""
    q = questions.select("question_id", F.col("type").alias("question_type"), T.strip(F.col("reference_answer")).alias("reference_answer"), "gold_chunk_ids")
    a = answers.join(q, "question_id").withColumn("answer_text", T.strip(F.col("answer_text")))
    cits = F.coalesce(F.col("citations"), F.expr("array()").cast(answers.schema["citations"].dataType))
    retrieved = F.transform(cits, lambda c: c["chunk_id"])
    cited = F.transform(F.filter(cits, lambda c: F.coalesce(c["cited_in_text"], F.lit(False))), lambda c: c["chunk_id"])
    numbers = T.cited_numbers(F.col("answer_text"))
    invalid = F.array_sort(F.filter(numbers, lambda n: (n < 1) | (n > F.size(cits))))
    a = a.withColumns({"retrieved_chunk_ids": retrieved, "cited_chunk_ids": cited, "invalid_citation_numbers": invalid})
    refused = F.col("answer_text") == REFUSAL
    unanswerable = F.col("question_type") == "unanswerable"
    supported = ~unanswerable & (F.size(F.array_except("gold_chunk_ids", "retrieved_chunk_ids")) == 0)
    rag = F.col("mode") == "rag"
    expected = unanswerable | ~supported
    both = F.size(F.array_intersect("cited_chunk_ids", "gold_chunk_ids"))
    return a.select(
        "answer_id", "question_id", "question_type", T.arm(F.col("mode"), F.col("retriever")).alias("arm"), "mode", "retriever", "question_text", "reference_answer", "answer_text",
        T.exact_match(F.col("answer_text"), F.col("reference_answer")).alias("exact_match"),
        T.token_f1(T.answer_tokens(F.col("answer_text")), T.answer_tokens(F.col("reference_answer"))).alias("token_f1"),
        refused.alias("is_exact_refusal"), unanswerable.alias("is_unanswerable"),
        F.when(rag, supported).alias("context_has_all_gold"), F.when(rag, expected).alias("expected_refusal"), F.when(rag, refused == expected).alias("support_gate_correct"),
        F.when(rag, expected & ~refused).alias("unsupported_answer"), F.when(rag, supported & refused).alias("supported_refusal"),
        "retrieved_chunk_ids", "gold_chunk_ids", "cited_chunk_ids",
        ((F.size("cited_chunk_ids") > 0) & (F.size("invalid_citation_numbers") == 0)).alias("has_valid_inline_citation"), "invalid_citation_numbers",
        share(both, F.size(F.array_distinct("cited_chunk_ids"))).alias("citation_precision"), share(both, F.size(F.array_distinct("gold_chunk_ids"))).alias("citation_recall"),
    )


def unknown_questions(answers: DataFrame, questions: DataFrame) -> DataFrame:
    return answers.join(questions, "question_id", "left_anti").select("answer_id", "question_id")


def check(answers: DataFrame, questions: DataFrame, arms: Sequence[str]) -> None:
    """Raises unless answers are unique, of known questions, and of every question in exactly these arms."""
    n = questions.count()
    got = {r.arm: r for r in answers.groupBy(T.arm(F.col("mode"), F.col("retriever")).alias("arm")).agg(F.count("*").alias("n"), F.countDistinct("answer_id").alias("ids"), F.countDistinct("question_id").alias("questions")).collect()}
    if set(got) != set(arms):
        raise ValueError(f"arms are {sorted(got)}, not {sorted(arms)}")
    for arm, r in got.items():
        if not r.n == r.ids == r.questions == n:
            raise ValueError(f"{arm}: {r.n} answers with {r.ids} ids to {r.questions} of {n} questions")
    lost = unknown_questions(answers, questions).first()
    if lost:
        raise ValueError(f"{lost.answer_id}: unknown question {lost.question_id}")


def aggregate(evaluated: DataFrame) -> DataFrame:
    """A row per arm. Means over nothing are 0; what needs retrieval is null for the naive arm."""
    num = lambda c: F.col(c).cast("double")
    refused, unanswerable = F.col("is_exact_refusal"), F.col("is_unanswerable")

    def mean(x: Column, where: Column | None = None) -> Column:
        return F.coalesce(F.avg(x if where is None else F.when(where, x)), F.lit(0.0))

    supported = F.coalesce(F.col("context_has_all_gold"), F.lit(False))
    rag = {
        "context_supported_count": F.count_if(supported), "context_unsupported_count": F.count_if(~supported), "support_gate_accuracy": mean(num("support_gate_correct")),
        "supported_answer_rate": mean((~refused).cast("double"), supported), "unsupported_refusal_rate": mean(refused.cast("double"), ~supported),
        "unsupported_answer_rate": mean(num("unsupported_answer")), "supported_refusal_rate": mean(num("supported_refusal")),
        "non_refusal_inline_citation_rate": mean(num("has_valid_inline_citation"), ~refused), "mean_citation_precision": mean(F.col("citation_precision"), ~refused),
        "mean_citation_recall": mean(F.col("citation_recall"), ~unanswerable), "invalid_citation_answer_count": F.count_if(F.size("invalid_citation_numbers") > 0),
    }
    every = {
        "count": F.count("*").cast("bigint"), "exact_match": mean(num("exact_match")), "mean_token_f1": mean(F.col("token_f1")), "answerable_mean_token_f1": mean(F.col("token_f1"), ~unanswerable),
        "unanswerable_exact_refusal_accuracy": mean(refused.cast("double"), unanswerable), "exact_refusal_count": F.count_if(refused),
    }
    out = evaluated.groupBy("arm").agg(*(c.alias(n) for n, c in (every | rag).items()))
    return out.select("arm", *every, *(F.when(F.startswith("arm", F.lit("rag_")), F.col(n)).alias(n) for n in rag))


def review_rows(evaluated: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Rows for human review; scores and notes of earlier rows with the same answer_id are kept."""
    rows = evaluated.select("answer_id", "question_id", "arm", "question_type", "question_text", "reference_answer", "answer_text", "retrieved_chunk_ids", "cited_chunk_ids", F.col("token_f1").alias("automated_token_f1"), F.col("exact_match").alias("automated_exact_match"))
    if earlier is None:
        return rows.select("*", *(F.lit("").alias(f) for f in REVIEW_FIELDS))
    old = earlier.select("answer_id", *(F.col(f).alias(f"__{f}") for f in REVIEW_FIELDS)).dropDuplicates(["answer_id"])
    return rows.join(old, "answer_id", "left").select(*rows.columns, *(F.coalesce(f"__{f}", F.lit("")).alias(f) for f in REVIEW_FIELDS))
