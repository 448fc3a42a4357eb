"""Ranking metrics from rankings (query_id, rank, item) and gold sets (query_id, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(problem, query_id): repeated items in a ranking or gold set, and rankings without gold."""
    if k <= 0:
        raise ValueError("k must be positive")
    twice = lambda df, name: df.groupBy("query_id", "item").count().where("count > 1").select(F.lit(name).alias("problem"), "query_id").distinct()
    bare = ranked.select("query_id").distinct().join(gold.select("query_id"), "query_id", "left_anti").select(F.lit("no gold").alias("problem"), "query_id")
    return twice(ranked, "repeated in ranking").unionByName(twice(gold, "repeated in gold")).unionByName(bare)


def validate(ranked: DataFrame, gold: DataFrame, k: int) -> None:
    bad = problems(ranked, gold, k).limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r.problem}: {r.query_id}" for r in bad))


def gold_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, item, rank) for each gold item, rank null if it isn't in the ranking."""
    return gold.select("query_id", "item").join(ranked.select("query_id", "item", "rank"), ["query_id", "item"], "left")


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ideal(n: Column, k: int) -> Column:
    """Discounted gain of min(n, k) gold items at the top."""
    return F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + discount(i))


def per_query(ranks: DataFrame, k: int) -> DataFrame:
    """(query_id, n_gold, first_relevant_rank, precision, recall, reciprocal_rank, ndcg) from gold_ranks.

    Precision is over k even if fewer were retrieved; the reciprocal rank looks at the whole ranking, the
    others at its first k.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    within = F.col("rank") <= k
    g = ranks.groupBy("query_id").agg(
        F.count("*").cast("bigint").alias("n_gold"), F.min("rank").alias("first_relevant_rank"), F.count_if(within).alias("hits"),
        F.coalesce(F.sum(F.when(within, discount(F.col("rank")))), F.lit(0.0)).alias("gain"))
    return g.select("query_id", "n_gold", "first_relevant_rank", (F.col("hits") / F.lit(float(k))).alias("precision"), (F.col("hits") / F.col("n_gold")).alias("recall"),
                    F.coalesce(F.lit(1.0) / F.col("first_relevant_rank"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("gain") / ideal(F.col("n_gold"), k)).alias("ndcg"))


def gold_rank_map(ranks: DataFrame) -> DataFrame:
    """(query_id, gold_ranks): a map from gold item to rank or null."""
    return ranks.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("item").cast("string"), "rank")))).alias("gold_ranks"))


METRICS = ("precision", "recall", "reciprocal_rank", "ndcg")


def macro(metrics: DataFrame) -> DataFrame:
    """One row: queries and the mean of each metric."""
    return metrics.agg(F.count("*").cast("bigint").alias("queries"), *(F.avg(m).alias(m) for m in METRICS))


def with_mean(metrics: DataFrame) -> DataFrame:
    """metrics with query_id as text and a last row MEAN."""
    rows = metrics.select(F.col("query_id").cast("string").alias("query_id"), *METRICS)
    return rows.unionByName(macro(metrics).select(F.lit("MEAN").alias("query_id"), *METRICS))


def answerable(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("type") != "unanswerable")


def evaluate(questions: DataFrame, ranked: DataFrame, k: int = 5, depth: int | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """Per answerable question its metrics, gold ranks, top k and type. questions: schemas.QUESTIONS; ranked:
    (query_id, rank, item) at full depth, or its first k if the gold items' ranks (query_id, item, rank) are given.
    A ranking of fewer than k items, or no question, raises."""
    q = answerable(questions)
    gold = q.select(F.col("question_id").alias("query_id"), F.explode("gold_chunk_ids").alias("item"))
    if q.isEmpty():
        raise ValueError("no answerable questions")
    if depth is not None and depth < k:
        raise ValueError("rankings are shorter than k")
    validate(ranked.join(q.select(F.col("question_id").alias("query_id")), "query_id", "left_semi"), gold, k)
    ranks = gold_ranks(ranked, gold) if ranks is None else gold_ranks(ranks, gold)
    top = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("top_k_chunk_ids"))
    out = per_query(ranks, k).join(gold_rank_map(ranks), "query_id").join(top, "query_id", "left")
    facts = q.select(F.col("question_id").alias("query_id"), F.col("type").alias("question_type"), "question_text", "gold_chunk_ids")
    return facts.join(out, "query_id").orderBy("query_id")
