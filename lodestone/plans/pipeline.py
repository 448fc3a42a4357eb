"""The stages from raw files to reports, each reading the Parquet tables of those before it."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25, chunking, dense, generation_metrics, models, preprocess, rag, retrieval_metrics, review
from lodestone.sources import readers, writers

log = logging.getLogger(__name__)

STAGES = ("fetch", "preprocess", "chunk", "bm25", "dense", "evaluate_retrieval", "generate", "evaluate_generation", "summarise", "diagnose")


class Pipeline:
    """Tables under one folder. ``members`` may be any (member, content) DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, questions: DataFrame | None = None, embedder: Callable[[], models.Embedder] = models.HashEmbedder, generator: Callable[[], models.Generator] = models.EchoGenerator, repo: str = "owner/corpus", tag: str = "main"):
        self.spark, self.folder, self.questions = spark, folder.rstrip("/"), questions
        self.embedder, self.generator, self.repo, self.tag = embedder, generator, repo, tag

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        writers.parquet(df, self.path(name))
        log.info("%s written", self.path(name))
        return self.read(name)

    def fetch(self, members: DataFrame, **keep) -> DataFrame:
        return self.write("files", readers.corpus_files(members, **keep))

    def preprocess(self) -> DataFrame:
        docs, demos, references = preprocess.documents(self.read("files"))
        self.write("unresolved", preprocess.unresolved(references))
        self.write("demos", demos)
        return self.write("docs", docs)

    def chunk(self) -> DataFrame:
        chunks = self.write("chunks", chunking.numbered(chunking.chunk_documents(self.read("docs"))))
        return chunking.validate(chunks)

    def corpus(self) -> DataFrame:
        return self.read("chunks").select(F.col("chunk_id").alias("doc_id"), "ord", "text")

    def bm25(self) -> bm25.Index:
        bm25.Index.build(self.corpus()).save(self.path("bm25"))
        return bm25.Index.load(self.spark, self.path("bm25"))

    def dense(self, coverage: int = dense.COVERAGE_TOKENS, context: int = dense.MAX_CONTEXT_TOKENS) -> DataFrame:
        """Late chunking: the model sees a document, or windows of a long one, and each chunk's vector is
        pooled from its own tokens; a chunk without any is embedded by its text. Offsets refer to the
        normalised text without demo markers. The report counts windows and fallbacks."""
        chunks = self.read("chunks")
        docs = self.read("docs").select("doc_id", T.without_markers(T.normalize(F.col("text"))).alias("text"))
        tokens = self.write("tokens", models.token_spans(docs, self.embedder))
        ranges = dense.token_ranges(chunks, tokens)
        wins = self.write("windows", dense.windows(ranges, tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens")), coverage, context))
        pooled = models.embed_windows(dense.window_texts(docs, chunks, tokens, wins), self.embedder)
        pooled = self.write("pooled", pooled.where("embedding is not null"))
        lost = chunks.join(pooled.select("chunk_id"), "chunk_id", "left_anti").select(F.col("chunk_id").alias("query_id"), "text")
        own = models.embed_queries(lost, self.embedder).select(F.col("query_id").alias("chunk_id"), F.col("qvec").alias("embedding"))
        out = self.write("dense", dense.with_fallback(chunks, pooled, own))
        self.write("dense_report", dense.embedding_report(chunks, wins, out))
        return out

    def search(self, system: str, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, chunk_id, score) for queries (query_id, text)."""
        if system == "bm25":
            return bm25.Index.load(self.spark, self.path("bm25")).search(queries, k).select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "score")
        if system == "dense":
            q = models.embed_queries(queries, self.embedder).select("query_id", "qvec")
            return dense.top_k(self.read("dense").select(F.col("chunk_id").alias("item"), "embedding"), q, k).select("query_id", "rank", F.col("item").alias("chunk_id"), "score")
        raise ValueError(f"unknown retriever {system!r}")

    def _asked(self) -> DataFrame:
        return self.questions.select(F.col("question_id").cast("long").alias("query_id"), F.col("question_text").alias("text"))

    def evaluate_retrieval(self, system: str, k: int = 5) -> DataFrame:
        """Metrics at k with reciprocal ranks over the full depth: the first k are searched, and the gold chunks'
        ranks are counted, so no ranking of all chunks is made."""
        depth = self.read("chunks").count()
        asked = self._asked()
        ranked = self.search(system, asked, k).withColumnRenamed("chunk_id", "item")
        questions = self.questions.withColumn("question_id", F.col("question_id").cast("long"))
        gold = retrieval_metrics.answerable(questions).select(F.col("question_id").alias("query_id"), F.explode("gold_chunk_ids").alias("item")).distinct()
        if system == "bm25":
            index = bm25.Index.load(self.spark, self.path("bm25"))
            ranks = bm25.gold_ranks(index.scores(asked), gold.withColumnRenamed("item", "doc_id"), index.docs).withColumnRenamed("doc_id", "item")
        else:
            ranks = dense.gold_ranks(self.read("dense").select(F.col("chunk_id").alias("item"), "embedding"), models.embed_queries(asked, self.embedder).select("query_id", "qvec"), gold)
        return self.write(f"retrieval_{system}", retrieval_metrics.evaluate(questions, ranked, k, depth, ranks))

    def results(self, system: str, k: int = rag.TOP_K) -> DataFrame:
        c = self.read("chunks").select("chunk_id", "doc_id", "text", "metadata.url", "metadata.demo_refs")
        hit = self.search(system, self._asked(), k).join(c, "chunk_id")
        hydrated = rag.hydrate(hit.select("chunk_id", "text", "demo_refs").distinct(), self.read("demos")).select("chunk_id", "hydrated")
        return hit.join(hydrated, "chunk_id").select(F.col("query_id").cast("int").alias("query_id"), "rank", "chunk_id", "doc_id", "score", "url", "demo_refs", "hydrated")

    def generate(self, systems: tuple[str, ...] = ("dense", "bm25"), modes: tuple[str, ...] = ("naive", "rag")) -> DataFrame:
        paths = readers.path_index(self.read("files"))
        return self.write("answers", rag.run(self.questions, {s: self.results(s) for s in systems}, self.generator, paths, self.repo, self.tag, modes))

    def evaluate_generation(self, arms: tuple[str, ...] = ("naive", "rag_bm25", "rag_dense")) -> DataFrame:
        answers = self.read("answers")
        generation_metrics.check(answers, self.questions, arms)
        per = self.write("generation_per_answer", generation_metrics.evaluate(answers, self.questions))
        self.write("generation_aggregate", generation_metrics.aggregate(per))
        return per

    def review_table(self, earlier: DataFrame | None = None) -> DataFrame:
        return self.write("review", generation_metrics.review_rows(self.read("generation_per_answer"), earlier))

    def _report(self, name: str, rows: DataFrame, content) -> None:
        """Beside the table: the rows as one CSV file, and content as JSON."""
        writers.csv(rows.coalesce(1), self.path(f"{name}_csv"))
        writers.text(self.spark, json.dumps(content, indent=2, ensure_ascii=False), self.path(f"{name}_json"))

    def summarise(self, reviewed: DataFrame, expected: int | None = None) -> DataFrame:
        """A row per arm, as a table, CSV and JSON. Invalid scores raise, and so do other than ``expected`` rows
        of review."""
        review.validate(reviewed)
        _sized(reviewed, expected, "reviewed answers")
        out = self.write("manual_summary", review.summary(reviewed))
        self._report("manual_summary", out.orderBy("arm"), writers.rows_json(out, "arm"))
        return out

    def diagnose(self, reviewed: DataFrame, expected: int | None = None) -> DataFrame:
        """A row per answerable question, as a table, CSV, JSON with the summary, and Markdown. Other than
        ``expected`` such questions raise."""
        review.validate(reviewed)
        rows = review.diagnostic(reviewed)
        _sized(rows, expected, "answerable questions")
        out = self.write("diagnostic", rows)
        summary = review.diagnostic_summary(out).first().asDict()
        summary["conclusion"] = review.conclusion(summary)
        self._report("diagnostic", out.orderBy("question_id"), {"summary": summary, "questions": writers.rows_json(out, "question_id")})
        writers.text(self.spark, review.markdown(out), self.path("diagnostic_markdown"))
        return out


def _sized(rows: DataFrame, expected: int | None, what: str) -> None:
    n = rows.count()
    if n == 0 or expected not in (None, n):
        raise ValueError(f"{n} {what}, not {'none' if expected is None else expected}")


def missing_outputs(folder: str, names: tuple[str, ...]) -> list[str]:
    """Names under the folder that have no table, for checking a finished run."""
    import os

    return [n for n in names if not os.path.exists(str(PurePosixPath(folder) / n / "_SUCCESS"))]
