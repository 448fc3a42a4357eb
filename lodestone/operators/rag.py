"""Prompts from retrieved chunks, answers, and the citations that these hold."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import models

TOP_K, MAX_NEW_TOKENS = 5, 512
REFUSAL = "I don't know"
#: The wording of the two system prompts.
GROUNDED_SYSTEM = """Answer the question using only the supplied numbered passages.

If the passages do not explicitly answer the question, your entire reply must be
this exact sentence:

I don't know

Write it exactly that way: a straight apostrophe, no trailing period, no citation,
no explanation, and nothing before or after it.

Otherwise, answer the question and follow these rules:
- Answer every part of the question that is explicitly supported.
- Place an inline citation such as [1] immediately after every factual sentence.
- Use only passage numbers that were supplied.
- Do not use prior knowledge.
- Do not infer prop names, defaults, variants, or component behaviour from related components.
- Do not treat a passing mention, dependency list, or example name as an answer.
- Never reply with citation markers alone; every reply must contain a sentence.
- Keep the answer concise."""
NAIVE_SYSTEM = """Answer the question about Material UI as accurately as you can. \
Keep it concise and to the point.
If you do not know the answer, respond with "I dont know" """


def hydrate(chunks: DataFrame, demos: DataFrame) -> DataFrame:
    """chunks (chunk_id, text, demo_refs) with ``hydrated``: the text, then each demo's source as a fenced
    block in order of demo_refs; demos that aren't known are left out. demos: (demo_id, lang, code)."""
    refs = chunks.select("chunk_id", F.posexplode("demo_refs").alias("n", "demo_id")).distinct()
    block = F.concat(F.lit("```"), F.col("lang"), F.lit("\n"), F.col("code"), F.lit("\n```"))
    blocks = refs.join(demos.select("demo_id", block.alias("block")), "demo_id").groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]).alias("blocks"))
    joined = chunks.join(blocks, "chunk_id", "left")
    return joined.withColumn("hydrated", F.concat_ws("\n\n", F.array("text"), F.coalesce("blocks", T.empty_array()))).drop("blocks")


def contexts(results: DataFrame) -> DataFrame:
    """(query_id, context) of results (query_id, rank, chunk_id, hydrated): numbered passages by rank."""
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("chunk_id"), F.lit(")\n"), F.col("hydrated"))
    per = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", passage.alias("passage")))).alias("p"))
    return per.select("query_id", F.array_join(F.transform("p", lambda x: x["passage"]), "\n\n").alias("context"))


def grounded_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Numbered passages:\n"), context, F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer:"))


def chat(system: Column, prompt: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def cited_in_range(answer: Column, passages: Column) -> Column:
    """The cited passage numbers from 1 to ``passages``, in order."""
    return F.array_sort(F.filter(T.cited_numbers(answer), lambda n: (n >= 1) & (n <= passages)))


def citations(answers: DataFrame, results: DataFrame, paths: DataFrame, repo: str, tag: str, corpus_dir: str = "data/corpus") -> DataFrame:
    """answers (answer_id, query_id, answer_text) with ``citations``, one per retrieved passage in rank order
    (see schemas.CITATION). results: (query_id, rank, chunk_id, doc_id, score, url, demo_refs); paths: (url,
    flat_name). A passage without a url has no source urls; an answer without passages no citations."""
    r = results.join(paths.select("url", "flat_name"), "url", "left")
    per = answers.select("answer_id", "query_id", T.cited_numbers(F.col("answer_text")).alias("__cited")).join(r, "query_id")
    source = F.struct(F.col("url").alias("repo_path"), F.concat(F.lit(corpus_dir + "/"), F.col("flat_name")).alias("corpus_path"), T.source_url(repo, tag, F.col("url")).alias("github_url"))
    one = F.struct(F.col("rank").cast("int").alias("passage_number"), "chunk_id", "doc_id", F.col("score").cast("double").alias("score"), F.array_contains("__cited", F.col("rank").cast("int")).alias("cited_in_text"), source.alias("source"), F.coalesce("demo_refs", T.empty_array()).alias("demo_refs"))
    lists = per.groupBy("answer_id").agg(F.array_sort(F.collect_list(one)).alias("citations"))
    return answers.join(lists, "answer_id", "left").withColumn("citations", F.coalesce("citations", F.expr("from_json('[]', 'array<struct<passage_number:int,chunk_id:string,doc_id:string,score:double,cited_in_text:boolean,source:struct<repo_path:string,corpus_path:string,github_url:string>,demo_refs:array<string>>>')")))


def arms(spark, retrievers: Sequence[str], modes: Sequence[str] = ("naive", "rag"), known: Sequence[str] = ("dense", "bm25")) -> DataFrame:
    """(place, mode, retriever): naive first, then a row per retriever. An unknown retriever or mode raises."""
    for r in retrievers:
        if r not in known:
            raise ValueError(f"unknown retriever {r!r}")
    for m in modes:
        if m not in ("naive", "rag"):
            raise ValueError(f"unknown mode {m!r}")
    rows = [("naive", None)] * ("naive" in modes) + [("rag", r) for r in retrievers] * ("rag" in modes)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, mode string, retriever string")


def answer_id(query_id: Column, mode: Column, retriever: Column) -> Column:
    return F.when(mode == "naive", F.format_string("%s-naive", query_id.cast("string"))).otherwise(F.concat(query_id.cast("string"), F.lit("-rag-"), retriever))


def run(questions: DataFrame, retrievers: dict[str, DataFrame], make: Callable[[], models.Generator], paths: DataFrame, repo: str, tag: str, modes: Sequence[str] = ("naive", "rag")) -> DataFrame:
    """Answers (schemas.ANSWERS) of all questions in all arms, in order of question and arm.

    retrievers: by name, the results (query_id, rank, chunk_id, doc_id, score, url, demo_refs, hydrated) for
    all questions. Generation runs in Arrow batches, one model per worker.
    """
    spark = questions.sparkSession
    arm = arms(spark, list(retrievers), modes, list(retrievers))
    grid = questions.select(F.col("question_id").alias("query_id"), "question_text").crossJoin(F.broadcast(arm))
    all_results = None
    for name, r in retrievers.items():
        one = r.withColumn("retriever", F.lit(name))
        all_results = one if all_results is None else all_results.unionByName(one)
    naive = grid.where("mode = 'naive'").withColumns({"system": F.lit(NAIVE_SYSTEM), "prompt": F.col("question_text")})
    made = naive
    if all_results is not None and "rag" in modes:
        key = F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("retriever"))
        ctx = contexts(all_results.withColumn("query_id", key)).withColumnRenamed("query_id", "__key")
        rag = grid.where("mode = 'rag'").join(ctx, key == F.col("__key"), "left")
        rag = rag.withColumns({"system": F.lit(GROUNDED_SYSTEM), "prompt": grounded_prompt(F.coalesce("context", F.lit("")), F.col("question_text"))}).select(naive.columns)
        made = naive.unionByName(rag)
    answered = models.generate(made, make).withColumn("answer_id", answer_id(F.col("query_id"), F.col("mode"), F.col("retriever")))
    base = answered.drop("system", "prompt")
    none = base.where("mode = 'naive'").withColumn("citations", F.expr("from_json('[]', 'array<struct<passage_number:int,chunk_id:string,doc_id:string,score:double,cited_in_text:boolean,source:struct<repo_path:string,corpus_path:string,github_url:string>,demo_refs:array<string>>>')"))
    out = none
    for name, r in (retrievers if "rag" in modes else {}).items():
        out = out.unionByName(citations(base.where((F.col("mode") == "rag") & (F.col("retriever") == name)), r, paths, repo, tag))
    return out.orderBy("query_id", "place").select("answer_id", F.col("query_id").alias("question_id"), "question_text", "mode", "retriever", "answer_text", "citations")


def report(answers: DataFrame) -> DataFrame:
    """(arm, answers, refusals, grounded): refusals start with the refusal sentence, grounded answers cite."""
    return answers.groupBy(T.arm(F.col("mode"), F.col("retriever")).alias("arm")).agg(
        F.count("*").alias("answers"), F.count_if(F.startswith("answer_text", F.lit(REFUSAL))).alias("refusals"), F.count_if(F.exists("citations", lambda c: c["cited_in_text"])).alias("grounded"))
