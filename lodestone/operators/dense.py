"""Dense retrieval: late chunking, window packing, an exact inner-product index and top-k search.

Models stand behind ``lodestone.operators.models.Embedder``; everything here is what surrounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens that a window may cover with chunks, and those that the model sees.
COVERAGE_TOKENS, MAX_CONTEXT_TOKENS = 6000, 8000
#: Queries that are broadcast to the index in one go; more are searched in several.
QUERY_BATCH = 4096


def token_ranges(chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, token_start, token_end) from chunks (doc_id, chunk_id, char_start, char_end) and
    tokens (doc_id, tok, start, end): the tokens with a width that lie wholly in the chunk, end exclusive.
    Tokens are in the order of their places. Chunks and tokens of a document are sorted together, by start and
    by end, so its cost is their sum and not their product; one shuffle serves both sorts and the result."""
    t = tokens.where(F.col("end") > F.col("start")).select("doc_id", "tok", "start", "end", F.lit(0).alias("side"))
    c = chunks.where("doc_id is not null and char_start is not null and char_end is not null")
    c = c.select("doc_id", "chunk_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.lit(1).alias("side"))
    doc = W.partitionBy("doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    low = F.min("tok").over(doc.orderBy(F.desc("start"), "side"))
    high = F.max("tok").over(doc.orderBy("end", "side"))
    inside = c.unionByName(t, allowMissingColumns=True).withColumns({"low": low, "high": high}).where("side = 1 and low <= high")
    return inside.groupBy("doc_id", "chunk_id").agg(F.min("low").alias("token_start"), (F.max("high") + 1).alias("token_end"))


def unmapped(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    return chunks.join(ranges.select("chunk_id"), "chunk_id", "left_anti").select("doc_id", "chunk_id")


def _pack(spans: Column, coverage: int, context: int) -> Column:
    """Windows from the last chunk backwards: a window takes earlier chunks while it covers at most
    ``coverage`` tokens, and starts up to ``context`` tokens before its end."""
    none = F.expr("cast(array() as array<struct<lo:int,hi:int,we:int>>)")
    order = F.when(F.size(spans) > 0, F.reverse(F.sequence(F.lit(0), F.size(spans) - 1))).otherwise(F.expr("cast(array() as array<int>)"))

    def step(acc, k):
        last, s = F.try_element_at(acc, F.lit(-1)), F.get(spans, k)
        fits = last.isNotNull() & (last["we"] - s["token_start"] <= coverage)
        grown = F.struct(k.alias("lo"), last["hi"].alias("hi"), last["we"].alias("we"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.array_append(acc, F.struct(k.alias("lo"), k.alias("hi"), s["token_end"].alias("we"))))

    packed = F.reverse(F.aggregate(order, none, step))
    return F.transform(packed, lambda w: F.struct(
        F.transform(F.slice(spans, w["lo"] + 1, w["hi"] - w["lo"] + 1), lambda s: s["chunk_id"]).alias("owned"),
        F.least(F.get(spans, w["lo"])["token_start"], F.greatest(F.lit(0), w["we"] - context)).alias("context_start"), w["we"].alias("window_end")))


def pack_windows(ranges: DataFrame, coverage: int = COVERAGE_TOKENS, context: int = MAX_CONTEXT_TOKENS) -> DataFrame:
    """(doc_id, window, owned, context_start, window_end) from token_ranges. A chunk larger than ``coverage``
    has a window of its own."""
    span = F.struct(F.col("token_start").cast("int").alias("token_start"), F.col("token_end").cast("int").alias("token_end"), "chunk_id")
    per = ranges.groupBy("doc_id").agg(F.sort_array(F.collect_list(span)).alias("__s"))
    return per.select("doc_id", F.posexplode(_pack(F.col("__s"), coverage, context)).alias("window", "w")).select("doc_id", "window", "w.owned", "w.context_start", "w.window_end")


def windows(ranges: DataFrame, doc_tokens: DataFrame, coverage: int = COVERAGE_TOKENS, context: int = MAX_CONTEXT_TOKENS) -> DataFrame:
    """``pack_windows`` for documents over ``context`` tokens; the others are one window that owns all.
    doc_tokens: (doc_id, n_tokens)."""
    r = ranges.join(doc_tokens, "doc_id")
    small = r.where(F.col("n_tokens") <= context)
    one = small.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token_start", "token_end", "chunk_id"))).alias("s"), F.max("n_tokens").cast("int").alias("window_end"))
    one = one.select("doc_id", F.lit(0).alias("window"), F.transform("s", lambda x: x["chunk_id"]).alias("owned"), F.lit(0).alias("context_start"), "window_end")
    return one.unionByName(pack_windows(r.where(F.col("n_tokens") > context).drop("n_tokens"), coverage, context))


def window_texts(docs: DataFrame, chunks: DataFrame, tokens: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, window, base, text, spans): the text that the model sees for each window, from the window's
    first to its last token, base code points into the document, and the spans of the chunks that it owns.
    docs: (doc_id, text); chunks: (doc_id, chunk_id, char_start, char_end); tokens: (doc_id, tok, start, end)."""
    ends = wins.select("doc_id", "window", F.explode(F.array(F.col("context_start"), F.col("window_end") - 1)).alias("tok"))
    cuts = ends.join(tokens, ["doc_id", "tok"]).groupBy("doc_id", "window").agg(F.min("start").alias("base"), F.max("end").alias("stop"))
    owned = wins.select("doc_id", "window", F.explode("owned").alias("chunk_id")).join(chunks.select("chunk_id", "char_start", "char_end"), "chunk_id")
    spans = owned.groupBy("doc_id", "window").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "char_start", "char_end"))).alias("spans"))
    text = F.substring("text", F.col("base") + 1, F.col("stop") - F.col("base"))
    return cuts.join(spans, ["doc_id", "window"]).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "window", "base", text.alias("text"), "spans")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Scaled to length 1; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def pool_spans(spans: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, embedding): the mean, scaled to length 1, of the token vectors of vectors (doc_id,
    start, end, vec) with a width that lie in the span of spans (doc_id, chunk_id, char_start, char_end).
    Spans without a token have no row. Vectors are summed by component, pre-aggregated before the shuffle."""
    v = vectors.where(F.col("end") > F.col("start"))
    inside = spans.select("doc_id", "chunk_id", "char_start", "char_end").join(v, "doc_id").where((F.col("start") >= F.col("char_start")) & (F.col("end") <= F.col("char_end")))
    parts = inside.select("doc_id", "chunk_id", F.posexplode("vec").alias("dim", "x"))
    means = parts.groupBy("doc_id", "chunk_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy("doc_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("s"))
    return whole.select("doc_id", "chunk_id", unit(F.transform("s", lambda p: p["m"])).alias("embedding"))


def with_fallback(chunks: DataFrame, pooled: DataFrame, own: DataFrame) -> DataFrame:
    """(chunk_id, embedding, late): the pooled vector, or else the one that the chunk's own text has."""
    o = own.select("chunk_id", F.col("embedding").alias("__own"))
    out = chunks.select("chunk_id").join(pooled.select("chunk_id", "embedding"), "chunk_id", "left").join(o, "chunk_id", "left")
    return out.select("chunk_id", F.coalesce("embedding", "__own").alias("embedding"), F.col("embedding").isNotNull().alias("late"))


def embedding_report(chunks: DataFrame, wins: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: documents in one window, documents in several, windows, chunks pooled late, chunks embedded
    on their own, chunks without a vector."""
    per = wins.groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = per.agg(F.count_if(F.col("n") == 1).alias("single_pass"), F.count_if(F.col("n") > 1).alias("windowed"), F.coalesce(F.sum("n"), F.lit(0)).alias("windows"))
    n = embedded.agg(F.count_if(F.col("late")).alias("late"), F.count_if(~F.col("late") & F.col("embedding").isNotNull()).alias("fallback"), F.count_if(F.col("embedding").isNull()).alias("missing"))
    return docs.crossJoin(n)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def query_batches(queries: DataFrame) -> list[DataFrame]:
    """queries (query_id, qvec) in parts of about QUERY_BATCH rows, dealt by a hash of the id."""
    parts = max(1, -(-queries.count() // QUERY_BATCH))
    if parts == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item, score) of every item for every query, in double precision: for full-depth rankings
    of a set of test queries, block by block. index: (item, embedding); queries: (query_id, qvec)."""
    out = None
    for batch in query_batches(queries.select("query_id", "qvec")):
        one = index.crossJoin(F.broadcast(batch)).select("query_id", "item", dot(F.col("embedding"), F.col("qvec")).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def top_k(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, item, score): the k items with the largest inner product; ties by item.

    The index is read once per batch of queries: each Arrow batch of it is one matrix product with the
    batch's queries, of which only k rows per query are kept, so what is shuffled grows with the queries and
    the tasks, not with the pairs. Items without a vector are not found; fewer than k items: all of them.
    """
    kind, qkind = index.schema["item"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    q = queries.where("qvec is not null").select("query_id", "qvec")
    out = None
    for group in query_batches(q):
        rows = group.collect()  # QUERY_BATCH vectors or so
        if not rows:
            continue
        qid, qmat = [r.query_id for r in rows], np.array([r.qvec for r in rows], np.float64)
        shared = index.sparkSession.sparkContext.broadcast((qid, qmat))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, qmat = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                s = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) @ qmat.T
                item = pdf["item"].to_numpy()
                size = min(k, len(item))
                # all that tie with the kth stay; the window decides
                cut = np.partition(s, len(item) - size, axis=0)[len(item) - size]
                i, j = np.nonzero(s >= cut)
                yield pd.DataFrame({"query_id": [qid[x] for x in j], "item": item[i], "score": s[i, j]})

        found = index.where("embedding is not null").select("item", "embedding").mapInPandas(best, f"query_id {qkind}, item {kind}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.limit(0).select(F.lit(None).cast(qkind).alias("query_id"), F.lit(1).alias("rank"), "item", F.lit(0.0).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "item", "score")


def gold_ranks(index: DataFrame, queries: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, item, rank): the rank of each gold item (query_id, item) among all items, counted and not sorted:
    1 + those with a larger score + ties before it. Items without a vector are no one's; a gold one is missing.

    The gold items of QUERY_BATCH queries at a time are broadcast with their scores; each Arrow batch of the index
    is counted against them."""
    kind, qkind = index.schema["item"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    have = index.where("embedding is not null").select("item", "embedding")
    out = None
    for group in query_batches(queries.where("qvec is not null").select("query_id", "qvec")):
        rows = gold.select("query_id", "item").distinct().join(F.broadcast(group), "query_id").join(have, "item").collect()  # the batch's gold
        if not rows:
            continue
        qid = sorted({r.query_id for r in rows})
        at = {q: n for n, q in enumerate(qid)}
        qvec = {r.query_id: r.qvec for r in rows}
        qmat = np.array([qvec[q] for q in qid], np.float64)
        asked = [(r.query_id, r.item, round(float(np.dot(np.array(r.embedding, np.float64), qmat[at[r.query_id]])), 9)) for r in rows]
        shared = index.sparkSession.sparkContext.broadcast((at, qmat, asked))

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            at, qmat, asked = shared.value
            for pdf in batches:
                if len(pdf):
                    s = np.round(np.stack(pdf["embedding"].to_numpy()).astype(np.float64) @ qmat.T, 9)
                    item = pdf["item"].to_numpy()
                    n = [int(((s[:, at[q]] > x) | ((s[:, at[q]] == x) & (item < i))).sum()) for q, i, x in asked]
                    yield pd.DataFrame({"query_id": [q for q, *_ in asked], "item": [i for _, i, _ in asked], "ahead": n})

        found = have.mapInPandas(count, f"query_id {qkind}, item {kind}, ahead long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return gold.limit(0).select("query_id", "item", F.lit(0).cast("bigint").alias("rank"))
    return out.groupBy("query_id", "item").agg((F.sum("ahead") + 1).cast("bigint").alias("rank"))
