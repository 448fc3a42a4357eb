"""BM25 as an inverted index: postings with hoisted weights, set-based search, deterministic top-k.

A corpus is a DataFrame (doc_id, ord, text): ``ord`` is the document's place in the corpus and breaks ties.
Queries are (query_id, text). A query's score is a sum over its words, repetitions included, of
idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg_len)); everything but the repetitions is known when
the index is built, so a posting carries its finished weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.tables import cut

K1, B = 1.5, 0.75
#: Rows of the queries' terms up to which they are broadcast to the postings.
BROADCAST_TERMS = 200_000


def with_order(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with ``ord``, the place in key order, without one task for all rows: range-partitioned, then
    numbered within the partitions and shifted by the sizes of those before. All columns of docs are moved;
    for large texts give the keys alone and join what is needed."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of our own is kept by AQE
    ranged = docs.repartitionByRange(parts, F.col(key)).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(key)))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__p").withColumn("ord", F.col("__before") + F.col("__i") - 1).drop("__p", "__i", "__before")


def lengths(corpus: DataFrame) -> DataFrame:
    """(doc_id, ord, doc_len): words per document, 0 included."""
    return corpus.select("doc_id", "ord", F.size(T.words("text")).cast("bigint").alias("doc_len"))


def term_frequencies(corpus: DataFrame) -> DataFrame:
    """(doc_id, ord, term, tf)"""
    # the outer form: Spark would repeat the pattern match in a filter for empty arrays
    w = corpus.select("doc_id", "ord", F.explode_outer(T.words("text")).alias("term")).where("term is not null")
    return w.groupBy("doc_id", "ord", "term").agg(F.count("*").cast("bigint").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").cast("bigint").alias("df"))


def stats(lens: DataFrame) -> DataFrame:
    """One row (n_docs, avg_len). An empty corpus has no average: null."""
    return lens.agg(F.count("*").cast("bigint").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))).otherwise(F.lit(0.0))


def weight(tf: Column, idf_: Column, doc_len: Column, avg: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * (tf * F.lit(k1 + 1)) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * doc_len / avg))


@dataclass
class Index:
    """The four tables of an index. ``postings``: (term, ord, doc_id, tf, w); ``terms``: (term, df, idf);
    ``docs``: (doc_id, ord, doc_len); ``stats``: one row."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame

    @staticmethod
    def build(corpus: DataFrame, k1: float = K1, b: float = B) -> Index:
        lens = lengths(corpus)
        one = stats(lens)
        w_ = corpus.select("doc_id", "ord", T.words("text").alias("w")).select("doc_id", "ord", F.size("w").cast("bigint").alias("doc_len"), F.explode_outer("w").alias("term")).where("term is not null")
        tf = cut(w_.groupBy("doc_id", "ord", "doc_len", "term").agg(F.count("*").cast("bigint").alias("tf")))
        terms = cut(document_frequencies(tf).crossJoin(F.broadcast(one)).select("term", "df", "avg_len", idf(F.col("n_docs"), F.col("df")).alias("idf")))
        joined = tf.join(terms.select("term", "idf", "avg_len"), "term")
        w = weight(F.col("tf"), F.col("idf"), F.col("doc_len"), F.col("avg_len"), k1, b)
        return Index(joined.select("term", "ord", "doc_id", "tf", w.alias("w")), terms.drop("avg_len"), lens, one)

    def save(self, folder: str) -> None:
        """Parquet tables; postings lie in ranges of terms, so a search reads few row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "ord").write.mode("overwrite").parquet(f"{folder}/postings")
        for name in ("terms", "docs", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        return Index(*(spark.read.parquet(f"{folder}/{n}") for n in ("postings", "terms", "docs", "stats")))

    def report(self) -> DataFrame:
        """(n_docs, avg_len, n_terms)"""
        return self.stats.crossJoin(self.terms.agg(F.count("*").cast("bigint").alias("n_terms")))

    def scores(self, queries: DataFrame) -> DataFrame:
        return score(self.postings, queries)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return top_k(parts(self.postings, queries), queries, self.docs, k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): repeated words count as often as they occur."""
    w = queries.select("query_id", F.explode(T.words("text")).alias("term"))
    return w.groupBy("query_id", "term").agg(F.count("*").cast("bigint").alias("qtf"))


def parts(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ord, doc_id, score): what each shared word adds to a document's score."""
    hit = postings.join(query_terms(queries), "term")
    return hit.select("query_id", "ord", "doc_id", (F.col("qtf") * F.col("w")).alias("score"))


def summed(parts_: DataFrame) -> DataFrame:
    return parts_.groupBy("query_id", "ord", "doc_id").agg(F.sum("score").alias("score"))


def score(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ord, doc_id, score) of the documents that hold a word of the query."""
    return summed(parts(postings, queries))


def search_corpus(corpus: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """Top-k without an index: one pass over the texts in which only words of the queries are exploded."""
    return top_k(parts(corpus_postings(corpus, queries, k1, b), queries), queries, corpus.select("doc_id", "ord"), k)


def score_corpus(corpus: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``score`` straight from the texts."""
    return score(corpus_postings(corpus, queries, k1, b), queries)


def corpus_postings(corpus: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Postings of the queries' words only, written once, as document frequencies and scores both need them.
    The semi-join by these words comes before any shuffle when their number allows a broadcast; document
    frequencies of other words are never needed."""
    wanted = cut(query_terms(queries).select("term").distinct().where("term <> ''"))
    if wanted.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    # Words that aren't wanted are one null term of the document, of which it has one more, so that each has a row.
    w = corpus.select("doc_id", "ord", T.words("text").alias("w")).select("doc_id", "ord", F.size("w").cast("bigint").alias("doc_len"), F.explode(F.array_append("w", "")).alias("term"))
    w = w.join(wanted.withColumn("wanted", F.lit(True)), "term", "left").select("doc_id", "ord", "doc_len", F.when(F.col("wanted"), F.col("term")).alias("term"))
    counted = cut(w.groupBy("doc_id", "ord", "doc_len", "term").agg(F.count("*").cast("bigint").alias("tf")))
    tf, one = counted.where("term is not null"), F.broadcast(stats(counted.where("term is null")))
    terms = document_frequencies(tf).crossJoin(one).select("term", "avg_len", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    return tf.join(terms, "term").withColumn("w", weight(F.col("tf"), F.col("idf"), F.col("doc_len"), F.col("avg_len"), k1, b)).select("term", "ord", "doc_id", "tf", "w")


def rank_order() -> list[Column]:
    """Best first; scores that differ by rounding are ties, which go by place in the corpus."""
    return [F.round("score", 9).desc(), F.col("ord").asc()]


def top_k(parts_: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, ord, score), k rows per query, from summands (query_id, ord, doc_id, score).

    Queries with fewer hits are filled up with the first documents of the corpus that they don't hit, at
    score 0: each query gets the first 2k documents as summands of 0, and k hits can hide at most k of these.
    """
    first = docs.orderBy("ord").limit(2 * k).select("doc_id", "ord")
    pad = queries.select("query_id").distinct().crossJoin(F.broadcast(first)).select("query_id", "ord", "doc_id", F.lit(0.0).alias("score"))
    best = W.partitionBy("query_id").orderBy(*rank_order())
    hits = summed(parts_.unionByName(pad)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "doc_id", "ord", "score")


def gold_ranks(scored: DataFrame, gold: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank): the rank of each gold document (query_id, doc_id) in the ranking of all
    documents, without making that ranking: 1 + better ones + ties before it. A gold document that the query
    doesn't hit comes after all hits, among the others by place. docs: (doc_id, ord), ord counting from 0."""
    order = docs.select("doc_id", "ord")
    wanted = scored.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    s = wanted.select("query_id", "doc_id", F.round("score", 9).alias("score")).join(order, "doc_id")
    g = gold.select("query_id", "doc_id").join(order.withColumnRenamed("ord", "gord"), "doc_id").join(s.select("query_id", "doc_id", F.col("score").alias("gscore")), ["query_id", "doc_id"], "left")
    g = g.select("query_id", "doc_id", "gord", F.coalesce("gscore", F.lit(0.0)).alias("gscore"))
    ahead = (F.col("score") > F.col("gscore")) | ((F.col("score") == F.col("gscore")) & (F.col("ord") < F.col("gord")))
    counted = g.join(s.select("query_id", "ord", "score"), "query_id", "left").groupBy("query_id", "doc_id", "gord", "gscore").agg(
        F.count_if(F.coalesce(ahead, F.lit(False))).alias("ahead"), F.count_if(F.coalesce(F.col("ord") < F.col("gord"), F.lit(False))).alias("hits_before"))
    other = F.when(F.col("gscore") == 0, F.col("gord") - F.col("hits_before")).otherwise(F.lit(0))
    return counted.select("query_id", "doc_id", (1 + F.col("ahead") + other).cast("bigint").alias("rank"))
