import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25, dense, generation_metrics, rag, retrieval_metrics, review


def ranked(spark, rankings):
    rows = [(q, i, item) for q, items in rankings.items() for i, item in enumerate(items, 1)]
    return spark.createDataFrame(rows, "query_id long, rank int, item string")


@pytest.mark.parametrize("items,k,want", [("axbyz", 5, (0.4, 1.0, 1.0, 0.9197207891481876)), ("xayzwb", 5, (0.2, 0.5, 0.5, 0.38685280723454163)), ("xyz", 3, (0, 0, 0, 0))])
def test_goldens(spark, items, k, want):
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, item string")
    m = retrieval_metrics.per_query(retrieval_metrics.gold_ranks(ranked(spark, {1: items}), gold), k).first()
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip((m.precision, m.recall, m.reciprocal_rank, m.ndcg), want))


BM25_RANKS = {1: [1], 2: [1], 3: [3], 4: [3], 5: [1], 6: [19], 7: [61], 8: [1, 23], 9: [1, 111], 10: [1, 8]}
DENSE_RANKS = {1: [1], 2: [2], 3: [13], 4: [4], 5: [1], 6: [2], 7: [1], 8: [2, 1], 9: [35, 1], 10: [2, 21]}


@pytest.mark.parametrize("ranks,want", [(BM25_RANKS, (0.16, 0.65, 0.6735691688236985, 0.5839441578296375)), (DENSE_RANKS, (0.2, 0.8, 0.6826923076923077, 0.6692536065216308))])
def test_published_aggregates(spark, ranks, want):
    rows = [(q, f"g{i}", r) for q, rs in ranks.items() for i, r in enumerate(rs)]
    m = retrieval_metrics.macro(retrieval_metrics.per_query(spark.createDataFrame(rows, "query_id long, item string, rank int"), 5)).first()
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip((m.precision, m.recall, m.reciprocal_rank, m.ndcg), want))


def test_bad_rankings_raise(spark):
    gold = spark.createDataFrame([(1, "a")], "query_id long, item string")
    retrieval_metrics.validate(ranked(spark, {1: "ab"}), gold, 5)
    for r, g, k in ((ranked(spark, {1: "aa"}), gold, 5), (ranked(spark, {2: "a"}), gold, 5), (ranked(spark, {1: "a"}), gold.union(gold), 5), (ranked(spark, {1: "a"}), gold, 0)):
        with pytest.raises(ValueError):
            retrieval_metrics.validate(r, g, k)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("p,r,want", [("", "", 1.0), ("a", "", 0.0), ("a b", "c", 0.0), ("a a b", "a b b", 2 / 3), ("It’s [1] OK!", "it's ok", 1.0)])
def test_token_f1(spark, p, r, want):
    assert math.isclose(one(spark, T.token_f1(T.answer_tokens(F.lit(p)), T.answer_tokens(F.lit(r)))), want)


def test_citations(spark):
    said = F.lit("[1] [7] [1, 2] [99999999999]")
    assert one(spark, rag.cited_in_range(said, F.lit(3))) == [1]
    assert sorted(one(spark, T.cited_numbers(said))) == [1, 7]


SOURCE = "struct<repo_path:string,corpus_path:string,github_url:string>"


def answers(spark, rows):
    from lodestone import schemas

    full = [(f"{q}-{m}", q, "?", m, r, t, [(i, c, "d", 1.0, used, (None, None, None), []) for i, (c, used) in enumerate(cs, 1)]) for q, m, r, t, cs in rows]
    return spark.createDataFrame(full, schemas.ANSWERS)


def questions(spark):
    from lodestone import schemas

    return spark.createDataFrame([(1, "?", "yes", ["a", "b"], "factoid"), (2, "?", "I don't know", [], "unanswerable")], schemas.QUESTIONS)


def test_evaluate(spark):
    a = answers(spark, [(1, "rag", "bm25", "Yes [1] [3].", [("a", True), ("b", False)]), (2, "rag", "bm25", " I don't know ", [("a", False)]), (1, "naive", None, "I dont know", [])])
    got = {r.answer_id + r.arm: r for r in generation_metrics.evaluate(a, questions(spark)).collect()}
    x = got["1-ragrag_bm25"]
    assert x.context_has_all_gold and x.support_gate_correct and not x.has_valid_inline_citation and x.invalid_citation_numbers == [3]
    assert x.citation_precision == 1.0 and x.citation_recall == 0.5
    y = got["2-ragrag_bm25"]
    assert y.is_exact_refusal and y.expected_refusal and y.support_gate_correct and not y.unsupported_answer
    z = got["1-naivenaive"]
    assert not z.is_exact_refusal and z.expected_refusal is None and z.citation_precision == 0.0
    agg = {r.arm: r for r in generation_metrics.aggregate(generation_metrics.evaluate(a, questions(spark))).collect()}
    assert agg["naive"].support_gate_accuracy is None and agg["rag_bm25"].support_gate_accuracy == 1.0
    with pytest.raises(ValueError):
        generation_metrics.check(a, questions(spark), ["naive", "rag_bm25"])


@pytest.mark.parametrize("text,want", [("I don't know", True), ("I dont know", False), ("I don't know.", False)])
def test_refusals(spark, text, want):
    a = answers(spark, [(1, "rag", "x", text, [])])
    assert generation_metrics.evaluate(a, questions(spark)).first().is_exact_refusal is want


def test_zero_pad_and_duplicates(spark):
    c = spark.createDataFrame([(10, 0, "the cat"), (11, 1, "a dog"), (12, 2, "the the dog"), (13, 3, "")], "doc_id long, ord long, text string")
    q = spark.createDataFrame([(1, "unknown"), (2, "the"), (3, "the the")], "query_id long, text string")
    got = {}
    for r in bm25.search_corpus(c, q, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got[1] == [(10, 0.0), (11, 0.0), (12, 0.0)]
    assert [d for d, _ in got[2]][2] == 11 and got[2][2][1] == 0.0
    assert all(math.isclose(2 * a, b) for (_, a), (_, b) in zip(got[2], got[3]))
    index = bm25.Index.build(c).search(q, 3).collect()
    assert {(r.query_id, r.rank, r.doc_id) for r in index} == {(r.query_id, r.rank, r.doc_id) for r in bm25.search_corpus(c, q, 3).collect()}


def test_gold_ranks_equal_the_full_ranking(spark, sf):
    docs = bm25.with_order(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    q = spark.createDataFrame([(1, "the"), (2, "de la"), (3, "zzz")], "query_id long, text string")
    scored = bm25.score_corpus(docs, q)
    full = {(r.query_id, r.doc_id): r.rank for r in bm25.search_corpus(docs, q, 200).collect()}
    assert len(full) == 600
    gold = q.crossJoin(docs.select("doc_id")).select("query_id", "doc_id")
    assert {(r.query_id, r.doc_id): r.rank for r in bm25.gold_ranks(scored, gold, docs).collect()} == full


def test_dense_edges(spark):
    i = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "item long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, qvec array<float>")
    got = [(r.query_id, r.rank, r.item) for r in dense.top_k(i, q, 10).orderBy("rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 2), (7, 3, 3)]
    assert dense.top_k(i, q.where("query_id = 8"), 3).count() == 0
    assert one(spark, dense.unit(F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_token_ranges_equal_the_pairwise_count(spark):
    import random

    r, tokens, chunks = random.Random(9), [], []
    for d in range(30):
        at = 0
        for n in range(r.randrange(0, 40)):
            at += r.randrange(0, 3)
            end = at + r.randrange(0, 4)  # some have no width
            tokens.append((d, n, at, end))
            at = end
        for c in range(8):
            a = r.randrange(0, at + 2)
            chunks.append((d, f"{d}.{c}", a, a + r.randrange(0, 20)))
    tokens += [(None, 0, 0, 3)]
    chunks += [(None, "x", 0, 9), (1, "open", None, 9)]
    t = spark.createDataFrame(tokens, "doc_id int, tok int, start int, end int")
    c = spark.createDataFrame(chunks, "doc_id int, chunk_id string, char_start int, char_end int")
    got = {(x.doc_id, x.chunk_id): (x.token_start, x.token_end) for x in dense.token_ranges(c, t).collect()}
    want = {}
    for d, cid, a, b in chunks:
        inside = [n for e, n, s, f in tokens if d is not None and a is not None and e == d and f > s and s >= a and f <= b]
        if inside:
            want[d, cid] = (min(inside), max(inside) + 1)
    assert got == want and len(want) > 100


def test_pack_windows_equals_the_fold(spark):
    import random

    r, docs, rows = random.Random(4), {}, []
    for d in range(40):
        at, spans = 0, []
        for c in range(r.randrange(1, 15)):
            start = at
            at += r.randrange(1, 60)
            spans.append((start, at, f"{d}.{c:02d}"))
        docs[d] = spans
        rows += [(d, c, s, e) for s, e, c in spans]
    got = {}
    for w in dense.pack_windows(spark.createDataFrame(rows, "doc_id int, chunk_id string, token_start int, token_end int"), 100, 130).orderBy("doc_id", "window").collect():
        got.setdefault(w.doc_id, []).append((w.owned, w.context_start, w.window_end))
    for d, spans in docs.items():
        want, k = [], len(spans) - 1
        while k >= 0:
            end, lo = spans[k][1], k
            while lo > 0 and end - spans[lo - 1][0] <= 100:
                lo -= 1
            want.insert(0, ([s[2] for s in spans[lo : k + 1]], min(spans[lo][0], max(0, end - 130)), end))
            k = lo - 1
        assert got[d] == want


def test_review(spark):
    cols = "answer_id string, question_id int, arm string, question_type string, manual_correctness_0_to_2 string, manual_groundedness_0_to_2 string, manual_completeness_0_to_2 string, manual_notes string"
    rows = [("1", 1, "naive", "factoid", "2", "2", "1", ""), ("2", 1, "rag_bm25", "factoid", "1", "2", "2", ""), ("3", 1, "rag_dense", "factoid", "2", "2", "2", "")]
    d = review.diagnostic(spark.createDataFrame(rows, cols)).first()
    assert d.naive_status == "incorrect" and d.best_rag_system == "dense" and not d.retrieval_improved_answer
    assert "| 1 | factoid | incorrect | 2/2 | 1/2 | 2/2 |" in review.markdown(review.diagnostic(spark.createDataFrame(rows, cols)))
    for bad in ("", "3", "1.5", "x"):
        with pytest.raises(ValueError, match="correctness"):
            review.validate(spark.createDataFrame([("1", 1, "naive", "factoid", bad, "2", "1", "")], cols))
    review.validate(spark.createDataFrame(rows, cols))
