import re

import numpy as np

from lodestone.operators import dense, models
from lodestone.plans import queries


def test_stand_in_vectors():
    seeds = np.array([0, 1, 2**32 - 1, 2**32, 2**63 + 5, 2**64 - 1], np.uint64)
    assert (models._normals(seeds, 7) == [np.random.default_rng(int(s)).standard_normal(7) for s in seeds]).all()
    m = models.HashEmbedder(5)
    for text in ("", "..", "a", " Ab_é a ß9\U0001f600x ²ⅷ 中文。 "):
        assert m.tokens(text) == [w.span() for w in re.finditer(r"\w+", text)]
        assert m.token_vectors(text).shape == (len(m.tokens(text)), 5)
    assert (m.token_vectors("Red red")[0] == m.token_vectors("x red")[1]).all()


def test_forgotten_words_have_the_same_vectors(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(200))
    want = models.HashEmbedder(6).token_vectors(text)
    monkeypatch.setattr(models, "_KEPT_WORDS", 3)
    assert all((models.HashEmbedder(6).token_vectors(part) == want[i : i + 10]).all() for i in range(0, 200, 10) for part in [" ".join(text.split()[i : i + 10])])


def test_documents_in_one_pass(spark):
    words = " ".join(f"é{i}, -" for i in range(40))
    docs = spark.createDataFrame([(1, words), (2, " one two. "), (3, "..."), (4, None), (5, ""), (6, words + " end")], "doc_id long, text string")
    cuts = [(d, f"{d}#{a:03d}", a, a + n) for d in (1, 6) for a, n in ((0, 30), (20, 45), (50, 120), (101, 2), (120, 60), (160, 900), (7, 250))] + [(2, "2#all", 0, 10), (2, "2#none", 8, 10), (3, "3#all", 0, 3), (5, "5#all", 0, 0), (4, "4#all", None, None), (9, "9#all", 0, 3)]
    chunks = spark.createDataFrame(cuts, "doc_id long, chunk_id string, char_start int, char_end int")
    tokens = models.token_spans(docs, models.HashEmbedder)
    n = tokens.groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n_tokens")
    for coverage, context in ((12, 20), (5, 40), (100, 100)):
        wins = dense.windows(dense.token_ranges(chunks, tokens), n, coverage, context)
        want = {r.chunk_id: r.embedding for r in models.embed_windows(dense.window_texts(docs, chunks, tokens, wins), models.HashEmbedder).collect()}
        got = {r.chunk_id: r.embedding for r in models.embed_documents(docs, chunks, models.HashEmbedder, coverage, context).collect()}
        assert got == want and "2#all" in got and "3#all" not in got


def test_windows_are_packed_alike(spark):
    at = models._places(models.HashEmbedder(), "x " * 60)
    spans = [{"chunk_id": f"c{a:03d}-{n}", "char_start": a, "char_end": a + n} for a, n in ((0, 9), (6, 20), (30, 3), (40, 40), (40, 10), (70, 50))]
    docs = spark.createDataFrame([(1, "x " * 60)], "doc_id int, text string")
    ranges = dense.token_ranges(spark.createDataFrame([(1, *s.values()) for s in spans], "doc_id int, chunk_id string, char_start int, char_end int"), models.token_spans(docs, models.HashEmbedder))
    for coverage, context in ((10, 15), (25, 30), (4, 4), (50, 59)):
        want = {(r.context_start, r.window_end, tuple(sorted(r.owned))) for r in dense.windows(ranges, spark.createDataFrame([(1, 60)], "doc_id int, n_tokens long"), coverage, context).collect()}
        assert {(a, b, tuple(sorted(s["chunk_id"] for s in owned))) for a, b, owned in models._windows(at, spans, coverage, context)} == want


def test_query_has_no_row_per_token(spark, sf):
    plan = queries.embed_windows_stub(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Window" not in plan
