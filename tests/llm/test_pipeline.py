"""The pipeline against plain Python versions of its stages."""

from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from lodestone.llm import bpe, simhash

from . import brute

SF = "/root/testdata/sf0.01"


def normalised(line):
    line = brute.ascii_lower("".join("0" if c in "123456789" else c for c in line))
    return " ".join(brute.words(line))


def quality(docs):
    lines = [[(i, line, normalised(line)) for i, line in enumerate(t.split("\n")) if brute.words(line)] for _, t, _ in docs]
    own = [normalised(t) for _, t, _ in docs]
    held, all_ = {}, {}
    for (_, _, s), ls, d in zip(docs, lines, own):
        if ls:
            all_.setdefault(s, set()).add(d)
        for *_, h in ls:
            held.setdefault((s, h), set()).add(d)
    out = []
    for (i, t, s), ls in zip(docs, lines):
        over = {k for k, _, h in ls if len(held[s, h]) > max(10, 0.02 * len(all_[s]))}
        n, _, _, _, rep = brute.quality_counts(t)
        gone = sum(len(brute.words(line)) for k, line, _ in ls if k in over)
        if not (n < 50 or 100 * rep > 50 * n or n - gone < 0.2 * n):
            out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in over), s))
    return out


def dedup_bounds(docs):
    """(must go, may go): what narrow links alone remove, and what narrow and all wide links would."""
    narrow = {i for (i, _, c) in brute.simhash_components([(i, t) for i, t, _ in docs], 3, 5) if i != c}
    m = np.stack([simhash._margins(t, 5, 42, simhash._WIDE) for _, t, _ in docs]) > 0
    bits = np.packbits(m, axis=1).view(np.uint64)
    pairs = []
    for k in range(len(docs)):
        x = bits[k + 1 :] ^ bits[k]
        pairs += [(k, k + 1 + int(j)) for j in np.nonzero((np.bitwise_count(x).sum(axis=1) <= simhash._WIDE_RADIUS) | (np.bitwise_count(x[:, 0]) <= 3))[0]]
    root = brute.roots(len(docs), pairs)
    least = {}
    for (i, _, _), r in zip(docs, root):
        least[r] = min(least.get(r, i), i)
    return narrow, {i for (i, _, _), r in zip(docs, root) if least[r] != i}


def sanitised(docs):
    terms = brute.telling([t for _, t, _ in docs])
    return [(i, brute.sanitise(t, terms), s) for i, t, s in docs]


def mix(docs):
    out = []
    for at, n in brute.mix_queue([(i, s, t) for i, t, s in docs]):
        i, t, s = docs[at]
        ends = [m.end() for m in brute.WORD.finditer(t)]
        out.append((i, t if n == len(ends) else t[: ends[n - 1]], s))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    return docs, plain


def rows(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_each_stage(spark, stages):
    docs, plain = stages
    for (_, stage), model in zip(corpus_pipeline.STAGES[:4], (quality, None, sanitised, mix)):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if model is None:
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            must, may = dedup_bounds(plain)
            gone = {i for i, _, _ in plain} - kept
            assert must <= gone <= may and len(gone) >= 0.9 * len(may)
            plain = [d for d in plain if d[0] in kept]
        else:
            plain = model(plain)
        got, want = rows(out), Counter(plain)
        assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
        assert all(r.n_chars == len(r.text) for r in out.collect())
        docs = spark.createDataFrame([(i, t, "x", s, len(t)) for i, t, s in plain], "doc_id long, text string, lang string, source string, n_chars long")
    last = corpus_pipeline.tokenize(spark, docs, SF)
    enc = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).bpe
    assert Counter((r.doc_id, r.n_tokens) for r in last.collect()) == Counter((i, len(enc.encode_ordinary(t))) for i, t, _ in plain)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_take_edges(spark):
    rows_ = [(1, None, None, None, None), (None, "", "en", "a", 0), (3, " ".join(f"w{i}" for i in range(80)), None, None, 5), (3, " ".join(f"w{i}" for i in range(80)), None, None, 5)]
    docs = spark.createDataFrame([(*r, "x") for r in rows_], "doc_id long, text string, lang string, source string, n_chars long, __key string")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            out.collect()
            if stage is not corpus_pipeline.tokenize:
                assert out.columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, docs, SF).count() == 2  # the empty texts are one group, the long ones another
