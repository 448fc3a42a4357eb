import hashlib
import random

import public_tokenizers as P
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.TreeBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, leaf=6, window=2)


def test_tokens_encode_to_themselves(coder):
    """The rank file has the property on which stable pairs rest."""
    for i, b in list(coder.bytes_of.items())[::7]:
        assert coder.bpe._core_bpe.encode_single_piece(b) == [i]


ALPHABET = "ab cdesrtlm'’  \n\t\x1c\x85 　019é漢字😀.,!?-—"


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=200), st.integers(2, 40), st.integers(2, 9))
def test_tree_equals_one_piece(text, leaf, window):
    c = test_tree_equals_one_piece.coder
    c.leaf, c.window = leaf, window
    ids = c.encode(text)
    assert ids == c.bpe.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


test_tree_equals_one_piece.coder = bpe.TreeBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The leftmost of the lowest-ranked neighbours is merged until none has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=120), st.integers(2, 20), st.integers(2, 9))
def test_tree_equals_rank_merges(text, leaf, window):
    c = test_tree_equals_one_piece.coder
    c.leaf, c.window = leaf, window
    ranks = {b: i for i, b in c.bytes_of.items()}
    assert c.encode(text) == [i for m in regex.finditer(P.PATTERN, text) for i in merged(m[0].encode(), ranks)]


def test_long_runs(coder):
    r = random.Random(3)
    coder.leaf, coder.window = 64, 16
    for chars in ("abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n ", "!?-=*", "漢字語文", "ab0", "a'", "é́"):
        for n in (1, 63, 64, 65, 700, 5000):
            t = "".join(r.choice(chars) for _ in range(n))
            for text in (t, f"x {t}", f"{t} end", f"'{t}'s"):
                assert coder.encode(text) == coder.bpe.encode_ordinary(text)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    plain = test_tree_equals_one_piece.coder.bpe
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text)
        g = got[r.doc_id]
        assert g.ids == ids and g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=False).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256 == nothing) for r in got) == [("1", 0, True), ("2", 0, True), ("2", 0, True), ("None", 1, False)]
    assert bpe.encode_decode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
