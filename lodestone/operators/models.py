"""What a model must offer, and deterministic stand-ins without any.

The stand-ins exist so that pipelines run and can be tested without weights; their output says nothing
about retrieval or answer quality.
"""

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.dense import COVERAGE_TOKENS, MAX_CONTEXT_TOKENS
from lodestone.shipping import ship

_WORD = re.compile(r"\w+")
#: Words whose vectors are kept as the latest ones, and as many before them.
_KEPT_WORDS = 100_000


class Embedder(Protocol):
    dim: int

    def tokens(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each token, untruncated."""

    def token_vectors(self, text: str) -> np.ndarray:
        """A vector per token of ``tokens``."""

    def query(self, text: str) -> np.ndarray:
        """The query's vector, of length 1."""


class Generator(Protocol):
    def ask(self, system: str, prompt: str) -> str: ...


class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, chunk_id, score) for queries (query_id, text): all queries at once."""


@functools.cache
def _word_characters() -> np.ndarray:
    """For each code point, whether it is one of \\w."""
    return np.array([c.isalnum() or c == "_" for c in map(chr, range(0x110000))])


def _powers(first: int, factor: int, n: int) -> np.ndarray:
    """first, first * factor, first * factor ** 2, .. in 32 bits, n + 1 of them as a column."""
    return np.array([first * pow(factor, i, 1 << 32) & 0xFFFFFFFF for i in range(n + 1)], np.uint32)[:, None]


_MIXING, _DRAWING = _powers(0x43B0D7E5, 0x931E8875, 16), _powers(0x8B51F9DD, 0x58F38DED, 8)


def _normals(seeds: np.ndarray, dim: int) -> np.ndarray:
    """A row for each seed (uint64): what np.random.default_rng(seed).standard_normal(dim) gives. A generator of its own
    costs each seed far more than the numbers, so all are seeded at once, as SeedSequence and PCG64 do it."""
    shift = np.uint32(16)

    def hashed(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        x = (x ^ by[:-1]) * by[1:]
        return x ^ (x >> shift)

    pool = np.zeros((4, len(seeds)), np.uint32)
    pool[:2] = np.ascontiguousarray(seeds, "<u8").view("<u4").reshape(-1, 2).T
    pool = hashed(pool, _MIXING[:5])
    for i in range(4):
        others = [j for j in range(4) if j != i]
        x = pool[others] * np.uint32(0xCA01F9DD) - hashed(pool[i], _MIXING[4 + 3 * i : 8 + 3 * i]) * np.uint32(0x4973F715)
        pool[others] = x ^ (x >> shift)
    state = np.ascontiguousarray(hashed(np.concatenate([pool, pool]), _DRAWING).T, "<u4").view("<u8")
    bits, out = np.random.PCG64(0), np.empty((len(seeds), dim))
    draw = np.random.Generator(bits)
    for row, (s1, s0, i1, i0) in zip(out, state.tolist(), strict=True):
        inc = ((i1 << 64 | i0) << 1 | 1) & (1 << 128) - 1
        first = ((s1 << 64 | s0) + inc) * 0x2360ED051FC65DA44385DF649FCCF645 + inc & (1 << 128) - 1
        bits.state = {"bit_generator": "PCG64", "state": {"state": first, "inc": inc}, "has_uint32": 0, "uinteger": 0}
        draw.standard_normal(out=row)
    return out


class HashEmbedder:
    """Each word has a fixed pseudo-random vector."""

    #: By dim, for all tasks of a Python worker: vectors of the words used last, and of those before them.
    _kept: dict[int, tuple[dict[str, bytes], dict[str, bytes]]] = {}

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _vectors(self, words: set[str]) -> dict[str, bytes]:
        """The vectors of all words, as bytes, among others."""
        recent, earlier = self._kept.get(self.dim, ({}, {}))
        if len(recent) > _KEPT_WORDS:
            recent, earlier = {}, recent
        self._kept[self.dim] = recent, earlier
        new = []
        for w in words:
            if w not in recent:
                if v := earlier.get(w):
                    recent[w] = v
                else:
                    new.append(w)
        if new:
            seeds = np.frombuffer(b"".join([hashlib.md5(w.lower().encode()).digest()[:8] for w in new]), "<u8")
            recent.update(zip(new, map(np.ndarray.tobytes, _normals(seeds, self.dim)), strict=True))
        return recent

    def tokens(self, text: str) -> list[tuple[int, int]]:
        inside = _word_characters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))

    def token_vectors(self, text: str) -> np.ndarray:
        found = _WORD.findall(text)
        vectors = self._vectors(set(found))
        return np.frombuffer(b"".join([vectors[w] for w in found])).reshape(len(found), self.dim)

    def query(self, text: str) -> np.ndarray | None:
        v = self.token_vectors(text)
        if not len(v):
            return None
        mean = v.mean(axis=0)
        size = np.linalg.norm(mean)
        return mean / size if size else None


class EchoGenerator:
    """Answers with the first passage's first sentence and its citation, or refuses without passages."""

    def ask(self, system: str, prompt: str) -> str:
        m = re.search(r"^\[1\] \([^)]*\)\n([^\n]+)", prompt, re.M)
        return f"{m[1].split('. ')[0].rstrip('.')} [1]." if m else "I don't know"


def embed_queries(queries: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """queries (query_id, text) with qvec; the model is made once per Python worker task."""

    ship(queries.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for x in batches:
            yield x.map(lambda t: None if (v := model.query(t or "")) is None else v.tolist())

    return queries.withColumn("qvec", F.pandas_udf(run, "array<double>")("text"))


def token_vectors(docs: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """(doc_id, tok, start, end, vec) of docs (doc_id, text)."""

    ship(docs.sparkSession)

    def run(batches):
        model = make()
        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                spans, v = model.tokens(t or ""), model.token_vectors(t or "")
                if len(spans):
                    yield pd.DataFrame({"doc_id": d, "tok": range(len(spans)), "start": [a for a, _ in spans], "end": [b for _, b in spans], "vec": v.tolist()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, tok int, start int, end int, vec array<double>")


def token_spans(docs: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """(doc_id, tok, start, end): the embedder's tokens of docs (doc_id, text), whole texts."""
    ship(docs.sparkSession)

    def run(batches):
        model = make()
        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                if spans := model.tokens(t or ""):
                    yield pd.DataFrame({"doc_id": d, "tok": range(len(spans)), "start": [a for a, _ in spans], "end": [b for _, b in spans]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, tok int, start int, end int")


def _places(model: Embedder, text: str) -> np.ndarray:
    """The embedder's tokens as an array of two columns."""
    found = model.tokens(text)
    return np.fromiter(itertools.chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2)


def _pooled(model: Embedder, text: str, base: int, spans) -> Iterator[tuple[str, list[float] | None]]:
    """(chunk_id, embedding) of the spans that a window owns, from one model pass over its text."""
    at, vec = _places(model, text) + int(base), model.token_vectors(text)
    for s in spans:
        inside = (at[:, 0] >= s["char_start"]) & (at[:, 1] <= s["char_end"]) & (at[:, 1] > at[:, 0])
        mean = vec[inside].mean(axis=0) if inside.any() else None
        size = 0.0 if mean is None else np.linalg.norm(mean)
        yield s["chunk_id"], (mean / size).tolist() if size else None


def embed_windows(windows: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """(chunk_id, embedding) of windows (text, base, spans array<struct<chunk_id, char_start, char_end>>):
    one model pass per window; each owned span's vector is the mean, scaled to length 1, of the vectors of the
    tokens with a width that lie in it, null if there are none. Token vectors don't leave the Python worker."""
    ship(windows.sparkSession)

    def run(batches):
        model = make()
        for pdf in batches:
            out = [x for text, base, spans in zip(pdf["text"], pdf["base"], pdf["spans"], strict=True) for x in _pooled(model, text or "", base, spans)]
            yield pd.DataFrame(out, columns=["chunk_id", "embedding"])

    return windows.select("text", "base", "spans").mapInPandas(run, "chunk_id string, embedding array<double>")


def _windows(at: np.ndarray, spans, coverage: int, context: int) -> list[tuple[int, int, list]]:
    """(context_start, window_end, owned spans) of a document with tokens at: ``dense.windows`` of its ``token_ranges``."""
    wide = np.flatnonzero(at[:, 1] > at[:, 0])
    if not len(wide):
        return []
    low = np.searchsorted(at[wide, 0], [s["char_start"] for s in spans], "left")
    high = np.searchsorted(at[wide, 1], [s["char_end"] for s in spans], "right") - 1
    held = sorted(((int(wide[a]), int(wide[b]) + 1, s) for a, b, s in zip(low, high, spans, strict=True) if a <= b), key=lambda x: (x[0], x[1], x[2]["chunk_id"]))
    if not held:
        return []
    if len(at) <= context:
        return [(0, len(at), [s for *_, s in held])]
    out: list[list] = []
    for start, end, s in reversed(held):
        if out and out[-1][1] - start <= coverage:
            out[-1][0] = start
            out[-1][2].append(s)
        else:
            out.append([start, end, [s]])
    return [(min(start, max(0, end - context)), end, owned) for start, end, owned in out]


def embed_documents(docs: DataFrame, chunks: DataFrame, make: Callable[[], Embedder], coverage: int = COVERAGE_TOKENS, context: int = MAX_CONTEXT_TOKENS) -> DataFrame:
    """(chunk_id, embedding) of chunks (doc_id, chunk_id, char_start, char_end) in docs (doc_id, text): ``embed_windows``
    of the texts of ``dense.windows``, without a row per token. A text meets its chunks in one shuffle by document;
    its tokens, their ranges and its windows don't leave the Python worker. Chunks without a token have no row."""
    ship(docs.sparkSession)
    c = chunks.where("doc_id is not null and char_start is not null and char_end is not null")
    per = c.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_id", "char_start", "char_end")).alias("spans"))

    def run(batches):
        model = make()
        for pdf in batches:
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
                at = _places(model, text or "")
                for first, end, owned in _windows(at, spans, coverage, context):
                    base, stop = int(at[first, 0]), int(at[end - 1, 1])
                    out += _pooled(model, text[base:stop], base, owned)
            yield pd.DataFrame(out, columns=["chunk_id", "embedding"])

    return docs.select("doc_id", "text").join(per, "doc_id").select("text", "spans").mapInPandas(run, "chunk_id string, embedding array<double>")


def generate(prompts: DataFrame, make: Callable[[], Generator]) -> DataFrame:
    """prompts (.., system, prompt) with answer_text, stripped."""

    ship(prompts.sparkSession)

    def run(batches):
        model = make()
        for pdf in batches:
            yield pdf.assign(answer_text=[model.ask(s, p).strip() for s, p in zip(pdf["system"], pdf["prompt"], strict=True)])

    schema = prompts.schema.simpleString()[len("struct<") : -1]
    return prompts.mapInPandas(run, f"{schema}, answer_text string")
