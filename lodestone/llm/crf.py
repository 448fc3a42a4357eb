"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's evidence is its own features and those of the lines before
and after it; neighbouring labels influence each other through the chain's transition weights. Forward and
backward passes give each line's marginal, and the marginals, weighted by the lines' lengths, the
document's quality, which a logistic curve fitted on the training rows turns into a probability.

Training takes a bounded sample of labelled documents (``sample`` of them) with all of their lines; every line
of a training document carries the document's label, and chains longer than ``piece`` lines are cut into several
for the gradient. Scoring takes all lines of all documents, each text one chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.shipping import ship

_COUNTED = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!", b"|", b".,;:?", bytes(range(128, 256)))
FEATURES = 18


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, code points per line). Empty text is one empty line."""
    rows, size, seen = [], [], set()
    for line in text.split("\n"):
        raw = line.encode()
        n = max(1, len(raw))
        words = raw.split()
        m = max(1, len(words))
        distinct = len(set(words))
        bare = {w.strip(b".,;:!?") for w in words}
        again = sum(map(bytes.__eq__, words, words[1:]))
        shares = [(len(raw) - len(raw.translate(None, c))) / n for c in _COUNTED]
        rows.append([1.0, *shares, np.log1p(len(words)), np.log1p(n), len(raw) / m / 10, float(len(words) < 4), distinct / m, again / m, float(line in seen), np.log1p(max(map(len, words), default=0)), len(bare) / m])
        if words:
            seen.add(line)
        size.append(max(1, len(line)))
    return np.array(rows, np.float32), np.array(size, np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and the line after (zeros at the ends)."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    return np.concatenate([x, np.concatenate([none, x[:-1]]), np.concatenate([x[1:], none])], axis=1)


@dataclass
class Chain:
    """Weights: unary (features), transition (2 x 2), the features' mean and scale, the curve (a, b)."""

    mean: np.ndarray
    scale: np.ndarray
    unary: np.ndarray
    transition: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """P(line is good) per line of each document, over all documents of the list at once."""
        length = np.array([len(d) for d in docs])
        order = np.argsort(-length, kind="stable")
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        s = ((np.concatenate([with_neighbours(d) for d in docs]) - self.mean) / self.scale) @ self.unary
        t = self.transition
        n, first, lengths = len(s), start[order], length[order]
        up, down = np.empty((n, 2)), np.zeros((n, 2))
        for i in range(int(lengths[0]) if len(lengths) else 0):
            at = first[: np.searchsorted(-lengths, -i, "left")] + i  # documents longer than i
            before = np.logaddexp(up[at - 1, :1] + t[0], up[at - 1, 1:] + t[1]) if i else 0.0
            up[at] = before + np.stack([np.zeros(len(at)), s[at]], axis=1)
            up[at] -= up[at].max(axis=1, keepdims=True)
        for i in range(int(lengths[0]) - 2 if len(lengths) else -1, -1, -1):
            at = first[: np.searchsorted(-lengths, -(i + 1), "left")] + i
            ahead = down[at + 1] + np.stack([np.zeros(len(at)), s[at + 1]], axis=1)
            down[at] = np.logaddexp(ahead[:, :1] + t[:, 0], ahead[:, 1:] + t[:, 1])
            down[at] -= down[at].max(axis=1, keepdims=True)
        z = up + down
        p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))
        return [p[a : a + m] for a, m in zip(start, length, strict=True)]

    def raw(self, docs: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        return np.array([(p * w).sum() / w.sum() for p, w in zip(self.marginals(docs), sizes, strict=True)])

    def score(self, docs: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.raw(docs, sizes) + b, -500, 500)))


def train(docs: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3, piece: int = 64) -> Chain:
    """Maximum likelihood by Adam. No rows: a chain that scores 0.5."""
    k = 3 * FEATURES
    if not docs:
        return Chain(np.zeros(k), np.ones(k), np.zeros(k), np.zeros((2, 2)), (0.0, 0.0))
    flat = np.concatenate([with_neighbours(d) for d in docs])
    mean, scale = flat.mean(axis=0), flat.std(axis=0)
    mean[scale < 1e-6] = 0.0
    scale[scale < 1e-6] = 1.0
    # (document, first line) of the pieces; a line's neighbours are those of the whole text
    whole, of, parts = docs, [], []
    for i, d in enumerate(docs):
        near = (with_neighbours(d) - mean) / scale
        for at in range(0, len(d), piece):
            of.append(i)
            parts.append(near[at : at + piece])
    per_doc = labels
    labels, docs = labels[of], parts
    length, width = np.array([len(d) for d in docs]), max(len(d) for d in docs)
    x = np.zeros((len(docs), width, k), np.float32)
    for i, d in enumerate(docs):
        x[i, : len(d)] = d
    on = np.arange(width) < length[:, None]
    y = labels[:, None] * on
    w = (1 / np.sqrt([len(whole[i]) for i in of]))[:, None] * on  # a long document counts more, but not by each of its lines
    w /= w.sum()
    unary, transition = np.zeros(k), np.zeros((2, 2))
    m, v = np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, steps + 1):
        s = x @ unary
        up, down = np.zeros((len(docs), width, 2)), np.zeros((len(docs), width, 2))
        local = np.stack([np.zeros_like(s), s], axis=2)
        up[:, 0] = local[:, 0]
        for i in range(1, width):
            up[:, i] = local[:, i] + np.logaddexp(up[:, i - 1, :1] + transition[0], up[:, i - 1, 1:] + transition[1])
        for i in range(width - 2, -1, -1):
            ahead = down[:, i + 1] + local[:, i + 1]
            down[:, i] = np.where(on[:, i + 1, None], np.logaddexp(ahead[:, :1] + transition[:, 0], ahead[:, 1:] + transition[:, 1]), 0)
        z = up + down
        total = np.logaddexp(z[:, :, 0], z[:, :, 1])
        p = np.where(on, np.exp(z[:, :, 1] - total), 0)
        g_unary = np.einsum("dt,dtk->k", (p - y) * w, x) + ridge * unary
        g_pair = ridge * transition
        if width > 1:
            both = up[:, :-1, :, None] + transition + (local + down)[:, 1:, None, :]
            both = np.exp(both - total[:, 1:, None, None]) * on[:, 1:, None, None]
            seen = np.zeros_like(both)
            lab = labels.astype(int)
            seen[np.arange(len(docs)), :, lab, lab] = on[:, 1:]
            g_pair = g_pair + ((both - seen) * w[:, 1:, None, None]).sum(axis=(0, 1))
        g = np.concatenate([g_unary, g_pair.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        unary, transition = unary - move[:k], transition - move[k:].reshape(2, 2)
    chain = Chain(mean, scale, unary, transition)
    chain.curve = _curve(chain.raw(whole, sizes), per_doc)
    return chain


def _curve(raw: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic curve by Newton's method, lightly ridged."""
    x = np.stack([raw, np.ones_like(raw)], axis=1)
    c = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5, 1e-3])
        c = c - np.linalg.solve(h, x.T @ (p - labels) + np.array([0.5, 1e-3]) * c * np.array([1, 1]))
    return float(c[0]), float(c[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain from at most ``sample`` labelled documents that aren't held out, taken in order of a hash of the id,
    with whole texts. Rows with a null id or label aren't used; an id labelled both ways is two documents. If ids
    repeat in docs, no more than ``sample`` rows of these are taken all the same."""
    rows = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"))).distinct()
    rows = rows.orderBy(F.xxhash64("id"), "id", "y").limit(sample)

    def run(batches):
        for b in batches:
            x, w = [], []
            for t in b.column(1):
                f, s = line_features(t.as_py())
                x.append(f.tobytes())
                w.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), pa.array(w, pa.binary())], names=["y", "x", "w"])

    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(rows), "id").select("id", "y", "text")
    picked = picked.orderBy(F.xxhash64("id"), "id", "y", F.md5("text")).limit(sample)
    got = picked.select("y", "text").mapInArrow(run, "y double, x binary, w binary").collect()
    got.sort(key=lambda r: (r.y, r.x))  # the order of the sums, and with it the chain, is the same in each run
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    return train(xs, [np.frombuffer(r.w) for r in got], np.array([r.y for r in got]))


_LINES = 20_000


def _by_lines(batch: pa.RecordBatch):
    """Parts of the batch of about so many lines; a text of more is a part by itself."""
    start, n = 0, 0
    for i, t in enumerate(batch.column(1)):
        own = (t.as_py() or "").count("\n") + 1
        if n and n + own > _LINES:
            yield batch.slice(start, i - start)
            start, n = i, 0
        n += own
    yield batch.slice(start)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted, n_lines) per row of docs. Null text counts as empty, which is
    one empty line; rows repeat as they do in docs; only id and text are read."""

    def run(batches):
        for whole in batches:
            for b in _by_lines(whole):
                f = [line_features(t or "") for t in b.column(1).to_pylist()]
                s = chain.score([x for x, _ in f], [w for _, w in f]) if f else np.empty(0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([len(x) for x, _ in f], pa.int64())], names=["id", "score", "n_lines"])

    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, score double, n_lines long")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")
