"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary.

The tree's leaves are short pieces of text, encoded by the rank file's own merges. Two neighbours are
joined by encoding a window around their boundary anew. The window ends where the tokens outside
provably stay as they are:

* at a position where the split pattern always ends a match, whatever stands around it
  (``_certain``): matches before and after it don't depend on each other, or
* within a long run of one character class, which is one match: at a token boundary where the tokens on
  both sides are stable as a pair, that is, their joint bytes encode to just these two tokens. BPE tokens
  are the encoding of their bytes exactly if every neighbouring pair of them is stable, so stable pairs at
  the window's ends prove the tokens outside.

Otherwise the window grows; in the end it holds both halves. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shipping import ship

_LEAF = 256
_WINDOW = 32
_CLASS = regex.compile(r"(\p{White_Space})|(\p{L})|(\p{N})|(.)", regex.S)


class TreeBPE:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = _LEAF, window: int = _WINDOW):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size_of = {v: len(k) for k, v in ranks.items()}
        self.leaf, self.window = max(2, leaf), max(2, window)
        self._stable: dict[tuple[int, int], bool] = {}
        self._class: dict[str, int] = {}

    # -- encoding ---------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """Ids of the text, as encoding it in one piece gives them. Empty text: none."""
        parts = [(text[i : i + self.leaf]) for i in range(0, len(text), self.leaf)]
        nodes = [(p, self.bpe.encode_ordinary(p)) for p in parts]
        while len(nodes) > 1:
            paired = [self._join(*nodes[i], *nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            nodes = paired + nodes[len(nodes) - len(nodes) % 2 :]
        return nodes[0][1] if nodes else []

    def _join(self, left: str, a: list[int], right: str, b: list[int]) -> tuple[str, list[int]]:
        text, w = left + right, self.window
        while True:
            head, tail = self._left_edge(left, a, w), self._right_edge(right, b, w)
            if head and tail:
                start, keep, before = head
                end, skip, after = tail
                if before is None and after is None:
                    new = self.bpe.encode_ordinary(left[start:] + right[:end])
                    return text, a[:keep] + new + b[skip:]
                new = self._run_window(left, a, keep, start, before, right, b, skip, end, after)
                if new is not None:
                    return text, a[:keep] + new + b[skip:]
            elif w >= max(len(left), len(right)):
                raise AssertionError("the whole text is a window")
            w *= 4

    def _left_edge(self, left: str, a: list[int], w: int):
        """(start in left, tokens kept, None): tokens before the start hold at a certain boundary; or
        (None, tokens kept, the last kept token) inside a run of one class."""
        if w >= len(left):
            return 0, 0, None
        low = len(left) - w
        for p in range(low, len(left)):
            if self._certain(left[p - 1], left[p]):
                size, keep = len(left[p:].encode()), len(a)
                while size > 0:
                    keep -= 1
                    size -= self.size_of[a[keep]]
                if size == 0:
                    return p, keep, None
        if not self._one_run(left[low - min(low, 3) :]) or low < 3:
            return None
        size, keep = len(left[len(left) - w // 2 :].encode()), len(a)
        while size > 0 and keep > 0:
            keep -= 1
            size -= self.size_of[a[keep]]
        # the kept token must lie wholly inside the run that the window shows
        reach = len(left[low:].encode()) - sum(self.size_of[t] for t in a[keep:])
        if keep == 0 or self.size_of[a[keep - 1]] > reach:
            return None
        return None, keep, a[keep - 1]

    def _right_edge(self, right: str, b: list[int], w: int):
        if w >= len(right):
            return len(right), len(b), None
        for p in range(1, w + 1):
            if self._certain(right[p - 1], right[p]):
                size, skip = len(right[:p].encode()), 0
                while size > 0:
                    size -= self.size_of[b[skip]]
                    skip += 1
                if size == 0:
                    return p, skip, None
        if not self._one_run(right[: w + 1]):
            return None
        size, skip = len(right[: w // 2].encode()), 0
        while size > 0 and skip < len(b):
            size -= self.size_of[b[skip]]
            skip += 1
        reach = len(right[:w].encode()) - sum(self.size_of[t] for t in b[:skip])
        if skip == len(b) or self.size_of[b[skip]] > reach:
            return None
        return None, skip, b[skip]

    def _run_window(self, left, a, keep, start, before, right, b, skip, end, after):
        """Tokens of a window of which an end lies inside a run; None if they prove nothing."""
        if before is not None and after is not None:
            if not self._one_run(left[-1] + right[0]):
                return None  # the run ends at the boundary itself; a wider window finds it certain
            window = b"".join(map(self.bytes_of.__getitem__, a[keep:] + b[:skip]))
            new = self.bpe._core_bpe.encode_single_piece(window)
            if new and self._pair(before, new[0]) and self._pair(new[-1], after):
                return new
            return None
        # One end certain, the other in a run: take whole matches at the certain end, single bytes of the run at the other.
        if before is not None:
            tail = right[:end]
            run = 0
            while run < len(tail) and self._one_run(left[-1] + tail[run]):
                run += 1
            if self._kind(left[-1]) == 0 or run < len(tail):
                return None  # white space hands its last character on; a mixed tail needs a certain start
            window = b"".join(map(self.bytes_of.__getitem__, a[keep:])) + tail.encode()
            new = self.bpe._core_bpe.encode_single_piece(window)
            return new if new and self._pair(before, new[0]) else None
        head = left[start:]
        if self._kind(right[0]) == 0 or "'" in head or not self._one_run(head + right[0]):
            return None
        window = head.encode() + b"".join(map(self.bytes_of.__getitem__, b[:skip]))
        new = self.bpe._core_bpe.encode_single_piece(window)
        return new if new and self._pair(new[-1], after) else None

    def _pair(self, x: int, y: int) -> bool:
        if (x, y) not in self._stable:
            if len(self._stable) > 200_000:
                self._stable.clear()
            self._stable[x, y] = self.bpe._core_bpe.encode_single_piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
        return self._stable[x, y]

    # -- where matches of the pattern end ---------------------------------------------------------

    def _kind(self, c: str) -> int:
        """0 white space, 1 letter, 2 number, 3 any other."""
        if c not in self._class:
            self._class[c] = _CLASS.match(c).lastindex - 1
        return self._class[c]

    def _certain(self, x: str, y: str) -> bool:
        """A match always ends between x and y: no match goes on from a letter, number or sign into
        another class, but for an apostrophe, which may start a contraction."""
        k = self._kind(x)
        return k != 0 and k != self._kind(y) and x != "'"

    def _one_run(self, s: str) -> bool:
        k = self._kind(s[0])
        return "'" not in s and all(self._kind(c) == k for c in s)

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: leaves are looked up, neighbours concatenated up the tree."""
        nodes = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + self.leaf])) for i in range(0, len(ids), self.leaf)]
        while len(nodes) > 1:
            nodes = [b"".join(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        return nodes[0] if nodes else b""


@lru_cache(maxsize=4)
def coder(ranks_path: str, pattern: str) -> TreeBPE:
    """One coder per Python worker."""
    return TreeBPE(ranks_path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) and, with_ids, ids: the whole text's tokens.

    Null text counts as empty: no tokens, the digests of nothing. Rows repeat as they do in docs, ids may
    be null; other columns are not read. Each text is one row's work, so nothing is shuffled.
    """

    def run(batches):
        c = coder(ranks_path, pattern)
        names = {i: str(i) for i in c.bytes_of}
        for b in batches:
            n, ids, a, d = [], [], [], []
            for t in b.column(1):
                tokens = c.encode(t.as_py() or "")
                n.append(len(tokens))
                a.append(hashlib.sha256(" ".join(map(names.__getitem__, tokens)).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(tokens)).hexdigest())
                if with_ids:
                    ids.append(tokens)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names_out = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names_out.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
