"""Exact top-k search of binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments. If two codes differ in fewer than segments * (r + 1) bits, they
differ in at most r bits of some segment. So a search that has looked up every segment value within r
bits has seen all codes up to the distance segments * (r + 1) - 1. The radius grows, one step at a time,
until the kth verified distance is within that: no unseen code can be nearer or tie.

Codes are searched once however many rows share them, and are dealt into blocks by their hash. A block of
the index meets a block of queries in one task, which holds these two and nothing else; each block's k
nearest are merged. The rows that come out grow with the queries, k and the blocks, not with pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import cut
from lodestone.shipping import ship

_INDEX_BLOCK, _QUERY_BLOCK = 1 << 17, 1 << 14


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i is 1 if component i is above 0. Null if the vector is null or hasn't ``bits`` components."""
    parts = [F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)).otherwise(F.lit(0)) for i in range(bits)]
    total = parts[0]
    for part in parts[1:]:
        total = total.bitwiseOR(part)
    return F.when(F.size(vector) == bits, total.cast("long"))


class MultiIndex:
    """Segment tables over one block of codes."""

    def __init__(self, codes: np.ndarray, segments: int = 4):
        self.codes, self.m = codes.astype(np.uint64), segments
        self.width = 64 // segments
        self.tables = []
        for s in range(segments):
            value = self._segment(self.codes, s)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, value[order]))
        self.flips = [np.zeros(1, np.uint64)]

    def _segment(self, codes, s):
        return (codes >> np.uint64(s * self.width)) & np.uint64((1 << self.width) - 1)

    def _flips(self, r: int) -> np.ndarray:
        """All changes of exactly r bits of a segment."""
        while len(self.flips) <= r:
            k = len(self.flips)
            self.flips.append(np.array([sum(1 << b for b in c) for c in combinations(range(self.width), k)], np.uint64))
        return self.flips[r]

    def search(self, code: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) of all codes up to the kth distance, ties at it included."""
        q = np.uint64(code)
        found = np.empty(0, np.int64)
        distance = np.empty(0, np.int64)
        for r in range(self.width + 1):
            flips, new = self._flips(r), []
            for s, (order, value) in enumerate(self.tables):
                want = self._segment(q, s) ^ flips
                lo, hi = np.searchsorted(value, want, "left"), np.searchsorted(value, want, "right")
                n = hi - lo
                if total := int(n.sum()):
                    at = np.repeat(hi - np.cumsum(n), n) + np.arange(total)
                    new.append(order[at])
            if new:
                found = np.union1d(found, np.concatenate(new))
                distance = np.bitwise_count(self.codes[found] ^ q).astype(np.int64)
            covered = self.m * (r + 1) - 1
            if len(found) >= k:
                kth = np.partition(distance, k - 1)[k - 1]
                if kth <= covered:
                    near = distance <= kth
                    return found[near], distance[near]
        return found, distance  # fewer than k codes: all of them


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code", segments: int = 4) -> DataFrame:
    """(query id, rank, neighbor id, distance): the k rows nearest to each query row, itself left out.

    Ties go to the smaller id. Rows without a code are neither found nor answered; a query whose id occurs
    in several rows is answered for each of them; fewer than k other rows: all of them. A neighbour is any
    row with another id.
    """
    here = cut(rows.where(F.col(code_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(code_col).alias("code")), scan=True)
    asked = cut(queries.where(F.col(code_col).isNotNull()).select(F.col(id_col).alias("query"), F.col(code_col).alias("code")), scan=True)
    # The k + 1 smallest ids of a code are all that can be among the nearest of anyone.
    first = W.partitionBy("code").orderBy("id")
    members = cut(here.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1))
    index = members.where("n = 1").select("code", F.col("id").alias("least"))
    want = asked.select("code").distinct()
    blocks = max(1, -(-index.count() // _INDEX_BLOCK))
    qblocks = max(1, -(-want.count() // _QUERY_BLOCK))
    block, qblock = F.pmod(F.xxhash64("code"), F.lit(blocks)), F.pmod(F.xxhash64("code", F.lit(1)), F.lit(qblocks))
    left = index.select("code", "least", block.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qblocks - 1).cast("long"))).alias("q"))
    right = want.select("code", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), qblock.alias("q"))

    def meet(codes: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        table = MultiIndex(codes["code"].to_numpy(), segments)
        known, least, asked = codes["code"].to_numpy(), codes["least"].to_numpy(), query["code"].to_numpy()
        picked, distances = [], []
        for code in asked:
            at, d = table.search(int(code) & 0xFFFFFFFFFFFFFFFF, k + 1)
            order = np.lexsort((least[at], d))[: k + 1]
            picked.append(at[order])
            distances.append(d[order])
        at = np.concatenate([np.empty(0, np.int64), *picked])
        d = np.concatenate([np.empty(0, np.int64), *distances])
        return pd.DataFrame({"code": np.repeat(asked, np.array([len(p) for p in picked], np.int64)), "near": known[at], "least": least[at], "distance": d})

    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(meet, f"code long, near long, least {kind}, distance long")
    best = W.partitionBy("code").orderBy("distance", "least")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("code", "near", "distance")
    ids = found.join(members.select(F.col("code").alias("near"), "id"), "near")
    best = W.partitionBy("code").orderBy("distance", "id")
    ids = ids.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    answers = asked.join(ids, "code")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query")), 1, k)
    return answers.select("query", F.posexplode(others).alias("rank", "x")).select("query", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbor"), F.col("x.distance").cast("int").alias("distance"))
