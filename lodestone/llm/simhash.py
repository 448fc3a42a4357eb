"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 64 bits has eight positional bytes. Two fingerprints that differ in at most r bits
differ in at most r bytes. Lists of a single positional byte would hold a 256th of the corpus each, so a
posting is keyed by four positions at once, those of the 14 blocks of the Steiner system S(3, 4, 8): a pair
that shares 8, 7, 6 or 5 bytes meets in 14, 7, 3 or 1 lists at least, the guaranteed minimum. The lists
that a pair shares are tallied, pairs below the minimum go, the rest are verified by their Hamming distance.

A list of more than ``longest_list`` fingerprints is not turned into pairs. Its members are linked
through the values next to them instead: each member points at all values half the radius away, and
members that point at the same value are joined to the smallest of them. That is exact as well
(see ``_through_neighbours``) and linear in the list's length; a pair that shares such a list is joined by it,
and any other pair has all its lists tallied.

For near-duplicates by similarity, wide fingerprints are looked up in bounded lists, and an exact join of
shingles (``similar_pairs``) finds the pairs that these lists leave out.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, cut, fresh
from lodestone.shipping import ship

_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BLOCK = 1 << 16  # shingles turned into bits at a time
_BROADCAST_TEXTS = 50_000  # ids of texts to verify that are broadcast
_SAMPLE, _COMMON = 8192, 1 << 16  # texts in which frequent shingles are counted, and how many of these are kept
_ROWS = 512  # texts of a batch that a Python worker has shingled at a time
_LIST = 4096  # members of a list of shingles that one task compares with the others
_PART = 1 << 21  # shingles that are counted at a time, whatever the table's size
_NONE = np.empty(0, np.uint64), np.empty(0, np.int64)  # no shingle known as frequent
#: The planes of the affine space of three bits: every three of the eight positions are in one of them.
_BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the n-word shingles (repeats count) of the text with A-Z lower-cased."""
    return int(_packed(_margins(text, n, seed, 1))[0])


def _hashes(text: str | None, n: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 of the n-word shingles in blocks; none for a text without words."""
    words = (text or "").encode().translate(_TO_LOWER).split()  # bytes.split() cuts at ASCII white space
    for at in range(0, max(1, len(words) - n + 1) if words else 0, _BLOCK):
        part = words[at : at + _BLOCK + n - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(n)), strict=False)) if len(words) > n else [b" ".join(words)]
        yield np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, max(1, len(part) - n + 1))


def _margins(text: str | None, n: int, seed: int, size: int) -> np.ndarray:
    """For each of 64 * size bits by how many more shingles have it set than not. The first 64 bits are those
    of the shingles' XXH64, the others of mixes of it."""
    return _tally(_hashes(text, n, seed), size)


def _tally(blocks: Iterable[np.ndarray], size: int) -> np.ndarray:
    total, ones = 0, np.zeros(64 * size, np.int64)
    for h in blocks:
        total += len(h)
        h = np.stack([h, *(_mix(h, k) for k in range(1, size))], axis=1)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones - total


def _distinct(blocks: Iterable[np.ndarray]) -> np.ndarray:
    """The set of the blocks' shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *blocks]))


def _set_digest(shingles: np.ndarray) -> int:
    """64 bits that stand for a shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64))


def _packed(margins: np.ndarray) -> np.ndarray:
    return np.packbits(margins > 0, bitorder="little").view(np.uint64)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The kth of several independent 64-bit hashes of h (the SplitMix64 finaliser)."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``_ROWS`` rows."""
    return (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, wide: bool = False, similarity: float = 0.8, common: tuple[np.ndarray, np.ndarray] = _NONE) -> DataFrame:
    """(id, fp), the fingerprint as a signed long; if wide also (wide, weak): four words, and of each set in
    ``_WIDE_SETS`` the two bits with the smallest margins, and (set, size, known, tail): the digest and size of the
    shingle set, how many of its shingles are ``common``, and the rarest of these. Null text counts as empty."""
    size = _WIDE if wide else 1

    def run(batches):
        for b in _parts(batches):
            blocks = [[*_hashes(t.as_py(), n)] for t in b.column(1)] if wide else (_hashes(t.as_py(), n) for t in b.column(1))
            m = np.array([_tally(x, size) for x in blocks], np.int64).reshape(-1, 64 * size)
            w = np.packbits(m > 0, axis=1, bitorder="little").view(np.int64).reshape(-1, size)
            columns, names = [b.column(0), pa.array(np.ascontiguousarray(w[:, 0]))], ["id", "fp"]
            if wide:
                sets = [_distinct(x) for x in blocks]
                columns += [pa.array(list(w), pa.list_(pa.int64())), pa.array([_weakest(x) for x in m], pa.list_(pa.int32()))]
                columns += [pa.array([_set_digest(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32())]
                known = [_ordered(x[_among(x, common[0])], *common) for x in sets]
                columns += [pa.array([len(x) for x in known], pa.int32()), pa.array([x[: _length(len(y), similarity)].view(np.int64) for x, y in zip(known, sets)], pa.list_(pa.int64()))]
                names += ["wide", "weak", "set", "size", "known", "tail"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    more = ", wide array<long>, weak array<int>, set long, size int, known int, tail array<long>"
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, fp long" + more * wide)


def _weakest(margins: np.ndarray) -> np.ndarray:
    """Of each wide set's bits the two with the smallest margins, earlier ones first in a tie."""
    return np.argsort(np.abs(margins)[_WIDE_BITS], axis=1, kind="stable")[:, :2].ravel().astype(np.int32)


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _guaranteed(radius: int) -> int:
    """Lists that two fingerprints share if all but ``radius`` of their bytes agree."""
    if not 0 <= radius <= 3:
        raise ValueError("the radius must be 0 to 3")
    return sum(min(c) >= radius for c in _BLOCKS)


def links(distinct: DataFrame, radius: int = 2, longest_list: int = 64) -> DataFrame:
    """Edges (a, b), a < b, between the distinct fingerprints ``fp``: every pair within the radius is
    joined, directly or over other edges, and every edge is a pair within the radius."""
    sets, least = _BLOCKS, _guaranteed(radius)
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("set"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("bytes")) for i, s in enumerate(sets))))
    postings = distinct.select("fp", key.alias("k")).select("fp", "k.set", "k.bytes")
    # One fingerprint more than the longest list tells the long lists; the limit works before the shuffle as well.
    head = W.partitionBy("set", "bytes").orderBy("fp")
    lists = postings.withColumn("n", F.row_number().over(head)).where(F.col("n") <= longest_list + 1).groupBy("set", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    lists = cut(lists)
    short = lists.where(F.size("fps") <= longest_list).select("fps", F.posexplode("fps").alias("i", "a"))
    pairs = short.select("a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
    tallied = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    # lists that are too long for pairs aren't in the tally; a pair that shares one is joined through its neighbours
    pairs = tallied.where((F.col("shared") >= least) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    long = lists.where(F.size("fps") > longest_list).select("set", "bytes")
    edges = pairs
    if not long.isEmpty():
        hot = postings.join(long, ["set", "bytes"], "left_semi")
        edges = pairs.unionByName(_through_neighbours(hot, sets, radius))
    return edges.distinct()


def _through_neighbours(members: DataFrame, sets: list[tuple[int, ...]], radius: int) -> DataFrame:
    """Members of long lists: with r = p + q, p <= q, a and b are within r if some value x is within
    p of a and within q of b. Owners of x (those within p) are within 2p <= r of each other, so each is
    joined to the smallest owner; b, within q of x, is within r of that one too."""
    near, far = radius // 2, radius - radius // 2
    spark = members.sparkSession

    def flips(most: int) -> DataFrame:
        """(set, flip): all changes of at most ``most`` bits outside the set's bytes; a few thousand rows at most."""
        rows = []
        for i, s in enumerate(sets):
            bits = [b for b in range(64) if b // 8 not in s]
            for size in range(most + 1):
                for c in combinations(bits, size):
                    m = sum(1 << b for b in c)
                    rows.append((i, m - (1 << 64) if m >> 63 else m))
        return F.broadcast(_small(spark, rows, set=pa.int32(), flip=pa.int64()))

    value = F.col("fp").bitwiseXOR(F.col("flip"))
    pointing = members.join(flips(near), "set").select("fp", value.alias("x"))
    owner = pointing.groupBy("x").agg(F.min("fp").alias("owner"))
    if far > near:
        pointing = members.join(flips(far), "set").select("fp", value.alias("x"))
    joined = pointing.join(owner, "x").where(F.col("fp") != F.col("owner"))
    a, b = F.least("fp", "owner"), F.greatest("fp", "owner")
    return joined.select(a.alias("a"), b.alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _small(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A table of the driver's rows. As an Arrow table: a list would be read by Python workers, which then stay
    in the executors' memory."""
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=[*types]))


#: Words of the wide fingerprint, the bits of 256 in which a pair may differ, the positional bytes of 32 that it
#: must share, the sets of so many positions by which it is looked up, and these sets' bits.
_WIDE, _WIDE_RADIUS, _WIDE_SHARED = 4, 56, 4
_WIDE_SETS = [sorted(random.Random(k).sample(range(8 * _WIDE), _WIDE_SHARED)) for k in range(24)]
_WIDE_BITS = np.array([[8 * p + b for p in s for b in range(8)] for s in _WIDE_SETS])


def wide_links(classes: DataFrame, longest_list: int = 8) -> DataFrame:
    """Candidates (a, b): fingerprints ``fp`` whose wide fingerprints are within 56 of 256 bits and that meet in a list.

    64 bits can't tell similarity 0.8: there they differ in about ten, and no positional byte need
    agree. Each posting is keyed by four positional bytes; the two of its bits that a change of the text would
    turn first are also looked up turned. The first ``longest_list`` members of a list, in an order drawn by a
    hash, are compared with each other, the rest of a longer list with the first one,
    so the candidates grow with the fingerprints and not with their pairs. Shared bytes are tallied, pairs
    below two go (of the key's four, the two turned bits may cost two), the rest are verified. Pairs of similarity
    0.8 can be missed, in long lists or without a common one; ``similar_pairs`` finds those, whatever was missed here.
    """
    word = lambda c, p: F.get(c, F.lit(p // 8))
    byte = lambda c, p: F.shiftrightunsigned(word(c, p), 8 * (p % 8)).bitwiseAND(F.lit(0xFF))
    sets = [F.struct((F.lit(k << 32) + sum((F.shiftleft(byte("wide", p), 8 * j) for j, p in enumerate(s)), F.lit(0))).alias("key"), F.get("weak", F.lit(2 * k)).alias("x"), F.get("weak", F.lit(2 * k + 1)).alias("y")) for k, s in enumerate(_WIDE_SETS)]
    each = classes.select("fp", F.explode(F.array(*sets)).alias("s")).select("fp", "s.key", "s.x", "s.y")
    postings = each.select("fp", F.explode(F.expr("array(key, key ^ shiftleft(1L, x), key ^ shiftleft(1L, y))")).alias("key"))
    # the limit works before the shuffle as well, so no list is gathered whole
    drawn = W.partitionBy("key").orderBy(F.xxhash64("fp", "key"))
    firsts = postings.withColumn("n", F.row_number().over(drawn)).where(F.col("n") <= longest_list).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "fp"))).alias("firsts"))
    lists = cut(firsts.where(F.size("firsts") > 1).select("key", F.col("firsts.fp").alias("fps")))
    short = lists.select("fps", F.posexplode("fps").alias("i", "x")).select("x", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("y"))
    full = lists.where(F.size("fps") == longest_list).select("key", F.get("fps", F.lit(0)).alias("head"))
    rest = postings.join(full, "key").where("fp <> head").select(F.col("fp").alias("x"), F.col("head").alias("y"))
    pairs = short.unionByName(rest).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
    x, y = (classes.select(F.col("fp").alias(c), F.col("wide").alias(f"wide_{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b")
    differ = [word("wide_a", 8 * w).bitwiseXOR(word("wide_b", 8 * w)) for w in range(_WIDE)]
    shared = sum((F.when(d.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for d in differ for p in range(8)), F.lit(0))
    return both.where((shared >= _WIDE_SHARED - 2) & (sum(map(F.bit_count, differ), F.lit(0)) <= _WIDE_RADIUS)).select("a", "b")


def _common_shingles(docs: DataFrame, text_col: str, n: int) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """((hashes in order, counts), texts that each counted one stands for): shingles that stand in two or more of
    some ``_SAMPLE`` texts, the ``_COMMON`` most frequent. They come last in the order, uncounted, and spread long
    lists: results don't depend on what was drawn."""

    def run(batches):
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(_hashes(t.as_py(), n)).view(np.int64))], names=["key"])

    ship(docs.sparkSession)
    every = max(1, docs.count() // _SAMPLE)
    drawn = docs.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(every)) == 0).distinct()
    counted = drawn.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = sorted((int(np.int64(r.key).view(np.uint64)), r.n) for r in counted.orderBy(F.desc("n"), "key").limit(_COMMON).collect())
    return (np.array([k for k, _ in rows], np.uint64), np.array([c for _, c in rows], np.int64)), float(every)


def _among(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the shingles are in ``common``."""
    return common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles if len(common) else np.zeros(len(shingles), bool)


def _ordered(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rare shingles (by ``common``) before frequent ones, then by hash, as they come."""
    if len(shingles) and len(common):
        often = np.where(_among(shingles, common), counts[np.minimum(np.searchsorted(common, shingles), len(common) - 1)], 0)
        if often.any():
            return shingles[np.argsort(often, kind="stable")]
    return shingles


def _length(size: int, similarity: float) -> int:
    """How many first shingles, in an order of all, make sure that two sets of the ``similarity`` have one in common."""
    return size - math.ceil(similarity * size - 1e-6) + 1


def _prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones (by ``common``) before frequent ones, then by hash."""
    return _ordered(shingles, common, counts)[: _length(len(shingles), similarity)].view(np.int64)


def _shared(docs: DataFrame, text_col: str, n: int, shingles: int, common: np.ndarray) -> DataFrame:
    """(set, key, n): the shingles that stand in n >= 2 different sets, ``common`` ones left out, a row for each set.

    The count is exact and has no table of all shingles in any one place: hashes are dealt by their range to as many
    parts as keep a part at about ``_PART`` of the ``shingles`` that there are, and travel packed. Copies count
    once for each batch of texts on the way and once in the end.
    """
    parts = max(1, -(-shingles // _PART))

    def deal(batches):
        for b in _parts(batches):
            sets = {_set_digest(x): x for x in (_distinct(_hashes(t.as_py(), n)) for t in b.column(0))}
            rare = [x[~_among(x, common)] for x in sets.values()]
            keys = np.concatenate([_NONE[0], *rare])
            owner = np.repeat(np.arange(len(rare), dtype=np.uint16), [len(x) for x in rare])
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            at = np.argsort(part, kind="stable")
            keys, owner, ends = keys[at], owner[at], np.searchsorted(part[at], np.arange(parts + 1))
            digests = np.array([*sets], np.int64).tobytes()
            full = [k for k in range(parts) if ends[k] < ends[k + 1]]
            packed = [[x[ends[k] : ends[k + 1]].tobytes() for k in full] for x in (keys, owner)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in (*packed, [digests] * len(full)))], names=["part", "keys", "owner", "sets"])

    def count(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")])
        sets = np.concatenate([np.frombuffer(d.as_py(), np.int64)[np.frombuffer(o.as_py(), np.uint16)] for o, d in zip(table.column("owner"), table.column("sets"))])
        at = np.argsort(keys, kind="stable")
        again = keys[at[1:]] == keys[at[:-1]]
        at = at[np.concatenate([again, [False]]) | np.concatenate([[False], again])]
        keys, sets = keys[at], sets[at]
        at = np.lexsort((sets, keys))
        keys, sets = keys[at], sets[at]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])])[: len(keys)]
        keys, sets = keys[new], sets[new]
        _, of, held = np.unique(keys, return_inverse=True, return_counts=True)
        held = held[of]
        more = held > 1
        return pa.table({"set": pa.array(sets[more], pa.int64()), "key": pa.array(keys[more].view(np.int64), pa.int64()), "n": pa.array(held[more].astype(np.int32), pa.int32())})

    ship(docs.sparkSession)
    dealt = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(deal, "part int, keys binary, owner binary, sets binary")
    return cut(dealt.groupBy("part").applyInArrow(count, "set long, key long, n int"))


def _prefixes(sets: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """``sets`` (set, root, size, known, tail) with the first shingles of each in an order of all: those in one set
    only, which are counted (``alone``) and not listed, those of ``shared`` by their number of sets, then the common ones."""
    lists = shared.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).getField("key").alias("keys"))
    length = F.col("size") - F.ceil(F.lit(float(similarity)) * F.col("size") - F.lit(1e-6)).cast("int") + 1
    keys = F.coalesce("keys", F.array().cast("array<long>"))
    alone = F.least(F.col("size") - F.col("known") - F.size(keys), length)
    some = sets.join(lists, "set", "left").select("set", "root", "size", alone.alias("alone"), F.concat(keys, "tail").alias("keys"), (length - alone).alias("more"))
    return some.select("set", "root", "size", "alone", F.expr("slice(keys, 1, more)").alias("prefix"))


def similar_pairs(sets: DataFrame, similarity: float, common: tuple[np.ndarray, np.ndarray] = _NONE, every: float = 1.0) -> DataFrame:
    """Candidates (a, b): all pairs of different root whose sets may have the Jaccard ``similarity``; none is left out.

    sets: (set, root, size, prefix), a row for each set; if there is a column alone, so many shingles that no other set
    has come before the prefix and aren't listed. The shingles of all sets are in one order. If x and y share
    o >= t / (1 + t) * (|x| + |y|), t being the similarity, their first common shingle stands at places i and j with
    |x| - i >= o and |y| - j >= o. So it is in both prefixes, each of x and y is no larger than the other's place
    allows (``most``), and the smaller one's place allows a partner of its own size at least: the others needn't be
    looked up, they are found. That is a plain equi-join by shingle without a longest list. The members of a list
    that the sample tells to be longer than ``_LIST`` are dealt to several tasks, each of which meets all that look up.
    """
    t = float(similarity)
    rows = sets.select("set", "root", "size", _alone(sets).alias("alone"), F.posexplode("prefix").alias("at", "key"))
    most = F.floor((F.col("size") - F.col("alone") - F.col("at")) * F.lit((1 + t) / t) + F.lit(1e-6)).cast("int") - F.col("size")
    rows = rows.select("key", "set", "root", "size", most.alias("most"))
    look, held, on = rows.where("most >= size"), rows, ["key"]
    long = [(int(k.view(np.int64)), int(parts)) for k, parts in zip(common[0], -(-common[1] * every // _LIST)) if parts > 1]
    if long:
        parts = F.broadcast(_small(sets.sparkSession, long, key=pa.int64(), parts=pa.int32()))
        each = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        look = look.join(parts, "key", "left").withColumn("part", F.explode(each)).drop("parts")
        held = held.join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("set"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        on = ["key", "part"]
    x = look.select(*on, *(F.col(c).alias(f"{c}_x") for c in ("set", "root", "size", "most")))
    fits = (F.col("size") >= F.col("size_x")) & (F.col("size") <= F.col("most_x")) & (F.col("size_x") <= F.col("most"))
    once = (F.col("size") > F.col("size_x")) | (F.col("set") > F.col("set_x"))
    pairs = x.join(held, on).where(fits & once & (F.col("root") != F.col("root_x")))
    return pairs.select(F.least("set", "set_x").alias("a"), F.greatest("set", "set_x").alias("b")).distinct()


def _alone(sets: DataFrame) -> Column:
    return F.col("alone") if "alone" in sets.columns else F.lit(0)


def overlapping(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of candidates (a, b) those whose prefixes allow the ``similarity``; no pair that has it goes.

    Of x and y, take the one whose prefix ends first in the common order. What x and y share and has its place up to
    there is in both prefixes, and the rest is in what follows that prefix. So they share at most what the
    prefixes share and the longer of the two remainders. Prefixes are a fifth of the shingles at 0.8, texts
    needn't be read, and few pairs that only have some passage in common are left.
    """
    t = float(similarity)
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct())
    few = nodes.count() <= _BROADCAST_TEXTS
    some = sets.join(F.broadcast(nodes) if few else nodes, "set", "left_semi").select("set", "size", (F.col("size") - _alone(sets) - F.size("prefix")).alias("rest"), "prefix")
    x, y = (some.select(F.col("set").alias(c), F.col("size").alias(f"size_{c}"), F.col("rest").alias(f"rest_{c}"), F.col("prefix").alias(f"prefix_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("prefix_a", "prefix_b"))
    rest = F.greatest("rest_a", "rest_b")
    enough = shared + rest + F.lit(1e-6) >= F.lit(t / (1 + t)) * (F.col("size_a") + F.col("size_b"))
    return pairs.join(x, "a").join(y, "b").where(enough).select("a", "b")


def verified(edges: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The edges (a, b) between shingle sets, known by their digests, that have a Jaccard similarity of at least
    ``similarity``. texts: (text), one or more for each set that has an edge. Shingles are told apart by 64-bit
    hashes."""

    def run(batches):
        for b in _parts(batches):
            sets = [_distinct(_hashes(t.as_py(), n)) for t in b.column(0)]
            digests = pa.array([_set_digest(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([digests, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set", "shingles"])

    ship(texts.sparkSession)
    sets = cut(texts.select("text").mapInArrow(run, "set long, shingles array<long>").dropDuplicates(["set"]))
    x, y = (sets.select(F.col("set").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = edges.join(x, "a").join(y, "b").select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return both.where(F.col("shared") + 1e-9 >= F.lit(float(similarity)) * (F.col("sizes") - F.col("shared"))).select("a", "b")


def _texts_of(docs: DataFrame, classes: DataFrame, edges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text) of the sets with an edge: the texts that have the smallest id of a set's documents."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    chosen = cut(classes.join(nodes, "set", "left_semi").select("least").distinct())
    few = chosen.count() <= _BROADCAST_TEXTS
    t = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return t.join(F.broadcast(chosen) if few else chosen, F.col("id").eqNullSafe(F.col("least")), "left_semi").select("text").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, from edges (a, b).

    Large-star and small-star rounds in turn (Kiveris et al. 2014) until the edges stay as they are.
    Minima are aggregated before the shuffle and joined back, so a centre with very many neighbours is
    no single task's work; each round is written to the shared checkpoint folder.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 2, longest_list: int = 64, wide: bool = False, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: (id, fp, component_id).

    Fingerprints within ``radius`` bits are linked. If ``wide``, texts are linked whose sets of shingles have the
    Jaccard ``similarity``, all of them (see ``_similar``), and copies are texts of the same set. component_id is the
    smallest id that is reachable. Empty and null texts have fingerprint 0 and are linked like any
    other. Rows repeat as they do in docs; null ids stay and are ignored by the minimum (null if a component
    has no other). An empty table gives an empty result. Other columns of docs are not read.
    """
    node = "set" if wide else "fp"
    if wide:
        common, every = _common_shingles(docs, text_col, n)
        fps = cut(fingerprints(docs, id_col, text_col, n, wide, similarity, common), scan=True)
    else:
        # bounded, since each file that is written forks the executor for a moment (its mode is set by a command)
        fps = cut(fingerprints(docs, id_col, text_col, n).coalesce(8 * docs.sparkSession.sparkContext.defaultParallelism), scan=True)
    classes = fps.groupBy(node).agg(F.min("id").alias("least"))  # copies meet here, after a partial minimum
    if wide:
        classes = cut(classes)
        roots = _similar(docs, fps, classes, id_col, text_col, n, radius, longest_list, similarity, common, every)
    else:
        roots = components(links(classes.select("fp"), radius, longest_list))
    rooted = classes.join(roots, F.col(node) == F.col("node"), "left").select(node, "least", F.coalesce("root", node).alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(named, "root").select(node, "component_id"), node).select("id", "fp", "component_id")


def _similar(docs: DataFrame, fps: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int, radius: int, longest_list: int, similarity: float, common: tuple[np.ndarray, np.ndarray], every: float) -> DataFrame:
    """(node, root) of the shingle sets, linked by their similarity.

    Candidates come from the fingerprints first: those within the radius, those of ``wide_links`` and the sets of
    one fingerprint. They make most components, and at a cost that grows with the sets and not with their pairs.
    What these lists don't show or cut off is found by ``similar_pairs`` between different components, so that no
    pair of the similarity is left unlinked; for that all shingles are counted (``_shared``), since the lists of an order
    that knows frequent ones from a sample only grow with the table, and their pairs with the square. Every candidate is verified, those of ``similar_pairs`` by their prefixes first.
    """
    one = cut(fps.groupBy("set").agg(F.min(F.struct("fp", "wide", "weak", "size", "known", "tail")).alias("w")).select("set", "w.*"))
    of = one.groupBy("fp").agg(F.min("set").alias("set"), F.min(F.struct("wide", "weak")).alias("w"))
    of = cut(of.select("fp", "set", "w.wide", "w.weak"))
    close = links(of.select("fp"), radius, longest_list).unionByName(wide_links(of.select("fp", "wide", "weak"))).distinct()
    x, y = (of.select(F.col("fp").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    edges = close.join(x, "a").join(y, "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    same = one.join(of.select("fp", F.col("set").alias("first")), "fp").where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    edges = cut(edges.unionByName(same))
    edges = cut(verified(edges, _texts_of(docs, classes, edges, id_col, text_col), n, similarity))
    roots = cut(components(edges))
    shared = _shared(docs, text_col, n, one.agg(F.sum("size")).first()[0] or 0, common[0])
    rooted = one.join(roots, one.set == roots.node, "left").select("set", F.coalesce("root", "set").alias("root"), "size", "known", "tail")
    sets = cut(_prefixes(rooted, shared, similarity))
    rest = cut(similar_pairs(sets, similarity, common, every))
    if rest.isEmpty():
        return roots
    rest = cut(overlapping(rest, sets, similarity))
    if rest.isEmpty():
        return roots
    rest = cut(verified(rest, _texts_of(docs, classes, rest, id_col, text_col), n, similarity))
    return roots if rest.isEmpty() else components(edges.unionByName(rest))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, radius: int = 3, wide: bool = True) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest id.

    Of repeated rows one stays; a group whose ids are all null keeps the row with the smallest text hash.
    Columns and values of the kept rows are unchanged, extra columns included.
    """
    key, rank = fresh(docs, "__key", "__rank")
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), text))
    found = near_duplicates(keyed.withColumn(key, F.struct(F.col(id_col), F.col(key))), key, text_col, n, radius, wide=wide)
    # component_id is the smallest (id, key) struct, nulls first: each group's own first row.
    chosen = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col(f"id.{key}").alias(key)).distinct()
    first = W.partitionBy(key).orderBy(key)
    kept = keyed.join(chosen, key, "left_semi").withColumn(rank, F.row_number().over(first))
    return kept.where(F.col(rank) == 1).drop(key, rank)
