import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import queries, simhash

from . import brute


def rows_of(df):
    return sorted((r.id if r.id is not None else -1, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect())


def test_fingerprint_is_the_contracts():
    r = random.Random(1)
    texts = ["", None, "one", "Two words", "a b c", "a b c a b c a b c", "ÀÉ É x y z\x0bq", " \t\n", "A" * 5000]
    texts += [" ".join(r.choice(["ab", "Cd", "é", "f,"]) for _ in range(r.randrange(1, 60))) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t) == brute.simhash(t)


def test_blocks_of_shingles(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    t = " ".join(f"w{i % 13}" for i in range(200))
    assert simhash.fingerprint(t) == brute.simhash(t)


def test_components_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.simhash_components([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(simhash.near_duplicates(docs)) == sorted(want)


def test_edges(spark):
    rows = [(3, None, "x"), (5, "", "x"), (9, " \n", "y"), (None, "a b c", "z"), (7, "a b c", "z"), (7, "a b c", "z"), (4, "q r s t u v", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = [(i if i is not None else -1, f, c) for i, f, c in brute.simhash_components([(i, t) for i, t, _ in rows])]
    assert rows_of(simhash.near_duplicates(docs)) == sorted(want)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def _codes(r, groups, flips):
    out = set()
    for _ in range(groups):
        base = r.getrandbits(64)
        for _ in range(40):
            f = base
            for b in r.sample(range(64), r.randrange(flips + 1)):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


def test_links_exact_for_long_and_short_lists(spark):
    r = random.Random(5)
    for radius in (1, 2, 3):
        codes = _codes(r, 5, radius + 1)
        signed = [c - (1 << 64) if c >> 63 else c for c in codes]
        pairs = [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= radius]
        want = brute.roots(len(codes), pairs)
        for longest in (2, 64):
            edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), radius, longest).collect()
            assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= radius for e in edges)
            at = {c: i for i, c in enumerate(signed)}
            got = brute.roots(len(codes), [(at[e.a], at[e.b]) for e in edges])
            assert [got.index(g) for g in got] == [want.index(w) for w in want]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(400))
    near = long.replace("w200", "other")
    rows = [(2, long, 1), (1, near, 2), (1, near, 2), (8, "quite another text of some length", 3), (9, None, 4), (10, "", 5), (None, "text without an id here now", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key int")
    got = sorted(((r.doc_id, r["__key"]) for r in simhash.keep_one(docs, radius=3).collect()), key=str)
    assert simhash.keep_one(docs).columns == docs.columns
    want = [(1, 2), (8, 3), (9, 4), (None, 6)]
    assert got == sorted(want, key=str)
    assert simhash.keep_one(docs.where(F.lit(False))).count() == 0


def test_wide_links_catch_similar_texts(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows, twins = [], []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(400)]
        other = list(words)
        for at in r.sample(range(400), 3):  # similarity about 0.93
            other[at] = "edited"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        twins.append((2 * i, 2 * i + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.id: x.component_id for x in simhash.near_duplicates(docs, n=5, radius=3, wide=True).collect()}
    caught = sum(found[a] == found[b] for a, b in twins)
    assert caught >= 54 and len(set(found.values())) == 120 - caught  # and nothing else is linked


def test_shared_boilerplate_is_no_near_duplicate(spark):
    """Any two share a passage, with similarity about 0.7: wide fingerprints are within 40 bits for many of them."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(330)]
    rows = [(i, " ".join(passage + [word() for _ in range(66)])) for i in range(400)]
    twin = rows[0][1].replace(rows[0][1].split()[100], "edited")
    docs = spark.createDataFrame(rows + [(1000, twin)], "doc_id long, text string")
    kept = {x.doc_id for x in simhash.keep_one(docs).collect()}
    assert kept == set(range(400))


def _exact_pairs(sets, similarity=0.8):
    return {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) + 1e-9 >= similarity * len(sets[i] | sets[j])}


def test_similar_pairs_leave_none_out(spark, monkeypatch):
    """Many sets share each shingle, sizes differ, and lists are dealt to several tasks or not."""
    r = random.Random(13)
    sets = []
    for _ in range(12):
        base = r.sample(range(300), r.randrange(5, 60))
        for _ in range(25):
            s = set(base) - set(r.sample(base, r.randrange(1 + len(base) // 5))) | set(r.sample(range(300), r.randrange(4)))
            sets.append(frozenset(s))
    sets = sorted(set(sets), key=sorted) + [frozenset()]
    want = _exact_pairs(sets[:-1])
    counts = Counter(h for s in sets for h in s)
    common = np.array(sorted(counts), np.uint64), np.array([counts[h] for h in sorted(counts)], np.int64)
    for known, longest in ((simhash._NONE, 4096), (common, 4096), (common, 7)):
        monkeypatch.setattr(simhash, "_LIST", longest)
        rows = [(i, i, len(s), simhash._prefix(np.array(sorted(s), np.uint64), 0.8, *known).tolist()) for i, s in enumerate(sets)]
        got = [(x.a, x.b) for x in simhash.similar_pairs(spark.createDataFrame(rows, "set long, root long, size int, prefix array<long>"), 0.8, known).collect()]
        assert want <= set(got) and len(got) == len(set(got))
        rooted = spark.createDataFrame([(i, 0, n, p) for i, _, n, p in rows], "set long, root long, size int, prefix array<long>")
        assert simhash.similar_pairs(rooted, 0.8, known).count() == 0  # what is linked already isn't met again


def test_no_pair_of_the_similarity_is_lost(spark):
    """Every list of a shared passage is longer than the longest one, and similarities start right at 0.8."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(150)], []
    for i in range(120):
        words = passage + [word() for _ in range(150)]
        other = list(words)
        for at in r.sample(range(4, 296), 6):
            other[at] = "edited"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    rows += [(1000 + i, "x " * 300 + " ".join(word() for _ in range(30))) for i in range(2)]  # one fingerprint, two texts
    sets = [frozenset(simhash._distinct(simhash._hashes(t, 5)).tolist()) for _, t in rows]
    pairs = _exact_pairs(sets)
    root = brute.roots(len(rows), sorted(pairs))
    least = {}
    for (i, _), x in zip(rows, root):
        least[x] = min(least.get(x, i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.id: x.component_id for x in simhash.near_duplicates(docs, n=5, radius=3, wide=True).collect()}
    assert len(pairs) > 50 and found == {i: least[x] for (i, _), x in zip(rows, root)}


def test_overlapping_keeps_similar_pairs_and_few_others(spark):
    """Sets of one passage meet in a rare shingle or two; that is too little of their prefixes."""
    r = random.Random(15)
    passage, sets = r.sample(range(10**6, 2 * 10**6), 25), []
    for _ in range(40):
        base = passage + r.sample(range(10**6), r.randrange(80, 140))
        other = set(base) - set(r.sample(base, len(base) // 12)) | set(r.sample(range(10**6), r.randrange(4)))
        sets += [frozenset(base), frozenset(other)]
    order = {h: k for k, h in enumerate(r.sample(sorted(set().union(*sets)), len(set().union(*sets))))}
    sets = sorted({frozenset(order[h] for h in s) for s in sets}, key=sorted)
    counts = Counter(h for s in sets for h in s if h % 9 == 0)  # most frequent ones are unknown
    common = np.array(sorted(counts), np.uint64), np.array([counts[h] for h in sorted(counts)], np.int64)
    want = _exact_pairs(sets)
    rows = [(i, i, len(s), simhash._prefix(np.array(sorted(s), np.uint64), 0.8, *common).tolist()) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "set long, root long, size int, prefix array<long>")
    met = simhash.similar_pairs(frame, 0.8, common)
    left = {(x.a, x.b) for x in simhash.overlapping(met, frame, 0.8).collect()}
    assert len(want) > 20 and want <= left
    assert met.count() > 3 * len(left)


def test_workers_hold_few_texts_at_a_time():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["id"]) for n in (1200, 0, 3)]
    parts = list(simhash._parts(batches))
    assert max(p.num_rows for p in parts) <= 512
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(1200), *range(3)]


def test_small_tables_need_no_python_worker(spark):
    rows = [(1, -(1 << 63)), (2, 5)]
    df = simhash._small(spark, rows, set=pa.int32(), flip=pa.int64())
    assert df.dtypes == [("set", "int"), ("flip", "bigint")] and [tuple(r) for r in df.collect()] == rows
    assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()


def test_few_files_whatever_the_partitions(spark, sf, tmp_path, monkeypatch):
    """A file that is written forks the executor, whose memory then counts twice for a moment."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(60).write.parquet(f"{tmp_path}/documents.parquet")
    made, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, **k: made.append(cut(df, **k)) or made[-1])
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(was, ("50", "1g", "false"), strict=True):
            spark.conf.set(k, v)
        out = queries.op9_simhash(spark, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "out").glob("*.parquet"))) <= 2 * cores
    assert len(made[0].inputFiles()) <= 8 * cores


def _passages(groups, of, r):
    """Texts of 300 words; those of a group share 90 of them, any other words are their own."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    passages = [[word() for _ in range(90)] for _ in range(groups)]
    return [(i, " ".join(passages[i % groups] + [word() for _ in range(210)])) for i in range(groups * of)]


def test_passages_that_no_sample_shows_make_no_candidates(spark, monkeypatch):
    """A group's pairs are the square of its size; before, all of them met in the passage's shingles."""
    monkeypatch.setattr(simhash, "_SAMPLE", 4)
    docs = spark.createDataFrame(_passages(6, 20, random.Random(16)), "doc_id long, text string")
    met, similar_pairs = [], simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda *a: met.append(similar_pairs(*a)) or met[-1])
    found = simhash.near_duplicates(docs, n=5, radius=3, wide=True).collect()
    assert len(found) == 120 and all(x.id == x.component_id for x in found)
    assert met[0].count() == 0


def test_shared_shingles_are_counted_exactly(spark, monkeypatch):
    """In one part or many; copies count once, wherever they stand, and common ones not at all."""
    rows = _passages(3, 4, random.Random(17)) + [(100, None), (101, ""), (102, "one two")]
    rows += [(200 + i, rows[0][1]) for i in range(3)]
    sets = {simhash._set_digest(x): x for x in (simhash._distinct(simhash._hashes(t, 5)) for _, t in rows)}
    holders = Counter(h for x in sets.values() for h in x.tolist())
    common = np.array(sorted(h for h, c in holders.items() if c > 1)[:20], np.uint64)
    want = {(d, int(np.uint64(h).view(np.int64)), holders[h]) for d, x in sets.items() for h in x.tolist() if holders[h] > 1 and h not in set(common.tolist())}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for part in (1 << 21, 100):
        monkeypatch.setattr(simhash, "_PART", part)
        got = [tuple(x) for x in simhash._shared(docs, "text", 5, sum(map(len, sets.values())), common).collect()]
        assert len(want) > 500 and len(got) == len(want) and set(got) == want
