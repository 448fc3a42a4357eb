import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import hamming, urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "allow")]


def parse(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def judge(url, listed):
    host, path = parse(url)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, v = max(fits)
        return host, path, rule, v
    return host, path, None, "block" if url is not None and (host + path).rstrip("/") in listed else "allow"


def test_urls(spark):
    r = random.Random(1)
    hosts = ["example.net", "a.example.net", "xexample.net", "NET", "b.Example.COM", "example.com", "x.org", "org", "", "example.com:80", "é.org", "..org", "a@b.net"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/fr", "/e?/en/", "#/", "/de/?q", "/x/y/", "//", "/\n"]
    rows = [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "://", "a://b://c/", "http:///en/"]
    rows += ["https://hot.example.net/en/1"] * 200
    listed_urls = ["HTTPS://example.com/x/y", "http://b.example.com/", None, "bad", "http://x.org/x/y///"]
    listed = {"".join(parse(u)).rstrip("/") for u in listed_urls if u} - {""}
    pages = spark.createDataFrame([(i, u, "v", i) for i, u in enumerate(rows)], "page_id int, url string, Verdict string, __url int")
    both = urls.blocked(spark.createDataFrame([(u,) for u in listed_urls], "url string"), "url").unionByName(urls.rules(spark, RULES))
    out = urls.judge(pages, both)
    assert out.columns == ["page_id", "url", "Verdict", "__url", "host", "path", "rule", "verdict_"]
    got = out.collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.host, g.path, g.rule, g.verdict_) == judge(g.url, listed), g.url
    assert urls.judge(pages.limit(0), both).count() == 0
    assert {r_.verdict_ for r_ in urls.judge(pages, both.limit(0)).collect()} == {"allow"}


def test_bloom_passes_all_members_and_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("in"), "id").alias("text"))
    blocks = -(-5000 * urls._BITS // 512)
    table = urls.bloom(listed, blocks)
    assert urls.possible(listed, table, blocks).count() == 5000
    others = spark.range(20000).select(F.concat(F.lit("out"), "id").alias("text"))
    assert urls.possible(others, table, blocks).count() < 200


def brute_nearest(rows, queries, k):
    out = []
    for q, qc in queries:
        near = sorted(((qc ^ c) & (1 << 64) - 1).bit_count() * 10**9 + i for i, c in {x for x in rows if x[1] is not None} if i != q)
        out += [(q, n + 1, x % 10**9, x // 10**9) for n, x in enumerate(near[:k])]
    return sorted(out)


def signed(c):
    return c - (1 << 64) if c >> 63 else c


def test_nearest(spark, monkeypatch):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(8)]
    rows = []
    for i in range(300):
        c = r.choice(base)
        for b in r.sample(range(64), r.randrange(9)):
            c ^= 1 << b
        rows.append((i, signed(c)))
    rows += [(300 + i, signed(base[0])) for i in range(120)] + [(5, rows[5][1]), (999, None)]
    df = spark.createDataFrame(rows, "vec_id long, code long")
    queries = [x for x in rows if x[0] % 50 == 0]
    for index_block, query_block in ((1 << 17, 1 << 14), (40, 3)):
        monkeypatch.setattr(hamming, "_INDEX_BLOCK", index_block)
        monkeypatch.setattr(hamming, "_QUERY_BLOCK", query_block)
        got = hamming.nearest(df, df.where("vec_id % 50 = 0"), 7)
        assert sorted(map(tuple, got.collect())) == brute_nearest(rows, queries, 7)
    few = df.where("vec_id < 4")
    assert hamming.nearest(few, few.where("vec_id = 0"), 7).count() == 3
    assert hamming.nearest(df.limit(0), df.limit(0), 7).count() == 0


def test_search_grows_until_covered():
    r = np.random.default_rng(1)
    codes = r.integers(0, 2**63, 500, dtype=np.uint64)
    index = hamming.MultiIndex(codes)
    for q in (int(codes[0]), 0, 2**63 - 1):
        at, d = index.search(q, 5)
        want = np.bitwise_count(codes ^ np.uint64(q))
        kth = np.sort(want)[4]
        assert sorted(at) == list(np.nonzero(want <= kth)[0]) and (want[at] == d).all()
    assert len(index.search(0, 1000)[0]) == 500


def test_sign_code(spark):
    v = [1.0 if i in (0, 63) else -1.0 for i in range(64)]
    got = [x.c for x in spark.createDataFrame([(1, v), (2, None), (3, v[:63])], "i int, v array<float>").orderBy("i").select(hamming.sign_code(F.col("v")).alias("c")).collect()]
    assert got == [signed(1 | 1 << 63), None, None]
