"""Chunking against a plain model of its rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking

HEAD = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)


def normal(t):
    t = "\n".join(line.rstrip() for line in t.splitlines())
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def model_sections(t):
    found = list(HEAD.finditer(t))
    if not found:
        return [(0, "Document", 0, len(t))]
    out = [(0, "Introduction", 0, found[0].start())] if t[: found[0].start()].strip() else []
    ends = [m.start() for m in found[1:]] + [len(t)]
    return out + [(len(m[1]), m[2], m.start(), e) for m, e in zip(found, ends)]


def model_parts(t, start, end, most, overlap):
    toks = [m.span() for m in re.finditer(r"\S+", t[start:end])]
    if len(toks) <= most:
        return [(start, end)]
    out, i = [], 0
    while True:
        w = toks[i : i + most]
        out.append((start + w[0][0], start + w[-1][1]))
        if i + most >= len(toks):
            return out
        i += most - overlap


def model_chunks(doc_id, raw, most, overlap):
    t, marks = normal(raw), []
    while m := re.search(r"\[\[DEMO:([^\]]+)\]\]", t):
        marks.append((m.start(), m[1]))
        t = t[: m.start()] + t[m.end() :]
    if not t.strip():
        return []
    s = model_sections(t)
    spans = [([s[0][1]], s[0][2], s[0][3])] if len(s) == 1 else [([a[1], b[1]], a[2], b[3]) for a, b in zip(s, s[1:])]
    out, n = [], 0
    for heads, a, b in spans:
        if not re.sub(r"^#{1,6}\s+.*$", "", t[a:b], flags=re.M).strip():
            continue
        n += 1
        parts = model_parts(t, a, b, most, overlap)
        for k, (x, y) in enumerate(parts, 1):
            name = f"{doc_id}__chunk_{n:04d}" + (f"__part_{k:03d}" if len(parts) > 1 else "")
            refs = list(dict.fromkeys(d for p, d in marks if x <= p < y))
            out.append((name, normal(t[x:y]), tuple(heads), tuple(refs), x, y))
    return out


def docs_of(spark, texts, kind="prose"):
    meta = F.struct(F.lit("Title").alias("title"), F.lit(None).cast("string").alias("component"), F.lit("u").alias("url"), F.lit(kind).alias("doc_type"))
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").withColumn("metadata", meta)


def texts():
    r = random.Random(2)
    pieces = ["word", "# Head", "## Sub  ", "#", "é😀", "\n", "\n\n", "\n\n\n", " ", "\t", "[[DEMO:a.js]]", "[[DEMO:b.tsx]]", "####### seven", "#nospace", "\r\n", " ", "x" * 9]
    made = ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(150)]
    return made + ["", "# A\n\n## B\n\n## C\ntext", "text [[DEMO:z.js]]", "# Only", "#\nbody here"] + [" ".join(["t"] * n) for n in (5, 6, 9, 10, 13, 14)]


def test_chunks_equal_the_model(spark):
    ts = texts()
    got = chunking.chunk_documents(docs_of(spark, ts), max_tokens=5, overlap=1).collect()
    want = [c for i, t in enumerate(ts) for c in model_chunks(f"d{i}", t, 5, 1)]
    assert sorted((c.chunk_id, c.text, tuple(c.metadata.headings), tuple(c.metadata.demo_refs), c.char_start, c.char_end) for c in got) == sorted(want)


@pytest.mark.parametrize("n,parts", [(500, 1), (501, 2), (900, 2), (901, 3)])
def test_number_of_parts(spark, n, parts):
    assert chunking.chunk_documents(docs_of(spark, [" ".join(["w"] * n)])).count() == parts


def test_api_is_one_chunk(spark):
    c = chunking.chunk_documents(docs_of(spark, ["# A\n" + "w " * 600], "api")).collect()
    assert len(c) == 1 and c[0].metadata.headings == ["Title"] and c[0].metadata.split_index is None


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunking.chunk_documents(docs_of(spark, ["a"]), 10, 10)


def test_validate(spark):
    good = chunking.chunk_documents(docs_of(spark, ["a b c"]))
    assert chunking.validate(good).count() == 1
    with pytest.raises(ValueError, match="duplicate"):
        chunking.validate(good.unionByName(good))


def test_normalize(spark):
    r = random.Random(3)
    ts = ["".join(r.choice(" \t\n\r\nab \x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2003\u2028\u2029\u3000\n\n") for _ in range(40)) for _ in range(300)]
    got = [x.n for x in spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t string").select("i", T.normalize(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [normal(t) for t in ts]


def test_titles(spark):
    names = ["3d-view", "b_side", "don't-stop", "été_2024x", "ALL-CAPS", "a1b2"]
    got = [x.t for x in spark.createDataFrame([(i, f"x/{n}.md") for i, n in enumerate(names)], "i int, p string").select("i", T.title_from_name(F.col("p")).alias("t")).orderBy("i").collect()]
    assert got == [" ".join(n.replace("-", " ").replace("_", " ").split()).title() for n in names]


def test_many_sections_in_one_text(spark):
    text = "".join(f"# h{i}\n\nbody {i}\n\n" for i in range(3000))
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = chunking.section_pairs(d).collect()
    assert len(got) == 2999 and got[-1].headings == ["h2998", "h2999"] and got[0].char_start == 0
