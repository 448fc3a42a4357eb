"""PII, quality rules, mixing."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, pii, quality
from lodestone.llm.queries import ORACLE_SQL

from . import brute

CLASH = "doc_id long, text string, source string, lang string, key string, spans int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "k", 1) for r in rows], CLASH)


def messy(seed, n, alphabet):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


PII_TEXTS = [
    None, "", "a@b.c", "a@b.c@d.e x", "a@b.c_x@d.e", "é a.b+c@x-y.co.uk. é", "@a.b a@.b a@b", "1.2.3.4", "999.1.2.3 01.002.0003.255 1.2.3.4.5.6.7.8",
    "00000000000000000001.1.1.1", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "41111111111111111111111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 x",
    "+49 (30) 123456-78", "+1 2 3", "+123456789012345678", "mail 😀 me+1@x.yz +44 20 7946 0958 10.0.0.1", "1" * 3000, "a." * 3000 + "@b.c", "+1" * 500,
]


def test_base_spans(spark):
    texts = PII_TEXTS + messy(1, 200, "a1@.+- (4") + messy(2, 200, "0123456789 -.") + messy(3, 100, "+123 ()-.5é")
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii_row(t), t


def planted():
    """Texts in which a name and a place stand near someone's address in several, near it in one only, far from it,
    and without it; rare words beside an entity of one text; an entity that a third of all texts have; copies."""
    r = random.Random(4)
    common = [f"w{i}" for i in range(30)]
    prose = lambda n: " ".join(r.choice(common) for _ in range(n))
    texts = [prose(30) for _ in range(120)]
    texts += [f"{prose(40)} Dr Zweistein of Kleinstadt reaches anna@x.org daily {prose(8)} {i}" for i in range(6)]
    texts += [f"{prose(10)} ZWEISTEIN was seen. {prose(10)}", f"Zweistein, {prose(100)} anna@x.org {prose(30)}"]  # without the entity, and far from it
    texts += [f"{prose(10)} in Kleinstadt {prose(5)} {i}" for i in range(9)]  # the place tells too little
    texts += [f"{prose(20)} ask Einzig, +49 30 1234567, {prose(20)}", f"{prose(20)} ask Doppelt, +49 30 7654321, {prose(20)}", f"{prose(20)} Doppelt {prose(5)}"]
    texts += [f"{prose(6)} mail info@host.example or hotline {prose(6)} {i}" for i in range(70)]
    return texts + [texts[120]] * 3 + [texts[126]] * 5 + [None, ""]


def sql_over(query, rows, columns):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=columns))
    return con.execute(query).df().to_dict("records")


def test_disclosing_terms(spark):
    """With the parameters of production."""
    texts = planted()
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    terms = brute.telling(texts)
    assert {"zweistein", "einzig", "hotline"} <= set(terms) and not {"kleinstadt", "doppelt", "ask"} & set(terms) and not any(t[0] == "w" for t in terms)
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, t in enumerate(texts):
        assert [tuple(map(int, x.split(":")[1:])) for x in got[i].spans.split(",") if x.startswith("term")] == [x[:2] for x in brute.term_spans(t, terms)], t
    assert got[126].n_terms == 1 and got[126].n_email == 0  # the text without the entity
    for x in sql_over(ORACLE_SQL["op5_pii"], [(i, t) for i, t in enumerate(texts)], ["doc_id", "text"]):
        assert (got[x["doc_id"]].spans, got[x["doc_id"]].n_terms) == (x["spans"], x["n_terms"])
    clean = {r_.doc_id: r_.text for r_ in pii.sanitised(docs).collect()}
    assert clean == {i: None if t is None else brute.sanitise(t, terms) for i, t in enumerate(texts)}
    assert "anna@" not in clean[121] and "Zweistein" not in clean[121] and "ZWEISTEIN" not in clean[126] and clean[3] == texts[3]
    assert pii.sanitised(docs).columns == docs.columns


def test_pii_of_repeated_rows(spark):
    """Rows that repeat, null ids and copies count as one text."""
    rows = [(None, "Name Eins a@b.c", "s")] * 3 + [(5, "Name Eins a@b.c", "s")] * 2 + [(6, "Eins alone", "s"), (7, "Name alone", "s"), (8, "more words", "s")]
    got = [(r.doc_id, r.n_terms) for r in pii.report(frame(spark, rows)).collect()]
    terms = brute.telling([t for _, t, _ in rows])
    assert sorted(got, key=str) == sorted([(i, len(brute.term_spans(t, terms))) for i, t, _ in rows], key=str)


def test_pii_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.report(docs).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii_row(text[r.doc_id])


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a", "s")]).where(F.lit(False))
    assert pii.report(docs).count() == pii.sanitised(docs).count() == 0
    assert quality.judge(docs).count() == quality.cleaned(docs).count() == 0
    assert mixing.plan(docs).count() == mixing.mixed(docs).count() == 0


def test_quality_counts(spark, sf):
    texts = [None, "", "\n\n", "a b c a b c", "x\nx\n x\n\n", "a a a a a", "é# *\x0b$%&|<> \x1c"] + messy(7, 300, "ab \n") + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    for r in quality.judge(docs).collect():
        want = brute.quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and (not failed or not r.kept)


def test_frequent_lines(spark):
    r = random.Random(9)
    rows = []
    for i in range(60):
        body = "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20)) for _ in range(6))
        rows.append((i, f"Menu  1 home about\n{body}", "h" if i % 3 else None))
    only = "\n".join(["menu 2 HOME about"] * 30)  # nothing but the frequent line
    rows += [(100, only, "h"), (100, only, "h")]
    copied = "\n".join(" ".join("abcde"[k] * (j + 1) for j in range(20)) for k in range(5))
    rows += [(200 + i, copied, "h") for i in range(50)]  # copies are one document
    docs = frame(spark, rows)
    verdicts = quality.judge(docs, least=10)
    got = {x.doc_id: x for x in verdicts.collect()}
    assert verdicts.count() == len(rows)
    assert all(got[i].frequent_words == 4 and got[i].kept for i in range(60))
    assert got[100].frequent_words == 120 and not got[100].kept
    assert all(got[200 + i].kept and got[200 + i].frequent_words == 0 for i in range(50))
    clean = {x.doc_id: x.text for x in quality.cleaned(docs, least=10).collect()}
    assert clean[0] == rows[0][1].split("\n", 1)[1] and 100 not in clean and clean[200] == copied


def test_a_footer_is_counted_whatever_its_hash(spark):
    """100 different documents of one host share a footer; each document's own lines hash below and above it."""
    r = random.Random(10)
    for footer in [f"footer {w} of this host" for w in ("alpha", "beta", "gamma", "delta", "kappa", "omega")]:
        rows = [(i, "\n".join([" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(3)] + [footer]), "h") for i in range(100)]
        got = quality.judge(frame(spark, rows)).collect()
        assert all(x.frequent_words == 5 and x.kept for x in got), footer


def test_near_copies_are_documents_and_copies_are_one(spark):
    r = random.Random(3)
    body = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20)) for _ in range(4)]
    near = [(i, "\n".join([*body, f"own line {'x' * i}"]), None) for i in range(12)]
    copies = [(100 + i, "\n".join(["Other " + b for b in body]) + " " * i, None) for i in range(40)]
    got = {x.doc_id: x.frequent_words for x in quality.judge(frame(spark, near + copies)).collect()}
    assert all(got[i] == 80 for i in range(12)) and all(got[100 + i] == 0 for i in range(40))


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    rows = []
    for s in ["b", "a", None, "é", "", "Z"][: 2 + seed]:
        for _ in range(r.choice([1, 5, 30])):
            rows.append((len(rows), " ".join(["w"] * r.randrange(80)), s))
    rows += [(7, "dup dup", "a"), (7, "dup dup", "a"), (8, None, "a"), (None, "x y", "b")]
    docs = frame(spark, rows)
    want = brute.mix([(s, len(brute.words(t))) for _, t, s in rows])
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    taken = brute.mix_taken([(i, s, t) for i, t, s in rows])
    assert sorted((str(g.doc_id), str(g.source), g.size, g.taken) for g in got) == sorted((str(i), str(s), n, k) for i, s, n, k in taken)
    for g in got:
        size, target = want[g.source]
        assert g.source_size == size and abs(g.target - target) < 1e-6
        assert 0 <= g.taken <= 2 * g.size
    longest = max((g.size for g in got), default=0)
    for s, (_, target) in want.items():
        assert abs(sum(g.taken for g in got if g.source == s) - target) <= 2 * longest
    assert sum(g.taken for g in got) == int(1.5 * sum(g.size for g in got))
    again = mixing.plan(docs.repartition(3)).collect()
    key = lambda x: (str(x.doc_id), x.size, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    stream = sorted(mixing.queue(docs).collect(), key=lambda x: x.position)
    at = 0
    for a in stream:
        assert a.position == at
        at += a.taken
    assert [a.finish for a in stream] == sorted(a.finish for a in stream)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len(brute.words(x.text)) for x in out.collect()) == sum(g.taken for g in got)


def test_a_row_that_makes_a_third_of_all(spark):
    rows = [(None, "same text", "a")] * 50 + [(i, f"text number {i}", "a" if i % 2 else "b") for i in range(100)]
    docs = frame(spark, rows)
    got = mixing.plan(docs).collect()
    assert sum(g.taken for g in got) == int(1.5 * (50 * 2 + 100 * 3)) and len(got) == 150
    assert sum(len(brute.words(x.text)) for x in mixing.mixed(docs).collect()) == 600


def test_ways_beyond_the_broadcasts(spark, sf, monkeypatch):
    """What is too large to broadcast takes another way to the same result."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.limit(20)).withColumn("source", F.lit("one"))
    stages = (lambda d: quality.cleaned(d, least=3, part=0.001), lambda d: pii.sanitised(d, open_bits=3.0), mixing.mixed)
    rows = lambda df: sorted(map(str, df.collect()))
    near = [rows(f(docs)) for f in stages]
    assert near[0] != rows(docs) and near[1] != rows(docs)
    monkeypatch.setattr(quality, "_BROADCAST_LINES", -1)
    monkeypatch.setattr(pii, "_BROADCAST_TERMS", -1)
    assert [rows(f(docs)) for f in stages] == near


def test_counts_and_lines_read_texts_without_passes_to_spare(spark):
    """Whole texts are neither rewritten by regular expressions nor, if ASCII, translated; results are as before."""
    odd = ["", " ", "\n\n a \n", "a\tb  c\r\nÉ A1\x0b9 \n\x85x  y", "  #$%&|<>* 12", "Ä  B\nA b\x0c", "İI\nΣΑΣ 1\n1", "Plain line 19\nplain  LINE 28\n", None]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    counts = quality.text_counts(docs, F.col("text"), [F.col("doc_id")])
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "regexp_replace(" not in plan
    for r in counts.collect():
        n, chars, symbols, dup, rep = brute.quality_counts(odd[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
    zero = str.maketrans("123456789", "0" * 9)
    plain = lambda t: " ".join(brute.words(brute.ascii_lower(t.translate(zero))))
    got = docs.select("doc_id", quality.normalised(F.col("text")).alias("x")).collect()
    assert all(r.x == (plain(odd[r.doc_id]) if odd[r.doc_id] is not None else None) for r in got)
    lines = {(r.doc, r.hash) for r in quality._lines(docs, F.col("text"), F.lit("h")).collect()}
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert lines == {(bytes.fromhex(digest(plain(t))), int(digest(plain(x))[:15], 16)) for t in odd if t for x in t.split("\n") if brute.words(x)}
