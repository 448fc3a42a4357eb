import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import chat, crf, licenses
from lodestone.llm.queries import op10_chat_format


# -- conditional random field ---------------------------------------------------------------------


def test_marginals_equal_enumeration():
    from itertools import product

    r = np.random.default_rng(2)
    k = 3 * crf.FEATURES
    chain = crf.Chain(np.zeros(k), np.ones(k), r.normal(size=k) * 0.3, r.normal(size=(2, 2)))
    docs = [r.normal(size=(n, crf.FEATURES)).astype(np.float32) for n in (1, 4, 2, 6)]
    for d, got in zip(docs, chain.marginals(docs)):
        s = crf.with_neighbours(d) @ chain.unary
        total, good = 0.0, np.zeros(len(d))
        for y in product((0, 1), repeat=len(d)):
            w = np.exp(sum(s[i] * y[i] for i in range(len(d))) + sum(chain.transition[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert np.allclose(got, good / total)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in crf.score(docs, crf.fit(docs, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[x.doc_id].predicted, x.quality) for x in labels.collect() if got[x.doc_id].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.93
    again = {r.doc_id: r.score for r in crf.score(docs, crf.fit(docs.repartition(5), labels.repartition(3))).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in got.items())


def test_crf_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "\n\n" * 4000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 1)], "doc_id long, quality int")
    chain = crf.fit(docs, labels)
    out = crf.score(docs, chain)
    assert out.count() == 4 and {r.score for r in out.collect()} == {0.5}
    assert crf.score(docs.limit(0), chain).count() == 0


# -- licenses -------------------------------------------------------------------------------------


def test_each_template_is_found():
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            words = t.split()
            wrapped = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
            for text in (f"Some prose.\n{t}\nMore prose.", f"é lead\n\n{wrapped}\n\nend", t.upper()):
                _, found = licenses.scan(text)
                assert name in {f.license for f in found}, (name, text)
                assert all(text[f.start : f.end].strip() for f in found)


def test_wording_differences():
    mit = licenses.TEMPLATES["MIT"][3]
    words = mit.split()
    words[20] = "people"
    _, found = licenses.scan(" ".join(words))
    assert [(f.license, f.differences) for f in found] == [("MIT", 1)]
    assert licenses.scan("Licensed under the Apache License, Version 3.0.")[1] == []
    assert licenses.scan("The license of my car, the copyright of a song.")[1] == []
    assert licenses.scan("") == (0, [])


def test_reworded_bodies_without_license_words():
    """Compression alone makes the candidates: the words of ``HINT`` are all replaced."""
    import re

    r = random.Random(8)
    tried = 0
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            words = t.split()
            for i, w in enumerate(words):
                if re.search(licenses.HINT, w):
                    words[i] = "terms"
            body = re.sub(r"(?i)free of charge|free software|public domain|creative commons", "gratis", " ".join(words))
            n = len(licenses._WORD.findall(t))
            allowed, changed = int(0.1 * n), len(licenses._WORD.findall(t)) and sum(a != b for a, b in zip(t.split(), body.split()))
            if n < licenses._BODY or re.search(licenses.HINT, body) or changed > allowed or len(body.split()) != len(t.split()):
                continue
            tried += 1
            prose = lambda k: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(k))
            text = f"{prose(700)} {body} {prose(700)}"
            assert name in {f.license for f in licenses.scan(text)[1]}, (name, body)
    assert tried >= 4


def test_candidates_lose_nothing_that_every_template_would_find():
    """Against the plain way: every body held against every block word by word."""
    r = random.Random(9)
    bodies = [(i, t) for i, t in enumerate(licenses._templates()[0]) if len(t[2]) >= licenses._BODY]
    for k in range(60):
        i, t = r.choice(bodies)
        words = t[1].split()
        for at in r.sample(range(len(words)), r.randrange(len(words) // 10 + 1)):
            words[at] = r.choice(["another", "some", "wording"])
        prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
        block = f"{prose(200)} {' '.join(words)} {prose(200)}"
        want = {j for j, _ in bodies if licenses.confirm(block, j)}
        assert want <= set(licenses.candidates(block)), (t[0], block)


def test_notices_within_one_long_line():
    r = random.Random(3)
    common = "the of and to a in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()
    short = [(n, t) for n, texts in licenses.TEMPLATES.items() for t in texts if len(t) < 100]
    for k in range(20):  # one notice in a line of prose
        for name, t in short:
            words = [r.choice(common) for _ in range(760)]
            words.insert(r.randrange(760), t)
            assert name in {f.license for f in licenses.scan(" ".join(words))[1]}, (k, name)
    words = [r.choice(common) for _ in range(600)]
    for _, t in short:  # many in one
        words.insert(r.randrange(len(words)), t)
    assert {n for n, _ in short} == {f.license for f in licenses.scan(" ".join(words))[1]}


def test_licenses_of_documents(spark, sf):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in licenses.scan_documents(docs).collect()}
    lines = {"MIT": r"Released under the MIT License\.", "Apache-2.0": r"Licensed under the Apache License, Version 2\.0\.", "GPL-3.0": r"This work is licensed under the GNU General Public License, version 3\.", "CC-BY-NC-4.0": r"Licensed under CC BY-NC 4\.0\.", "all-rights-reserved": r"All rights reserved\."}
    for r in docs.collect():
        assert got[r.doc_id] == {n for n, p in lines.items() if re.search(p, r.text)}


def test_license_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (3, "All rights reserved. " * 3000, "x")], "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in licenses.scan_documents(docs).collect()}
    assert got[1].licenses == got[None].licenses == "" and len(got[3].finds) == 3000
    assert licenses.scan_documents(docs.limit(0)).count() == 0


# -- chat -----------------------------------------------------------------------------------------

CONTROL = st.lists(st.sampled_from([*chat.CONTROLS, chat.SIGN, "a", "<", "/s>", "\n", "[", "b", "|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(CONTROL, CONTROL)
def test_render_reads_back(role, text):
    segment, start, end = chat.render(role, text, (role,))
    assert chat.read_back(segment) == (role, text) and chat.unescape(segment[start:end]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def final(events):
    return [(c, m.role, "".join(m.parts)) for c, m in chat.fold((c, s, "", 0, k, t, r, x) for c, s, k, t, r, x in events)]


def test_fold():
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "he"), (1, 2, "delta", 1, None, "llo"), (1, 3, "message", 2, "user", "more"), (1, 4, "delta", 3, "assistant", "x"),
        (1, 5, "edit", 0, None, "hi!"), (1, 6, "regenerate", 1, None, None), (1, 7, "delta", 1, None, "again"), (2, 0, "message", 0, "user", None), (2, 1, "delete", 9, None, None), (2, 2, "message", 1, "assistant", "a"), (2, 3, "delete", 0, None, None),
    ]
    assert final(log) == [(1, "user", "hi!"), (1, "assistant", "again"), (2, "assistant", "a")]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def want(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), digest(loss), sum(len(chat.render(r, x)[0]) for _, r, x in turns))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect()}


def test_conversations(spark, sf):
    c = "</s>[INST] ok [/INST]"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(op10_chat_format(spark, sf)) == want(rows + [(-1, 0, "user", c), (-1, 1, "assistant", c)])


def test_chat_edges(spark):
    r = random.Random(1)
    long = "".join(r.choice("ab␛<|end|>é") for _ in range(30000))
    rows = [(1, 0, "user", None), (1, 1, "assistant", long), (1, 2, None, ""), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, None, "user", "first"), (3, 0, "assistant", "z")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, seq int")
    log = chat.as_events(df, piece=7)
    flat = [(c, -1 if t is None else t, ro, x) for c, t, ro, x in rows]
    assert got(chat.digests(chat.format_conversations(log))) == want(flat)
    assert chat.digests(chat.format_conversations(log.limit(0))).count() == 0
