import io
import json
import tarfile

import pytest

from lodestone import schemas
from lodestone.functions import text as T
from lodestone.operators import preprocess
from lodestone.plans import cli
from lodestone.plans.pipeline import STAGES, Pipeline, missing_outputs
from lodestone.sources import readers, writers
from lodestone.streaming import ingest

FILES = {
    "m-1/docs/data/material/a/a.md": '---\ntitle: Apples\ncomponents: Apple\n---\n# Apples\n\nApples are <b>red</b> &amp; round. {{"demo": "Red.js"}}\n\n## Uses\n\nPies and juice. {{"component": "x"}}\n\n## More\n\nCider and vinegar and cake.',
    "m-1/docs/data/material/a/Red.tsx": "export const Red = 1;\n",
    "m-1/docs/data/material/b/b-side.md": "# Pears\n\nPears are green.",
    "m-1/docs/data/material/b/Red.tsx": "other",
    "m-1/docs/pages/material-ui/api/apple.json": json.dumps({"name": "Apple", "props": {"color": {"type": {"name": "string"}, "default": "'red'", "description": "The colour."}}}),
    "m-1/README.md": "not kept",
}


def archive(tmp_path):
    p = tmp_path / "in" / "c.tar.gz"
    p.parent.mkdir()
    with tarfile.open(p, "w:gz") as t:
        for name, text in FILES.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    return str(p)


def test_flat_names():
    used = set()
    assert [preprocess.flat_name(r, used) for r in ("a/i.js", "b/i.js", "c/b/i.js")] == ["i.js", "b__i.js", "b_2__i.js"]


def test_from_archive_to_report(spark, tmp_path, capsys):
    q = spark.createDataFrame([(1, "What colour are apples?", "red", ["prose__a__chunk_0001"], "factoid"), (2, "What are pears?", "green", ["prose__b-side__chunk_0001"], "multi-hop"), (3, "Who?", "I don't know", [], "unanswerable")], schemas.QUESTIONS)
    p = Pipeline(spark, str(tmp_path / "out"), q)
    files = {r.url: r for r in p.fetch(readers.archive_members(spark, archive(tmp_path))).collect()}
    assert len(files) == 5 and files["docs/data/material/b/Red.tsx"].flat_name == "b__Red.tsx"
    docs = {r.doc_id: r for r in p.preprocess().collect()}
    assert docs["prose__a"].text == "# Apples\n\nApples are red & round. \n\n[[DEMO:Red.tsx]]\n\n## Uses\n\nPies and juice. \n\n## More\n\nCider and vinegar and cake."
    assert docs["prose__a"].metadata.component == "Apple" and docs["prose__b-side"].metadata.title == "B Side"
    assert docs["api__apple"].text == "Apple component API reference.\nProp `color`: type string. Default: 'red'. The colour."
    chunks = {r.chunk_id: r for r in p.chunk().collect()}
    assert chunks["prose__a__chunk_0001"].metadata.demo_refs == ["Red.tsx"]
    assert sorted(c.ord for c in chunks.values()) == list(range(len(chunks)))
    p.bm25()
    whole = {r.chunk_id: r.embedding for r in p.dense().collect()}
    assert all(whole.values()) and p.read("dense_report").first().windowed == 0
    packed = {r.chunk_id: r.embedding for r in p.dense(coverage=6, context=8).collect()}
    assert p.read("dense_report").first().windowed > 0  # the stand-in's vectors don't depend on their context
    assert all(abs(a - b) < 1e-9 for c in whole for a, b in zip(whole[c], packed[c]))
    m = {r.query_id: r for r in p.evaluate_retrieval("bm25", 2).collect()}
    assert m[1].first_relevant_rank == 1 and p.evaluate_retrieval("dense", 2).count() == 2
    both = writers.retrieval_report(p.read("retrieval_bm25"), str(tmp_path / "csv"))
    writers.metrics_json(p.read("retrieval_bm25"), str(tmp_path / "m.json"))
    assert len(json.loads((tmp_path / "m.json").read_text())["questions"]) == 2
    assert both.where("query_id = 'MEAN'").count() == 1 and writers.console(p.read("retrieval_bm25")).startswith("queries: 2")
    a = {r.answer_id: r for r in p.generate().collect()}
    assert len(a) == 9 and a["1-naive"].citations == [] and a["1-rag-bm25"].citations[0].cited_in_text
    assert a["1-rag-bm25"].citations[0].source.github_url.startswith("https://github.com/owner/corpus/blob/main/docs/")
    p.evaluate_generation()
    r = p.review_table().toDF(*p.read("review").columns)
    scored = r.withColumns({c: __import__("pyspark").sql.functions.lit("2") for c in schemas.REVIEW_FIELDS[:3]})
    assert p.summarise(scored).count() == 3 and p.diagnose(scored).count() == 2
    assert json.loads("\n".join(x.value for x in spark.read.text(p.path("manual_summary_json"), wholetext=True).collect()))[0]["arm"] == "naive"
    told = json.loads(spark.read.text(p.path("diagnostic_json"), wholetext=True).first().value)
    assert told["summary"]["questions"] == 2 == len(told["questions"]) and told["summary"]["conclusion"]
    assert readers.review_csv(spark, p.path("diagnostic_csv")).count() == 2
    assert spark.read.text(p.path("diagnostic_markdown"), wholetext=True).first().value.startswith("# No-Context")
    with pytest.raises(ValueError, match="2 answerable questions, not 10"):
        p.diagnose(scored, 10)
    with pytest.raises(ValueError, match="0 reviewed"):
        p.summarise(scored.limit(0))
    assert missing_outputs(str(tmp_path / "out"), ("docs", "chunks", "answers", "nothing")) == ["nothing"]
    assert "prose__b-side" in cli.show(p, "bm25", "pears", 1)
    assert len(STAGES) == 10


def test_strict_readers(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text('{"doc_id": "a", "text": "x"}\n\n{"doc_id": "a", "text": "y"}\n')
    assert [(r.doc_id, r.text) for r in readers.docs_by_id(spark, str(f)).collect()] == [("a", "y")]
    c = tmp_path / "c.jsonl"
    c.write_text("".join(json.dumps({"chunk_id": i, "doc_id": "a", "text": t}) + "\n" for i, t in (("1", "x"), ("2", "y"), ("1", "z"))))
    assert readers.chunks(spark, str(c)).count() == 3
    assert {r.chunk_id: r.text for r in readers.chunks_by_id(spark, str(c)).collect()} == {"1": "z", "2": "y"}
    for bad in ('{"doc_id": "a"}\n', "{broken\n", "\n"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            readers.docs(spark, str(f))
    f.write_text('{"question_id": 1, "question_text": "a"}\n{"question_id": 1, "question_text": "b"}\n')
    with pytest.raises(ValueError, match="repeats"):
        readers.questions(spark, str(f))


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "b"\nc', ["x"])], "answer_id string, t string, ids array<string>")
    writers.csv(rows, str(tmp_path / "c"))
    back = readers.review_csv(spark, str(tmp_path / "c")).first()
    assert back.t == 'a "b"\nc' and back.ids == '["x"]'
    with pytest.raises(ValueError):
        writers.csv(rows.limit(0), str(tmp_path / "e"))


def test_manifest_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("b", "u/b", "prose"), ("a", "u/a", "demo")], schemas.MANIFEST)
    writers.manifest(files, str(tmp_path / "m.json"))
    assert list(json.loads((tmp_path / "m.json").read_text())) == ["a", "b"]
    assert readers.manifest(spark, str(tmp_path / "m.json")).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"doc_id": f"d{i}", "text": "# A\n\nwords here", "metadata": {"doc_type": "prose"}}))
    ingest.append_chunks(ingest.arriving_docs(spark, str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 3


def test_every_entity_is_decoded(spark):
    from pyspark.sql import functions as F

    union = "'inherit'<br>&#124;&nbsp;'primary'<br>&#124;&nbsp;'secondary'"
    props = {"color": {"type": {"name": "union", "description": union}, "description": "One&mdash;or &#x27;more&#x27;&hellip;"}, "plain": {"type": {"name": "bool"}}}
    raw = [(1, json.dumps({"name": "Apple", "props": props})), (2, json.dumps({"name": "Pear"}))]
    d = spark.createDataFrame(raw, "id int, raw string").select("id", T.flatten_api(F.from_json("raw", schemas.API_PROPS)).alias("flat"))
    got = {r.id: r.flat for r in d.collect()}
    assert got[1] == "Apple component API reference.\nProp `color`: type 'inherit' | 'primary' | 'secondary'. One—or 'more'…\nProp `plain`: type bool."
    assert got[2] == "Pear component API reference."


def test_strip_html_query_decodes_every_entity(spark, tmp_path):
    from lodestone.plans import queries

    spark.createDataFrame([(1, "<p>a &mdash; b&#124;c &amp;lt; &hellip;</p>")], "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r.plain for r in queries.strip_html(spark, str(tmp_path)).where("page_id > 0").collect()] == ["a — b|c &lt; …"]
