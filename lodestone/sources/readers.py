"""Readers. Schemas are declared, bad input raises with what is wrong, nothing is inferred."""

from __future__ import annotations

import io
import os
import tarfile
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import preprocess


def download(url: str, target: str, step: int = 1 << 20) -> str:
    """The file at url, fetched once: an existing target is taken as it is. Written whole or not at all."""
    if os.path.exists(target):
        return target
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    part = f"{target}.part"
    with urllib.request.urlopen(url) as r, open(part, "wb") as f:
        while block := r.read(step):
            f.write(block)
    os.replace(part, target)
    return target


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(member, content) of the regular files in .tar or .tar.gz archives, one task per archive, a member at
    a time. ``path`` may be a folder or glob on any store that Spark reads."""

    def untar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as t:
                    for m in t:
                        if m.isfile():
                            yield pd.DataFrame({"member": [m.name], "content": [t.extractfile(m).read()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(untar, "member string, content binary")


def extracted_members(spark: SparkSession, folder: str) -> DataFrame:
    """The same from an extracted tree."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_replace("path", r"^\w+:/*", "/").alias("member"), "content")


def corpus_files(members: DataFrame, keep=preprocess.KEEP, demo_extensions=preprocess.DEMO_EXTENSIONS) -> DataFrame:
    """(flat_name, url, doc_type, raw) of the members to keep, with unique flat names in order of member."""
    kind = preprocess.classify(F.col("member"), keep, demo_extensions)
    kept = members.withColumn("__c", kind).where("__c is not null")
    files = kept.select("member", "__c.url", "__c.rel", "__c.doc_type", F.decode("content", "UTF-8").alias("raw"))
    return preprocess.flatten_names(files, "member").select("flat_name", "url", "doc_type", "raw")


def jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), unique: str | None = None) -> DataFrame:
    """JSON lines, blank ones skipped. Malformed lines, missing required fields, repeated keys and an empty
    file raise; a line is named by its text, as line numbers mean nothing in a split file."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    parsed = lines.select("value", F.from_json("value", f"struct<{_typed(schema)},_bad:string>", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    wrong = F.col("r._bad").isNotNull()
    for field in required:
        wrong = wrong | F.col(f"r.{field}").isNull()
    first = parsed.where(wrong).select(F.substring("value", 1, 200).alias("v")).first()
    if first:
        raise ValueError(f"{path}: bad line or missing {', '.join(required)}: {first.v}")
    out = parsed.select("r.*").drop("_bad")
    if out.isEmpty():
        raise ValueError(f"{path} is empty")
    if unique:
        twice = out.groupBy(unique).count().where("count > 1").first()
        if twice:
            raise ValueError(f"{path}: {unique} {twice[0]!r} repeats")
    return out


def _typed(schema: str) -> str:
    """"a int, b array<string>" as the inside of a struct type."""
    out, depth, field = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            field = ""
        else:
            field += c
    return ",".join(out)


def docs(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.DOCS, ("doc_id", "text"))


def docs_by_id(spark: SparkSession, path: str) -> DataFrame:
    """Documents with unique ids: of repeated ones the last in the file stays."""
    return preprocess.last_wins(docs(spark, path).withColumn("__place", F.monotonically_increasing_id()), "doc_id", F.col("__place")).drop("__place")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks in file order: ``ord`` counts them."""
    c = jsonl(spark, path, schemas.CHUNKS, ("chunk_id", "doc_id", "text")).withColumn("__place", F.monotonically_increasing_id())
    from lodestone.operators.bm25 import with_order

    return with_order(c, "__place").drop("__place")


def chunks_by_id(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with unique ids, for lookups: of repeated ones the last in the file stays."""
    return preprocess.last_wins(chunks(spark, path), "chunk_id", F.col("ord"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.QUESTIONS, ("question_id", "question_text"), "question_id")


def answers(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.ANSWERS, ("answer_id", "question_id", "answer_text"))


def demos(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.DEMOS, ("demo_id",), "demo_id")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(flat_name, url, doc_type) of a JSON object keyed by flat name."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<url:string,doc_type:string>>", {"mode": "FAILFAST"}).alias("m"))
    return raw.select(F.explode("m").alias("flat_name", "e")).select("flat_name", "e.url", "e.doc_type")


def path_index(files: DataFrame) -> DataFrame:
    """(url, flat_name), urls normalised; of clashing ones the last by flat_name."""
    n = files.select(preprocess.normal_path(F.col("url")).alias("url"), "flat_name")
    w = W.partitionBy("url").orderBy(F.desc("flat_name"))
    return n.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def review_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; cells may hold line ends and doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
