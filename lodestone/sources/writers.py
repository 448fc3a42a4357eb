"""Writers. Large tables go out in parallel; only reports, a few rows, are written by the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import retrieval_metrics, review


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, UTF-8, nulls left out of the lines as Spark does unless told otherwise."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def csv(df: DataFrame, path: str) -> None:
    """A folder of CSV with a header, quotes doubled; no rows raise."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    flat(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def manifest(files: DataFrame, path: str) -> None:
    """One JSON object, keys in order: the manifest has a row per file and is written by the driver."""
    rows = files.select("flat_name", "url", "doc_type").orderBy("flat_name").collect()
    with open(path, "w", encoding="utf-8") as f:
        json.dump({r.flat_name: {"url": r.url, "doc_type": r.doc_type} for r in rows}, f, indent=2, ensure_ascii=False)


def retrieval_report(evaluated: DataFrame, path: str) -> DataFrame:
    """Per-question metrics with a MEAN row, as CSV. Returns what was written."""
    out = flat(evaluated.withColumn("query_id", F.col("query_id").cast("string")))
    mean = retrieval_metrics.macro(evaluated).select(F.lit("MEAN").alias("query_id"), *retrieval_metrics.METRICS)
    both = out.unionByName(mean, allowMissingColumns=True)
    csv(both.coalesce(1), path)
    return both


def metrics_json(evaluated: DataFrame, path: str) -> None:
    """Means and per-question metrics as one JSON object: a row per test question, written by the driver."""
    questions = [json.loads(r.j) for r in evaluated.orderBy("query_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"aggregate": retrieval_metrics.macro(evaluated).first().asDict(), "questions": questions}, f, indent=2, ensure_ascii=False)


def text(spark: SparkSession, content: str, path: str) -> None:
    """A report as a folder with one text file, on any store that Spark writes."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def rows_json(rows: DataFrame, *order: str) -> list[dict]:
    """A report's few rows as objects, nulls kept."""
    return [json.loads(r.j) for r in rows.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def diagnostic_report(rows: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(review.markdown(rows))


def console(metrics: DataFrame) -> str:
    """The metrics' means as text."""
    m = retrieval_metrics.macro(metrics).first()
    return "\n".join([f"queries: {m.queries}", *(f"{n}: {m[n]:.4f}" for n in retrieval_metrics.METRICS)])
