"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import cut, shared_folder

__all__ = ["GAP", "LOWER", "UPPER", "WORD", "cut", "fresh", "row_key", "shared_folder", "table", "word_count"]

#: A word is a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_: Column, text: Column) -> Column:
    """128 bits of a row's id and text, null unlike anything else: stands for the row in joins."""
    marked = lambda c: F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.md5(c.cast("string"))))
    return F.unhex(F.md5(F.concat(marked(id_), marked(text))))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null or empty text."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{GAP}|{GAP}\z", "")
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, GAP, -1))).cast("long")
