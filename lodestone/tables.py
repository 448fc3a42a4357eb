"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_ROW_GROUP = 32 << 20  # bytes that a task's writer and reader hold at a time
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, scan: bool = False) -> DataFrame:
    """Cut the lineage: written as Parquet into spark.checkpoint.dir, which every executor can read, and
    read again. A folder of our own is used only in local mode, where the session names none (tests, notebooks).

    What comes out of a shuffle is written by two tasks for each core at most, not as a file for each shuffle
    partition; with ``scan``, each task of the scan that made it writes its own file. The shuffles behind the table
    go when it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        (df if scan else df.coalesce(2 * spark.sparkContext.defaultParallelism)).write.option("parquet.block.size", _ROW_GROUP).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile are deleted as it ends. Otherwise they stay until the driver happens to
    collect its garbage, and the disk holds those of several joins at once."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a folder of our own in local mode, where all tasks share the machine, and
    an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
