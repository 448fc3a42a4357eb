import time

from pyspark.sql import functions as F

from lodestone.tables import _CLEANUP, cut


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for f in files.mkString("\n").split("\n") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    was, before = spark.conf.get(_CLEANUP, None), shuffled(spark)
    # the frame is held, so no garbage collection can have removed its shuffles
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    joined = counted.join(counted.withColumnRenamed("count", "n").hint("merge"), "k")
    out = cut(joined)
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert sorted((r.k, r.n) for r in out.collect()) == sorted((r.k, r.n) for r in joined.collect())
    assert spark.conf.get(_CLEANUP, None) == was
