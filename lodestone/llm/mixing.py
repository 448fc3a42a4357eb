"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, again from the start when a pass is over. A
copy's virtual finish time is the number of its source's words up to and including it, divided by the
source's target. All sources' copies are sorted by their virtual finish times over ranges, and the mix is
what comes before the total budget is spent: at virtual time 1 each source has been served its target but
for the copy in service, and the copies that finish next fill the rest. The one copy at the cut is taken up
to the word that spends the budget.

All running sums work in two steps, sums of small buckets or of sorted ranges first, so no source is one
task's work. Rows that repeat are one row with a count until the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fresh, word_count

#: Hexadecimal digits of the shuffle key that make a bucket.
_DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows, one target per source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all words.
    A target stops at ``most`` times its source's size; what that frees goes to the others by weight until
    none is above. In closed form: target = min(cap, level * weight), the level from the caps sorted by
    cap / weight. Works on a row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    # The level is the first that no later cap undercuts; sources before it are at their caps.
    per = per.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "source", "level")))
    per = per.withColumn("at", fits.over(everything)["level"])
    return per.select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("w"))).alias("target"))


def _placed(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, id_col: str, text_col: str, source_col: str, carry: Sequence[str]) -> DataFrame:
    """One row per distinct (doc_id, source, size, digest, carry) with the ``repeats`` of it, source_size,
    target and served_before: its source's words ahead of the first of them in the shuffled order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    small = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), F.md5(text).alias("digest"), *carry)
    small = cut(small, scan=True)
    goal = cut(targets(small, weights, share, most))
    rows = small.groupBy(*small.columns).agg(F.count("*").alias("repeats"))
    # The text's digest is part of the key, so that rows without an id, or with the same, don't share a bucket.
    rows = rows.withColumn("shuffled", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "digest"))).withColumn("words", F.col("size") * F.col("repeats"))
    rows = cut(rows.withColumn("bucket", F.substring("shuffled", 1, _DIGITS)))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("words").alias("in_bucket"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0))).drop("in_bucket")
    inside = W.partitionBy("source", "bucket").orderBy("shuffled", "size", *carry).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    b, g = buckets.withColumnsRenamed({"source": "source_b", "bucket": "bucket_b"}), goal.withColumnRenamed("source", "source_g")
    rows = rows.join(b, F.col("source").eqNullSafe(F.col("source_b")) & (F.col("bucket") == F.col("bucket_b")))
    rows = rows.join(g, F.col("source").eqNullSafe(F.col("source_g"))).withColumn("served_before", F.col("ahead") + F.col("within"))
    return cut(rows.select("doc_id", "source", "size", "digest", *carry, "repeats", "source_size", "target", "served_before"))


def _queue(rows: DataFrame, share: float, most: float) -> DataFrame:
    """The mix: rows' columns, nth (of the repeats), pass, start, finish, position and taken of the copies of
    which the mix takes words. ``position`` is the number of words before the copy in the whole mix."""
    numbers = rows.agg(F.sum(F.col("size") * F.col("repeats")).alias("all"), F.max(F.when(F.col("target") > 0, F.col("size") / F.col("target"))).alias("longest")).first()
    budget = int((numbers["all"] or 0) * min(share, most))
    passes = max(1, -int(-most // 1))
    each = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)).alias("nth"))
    each = each.withColumn("start", F.col("pass") * F.col("source_size") + F.col("served_before") + F.col("nth") * F.col("size"))
    each = each.withColumn("finish", (F.col("start") + F.col("size")) / F.col("target"))
    # When the copies in service at virtual time 1 are all finished, every source has been served its target:
    # what finishes later comes after the budget.
    each = each.where(F.col("finish") <= 1.0 + (numbers["longest"] or 0.0) + 1e-9)
    order = ["finish", F.col("source").asc_nulls_last(), "start"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written before it is read twice: the ranges' bounds are drawn anew whenever the sort is made again.
    ranged = cut(each.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), scan=True)
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    ranges = ranged.groupBy("range").agg(F.sum("size").alias("in_range")).select("range", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # ranges that begin beyond the budget aren't sorted
    mix = ranged.join(F.broadcast(ranges.where(F.col("ahead") < budget)), "range")
    mix = mix.withColumn("position", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    mix = mix.withColumn("taken", F.least(F.col("size"), F.lit(budget) - F.col("position"))).where("taken > 0")
    return mix.drop("ahead", "range")


def queue(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as a stream: doc_id, source, size, pass, finish, position and taken of its copies; sorted by
    position it is in order of virtual finish times. See ``plan`` for what the parameters and rows mean."""
    rows = _placed(docs, weights, share, most, seed, id_col, text_col, source_col, ())
    return _queue(rows, share, most).select("doc_id", "source", "size", "pass", "finish", "position", "taken")


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, and taken: the words of all its
    copies that come before the queue's budget, the words of ``share`` (at most ``most``) times all sizes.

    A source's taken words differ from its target by less than its longest document at virtual time 1, and by
    its part of what the copies in service there leave to fill. The order is by MD5 of seed, id and text:
    reruns agree. Null text: size 0. Null ids and null sources are values of their own. Rows that repeat have
    a row each; which of them a last copy counts for is arbitrary, as they are equal. A very long text is one
    copy and may be the one at the cut. An empty table: no rows. Other columns are not read.
    """
    rows = _placed(docs, weights, share, most, seed, id_col, text_col, source_col, ())
    own = ["doc_id", "source", "size", "digest", "nth", "source_size", "target"]
    none = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)).alias("nth")).select(*own, F.lit(0).cast("long").alias("taken"))
    taken = _queue(rows, share, most).select(*own, F.col("taken").cast("long"))
    return none.unionByName(taken).groupBy(*own).agg(F.sum("taken").alias("taken")).drop("digest", "nth")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """docs as the mix takes them: a row for each taken copy, the copy at the cut ending with its last taken
    word. Columns of docs stay; n_chars follows the text. Rows that repeat in every column are one row of the
    texts, which their copies share; texts are moved once."""
    key, = fresh(docs, "__key")
    text = F.col(text_col).cast("string")
    others = [c for c in docs.columns if c != text_col]
    whole = F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.md5(text).alias("text")))
    keyed = docs.withColumn(key, F.unhex(F.md5(whole)))
    rows = _placed(keyed, weights, share, most, seed, id_col, text_col, source_col, (key,))
    words, size = fresh(keyed, "__words", "__size")
    stream = cut(_queue(rows, share, most).select(F.col(key), F.col("taken").alias(words), F.col("size").alias(size)))
    twice = cut(rows.where("repeats > 1").select(key).distinct())
    if twice.isEmpty():
        out = keyed.join(stream, key)
    else:
        once = keyed.join(twice, key, "left_anti").unionByName(keyed.join(twice, key, "left_semi").dropDuplicates([key]))
        out = once.join(stream, key)
    whole = F.col(words) >= F.col(size)
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), 1, F.col(words).cast("int")), "")
    out = out.withColumn(text_col, F.when(whole, text).otherwise(first))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)
