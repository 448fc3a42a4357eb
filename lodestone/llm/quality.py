"""Quality rules: counts within the text, and line frequency across documents.

Every line is normalised and hashed; per host the distinct documents that hold it are counted. Lines above
the host's limit (menus, notices, footers) are removed, and documents of which too little is left are
rejected. All of it is DataFrame expressions.

Copies must not count as many documents, or a page that was fetched a thousand times would make boilerplate
of itself. A document is therefore known by the 128-bit digest of its whole normalised text: what differs in
any word is another document, copies are one. The digest is made within the row; a line's documents are
counted in two steps, distinct (host, line, document) first, so a line that a third of all documents hold is
spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import GAP, LOWER, UPPER, cut

_BROADCAST_LINES = 100_000
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP, -1), "")  # the text is read once; trimming first would be two more passes


def repeated_words(w: str) -> Column:
    """Words in three-word windows that occur twice or more in the column of words w.

    Windows are compared by a 64-bit hash. Texts without a repeated window end at the first comparison;
    for others the windows are sorted by hash, those with an equal neighbour are repeated, and the union of
    the three places that each covers is counted from the sorted places.
    """
    ordered = "sort_array(transform(__h, (h, i) -> struct(h as h, i as i)))"
    return F.expr(
        f"""case when size({w}) < 3 or size(array_distinct(__h)) = size(__h) then 0L else
            aggregate(array({ordered}), 0L, (a0, s) -> aggregate(
                sort_array(transform(
                    filter(transform(s, (x, j) -> struct(x.i as i, (x.h <=> get(s, j - 1).h) or (x.h <=> get(s, j + 1).h) as twice)), y -> y.twice),
                    y -> y.i)),
                struct(0L as n, -3 as p),
                (a, i) -> struct(a.n + least(3, i - a.p) as n, i as p),
                a -> a.n)) end"""
    )


def text_counts(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """keep (no column __t, __w or __h), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__t"))
    t = t.withColumn("__w", words(F.col("__t")))
    window = F.expr("case when size(__w) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(__w) - 3), i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))) end")
    t = t.withColumn("__h", window)
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    names = [c for c in t.columns if c not in ("__t", "__w", "__h")]
    return t.select(
        *names,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("__t", f"[{_SYMBOLS}]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words("__w").cast("long").alias("n_repeat_words"),
    )


def normalised(line: Column) -> Column:
    """A-Z lower-cased, digits as 0, white space squeezed. Translating goes by a map of strings, character by
    character, so ASCII lines are lower-cased natively; and few lines have anything to squeeze."""
    ascii_only = F.octet_length(line) == F.length(line)
    low = F.when(ascii_only, F.regexp_replace(F.lower(line), "[1-9]", "0")).otherwise(F.translate(line, UPPER + "123456789", LOWER + "000000000"))
    gaps = reduce(Column.__or__, (F.contains(line, F.lit(g)) for g in ("  ", "\t", "\n", "\v", "\f", "\r")))
    return F.trim(F.when(gaps, F.regexp_replace(low, GAP, " ")).otherwise(low))


def line_hash(normal: Column) -> Column:
    """The first 60 bits of the MD5 of a normalised line."""
    return F.conv(F.substring(F.md5(normal), 1, 15), 16, 10).cast("long")


def document_digest(lines: Column) -> Column:
    """128 bits of the whole normalised text, from its normalised lines with a word: white space of all kinds (line
    ends too) counts as one blank."""
    return F.unhex(F.md5(F.array_join(lines, " ")))


def _lines(docs: DataFrame, text: Column, host: Column) -> DataFrame:
    """(host, doc, hash): the distinct lines with a word of each row."""
    text = F.coalesce(text, F.lit(""))
    held = F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda x: x != "")
    # lines and digest in projections of their own: beside the explode they would be made for each line
    rows = docs.select(host.alias("host"), held.alias("held"))
    rows = rows.select("host", document_digest(F.col("held")).alias("doc"), F.array_distinct(F.transform("held", line_hash)).alias("own"))
    return rows.select("host", "doc", F.explode("own").alias("hash"))


def frequent_lines(lines: DataFrame, least: int = 10, part: float = 0.02) -> DataFrame:
    """(host, hash, documents) of the lines above their host's limit: ``least`` distinct documents or
    ``part`` of the host's, whichever is more. Only documents with a line count, all copies as one."""
    per = lines.distinct().groupBy("host", "hash").agg(F.count("*").alias("documents")).where(F.col("documents") > least)
    size = lines.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("all"))
    size = size.select(F.col("host").alias("__host"), "all")
    over = per.join(size, F.col("host").eqNullSafe(F.col("__host")))
    return over.where(F.col("documents") > F.greatest(F.lit(float(least)), F.col("all") * F.lit(float(part)))).select("host", "hash", "documents")


#: Frequent hashes that a bucket of a host's list holds on average: what each line is compared with.
_BUCKET = 8


def _by_host(frequent: DataFrame) -> DataFrame:
    """(host, over): per host its frequent lines' hashes, dealt into an array of short lists by their value, so
    that a line is looked up in one of these."""
    lists = frequent.groupBy("host").agg(F.ceil(F.count("*") / F.lit(_BUCKET)).cast("int").alias("size"))
    named = lists.select(F.col("host").alias("__h"), "size")
    at = F.pmod("hash", F.col("size")).cast("int").alias("at")
    dealt = frequent.join(named, F.col("host").eqNullSafe(F.col("__h"))).select("host", at, F.array("hash").alias("one"))
    empty = lists.select("host", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"), F.expr("cast(array() as array<bigint>)").alias("one"))
    buckets = dealt.unionByName(empty).groupBy("host", "at").agg(F.flatten(F.collect_list("one")).alias("hashes"))
    return buckets.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "hashes"))), lambda b: b["hashes"]).alias("over"))


def _judged(docs: DataFrame, text: Column, host: Column, keep: list[Column], least: int, part: float, left: float) -> DataFrame:
    """keep, the columns of ``text_counts``, __gone, frequent_words, base_failed and kept. __gone has a boolean
    per line, true for those that go, and is null where none of the host's are frequent. keep must not hold
    names with two leading underscores but __row."""
    frequent = cut(frequent_lines(cut(_lines(docs, text, host), scan=True), least, part))
    whole = docs.select(*keep, text.alias("__text"), host.alias("__of"))
    if frequent.count() <= _BROADCAST_LINES:
        flagged = _flag_within_rows(whole, F.broadcast(_by_host(frequent)))
    else:
        flagged = _flag_by_join(whole, frequent)
    names = [c for c in flagged.columns if c not in ("__text", "__gone")]
    counts = text_counts(flagged, F.col("__text"), [*map(F.col, names), F.col("__text"), F.col("__gone")])
    # words are counted only in lines that go
    parts = F.arrays_zip(F.split(F.coalesce("__text", F.lit("")), "\n", -1).alias("line"), F.col("__gone").alias("gone"))
    gone = F.aggregate(F.filter(parts, lambda p: p["gone"]), F.lit(0), lambda a, p: a + F.size(words(p["line"])))
    out = counts.withColumn("frequent_words", F.coalesce(F.when(F.col("__gone").isNotNull(), gone), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("frequent_words")) < F.lit(float(left)) * F.col("n_words")
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})


def _hash_or_null(line: Column) -> Column:
    """The hash of a line with a word, null for others."""
    return F.when(line.rlike(r"[^\x20\x09-\x0D]"), line_hash(normalised(line)))


def _flag_within_rows(whole: DataFrame, per_host: DataFrame) -> DataFrame:
    per = per_host.select(F.col("host").alias("__host"), F.col("over").alias("__over"))
    whole = whole.join(per, F.col("__of").eqNullSafe(F.col("__host")), "left").drop("__of", "__host")
    # hosts without frequent lines keep all of theirs unread
    hashes = F.transform(F.split(F.coalesce("__text", F.lit("")), "\n", -1), _hash_or_null)
    gone = F.transform(hashes, lambda h: F.coalesce(F.array_contains(F.get(F.col("__over"), F.pmod(h, F.size("__over")).cast("int")), h), F.lit(False)))
    return whole.withColumn("__gone", F.when(F.col("__over").isNotNull(), gone)).drop("__over")


def _flag_by_join(whole: DataFrame, frequent: DataFrame) -> DataFrame:
    """The same beyond the broadcast: lines are joined with the frequent ones, and each distinct (host, text)
    of the rows meets the numbers of its lines that go."""
    key = F.unhex(F.md5(F.concat(F.when(F.col("__of").isNull(), "0").otherwise(F.concat(F.lit("1"), F.md5("__of"))), F.coalesce("__text", F.lit("")))))
    keyed = whole.withColumn("__key", key)
    held = keyed.select("__key", F.col("__of").alias("__host"), F.posexplode(F.split(F.coalesce("__text", F.lit("")), "\n", -1)).alias("at", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    held = held.select("__key", "__host", "at", line_hash(normalised(F.col("line"))).alias("__hash"))
    over = held.join(frequent.select("host", "hash"), (F.col("__hash") == F.col("hash")) & F.col("__host").eqNullSafe(F.col("host")), "left_semi")
    removed = cut(over.groupBy("__key").agg(F.collect_set("at").alias("__at")))
    out = keyed.join(removed, "__key", "left")
    gone = F.transform(F.split(F.coalesce("__text", F.lit("")), "\n", -1), lambda _, i: F.array_contains("__at", i))
    return out.withColumn("__gone", F.when(F.col("__at").isNotNull(), gone)).drop("__key", "__of", "__at")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = 10, part: float = 0.02, left: float = 0.2) -> DataFrame:
    """Per row of docs its id, the counts of ``text_counts``, frequent_words, base_failed and kept.

    base_failed: under 50 words, or over half of them in repeated windows. Rejected are these and documents
    of which less than the part ``left`` of the words remains when frequent lines go. Null text counts as
    empty (and fails). Null hosts are one host, rows that repeat one document with a row each in the result,
    null ids are ids; an empty table gives an empty one. Very long texts are whole rows and arrays of their
    lines and words: a task's memory must hold a few times its longest text. Other columns are not read.
    """
    text, host = F.col(text_col).cast("string"), F.col(host_col).cast("string")
    out = _judged(docs, text, host, [F.col(id_col).alias("id")], least, part, left)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "frequent_words", "base_failed", "kept")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars", least: int = 10, part: float = 0.02, left: float = 0.2) -> DataFrame:
    """The kept rows of docs without their frequent lines. n_chars, if there, follows the text; other
    columns stay as they are, whatever their names.

    Where the frequent lines are few enough to be broadcast, each host's in one array, a document is judged
    and cut within its row, and texts aren't shuffled.
    """
    text, host = F.col(text_col).cast("string"), F.col(host_col).cast("string")
    judged = _judged(docs, text, host, [F.struct(*docs.columns).alias("__row")], least, part, left)
    parts = F.arrays_zip(F.split("__text", "\n", -1).alias("line"), F.col("__gone").alias("gone"))
    rest = F.array_join(F.transform(F.filter(parts, lambda p: ~p["gone"]), lambda p: p["line"]), "\n")
    # A rejected document explodes to nothing. As a filter this would be pushed below the counts and repeat them.
    one = F.array(F.struct(F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(rest).alias("text")))
    kept = F.when(F.col("kept"), one).otherwise(F.expr("cast(array() as array<struct<text:string>>)"))
    out = judged.select("__row", F.explode(kept).alias("__kept")).select(*(F.col("__kept.text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)
