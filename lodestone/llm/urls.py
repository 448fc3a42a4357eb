"""URL filters: a blocked Bloom filter before an exact hash join.

The list holds host-and-path rules and single canonical URLs. Every URL is turned into the canonical
strings that could be listed for it; the Bloom filter, one 512-bit block of eight words to each string,
passes possible hits only; the exact join removes its false positives. URLs are judged once however often
they occur; only the join of the verdicts back to the rows sees a hot URL's rows, and null ones aren't joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, cut, fresh

#: Bits of the filter for each listed string, and the multipliers that pick a bit in each of the eight words.
_BITS = 16
_ODD = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
#: A block has nine longs: 65,536 of them are under 5 MB in a broadcast. Larger filters are joined by shuffle.
_BROADCAST_BLOCKS = 1 << 16
_BROADCAST_LISTED = 1 << 15


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """The form in which single URLs are listed: host and path, without slashes at the end."""
    return F.regexp_replace(F.concat(host(url), path(url)), r"/+\z", "")


def rules(spark, listed: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a list. Each is a row (kind, text, verdict, rule, host_len, path_len)."""
    rows = [("rule", f"{h}\n{p}", v, h + p, len(h), len(p)) for h, p, v in listed]
    return spark.createDataFrame(rows, "kind string, text string, verdict string, rule string, host_len int, path_len int")


def blocked(urls: DataFrame, url_col: str) -> DataFrame:
    """Single URLs to block as a list; null ones are not listed."""
    one = urls.where(F.col(url_col).isNotNull()).select(canonical(F.col(url_col)).alias("text")).where("text <> ''").distinct()
    return one.select(F.lit("url").alias("kind"), "text", F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("host_len"), F.lit(0).alias("path_len"))


def _bits(text: Column) -> list[Column]:
    """The bit in each of a block's eight words, from the low 30 bits of a second hash."""
    h = F.xxhash64(text, F.lit(1)).bitwiseAND(F.lit(0x3FFFFFFF))
    return [F.shiftright((h * F.lit(m)).bitwiseAND(F.lit(0xFFFFFFFF)), 26).cast("int") for m in _ODD]


def _block(text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: a row (block, w0 .. w7) per block that is in use. Built with partial ORs."""
    one = [F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(8)]
    return listed.select(_block(F.col("text"), blocks).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("text"))))).groupBy("block").agg(*one)


def possible(candidates: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """Rows of candidates (with a column text) that the filter passes."""
    probe = candidates.withColumns({"block": _block(F.col("text"), blocks)} | {f"b{i}": b for i, b in enumerate(_bits(F.col("text")))})
    table = F.broadcast(filter_) if blocks <= _BROADCAST_BLOCKS else filter_
    hit = probe.join(table, "block")
    for i in range(8):
        hit = hit.where(F.expr(f"(shiftright(w{i}, b{i}) & 1L) = 1L"))
    return hit.select(*candidates.columns)


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict added (under other names if pages has them already: see
    ``fresh``). listed: the union of ``rules`` and ``blocked``.

    A rule fits its host and all subdomains if the path starts with its path; the longest fitting rule
    decides. Very long URLs and hosts of very many labels are judged like others, by their last labels. Without
    one, a listed URL is blocked and any other allowed. Null and malformed URLs have an
    empty host and path and are allowed. A rule or URL may be listed repeatedly; of rules of equal length
    the block goes first. An empty list allows all; empty pages give an empty result.
    """
    listed = cut(listed.distinct())
    facts = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.when(F.col("kind") == "rule", F.col("path_len")))).alias("lens"),
                       F.max(F.when(F.col("kind") == "rule", F.size(F.split(F.split_part("text", F.lit("\n"), F.lit(1)), "[.]")))).alias("labels")).first()
    blocks = max(1, -(-facts.n * _BITS // 512))
    url, h, p = F.col("__url"), F.col("__host"), F.col("__path")
    distinct = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("__url")).distinct()
    distinct = distinct.withColumns({"__host": host(url), "__path": path(url)})
    lens = F.array(*(F.lit(n) for n in facts.lens)) if facts.lens else F.expr("cast(array() as array<int>)")
    # suffixes of no more labels than a rule has: a hostile host of very many labels makes no more of them
    suffixes = F.expr(f"transform(array(struct(split(__host, '[.]') as p)), x -> transform(sequence(1, least(size(x.p), {facts.labels or 1})), n -> concat_ws('.', slice(x.p, size(x.p) - n + 1, n))))[0]")
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(lens, lambda n: n <= F.length(p)), lambda n: F.concat(s, F.lit("\n"), F.substring(p, F.lit(1), n)))))
    texts = F.array_distinct(F.concat(F.array(canonical(url)), F.when(h == "", F.expr("cast(array() as array<string>)")).otherwise(pairs)))
    candidates = distinct.select("__url", F.explode(texts).alias("text"))
    passed = possible(candidates, bloom(listed, blocks), blocks)
    exact = F.broadcast(listed) if facts.n <= _BROADCAST_LISTED else listed
    hits = passed.join(exact, "text")
    best = F.max(F.struct((F.col("kind") == "rule").alias("is_rule"), (F.col("host_len") + F.col("path_len")).alias("long"), "host_len", "verdict", "rule"))
    judged = hits.groupBy("__url").agg(best.alias("best")).select("__url", F.col("best.rule").alias("__rule"), F.col("best.verdict").alias("__verdict"))
    names = fresh(pages, "host", "path", "rule", "verdict")
    own = fresh(pages, "__url", "__rule", "__verdict")
    given = pages.where(F.col(url_col).isNotNull()).join(judged.toDF(*own), F.col(url_col) == F.col(own[0]), "left")
    none = pages.where(F.col(url_col).isNull()).select("*", *(F.lit(None).cast("string").alias(c) for c in own))
    out = given.unionByName(none)
    return out.select(*pages.columns, host(F.col(url_col)).alias(names[0]), path(F.col(url_col)).alias(names[1]), F.col(own[1]).alias(names[2]), F.coalesce(F.col(own[2]), F.lit("allow")).alias(names[3]))
