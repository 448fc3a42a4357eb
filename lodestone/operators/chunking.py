"""Chunks with exact character offsets: sections by headings, pairs of sections, windows of tokens.

Documents are (doc_id, text, metadata). Everything is done within a document's row with array expressions,
or on rows that carry doc_id, so only numbering chunks shuffles anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T

MAX_TOKENS, OVERLAP = 500, 100


def sections(text: Column) -> Column:
    """array<struct<level, heading, start, end>> in document order. Without a heading one section
    "Document" of level 0; text before the first heading, unless blank, is the section "Introduction"."""
    gaps, found = F.split(text, T.HEADING, -1), T.all_matches(text, T.HEADING, 0)
    marks, titles = T.all_matches(text, T.HEADING, 1), T.all_matches(text, T.HEADING, 2)
    size = F.length(text)
    # An array of one makes the matches variables; as expressions they would be made anew for each section.
    once = F.array(F.struct(T.offsets(gaps, found).alias("starts"), marks.alias("marks"), titles.alias("titles"), F.get(gaps, F.lit(0)).alias("lead"), size.alias("size")))

    def alone(heading, end):
        return F.array(F.struct(F.lit(0).alias("level"), F.lit(heading).alias("heading"), F.lit(0).alias("start"), end.alias("end")))

    def whole(m):
        def one(start, i):
            end = F.coalesce(F.get(m["starts"], i + 1), m["size"])
            return F.struct(F.length(F.get(m["marks"], i)).alias("level"), F.get(m["titles"], i).alias("heading"), start.alias("start"), end.alias("end"))

        preface = F.when(T.is_blank(m["lead"]), F.slice(alone("Introduction", m["size"]), 2, 0)).otherwise(alone("Introduction", F.get(m["starts"], F.lit(0))))
        return F.when(F.size(m["starts"]) == 0, alone("Document", m["size"])).otherwise(F.concat(preface, F.transform(m["starts"], one)))

    return F.get(F.transform(once, whole), F.lit(0))


def token_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tok, start, end) of the texts' tokens: running sums of the lengths of token and space before it."""
    pieces = docs.select(key, F.posexplode_outer(T.all_matches(F.col("text"), r"(?U)\s*\S+", 0)).alias("tok", "p")).where("p is not null")
    end = F.sum(F.length("p")).over(W.partitionBy(key).orderBy("tok"))
    token = F.length(F.regexp_replace("p", r"^(?U)\s+", ""))
    return pieces.select(key, "tok", end.cast("int").alias("end"), token.alias("n")).select(key, "tok", (F.col("end") - F.col("n")).alias("start"), "end")


def split_spans(doc_spans: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Rows (.., text, char_start, char_end) with one row per part: part, parts, char_start, char_end and
    the part's ``body``. A span of at most max_tokens stays whole, blanks included; a longer one becomes
    windows of max_tokens that overlap, each from its first token's start to its last token's end."""
    if overlap >= max_tokens:
        raise ValueError("overlap must be smaller than max_tokens")
    stride = max_tokens - overlap
    keep = [c for c in doc_spans.columns if c not in ("text", "char_start", "char_end")]
    body = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    s = doc_spans.select(*keep, "char_start", "char_end", body.alias("body"))
    s = s.withColumn("__pieces", T.all_matches(F.col("body"), r"(?U)\s*\S+", 0)).withColumn("__n", F.size("__pieces"))
    parts = F.when(F.col("__n") <= max_tokens, F.lit(1)).otherwise(F.ceil((F.col("__n") - max_tokens) / F.lit(stride)).cast("int") + 1)
    s = s.withColumn("parts", parts)
    # lengths summed to the window's first token and over the window: a window is a slice of the pieces
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    total = lambda xs: F.length(F.array_join(xs, ""))
    first = F.col("part") * stride
    lead = F.when(F.col("part") == 0, 0).otherwise(total(F.slice("__pieces", 1, first)))
    window = F.slice("__pieces", first + 1, max_tokens)
    s = s.withColumn("__lead", lead).withColumn("__text", F.array_join(window, ""))
    indent = F.length("__text") - F.length(F.regexp_replace("__text", r"^(?U)\s+", ""))
    whole = F.col("parts") == 1
    start = F.when(whole, F.col("char_start")).otherwise(F.col("char_start") + F.col("__lead") + indent)
    end = F.when(whole, F.col("char_end")).otherwise(F.col("char_start") + F.col("__lead") + F.length("__text"))
    out = F.when(whole, F.col("body")).otherwise(F.regexp_replace("__text", r"^(?U)\s+", ""))
    return s.select(*keep, "part", "parts", start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), out.alias("body"))


def heading_only(text: Column) -> Column:
    """Nothing but headings and white space."""
    return T.is_blank(F.regexp_replace(text, T.HEADING_LINE, ""))


def section_pairs(docs: DataFrame) -> DataFrame:
    """(doc columns, chunk_index, headings, char_start, char_end): each section with the next one, stride
    one; a lone section alone. Spans with nothing but headings are left out and take no number."""
    # held as a column of its own, else the projections below would be merged and find the sections per section
    s = docs.withColumn("__s", F.explode(F.array(sections(F.col("text")))))
    n = F.size("__s")

    def pair(x, i):
        nxt = F.get(F.col("__s"), i + 1)
        return F.struct(F.when(n == 1, F.array(x["heading"])).otherwise(F.array(x["heading"], nxt["heading"])).alias("headings"), x["start"].alias("char_start"), F.when(n == 1, x["end"]).otherwise(nxt["end"]).alias("char_end"))

    pairs = F.slice(F.transform("__s", pair), 1, F.greatest(F.lit(1), n - 1))
    full = F.filter(pairs, lambda p: ~heading_only(F.substring(F.col("text"), p["char_start"] + 1, p["char_end"] - p["char_start"])))
    out = s.select(*docs.columns, F.posexplode_outer(full).alias("__i", "__p")).where("__p is not null")
    return out.select(*docs.columns, (F.col("__i") + 1).alias("chunk_index"), "__p.headings", "__p.char_start", "__p.char_end")


def chunk_id(doc_id: Column, index: Column, part: Column, parts: Column) -> Column:
    return F.when(parts > 1, F.format_string("%s__chunk_%04d__part_%03d", doc_id, index, part)).otherwise(F.format_string("%s__chunk_%04d", doc_id, index))


def claim_demos(chunks: DataFrame, markers: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_id, char_start, char_end, ..) with demo_refs: the distinct demos of markers
    (doc_id, pos, demo_id) at a position in [char_start, char_end), by position. A range condition on top
    of an equi-join by document; a marker at a document's very end belongs to no chunk."""
    hit = chunks.select("doc_id", "chunk_id", "char_start", "char_end").join(markers, "doc_id").where((F.col("pos") >= F.col("char_start")) & (F.col("pos") < F.col("char_end")))
    first = hit.groupBy("chunk_id", "demo_id").agg(F.min(F.struct("pos", "demo_id")).alias("m"))
    refs = first.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["demo_id"]).alias("demo_refs"))
    return chunks.join(refs, "chunk_id", "left").withColumn("demo_refs", F.coalesce("demo_refs", T.empty_array()))


def _demos_between(markers: Column, start: Column, end: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(markers, lambda m: (m["pos"] >= start) & (m["pos"] < end)), lambda m: m["demo_id"]))


def chunk_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks (see schemas.CHUNKS) of docs (doc_id, text, metadata).

    Prose is cut into section pairs and those into token windows; an API document is one chunk. Blank
    documents have none. Texts are normalised first and demo markers taken out afterwards; a chunk's text is
    normalised once more while its offsets refer to the document's text without markers.
    """
    d = docs.select("doc_id", "metadata", T.normalize(F.col("text")).alias("__raw"))
    d = d.select("doc_id", "metadata", T.marker_positions(F.col("__raw")).alias("__markers"), T.without_markers(F.col("__raw")).alias("text")).where(~T.is_blank(F.col("text")))
    is_api = F.coalesce(F.col("metadata.doc_type") == "api", F.lit(False))
    prose = split_spans(section_pairs(d.where(~is_api)), max_tokens, overlap)
    title = F.coalesce(F.nullif(F.col("metadata.component"), F.lit("")), F.nullif(F.col("metadata.title"), F.lit("")), F.lit("API reference"))
    api = d.where(is_api).select("doc_id", "metadata", "__markers", F.lit(1).alias("chunk_index"), F.array(title).alias("headings"), F.lit(0).alias("part"), F.lit(1).alias("parts"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.col("text").alias("body"))
    all_ = prose.select(api.columns).unionByName(api)
    split = F.when(F.col("parts") > 1, F.col("part") + 1)
    text = T.normalize(F.col("body"))
    m = F.col("metadata")
    meta = F.struct(
        m["title"].alias("title"), m["component"].alias("component"), m["url"].alias("url"), m["doc_type"].alias("doc_type"),
        F.col("headings"), _demos_between(F.col("__markers"), F.col("char_start"), F.col("char_end")).alias("demo_refs"),
        F.col("chunk_index").cast("int").alias("chunk_index"), split.cast("int").alias("split_index"),
    )
    return all_.select(chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("part") + 1, F.col("parts")).alias("chunk_id"), "doc_id", text.alias("text"), meta.alias("metadata"), T.token_count(text).cast("int").alias("token_count"), "char_start", "char_end")


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with ``ord``, the place in the corpus: by document, then chunk, then part. Documents are given
    places by running sums of their numbers of chunks, in two steps; chunks meet their document's place in one
    shuffle by doc_id."""
    from lodestone.operators.bm25 import with_order

    per = chunks.groupBy("doc_id").agg(F.count("*").alias("__n"))
    placed = with_order(per, "doc_id").withColumn("__bucket", F.expr("ord div 4096"))
    inside = W.partitionBy("__bucket").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("__bucket").agg(F.sum("__n").alias("__t"))
    before = totals.select("__bucket", F.coalesce(F.sum("__t").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    start = placed.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(before, "__bucket").select("doc_id", (F.col("__before") + F.col("__in")).alias("__start"))
    within = W.partitionBy("doc_id").orderBy("metadata.chunk_index", F.coalesce("metadata.split_index", F.lit(0)))
    return chunks.join(start, "doc_id").withColumn("ord", F.col("__start") + F.row_number().over(within) - 1).drop("__start")


def violations(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(problem, chunk_id) of duplicate ids, blank texts, missing documents, oversized prose and bad spans."""
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("problem"), "chunk_id")
    checks = {
        "blank": T.is_blank(F.col("text")),
        "no document": F.coalesce(F.col("doc_id"), F.lit("")) == "",
        "oversized": (F.col("metadata.doc_type") == "prose") & (F.col("token_count") > max_tokens),
        "bad span": F.coalesce(F.col("char_end") <= F.col("char_start"), F.lit(True)),
    }
    each = F.array(*(F.when(c, F.lit(name)) for name, c in checks.items()))
    rows = chunks.select(F.explode(F.array_compact(each)).alias("problem"), "chunk_id")
    return twice.unionByName(rows)


def validate(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """chunks, or a ValueError that names the first ten of each kind of problem."""
    bad = violations(chunks, max_tokens)
    first = bad.withColumn("i", F.row_number().over(W.partitionBy("problem").orderBy("chunk_id"))).where("i <= 10")
    found = first.groupBy("problem").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids")).orderBy("problem").collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {', '.join(map(str, r.ids))}" for r in found))
    return chunks


def statistics(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row: chunks, prose and api chunks, split parts, oversized api chunks, token counts."""
    kind, n = F.col("metadata.doc_type"), F.col("token_count")
    return chunks.agg(
        F.count("*").cast("bigint").alias("chunks"), F.count_if(kind == "prose").alias("prose"), F.count_if(kind == "api").alias("api"),
        F.count_if(F.col("metadata.split_index").isNotNull()).alias("split_parts"), F.count_if((kind == "api") & (n > max_tokens)).alias("oversized_api"),
        F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(n).alias("avg_tokens"),
    )
