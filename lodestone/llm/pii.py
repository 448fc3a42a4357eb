"""Personal data: patterns, and terms that give protected entities away.

The patterns find the protected entities themselves. A term that stands near an entity (within ``reach``)
discloses it if the corpus shows that seeing the term tells the entity. With P(entity | term) estimated as
(n_both + a P(entity)) / (n_term + a), where n_both counts the distinct texts that show the two near each
other, n_term those that hold the term anywhere, and ``a`` = ``prior`` texts' worth of doubt:

* what the term leaves open, -log2 P(entity | term), is at most ``open_bits``, and
* what it tells, log2(P(entity | term) / P(entity)), is at least the part ``share`` of the entity's own
  information -log2 P(entity).

Both are relative to the entity, so they mean the same at every size of corpus, for an entity in one text and
for one in a third of all. Every occurrence of a disclosing term is marked, in all texts, with or without the
entity in them. Entities and merely telling terms are generalised to their kind; terms that all but determine
the entity (P at least ``removed``) are removed. All DataFrame expressions.

Copies of a text are one text for all these counts. The first of the rows with a text counts for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fresh, row_key

#: In the order of the kinds. The e-mail and IP patterns start at the start of a run of their first class
#: (or where the last match ended): a match that starts within a run would have started at its start. That
#: and the possessive quantifiers, after which nothing could be given back, keep long runs linear. A card
#: number needs 14 digits at least, so shorter runs, which would be dropped, aren't matched at all.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
TERM = len(KINDS)
_TOKEN = r"[\p{L}\p{M}\p{N}_]+"
_BROADCAST_TERMS = 50_000


def matches(text: Column, pattern: str, kind: int, when: Column | None = None, keep=None) -> Column:
    """array<struct<start, kind, end, value>> of the pattern's matches, or of those whose value ``keep`` is true for;
    offsets in code points. Matches that aren't kept cost no more than their length: the array is copied for
    each that is."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        more = F.array_append(a["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), (more if keep is None else F.when(keep(x["value"]), more).otherwise(a["out"])).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    return spans if when is None else F.when(when, spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All pattern matches that hold, by start, then kind."""
    digits = text.rlike("[0-9]")
    email = matches(text, PATTERNS[0], 0, F.contains(text, F.lit("@")))

    def octet(p):
        bare = F.ltrim(p, F.lit("0"))
        return F.when(F.length(bare) <= 3, F.concat(F.lit("0"), bare).cast("int") <= 255).otherwise(False)

    ip = F.filter(matches(text, PATTERNS[1], 1, digits & F.contains(text, F.lit("."))), lambda x: F.forall(F.split(x["value"], r"\."), octet))

    def card(x):
        d = F.regexp_replace(x["value"], "[ -]", "")
        return F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(False)

    cards = F.filter(matches(text, PATTERNS[2], 2, digits), card)
    phones = F.filter(matches(text, PATTERNS[3], 3, digits & F.contains(text, F.lit("+"))), lambda x: F.length(F.regexp_replace(x["value"], "[^0-9]", "")).between(10, 15))
    return F.sort_array(F.concat(email, ip, cards, phones))


def _is(kind: int):
    return lambda x: x["kind"] == kind


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, (*KINDS, "term"))), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _contexts(found: DataFrame, reach: int) -> DataFrame:
    """Distinct (entity, term, text): tokens within ``reach`` code points of an entity, whole tokens only and
    none that a pattern has matched; text is the text's digest. found: text, spans."""
    e = found.select(_digest(F.col("text")).alias("digest"), "text", "spans").select("digest", "text", "spans", F.explode("spans").alias("e"))
    e = e.select("digest", "text", "spans", _entity(F.col("e")).alias("entity"), "e.start", "e.end")
    low = F.greatest(F.lit(0), F.col("start") - reach)
    left = F.substring("text", low + 1, F.col("start") - low)
    right = F.substring("text", F.col("end") + 1, F.lit(reach))
    tokens = F.concat(
        F.transform(matches(left, _TOKEN, TERM), lambda x: F.struct((x["start"] + low).alias("start"), (x["end"] + low).alias("end"), x["value"].alias("value"), ((x["start"] == 0) & (low > 0)).alias("cut"))),
        F.transform(matches(right, _TOKEN, TERM), lambda x: F.struct((x["start"] + F.col("end")).alias("start"), (x["end"] + F.col("end")).alias("end"), x["value"].alias("value"), ((x["end"] == reach) & (F.length("text") > F.col("end") + reach)).alias("cut"))),
    )
    whole = F.filter(tokens, lambda t: ~t["cut"] & ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    terms = F.array_distinct(F.transform(whole, lambda t: F.lower(t["value"])))
    return e.select("digest", "entity", F.explode(terms).alias("term")).select("entity", "term", F.col("digest").alias("text")).distinct()


def _entity(span: Column) -> Column:
    """128 bits of the kind and the lower-cased value."""
    return F.unhex(F.md5(F.concat_ws(":", span["kind"].cast("string"), F.lower(span["value"]))))


def _posterior(n_both: Column, n_term: Column, p_entity: Column, prior: float) -> Column:
    return (n_both + F.lit(float(prior)) * p_entity) / (n_term + F.lit(float(prior)))


def _firsts(docs: DataFrame, key: Column, text: Column) -> tuple[DataFrame, DataFrame]:
    """(copied, numbers): for each text that several rows have (digest, first, rows): the smallest key of these
    and how many rows have that one; and one row (n) with the number of distinct texts."""
    per = docs.select(_digest(text).alias("digest"), key.alias("key")).groupBy("digest", "key").agg(F.count("*").alias("rows"))
    per = cut(per.groupBy("digest").agg(F.min(F.struct("key", "rows")).alias("first"), F.sum("rows").alias("all")))
    copied = per.where("all > 1").select("digest", F.col("first.key").alias("first"), F.col("first.rows").alias("rows"))
    return copied, per.agg(F.count("*").alias("n"))


def telling_terms(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, reach: int, open_bits: float, share: float, prior: float) -> DataFrame:
    """(text, term, p): the digests of the texts that hold a term above the thresholds, and p, the greatest
    P(entity | term) of an entity that it discloses. found: (text, spans) of the rows with an entity.

    Terms are counted by partial sums, so what is shuffled is the vocabulary, not the tokens. A term is in at
    least as many texts as it is near an entity in, which leaves few of the common words to be counted for; one
    that is in no more is in known texts. Only the others are looked up in all texts.
    """
    least = F.lit(2.0 ** -open_bits)

    def above(p: Column) -> Column:
        return (p >= least) & (p >= F.pow(F.col("p_entity"), F.lit(1.0 - share)))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)))
    key = row_key(F.col(id_col), text)
    copied, numbers = _firsts(docs, key, text)
    numbers = F.broadcast(numbers)
    contexts = cut(_contexts(found, reach))
    n_entity = found.select(_digest(F.col("text")).alias("text"), F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    both = contexts.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    near = contexts.select("term", "text").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = both.join(near, "term").join(n_entity, "entity").crossJoin(numbers).withColumn("p_entity", F.col("n_entity") / F.col("n"))
    pairs = cut(pairs.where(above(_posterior(F.col("n_both"), F.col("n_near"), F.col("p_entity"), prior))).select("term", "n_both", "n_near", "p_entity"))
    wanted = cut(pairs.select("term").distinct())
    # A copied text counts once: by its first key's rows, each for its part of one.
    few = copied.count() <= _BROADCAST_TERMS
    known = docs.select(key.alias("key"), _digest(text).alias("digest"), text.alias("text")).join(F.broadcast(copied) if few else copied, "digest", "left")
    part = F.when(F.col("first").isNull(), F.lit(1.0)).when(F.col("key") == F.col("first"), F.lit(1.0) / F.col("rows")).otherwise(F.lit(0.0))
    once = known.select(part.alias("part"), "text").where("part > 0")
    counted = once.select("part", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0)))).alias("term"))
    if wanted.count() <= _BROADCAST_TERMS:
        counted = counted.join(F.broadcast(wanted), "term", "left_semi")
    n_term = counted.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_term"))
    scored = pairs.join(n_term, "term").withColumn("p", _posterior(F.col("n_both"), F.col("n_term"), F.col("p_entity"), prior))
    terms = cut(scored.where(above(F.col("p"))).groupBy("term").agg(F.max("p").alias("p"), (F.max("n_term") > F.max("n_near")).alias("elsewhere")))
    held = contexts.select("text", "term").distinct().join(terms.where("not elsewhere"), "term").select("text", "term", "p")
    elsewhere = terms.where("elsewhere").select("term", "p")
    n = elsewhere.count()
    if n:
        all_ = docs.select(_digest(text).alias("text"), words.alias("terms")).select("text", F.explode("terms").alias("term"))
        held = held.unionByName(all_.join(F.broadcast(elsewhere) if n <= _BROADCAST_TERMS else elsewhere, "term").select("text", "term", "p").distinct())
    return held


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 100, open_bits: float = 1.0, share: float = 0.5, prior: float = 1.0, removed: float = 0.9) -> DataFrame:
    """(key, terms): for the texts of docs that hold disclosing terms their digest and the spans of these in the
    text: array<struct<start, kind 4, end, remove>> by place, whole tokens that no pattern's match
    touches; ``remove`` if P(entity | term) is at least ``removed``.

    Null text counts as empty. Rows with the same text have equal results. Null ids are ids. With the
    default ``prior`` a term that stands in a single text, near an entity of a single text, is generalised: it
    identifies that record; one that a second text holds without the entity is not. Documents with the two
    further apart than ``reach`` give no evidence, but the term is marked in them. An empty table gives an empty
    result. Texts are handled whole, within their rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(text.alias("text")).where(F.col("text").rlike(r"[0-9@]")).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    found = cut(base, scan=True)
    held = telling_terms(docs, found, id_col, text_col, reach, open_bits, share, prior)
    per = cut(held.groupBy(F.col("text").alias("key")).agg(F.map_from_entries(F.collect_set(F.struct("term", F.col("p") >= removed))).alias("telling")))
    few = per.count() <= _BROADCAST_TERMS
    keyed = docs.select(_digest(text).alias("key"), text.alias("text")).join(F.broadcast(per) if few else per, "key")
    keyed = keyed.withColumn("spans", base_spans(F.col("text")))
    tokens = matches(F.col("text"), _TOKEN, TERM, keep=lambda v: F.map_contains_key("telling", F.lower(v)))
    free = F.filter(tokens, lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    spans = F.transform(free, lambda t: F.struct(t["start"].alias("start"), F.lit(TERM).alias("kind"), t["end"].alias("end"), F.element_at("telling", F.lower(t["value"])).alias("remove")))
    marked = cut(keyed.select("key", spans.alias("terms")), scan=few)
    return cut(marked.where(F.size("terms") > 0).groupBy("key").agg(F.first("terms").alias("terms")))  # copies have the same


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Counts and spans per row of docs: n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    terms = find(docs, id_col, text_col, **how)
    few = (terms.agg(F.sum(F.size("terms"))).first()[0] or 0) <= _BROADCAST_TERMS
    rows = docs.select(F.col(id_col).alias("id"), _digest(text).alias("key"), base_spans(text).alias("spans"))
    out = rows.join(F.broadcast(terms) if few else terms, "key", "left")
    base = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    more = F.transform(F.coalesce("terms", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,remove:boolean>>)")), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.sort_array(F.concat(base, more))).alias("spans"), F.size(more).cast("long").alias("n_terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """docs with spans replaced: entities by [EMAIL], [IP], [CARD], [PHONE], telling terms by [TERM], terms
    that determine an entity removed. Overlapping spans are replaced once, by the first one's mark. Null
    text stays null; other columns stay, n_chars follows the text."""
    terms = find(docs, id_col, text_col, **how)
    key, more, spans = fresh(docs, "__key", "__terms", "__spans")
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn(key, _digest(F.coalesce(text, F.lit(""))))
    few = (terms.agg(F.sum(F.size("terms"))).first()[0] or 0) <= _BROADCAST_TERMS
    told = terms.select(F.col("key").alias(key), F.col("terms").alias(more))
    out = keyed.join(F.broadcast(told) if few else told, key, "left")
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")))
    base = F.transform(base_spans(F.coalesce(text, F.lit(""))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(marks, x["kind"] + 1).alias("mark")))
    telling = F.transform(F.coalesce(F.col(more), F.expr("cast(array() as array<struct<start:int,kind:int,end:int,remove:boolean>>)")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["remove"], F.lit("")).otherwise(F.element_at(marks, F.lit(TERM + 1))).alias("mark")))
    out = out.withColumn(spans, F.sort_array(F.concat(base, telling)))

    def step(a, x):
        start = F.greatest(a["at"], x["start"])
        fresh_ = x["start"] >= a["at"]
        piece = F.when(fresh_, F.concat(F.substring(text, a["at"] + 1, start - a["at"]), x["mark"])).otherwise("")
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.array_append(a["out"], piece).alias("out"))

    none = F.expr("cast(array() as array<string>)")
    rebuilt = F.aggregate(spans, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    out = out.withColumn(text_col, F.when(F.size(spans) > 0, rebuilt).otherwise(text))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)
