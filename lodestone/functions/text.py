"""Text cleaning, parsing and tokenising as Column expressions.

Java's regular expressions need care to mean what Unicode text processing wants: ``(?U)`` widens \\s to all
white space, ``(?d)`` makes the line feed the only line end, and words are ``[\\p{L}\\p{N}_]+``, which Spark,
DuckDB and others read alike. Offsets are code points: sums of ``length``.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"(?U)\S+"
#: The characters that end a line, white space that doesn't, and both (as Unicode text processing,
#: not Java, has them: the separators U+001C to U+001F are white space too).
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
BLANK = r"[\t \x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What documents, prompts and answers must look like to be read alike.
HEADING = r"(?dm)^(#{1,6})\s+(.+?)\s*$"
HEADING_LINE = r"(?dm)^#{1,6}\s+.*$"
DIRECTIVE = r"(?s)\{\{.*?\}\}"
MARKER = r"\[\[DEMO:([^\]]+)\]\]"
CITATION = r"\[(\d+)\]"
FRONTMATTER = r"(?s)\A---\s*\n(.*?\n)---\s*\n?"


def empty_array(kind: str = "string") -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def all_matches(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def collapse_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\n{3,}", "\n\n")


# -- words and tokens -----------------------------------------------------------------------------


def words(x: Column) -> Column:
    """Lower-cased words in order."""
    return all_matches(F.lower(x), WORD)


def tokens(x: Column) -> Column:
    """Runs without white space."""
    return all_matches(x, TOKEN)


def token_count(x: Column) -> Column:
    return F.size(tokens(x))


def is_blank(x: Column) -> Column:
    return ~F.coalesce(x, F.lit("")).rlike(r"(?U)\S")


# -- cleaning -------------------------------------------------------------------------------------


def normalize(x: Column) -> Column:
    """One kind of line end, no white space at line ends, at most one empty line, stripped."""
    x = F.regexp_replace(x, LINE_END, "\n")
    x = F.regexp_replace(x, rf"(?<!{BLANK}){BLANK}++(?=\n|\z)", "")
    return strip(collapse_newlines(x))


def normalize_answer(x: Column) -> Column:
    """For comparing answers: lower case, straight apostrophes, no citations, no punctuation."""
    x = F.regexp_replace(F.lower(x), "’", "'")
    x = F.regexp_replace(x, r"\[\d+\]", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_\s']", " ")
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def strip_tags(x: Column) -> Column:
    """Without script and style elements, then without anything between < and >."""
    x = F.regexp_replace(x, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    return F.regexp_replace(x, r"<[^>]+>", "")


def unescape_common(x: Column) -> Column:
    """The entities &quot; &copy; &middot; &lt; &gt; &nbsp; and, last, &amp;."""
    for entity, c in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(c))
    return x


@F.pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    """All of HTML's entities, in Arrow batches."""
    return x.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(found: re.Match) -> str:
    return html.unescape(found[0]) if found[1][0] == "#" else html5.get(f"{found[1]};", found[0])


@F.pandas_udf(StringType())
def unescape_closed(x: pd.Series) -> pd.Series:
    """All of HTML's entities that end in a semicolon; what ``unescape`` reads without one (&amp, &ampx;) stays."""
    return x.map(lambda s: _CLOSED.sub(_closed, s), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def unescape_each(x: pd.Series) -> pd.Series:
    """All of HTML's entities in each text of an array; within a lambda no Python can run."""
    return x.map(lambda a: None if a is None else [None if s is None else html.unescape(s) for s in a])


def strip_html(x: Column, complete: bool = True) -> Column:
    """Plain text of HTML or of Markdown with tags. ``complete`` decodes every entity (in Python, by Arrow
    batches), otherwise the common ones (in the JVM)."""
    bare = strip_tags(x)
    return normalize(unescape(bare) if complete else unescape_common(bare))


def clean_prop_type(x: Column, complete: bool = True) -> Column:
    """Entities decoded, <br> (in this spelling) and white space to single spaces, stripped."""
    return one_line(unescape(x) if complete else unescape_common(x))


def one_line(x: Column) -> Column:
    """<br> and white space to single spaces, stripped."""
    return strip(F.regexp_replace(F.replace(x, F.lit("<br>"), F.lit(" ")), rf"{SPACE}+", " "))


def preview(x: Column, size: int = 300) -> Column:
    return F.regexp_replace(F.substring(x, 1, size), "\n", " ")


# -- metadata -------------------------------------------------------------------------------------


def stem(path: Column) -> Column:
    """File name without its folder and last extension."""
    name = F.regexp_extract(path, r"[^/]*\z", 0)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


def frontmatter(x: Column) -> Column:
    """map of the ``key: value`` lines of a leading --- block; empty if there is none."""
    block = F.regexp_extract(x, FRONTMATTER, 1)
    lines = F.filter(F.split(block, r"\r?\n", -1), lambda s: s.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pair = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^([\w-]+)\s*:", 1).alias("k"), F.regexp_replace(F.regexp_replace(s, r"^[\w-]+\s*:\s*|\s+$", ""), r"""^(['"])(.*)\1$""", "$2").alias("v")))
    # of repeated keys the last holds
    last = F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, i + 2, F.size(pair)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def without_frontmatter(x: Column) -> Column:
    return F.regexp_replace(x, FRONTMATTER, "")


def title_from_name(path: Column) -> Column:
    """Title Case: each run of letters with a case begins with a capital, after digits and apostrophes too."""
    words_ = F.regexp_replace(F.regexp_replace(stem(path), "[-_]+", " "), rf"{SPACE}+", " ")
    runs = all_matches(F.lower(strip(words_)), r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+")
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def doc_id(doc_type: Column, flat_name: Column) -> Column:
    return F.concat(doc_type, F.lit("__"), stem(flat_name))


def fence_language(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(".ts", ".tsx"), "tsx").otherwise("jsx")


def source_url(repo: str, tag: str, path: Column) -> Column:
    """Null where the path is null or empty."""
    return F.when(path != "", F.concat(F.lit(f"https://github.com/{repo}/blob/{tag}/"), path))


# -- markers and citations ------------------------------------------------------------------------


def offsets(gaps: Column, found: Column) -> Column:
    """Start of each match, from the pieces between the matches and the matches themselves."""
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("m"))
    zero = F.struct(F.lit(0).alias("at"), empty_array("int").alias("out"))

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["m"])).alias("at"), F.array_append(a["out"], start).alias("out"))

    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def without_markers(x: Column) -> Column:
    return F.regexp_replace(x, MARKER, "")


def marker_positions(x: Column) -> Column:
    """array<struct<pos, demo_id>>: demo markers, by their place in the text without markers."""
    gaps, ids = F.split(x, MARKER, -1), all_matches(x, MARKER, 1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(ids)).alias("gap"), ids.alias("demo_id"))
    zero = F.struct(F.lit(0).alias("at"), empty_array("struct<pos:int,demo_id:string>").alias("out"))

    def step(a, x):
        at = a["at"] + F.length(x["gap"])
        return F.struct(at.alias("at"), F.array_append(a["out"], F.struct(at.alias("pos"), x["demo_id"].alias("demo_id"))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def cited_numbers(x: Column) -> Column:
    """The distinct numbers n of markers [n], in order of appearance; numbers beyond an int are none."""
    digits = F.filter(all_matches(x, CITATION, 1), lambda s: F.length(F.ltrim(s, F.lit("0"))) <= 9)
    return F.array_distinct(F.transform(digits, lambda s: s.cast("int")))


def arm(mode: Column, retriever: Column) -> Column:
    return F.when(mode == "naive", "naive").otherwise(F.concat(F.lit("rag_"), retriever))


# -- answer scores --------------------------------------------------------------------------------


def answer_tokens(x: Column) -> Column:
    """Tokens of the answer for token F1."""
    n = normalize_answer(x)
    return F.when(n == "", empty_array()).otherwise(F.split(n, " ", -1))


def token_f1(predicted: Column, reference: Column) -> Column:
    """Multiset F1 of two token arrays; 1 if both are empty, 0 if one is."""

    def numbered(tokens_):
        """Each occurrence told apart by its place among its equals in the sorted tokens. The outer array of
        one makes the tokens a variable; as an expression they would be made anew for each of them."""
        inner = lambda xs: F.transform(xs, lambda x, i: F.concat(x, F.lit("\u0001"), (i - F.array_position(xs, x)).cast("string")))
        return F.get(F.transform(F.array(F.sort_array(tokens_)), inner), F.lit(0))

    p, r = predicted, reference
    shared = F.size(F.array_intersect(numbered(p), numbered(r)))
    total = F.size(p) + F.size(r)
    return F.when(total == 0, 1.0).otherwise(F.lit(2.0) * shared / total)


def exact_match(predicted: Column, reference: Column) -> Column:
    return normalize_answer(predicted) == normalize_answer(reference)


# -- API reference --------------------------------------------------------------------------------


def flatten_api(parsed: Column) -> Column:
    """A sentence for the component and one for each of its props, a line each."""
    none = F.lit("")
    entries = F.map_entries(parsed["props"])

    def kind(e):
        return F.coalesce(F.nullif(e["value"]["type"]["description"], none), F.nullif(e["value"]["type"]["name"], none), F.lit("unspecified"))

    def sentence(p):
        e, more = p["e"], one_line(p["more"])
        text = F.concat(F.lit("Prop `"), e["key"], F.lit("`: type "), one_line(p["kind"]), F.lit("."))
        default = F.when(e["value"]["default"].isNotNull(), F.concat(F.lit(" Default: "), e["value"]["default"], F.lit("."))).otherwise("")
        return F.concat(text, default, F.when(more != "", F.concat(F.lit(" "), more)).otherwise(""))

    head = F.concat(F.coalesce(parsed["name"], F.lit("Unknown component")), F.lit(" component API reference."))
    kinds = unescape_each(F.transform(entries, kind))
    more = unescape_each(F.transform(entries, lambda e: F.coalesce(e["value"]["description"], none)))
    parts = F.arrays_zip(entries.alias("e"), kinds.alias("kind"), more.alias("more"))
    props = F.coalesce(F.transform(parts, sentence), empty_array())
    return F.concat_ws("\n", F.array(head), props)
