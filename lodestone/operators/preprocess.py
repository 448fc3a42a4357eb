"""Raw documentation files to clean documents and a table of demo sources.

Files are (flat_name, url, doc_type, raw): url is the path in the repository, flat_name the unique file name.
"""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone import schemas
from lodestone.functions import text as T
from lodestone.shipping import ship

#: Subtrees to keep with the extension of their documents and the type these get, and the
#: extensions of demo sources.
KEEP = (("docs/data/material/", ".md", "prose"), ("docs/pages/material-ui/api/", ".json", "api"))
DEMO_EXTENSIONS = (".js", ".tsx")
#: Extensions to try, in order, after the one that a demo reference names.
FALLBACK = (".js", ".tsx", ".jsx", ".ts")


def classify(member: Column, keep=KEEP, demo_extensions=DEMO_EXTENSIONS) -> Column:
    """struct<rel, doc_type> of an archive member, null if it isn't kept. The first subtree that is in the
    path and takes the extension decides; rel is the path below it."""
    ext = T.extension(member)
    out = F.lit(None).cast("struct<url:string,rel:string,doc_type:string>")
    for subtree, wanted, kind in reversed(keep):
        inside = F.contains(member, F.lit(f"/{subtree}"))
        rel = F.substr(member, F.locate(f"/{subtree}", member) + F.lit(len(subtree) + 1))
        url = F.concat(F.lit(subtree), rel)
        made = F.struct(url.alias("url"), rel.alias("rel"), F.when(ext == wanted, kind).otherwise("demo").alias("doc_type"))
        out = F.when(inside & (ext.isin(wanted, *demo_extensions)), made).otherwise(out)
    return out


def flat_name(rel: str, used: set[str]) -> str:
    """A file name that isn't used yet, from the path: the name, the name behind its folder, or that with
    the first free number from 2. Adds it to ``used``."""
    *folders, base = rel.split("/")
    parent = folders[-1] if folders else "root"
    name, n = base, 1
    while name in used:
        name = f"{parent}__{base}" if n == 1 else f"{parent}_{n}__{base}"
        n += 1
    used.add(name)
    return name


def flatten_names(files: DataFrame, order_col: str = "place", rel_col: str = "rel") -> DataFrame:
    """files with flat_name, claimed in the order of ``order_col``.

    A name depends on the names before it, but only those that could clash: claims of one base name meet in
    one group. (A made name parent__base could be another file's own base name; those are grouped with it by
    what follows the last "__".)
    """
    ship(files.sparkSession)
    group = F.regexp_extract(F.col(rel_col), r"((?:(?!__)[^/])*)\z", 1)
    kept = files.withColumn("__group", group)
    schema = files.schema.simpleString()[len("struct<") : -1]

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, used = pdf.sort_values(order_col, kind="stable"), set()
        return pdf.drop(columns="__group").assign(flat_name=[flat_name(r, used) for r in pdf[rel_col]])

    return kept.groupBy("__group").applyInPandas(claim, f"{schema}, flat_name string")


def manifest(files: DataFrame) -> DataFrame:
    return files.select("flat_name", "url", "doc_type").orderBy("flat_name")


@F.pandas_udf(StringType())
def normal_path(x: pd.Series) -> pd.Series:
    return x.map(posixpath.normpath, na_action="ignore")


def resolve_demos(refs: DataFrame, index: DataFrame) -> DataFrame:
    """refs (url, ref, ..) with demo_id and resolved, null where nothing exists: the reference is taken from
    the document's folder; the path itself is tried first, then its stem with the other extensions.
    index: (url, flat_name)."""
    folder = F.regexp_replace("url", r"[^/]*\z", "")
    joined = F.when(F.startswith("ref", F.lit("/")), F.col("ref")).otherwise(F.concat(folder, F.col("ref")))
    path = refs.withColumn("__path", normal_path(joined))
    ext = F.regexp_extract("__path", r"[^/](\.[^./]*)\z", 1)
    bare = F.expr("substring(__path, 1, length(__path) - length(regexp_extract(__path, '[^/](\\\\.[^./]*)$', 1)))")
    others = F.filter(F.array(*map(F.lit, FALLBACK)), lambda e: e != ext)
    tries = F.concat(F.array(F.col("__path")), F.transform(others, lambda e: F.concat(bare, e)))
    asked = path.select("url", "ref", F.posexplode(tries).alias("n", "try")).distinct()
    found = asked.join(index.select(F.col("url").alias("try"), "flat_name"), "try")
    best = found.groupBy("url", "ref").agg(F.min_by(F.struct(F.col("flat_name").alias("demo_id"), F.col("try").alias("resolved")), "n").alias("b"))
    return refs.join(best, ["url", "ref"], "left").select(*refs.columns, "b.demo_id", "b.resolved")


def _demo_ref(directive: Column) -> Column:
    """The demo that a directive names, null if it isn't valid JSON or names none."""
    body = F.substr(directive, F.lit(2), F.length(directive) - 2)
    return F.nullif(F.from_json(body, "demo string", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})["demo"], F.lit(""))


def resolve_directives(docs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with their directives replaced, references (doc_id, n, ref, demo_id, resolved)).

    docs: (doc_id, url, text). A directive with a demo that exists becomes a marker between empty lines,
    any other directive nothing.
    """
    d = docs.withColumn("__found", T.all_matches(F.col("text"), T.DIRECTIVE, 0))
    each = d.select("doc_id", "url", F.posexplode("__found").alias("n", "directive"))
    refs = each.withColumn("ref", _demo_ref(F.col("directive"))).where("ref is not null").select("doc_id", "url", "n", "ref")
    resolved = resolve_demos(refs, index)
    marks = resolved.where("demo_id is not null").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "demo_id"))).alias("__marks"))
    gaps = F.split("text", T.DIRECTIVE, -1)

    def piece(g, i):
        demo = F.try_element_at(F.col("__marks"), i)
        return F.concat(g, F.coalesce(F.concat(F.lit("\n\n[[DEMO:"), demo, F.lit("]]\n\n")), F.lit("")))

    rebuilt = T.strip(T.collapse_newlines(F.array_join(F.transform(gaps, piece), "")))
    out = d.join(marks, "doc_id", "left").withColumn("text", rebuilt).select(*docs.columns)
    return out, resolved.select("doc_id", "n", "ref", "demo_id", "resolved")


def unresolved(references: DataFrame) -> DataFrame:
    return references.where("demo_id is null").select("doc_id", "ref")


def demos_table(files: DataFrame, references: DataFrame) -> DataFrame:
    """(demo_id, url, lang, code) of the demos that are referred to, by demo_id."""
    used = references.where("demo_id is not null").select(F.col("demo_id").alias("flat_name")).distinct()
    d = files.join(used, "flat_name")
    return d.select(F.col("flat_name").alias("demo_id"), "url", T.fence_language(F.col("url")).alias("lang"), T.strip(F.col("raw")).alias("code")).orderBy("demo_id")


def prose_metadata(files: DataFrame) -> DataFrame:
    """title and component of Markdown files: from their front matter, or, if that is empty, the title from
    the file name and no component."""
    m = files.withColumn("__m", T.frontmatter(F.col("raw")))
    none = F.size("__m") == 0
    return m.withColumns({
        "title": F.when(none, T.title_from_name(F.coalesce("url", "flat_name"))).otherwise(F.try_element_at("__m", F.lit("title"))),
        "component": F.when(~none, F.try_element_at("__m", F.lit("components"))),
    }).drop("__m")


def documents(files: DataFrame, complete_entities: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, demos, references) of raw files; see schemas.DOCS and schemas.DEMOS.

    Demo sources aren't documents; prose is stripped of front matter, tags and directives, API JSON becomes
    sentences. An API file without a name raises.
    """
    prose = prose_metadata(files.where((F.col("doc_type") == "prose") & (T.extension(F.col("flat_name")) == ".md")))
    body = T.strip_html(T.without_frontmatter(F.col("raw")), complete_entities)
    prose = prose.select(T.doc_id(F.col("doc_type"), F.col("flat_name")).alias("doc_id"), "url", body.alias("text"), "title", "component", "doc_type")
    index = files.select("url", "flat_name")
    prose, references = resolve_directives(prose, index)
    api = files.where((F.col("doc_type") == "api") & (T.extension(F.col("flat_name")) == ".json")).withColumn("__j", F.from_json("raw", schemas.API_PROPS, {"allowSingleQuotes": "false"}))
    name = F.coalesce(F.col("__j.name"), F.raise_error(F.concat(F.lit("no name in "), F.col("flat_name"))).cast("string"))
    api = api.select(T.doc_id(F.col("doc_type"), F.col("flat_name")).alias("doc_id"), "url", T.flatten_api(F.col("__j")).alias("text"), name.alias("title"), name.alias("component"), "doc_type")
    meta = F.struct("title", "component", "url", "doc_type").alias("metadata")
    docs = prose.unionByName(api).select("doc_id", "text", meta)
    return docs, demos_table(files, references), references


def rejected(files: DataFrame) -> DataFrame:
    """(flat_name, doc_type) of documents with an extension that nothing reads."""
    ext = T.extension(F.col("flat_name"))
    return files.where((F.col("doc_type") != "demo") & ~ext.isin(".md", ".json")).select("flat_name", "doc_type")


def last_wins(docs: DataFrame, key: str, place: Column) -> DataFrame:
    """One row per key, the one that comes last."""
    w = W.partitionBy(key).orderBy(place.desc())
    return docs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
