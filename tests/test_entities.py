import html
import os
import sys
from html.entities import html5

sys.path.insert(0, os.path.dirname(__file__))
from compare import connect, differences

from lodestone.functions import text as T
from lodestone.plans import queries
from lodestone.registry import ORACLE_SQL

OPEN = ["a &amp", "<title>b&amp</title><p>c &quot d</p>", "&copy 1 &amp;copy &amp;&amp", "&ampx; &lt&gt; &#39 &#39;&#124;", "&am &a &; && &#; &#x; &nbsp;", "&amp;amp;lt; &am&amp;p; &middot", None]


def pages(spark, tmp_path):
    spark.createDataFrame(list(enumerate(OPEN)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    return con


def test_strip_html_leaves_open_references_as_its_sql(spark, tmp_path):
    con = pages(spark, tmp_path)
    assert differences(queries.strip_html(spark, str(tmp_path)), con, ORACLE_SQL["strip_html"]) == []


def test_html_unescape_leaves_open_references_as_its_sql(spark, tmp_path):
    con = pages(spark, tmp_path)
    assert differences(queries.html_unescape(spark, str(tmp_path)), con, ORACLE_SQL["html_unescape"]) == []


def test_every_closed_reference_is_decoded(spark):
    names = [f"x&{n}y" for n in html5 if n.endswith(";")] + ["&#8212;", "&#x2014;", "&#X2014;", "&#0;", "&#150;", "&#1114112;"]
    got = spark.createDataFrame([(n,) for n in names], "s string").coalesce(1).select(T.unescape_closed("s").alias("s")).collect()
    assert [r.s for r in got] == [html.unescape(n) for n in names]
