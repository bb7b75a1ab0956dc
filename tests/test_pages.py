"""Pages whose character references are cut short."""

import os

import pytest

from postloom.catalog import QUERIES, SQL
from postloom.sources.html import parse

SHORT = "Nets &amp;&amp and &copy; tails&amp"
LONG = SHORT + " word" * 60 + " &ampere &#65 end&amp"


@pytest.mark.parametrize("name", ["page_details", "page_fallback"])
def test_open_references_stay_text_in_the_queries(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    html = f"<html><head><title>T</title></head><body><nav>{SHORT}</nav><article><h1>{SHORT}</h1>{{}}</article></body></html>"
    rows = [(1, "https://a.org/1", html.format(LONG)), (2, "https://a.org/2", html.format("brief &amp"))]
    path = os.path.join(folder, "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/*.parquet'")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(r) for r in QUERIES[name](spark, folder).select(*names).collect()) == sorted(found.fetchall())


def test_reader_with_open_and_closed_references():
    html = '<a href="?x=1&y=2&amp;z">a&amp b&amp;c &#65; &ampx;</a><script>a && b&amp</script><!--d & e-->'
    browser, closed = parse(html), parse(html, closed_references=True)
    assert next(browser.descendants()).text() == "a& b&c A &x;"
    link, script = closed.descendants()
    assert link.text() == "a&amp b&c A &ampx;" and link.attrs["href"] == "?x=1&y=2&z"
    assert script.inner_html() == "a && b&amp" and closed.inner_html().endswith("<!--d & e-->")
