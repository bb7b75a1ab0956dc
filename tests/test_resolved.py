"""Listings of one URL whose captures differ."""

import os

import pytest

from postloom.catalog import QUERIES, SQL


def test_pages_of_one_url_keep_their_own_details(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    page = "<html><head><title>Title {0}</title></head><body><article>Page {0}{1}</article></body></html>"
    hosts = ["a-b", "c-d", "e-f", "g-h"]  # one of each kind
    rows = [
        (i, f"https://{hosts[i % 4]}.example.org/{'en' if i < 8 else i}", page.format(i, " word" * (60 * (i % 3))))
        for i in range(12)
    ]
    path = os.path.join(folder, "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/*.parquet'")
    found = con.execute(SQL["resolved_postings"])
    names = [d[0] for d in found.description]
    got = [tuple(r) for r in QUERIES["resolved_postings"](spark, folder).select(*names).collect()]
    assert len(got) == 12 and sorted(got) == sorted(found.fetchall())
