import pytest
from pyspark.sql import functions as F

from postloom.functions import urls as U

CASES = [
    ("https://A.com/x?q=1#frag?not=query", "https://a.com/x?q=1"),
    ("https://a.com/x?refer=1&trk=2&utmost=3&trkid=4&utm_=5", "https://a.com/x?refer=1&trkid=4&utmost=3"),
    ("https://a.com/1?b=2&a=1&b=1", "https://a.com/1?a=1&b=2&b=1"),
    ("https://a.com/1?Ref=2&TRK=1&lever-source=z", "https://a.com/1"),
    ("http://a.com", "http://a.com/"),
    ("http://a.com/a//", "http://a.com/a/"),
    ("http://a.com//", "http://a.com/"),
    ("HTTP://A.com:80/x/", "http://a.com/x"),
    ("https://a.com:8443/x", "https://a.com:8443/x"),
    ("http://a.com/x?a", "http://a.com/x?a="),
    ("http://a.com/x?q=%20b+c&%41=1&a=2=3", "http://a.com/x?A=1&a=2%3D3&q=+b+c"),
    ("http://a.com/x?", "http://a.com/x"),
    ("http://u:p@a.com/x", "http://u:p@a.com/x"),
    ("http://a.com/a/../b/./c/", "http://a.com/b/c"),
    ("http://a.com/%2E%2e/b", "http://a.com/b"),
    ("http://müller.de/ä?q=é", "http://xn--mller-kva.de/%C3%A4?q=%C3%A9"),
    ("http://a.com/x?q=it's", "http://a.com/x?q=it%27s"),
    ("http://a.com/a b", "http://a.com/a%20b"),
    ("http://a.com/%zz?q=%zz", "http://a.com/%zz?q=%25zz"),
    ("  http://a.com/x\n", "http://a.com/x"),
    ("mailto:x@y.com", "mailto:x@y.com"),
    ("plainly no address", "plainly no address"),
    ("http://a.com:" + "9" * 5000 + "/x", "http://a.com:" + "9" * 5000 + "/x"),
    ("http://a.com:٣/x", "http://a.com:٣/x"),
    ("http://a.com:00080/x", "http://a.com/x"),
    ("http://[::1", "http://[::1"),
    ("http://" + "ü" * 300 + ".de/", "http://" + "ü" * 300 + ".de/"),
    ("http://", "http://"),
    ("", ""),
    (None, None),
]


def test_canonical_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(CASES)], "i int, u string")
    got = {r.i: r.url_key for r in U.with_canonical_url(df, "u").collect()}
    assert {CASES[i][0]: k for i, k in got.items()} == dict(CASES)


def test_native_and_helper_agree(spark):
    plain = [u for u, _ in CASES if u] + [
        "https://a-b.c.io/x_y/~z;p=1/(q)?a=1&&b=%3D%26&c=~!()*", "http://x.com/?z=1&y=2", "http://x.com?y=%7E",
    ]
    df = spark.createDataFrame([(u,) for u in plain], "u string").where(U.is_plain_url(F.col("u")))
    rows = U._plain_parts(df, F.col("u")).select("u", U._plain_key().alias("k")).collect()
    assert len(rows) > 10
    assert [(r.u, r.k) for r in rows] == [(r.u, U._canonical_other(r.u)) for r in rows]


def test_canonical_form_is_stable(spark):
    # One trailing slash is taken off per pass, so "//" endings need two.
    df = spark.createDataFrame([(u,) for u, _ in CASES if u and not u.endswith("//")], "u string")
    once = U.with_canonical_url(df, "u", "k")
    twice = U.with_canonical_url(once, "k", "k2")
    assert twice.where("k <> k2").count() == 0


def test_job_id(spark):
    df = spark.createDataFrame([("https://acme.com/jobs/1",), ("https://ACME.com/jobs/1/#x",)], "u string")
    ids = [r.id for r in U.with_job_id(df, "u").collect()]
    assert ids[0] == ids[1] and len(ids[0]) == 16


@pytest.mark.parametrize(
    "url, given, ats, expected",
    [
        ("https://boards.greenhouse.io/acme/jobs/77", None, "greenhouse", "acme"),
        ("https://boards.greenhouse.io/acme/jobs/77", "", "greenhouse", "acme"),
        ("https://boards.greenhouse.io/acme/jobs/77", "tok", "greenhouse", "tok"),
        ("https://x.com", None, None, None),
    ],
)
def test_board_token(spark, url, given, ats, expected):
    df = spark.createDataFrame([(url, given)], "u string, given string")
    row = U.with_ats_identity(U.with_ats(df, "u"), "u", "ats", "given").first()
    assert (row.ats, row.board_token) == (ats, expected)


def test_workday_identity(spark):
    df = spark.createDataFrame(
        [("https://acme.wd5.myworkdayjobs.com/en-US/ext/Careers/job/R1", None), ("https://x.myworkdayjobs.com/", "t")], "u string, g string"
    )
    a, b = U.with_ats_identity(U.with_ats(df, "u"), "u", "ats", "g").collect()
    assert tuple(a.workday) == ("acme.wd5.myworkdayjobs.com", "ext", "Careers", False)
    assert tuple(b.workday) == ("x.myworkdayjobs.com", "t", "careers", True)


def test_template_fills_first_slot_only(spark):
    df = spark.createDataFrame([("own", "a b&c", "x", 3, "http://x?q={{keyword}}&p={{page}}{{page}}")], "s string, k string, l string, p int, t string")
    url = df.select(U.search_url(F.col("s"), F.col("k"), F.col("l"), F.col("p"), F.col("t"))).first()[0]
    assert url == "http://x?q=a%20b%26c&p=3{{page}}"
