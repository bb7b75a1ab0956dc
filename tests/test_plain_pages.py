"""Plain pages are read in a short way, to the same end."""

import os
import random
import subprocess
import sys
from urllib.parse import quote, urljoin

import pytest
from pyspark.sql import functions as F

from postloom.functions.text import CHALLENGE_SIGNALS, challenge_reason
from postloom.plans import discover as plan
from postloom.plans.discover import read_result_pages
from postloom.schemas import RAW_PAGE, SEEN_IDS
from postloom.session import cut
from postloom.sources import extract, html

PIECES = [
    "<div>", "</div>", "<p>", "<p class='a b'>", "</p>", "<li>", "</li>", "<td>", "<th>", "<tr>", "<br>", "<br/>", "<IMG Src=\"a&amp;b\">",
    "<a href=\"/x?a=1&b=2&copy=3\" HREF='second' data-k=''>", "</a>", "</A >", "<h1\n id=\"t\"\t>", "<x-y z_9=\"1\">", "text", " & &amp &lt;b&gt; ",
    "café &eacute", "a < b", "<!-- note -->", "<!doctype html>", "<script>if (a < b) x()</script>", "<title>T &amp; t</title>", "<b disabled>",
    "<i a=1>", "<u a=\"<\">", "</p class=\"x\">", "<", ">", "\"", "&", "</>", "<1>", "<em a=\"1\"b=\"2\">",
]


def whole(page):
    reader = html._Reader()
    reader.feed(page)
    reader.close()
    return reader.root


def shape_of(node):
    parts, last = [], ""
    for part in node.parts:
        if isinstance(part, str):
            last += part
            continue
        parts += [last, part if isinstance(part, tuple) else shape_of(part)]
        last = ""
    return node.tag, node.attrs, [*parts, last]


def test_short_way_against_the_library():
    draw, short = random.Random(2), 0
    for kinds in (PIECES, PIECES[:20]):
        for _ in range(8_000):
            page = "".join(draw.choice(kinds) for _ in range(draw.randrange(9)))
            found = html._read_plain(page)
            short += found is not None
            assert shape_of(html.parse(page)) == shape_of(whole(page)), page
    assert short > 5_000


def test_addresses_against_the_library():
    draw = random.Random(3)
    bases = ["https://www.indeed.com/jobs?q=x", "HTTP://Ab.org:80/a/b", "https://u@h.org/", "ftp://h.org/", "https://[bad/", "nothing", ""]
    for _ in range(20_000):
        href = "/" * draw.randrange(3) + "".join(draw.choice("ab1/.?;#&=%:@ é[~") for _ in range(draw.randrange(7)))
        base = draw.choice(bases)
        try:
            want = quote(urljoin(base, href.strip()), safe=extract.URL_SAFE)
        except ValueError:
            want = ""
        assert extract._href(html.Element("a", {"href": href}, None), base) == want, (base, href)


def test_words_are_in_every_page_with_a_signal(spark):
    pages = [
        "ReCaptcha", "hCAPTCHA", "CF-turnstile", "Checking your BROWSER", "Cloudflare some challenge", "PerimeterX", "_PX-captcha", "dataDome",
        "Verify you are human", "are you a Robot", "unusual traffic from your network", "complete the security check",
        "please confirm you are a human", "Access denied\n to a bot", "Automated queries detected", "automated requests detected", "plain", None,
        "İ cloudflare K challenge", "access denied",
    ]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, page string")
    told = F.coalesce(*[F.when(F.col("page").rlike(p), r) for r, p in CHALLENGE_SIGNALS])
    got = rows.select("i", challenge_reason(F.col("page")).alias("got"), told.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in got) and sum(r["want"] is not None for r in got) == 17


def test_pages_are_read_once(spark, monkeypatch):
    """The markup is read by one job; what follows goes by its result."""
    written, read = [], spark.sparkContext.accumulator(0)

    def counted(df, label):
        written.append(label)
        return cut(df, label)

    monkeypatch.setattr(plan, "cut", counted)

    @F.udf("string")
    def markup(seq):
        read.add(1)
        return f'<div class="job_seen_beacon"><a class="jcs-JobTitle" href="/rc/clk?jk={seq}"><span id="jobTitle-1">QA</span></a></div>'

    rows = [(i, "indeed", f"k{i % 5}", "US", i // 5 + 1, "https://www.indeed.com/jobs") for i in range(20)]
    pages = spark.createDataFrame(rows, "seq long, source string, keyword string, location string, page_no int, url string")
    pages = pages.withColumn("html", markup.asNondeterministic()("seq")).select(*RAW_PAGE.fieldNames())
    todo = spark.createDataFrame([(f"indeed::k{i}::us", "p", 0, 0, 1) for i in range(5)], "key string, profile string, role_seq int, pos int, start_page int")
    found, recorded = read_result_pages(pages, todo, spark.createDataFrame([], SEEN_IDS), "now")
    assert found.count() == 20 and recorded.where("n_cards = 1 and not failed").count() == 20
    assert read.value == 20 and written.count("cards") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_executors_need_no_package(folder):
    """The reader travels by value: it works where the package is not on the path of the workers."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {repo!r}); sys.dont_write_bytecode = True\n"
        "from postloom.session import get_session\nfrom postloom.catalog import QUERIES\n"
        "spark = get_session('away', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.checkpoint.dir': sys.argv[1]})\n"
        "print('rows', QUERIES['page_cards'](spark, '/root/testdata/sf0.001').count())"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK_GATEWAY"))}
    done = subprocess.run([sys.executable, "-c", code, folder], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 281" in done.stdout, done.stderr[-2000:]
