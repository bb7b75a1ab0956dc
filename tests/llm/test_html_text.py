import re

import pytest

from postloom.llm import queries
from postloom.llm.html_text import extract_text, main_text
from tests.llm.helpers import DATA, HAVE_DATA

LONG = "The quick brown fox jumps over the lazy dog and runs on through the wide open fields of grain."

PAGES = {
    "article with everything around it": (
        f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head>
        <body class="has-sidebar"><header><p>Site head</p></header><nav><ul><li><a href="/">Home</a></ul></nav>
        <div class="ad">Buy now</div><article><header><h1>Title &amp; more</h1></header><p>{LONG}<p>Short.
        <aside>Also read</aside><form><input>Mail</form><p>Last&nbsp;  one.</article>
        <section id="comments"><article class="comment"><p>{LONG} says a reader</p></article></section>
        <footer>&copy; 2020</footer></body></html>""",
        ["Title & more", LONG, "Short.", "Last one."],
    ),
    "no declared article": (
        f"""<body><div id="menu"><a href=a>One</a><a href=b>Two</a></div><div class="cookie-notice">We use {LONG}</div>
        <div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>End.</p></div>
        <div class="sidebar-widget">{LONG}</div><div class="comments-area"><p>{LONG}</p></div></body>""",
        ["Head", LONG, LONG, "End."],
    ),
    "body of a post named by its class": (
        f"<div class='post-content'><p>A.</p><p>{LONG}</p></div><div>{LONG} elsewhere</div>",
        ["A.", LONG],
    ),
    "wrapper with a telling name": (
        f"<div class='page sidebar'><article><p>{LONG}</p></article></div>",
        [LONG],
    ),
    "cut off inside a tag": (f"<article><p>{LONG}</p><p>Next</p><foo", [LONG, "Next"]),
    "only a little text": ("<p>Hello <b>wor</b>ld</p>", ["Hello world"]),
    "plain text": ("just words < 3 and > 2", ["just words < 3 and > 2"]),
    "references": ("<p>a&lt;b&#65;&hearts;&nosuch;</p>", ["a<bA♥&nosuch;"]),
    "line break is white space": (f"<article><p>one<br>two<br/>three {LONG}</p></article>", [f"one two three {LONG}"]),
    "menu of links only": ("<div><a href=x>" + LONG + "</a></div>", []),
    "nothing": ("<html><body><nav>x</nav></body></html>", []),
    "comments are dropped": (f"<article><!-- <p>no</p> --><p>{LONG}</p><script>x</article>", [LONG]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, blocks = PAGES[name]
    assert main_text(html) == "\n\n".join(blocks)


def test_odd_pages(spark):
    many = "<p>" + LONG + "</p>"
    pages = [None, "", "<<<>>>", many * 3000, "<" * 50_000, many, many]
    df = spark.createDataFrame(
        [(i, h, "x", "y") for i, h in enumerate(pages)], "page_id long, html string, text string, n_chars string"
    )
    rows = {r["page_id"]: r["text"] for r in extract_text(df).collect()}
    assert rows[0] == rows[1] == ""
    assert rows[3].count("\n\n") == 2999
    assert rows[5] == rows[6] == LONG
    assert extract_text(df.where("false")).collect() == []


@pytest.mark.parametrize(
    "inner",
    [
        "<svg-icon name='x'></svg-icon>",
        "<video-player src=a></video-player>",
        "<select-box></select-box>",
        "<template-x></template-x>",
        "<title-bar></title-bar>",
        "<svg viewBox='0 0 1 1'/>",
        "<math/>",
        "<svg><text>no</text></svg>",
        "<select><option>no</select>",
        "<template>no</template>",
        "<object data=a>",
        "<video src=a>",
        "<svg>",
    ],
)
def test_only_closed_or_raw_elements_hide_text(inner):
    html = f"<article><p>{LONG}</p>{inner}<p>Last one.</p></article>"
    assert main_text(html) == f"{LONG}\n\nLast one."


@pytest.mark.parametrize("name", "script style title textarea iframe noscript template".split())
def test_unclosed_raw_elements_hide_the_rest(name):
    assert main_text(f"<article><p>{LONG}</p><{name}>x<p>y</p></article>") == LONG


@pytest.mark.parametrize("aside", ['<div class="ad">x</div>', "<aside>x</aside>", '<div class="share-box"><a href=a>x</a></div>'])
def test_an_inner_aside_does_not_end_the_text(aside):
    for last in ("Short closing sentence.", "短い結びの文です。", "<ul><li>One</li><li>Two</li></ul>"):
        html = f"<body><div><p>{LONG * 3}</p>{aside}<p>{last}</p></div></body>"
        blocks = ["One", "Two"] if "<ul>" in last else [last]
        assert main_text(html) == "\n\n".join([LONG * 3, *blocks])


def test_a_teaser_article_does_not_replace_the_body():
    teaser = '<article class="teaser"><p>Read this next.</p></article>'
    assert main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div>{teaser}").startswith(f"{LONG}\n\n{LONG}")


def test_links_and_short_paragraphs_inside_the_text_stay():
    links = "".join(f"<p><a href=a>Link {i}</a></p>" for i in range(5))
    html = f"<p>{LONG}</p>{links}<p>{LONG}</p>"
    assert main_text(html) == "\n\n".join([LONG, *(f"Link {i}" for i in range(5)), LONG])
    menu = "".join(f"<p><a href=a>漢 {i}</a></p>" for i in range(5))
    assert main_text(f"<p>漢字の段落です。</p>{menu}<p>次の段落です。</p>").count("段落") == 2


@pytest.mark.parametrize(
    "page",
    [
        "<form action=a><input>{0}<p>Last.</p></form><div class=footer>Foot line</div>",
        "<div class='two-sidebar-layout'>{0}<p>Last.</p></div><footer>Foot line</footer>",
        "<div class='sidebar-right'><div class='header-wrap'>{0}<p>Last.</p></div></div><div class=copyright>c</div>",
        "<form><div class='sidebar-x'>{0}<p>Last.</p><div class='ad'>Buy</div></div></form>",
        "<div>{0}<p>Last.</p></div><article class='teaser'><p>Short teaser about something else to read.</p></article>",
    ],
)
def test_a_wrapper_with_a_telling_name_is_no_aside(page):
    body = f"<p>{LONG}</p><p>{LONG}</p>"
    assert main_text(page.format(body)).split("\n\n")[:3] == [LONG, LONG, "Last."]


def test_what_stays_an_aside_at_any_length():
    for name in ("cookie-notice", "comments", "advert", "newsletter-signup"):
        assert main_text(f"<div class='{name}'><p>{LONG * 9}</p></div><div><p>{LONG}</p></div>") == LONG


def test_headings_and_menu_lines_at_the_edge():
    assert main_text(f"<h1 class='page-header'>Title here</h1><p>{LONG}</p>") == f"Title here\n\n{LONG}"
    menu = "<p><a href=a>Home</a></p><p><a href=b>News</a></p>"
    assert main_text(f"{menu}<p>{LONG}</p><p>End.</p>{menu}") == f"{LONG}\n\nEnd."


@pytest.mark.skipif(not HAVE_DATA, reason="test tables not present")
def test_windows_find_the_article_without_its_tags(spark):
    """The given pages, with their declared articles renamed, give the same text by the windows alone."""
    for row in queries.table(spark, DATA, "pages").collect():
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", row["html"])
        assert main_text(plain) == main_text(row["html"])
