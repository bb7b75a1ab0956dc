"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block of a page becomes a line. The lengths of the lines are
summed over a sliding window; where the sums rise above a threshold the text surges, where
they fall to nothing it dives, and what lies between is kept. That decides every page. What a page says
about its parts only changes the weights: links weigh nothing; elements that announce themselves as menus,
adverts, comments and the like are left out first, unless they hold nearly all text of the page; and if a declared
article holds two fifths of the text, its lines weigh all they have and the others are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3  # lines in a block
SURGE = 86  # characters in a block that make text of it

# Names of elements by their part in a page: fixed values of HTML.
RAW = "script|style|noscript|template|iframe|textarea|title"  # unclosed, they hide the rest of the page
ENCLOSED = frozenset("object svg math canvas audio video select".split())  # unclosed, they hide nothing
FOREIGN = frozenset("svg math".split())  # a slash at the end of the tag closes them
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ASIDES = frozenset("nav header footer aside form menu button dialog search head fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_ASIDES = frozenset("html body main p-main".split())

# Class, id and role words that announce something other than the article.
_PARTS = (
    "nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|header|masthead|topbar|footer|colophon|"
    "sidebar|side|aside|rail|widget|widgets|ad|ads|advert|adverts|advertisement|advertising|adsense|banner|"
    "sponsor|sponsored|sponsors|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|"
    "newsletter|subscribe|subscription|signup|login|search|searchbox|form|social|share|sharing|related|recommended|"
    "recommendations|trending|popular|comment|comments|commentlist|disqus|respond|reply|replies|discussion|"
    "pagination|pager|toolbar|copyright|legal|disclaimer|skip|complementary|contentinfo|tags|byline-share"
)
ASIDE_NAME = re.compile(
    rf"^(?!(?:has|with|no|without)[-_])(?:[a-z0-9]+[-_]+)?(?:{_PARTS})(?:[-_]+(?:[a-z0-9]+))*$"
)
# Words that also name wrappers around a whole page. An element of such a name that holds nearly all text
# is one; what calls itself an advert, a notice or a comment is that at any length.
WRAPPER_NAME = re.compile(r"nav|menu|header|masthead|topbar|sidebar|side|aside|rail|widget|form|legal|search|toolbar|skip|tags|related")
WRAPPERS = frozenset("div section form fieldset td center span".split())
COMMENT_NAME = re.compile(r"comment|disqus|repl(?:y|ies)|discussion|respond")
MAIN_NAME = re.compile(r"^(?:article|main|post|entry|story)[-_]?(?:body|content|text)$|^articlebody$")

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>{RAW})(?=[\s/>])(?:[^<>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<name>[a-z][^\s/<>]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*+)>
    |<(?P<end2>/?)(?P<name2>[a-z][^\s/<>]*)(?P<rest2>[^<>]*)>
    |<[!?/][^<>]*>""",
    re.IGNORECASE | re.DOTALL | re.VERBOSE,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\s(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.IGNORECASE)


class Line:
    """One block: its text, and how many of its characters are not in links."""

    __slots__ = ("parts", "weight", "zone")

    def __init__(self, zone: int):
        self.parts: list[str] = []
        self.weight = 0
        self.zone = zone  # 0: page, 1: declared article, -1: announced as something else

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def _names(rest: str) -> list[str]:
    return [n for m in _NAMES.finditer(rest) for n in (m[1] or m[2] or m[3] or "").lower().split()]


class Aside:
    """An element that is set aside: where it starts, how much text outside links it holds, and
    whether it may be a wrapper."""

    __slots__ = ("may_wrap", "start", "weight")

    def __init__(self, start: int, may_wrap: bool):
        self.start = start
        self.may_wrap = may_wrap
        self.weight = 0


def lines_of(html: str, wrappers: frozenset[int] = frozenset()) -> tuple[list[Line], list[Aside]]:
    """Blocks of a page in order, and what is set aside. An element that is set aside gives one empty
    line. Elements that start at one of ``wrappers`` are not."""
    lines = [Line(0)]
    asides: list[Aside] = []
    # Open elements that change the zone: name, depth of equal names inside, zone outside.
    zones: list[list] = []
    zone, links, at, skip = 0, 0, 0, 0
    lowered = html.lower()
    # The last place of each kind of end tag: an element that is never closed sets nothing aside.
    last_end: dict[str, int] = {}

    def closed_after(name: str, place: int) -> bool:
        if name not in last_end:
            last_end[name] = lowered.rfind(f"</{name}")
        return last_end[name] > place

    unclosed: set[str] = set()

    def end_of(name: str, place: int) -> int:
        """Where the next end tag of an enclosed element ends, 0 if there is none."""
        found = None if name in unclosed else re.compile(rf"</{name}\s*>").search(lowered, place)
        if found is None:
            unclosed.add(name)
        return found.end() if found else 0

    def put(text: str) -> None:
        if zone < 0:
            if not links:
                asides[-1].weight += len(text.strip())
        elif text:
            line = lines[-1]
            line.parts.append(text)
            if not links:
                line.weight += len(text.strip())

    for token in _TOKEN.finditer(html):
        if token.start() < skip:
            at = max(at, token.end())
            continue
        put(html[at : token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        rest = token["rest"] or token["rest2"] or ""
        ends = bool(token["end"] or token["end2"])
        if name in ENCLOSED:
            if not ends and not (name in FOREIGN and rest.endswith("/")):
                skip = end_of(name, at)
                at = max(at, skip)
            continue
        if name == "a":
            links = 0 if ends else 1
        if name == "br":
            put(" ")
        if zones and name == zones[-1][0]:
            zones[-1][1] += -1 if ends else not rest.endswith("/")
            if zones[-1][1] <= 0:
                zone = zones.pop()[2]
                lines.append(Line(zone))
                continue
        elif zones and zones[-1][0] == "p" and name in BLOCKS:
            zone = zones.pop()[2]  # a paragraph ends where the next block begins
            lines.append(Line(zone))
        if name == "body":
            zones, zone = [], 0
        if name in BLOCKS:
            links = 0
            lines.append(Line(zone))
        if ends or name in VOID or name in NEVER_ASIDES and name != "main" or zone < 0:
            continue
        names = _names(rest)
        if name in ("article", "main") or any(MAIN_NAME.match(n) for n in names):
            new = -1 if name != "main" and any(COMMENT_NAME.search(n) for n in names) else 1
        elif name == "header" and zone == 1:
            continue  # the head of the article itself
        elif token.start() in wrappers:
            continue
        elif name in ASIDES or _HIDDEN.search(rest) or name not in HEADINGS and any(ASIDE_NAME.match(n) for n in names):
            new = -1
        else:
            continue
        if new < 0 and name != "p" and not closed_after(name, at):
            continue
        if new < 0 and zone == 0 and name not in ("nav", "header", "footer", "aside", "head"):
            # A wrapper around the article is not an aside, unless it holds readers' comments.
            close = lowered.find(f"</{name}", at)
            inside = lowered[at : close if close >= 0 else len(lowered)]
            wraps = "<article" in inside or "<main" in inside
            if wraps and not any(COMMENT_NAME.search(n) for n in names):
                continue
        if new < 0:
            called = [n for n in names if ASIDE_NAME.match(n)]
            plain = name in WRAPPERS and not _HIDDEN.search(rest) and all(WRAPPER_NAME.search(n) for n in called)
            asides.append(Aside(token.start(), plain and not any(COMMENT_NAME.search(n) for n in names)))
        zones.append([name, 1, zone])
        zone = new
        lines.append(Line(zone))
    tail = html[at:]
    put(tail if "<" not in tail else re.sub(r"<[a-zA-Z/!?][^<>]*\Z", "", tail))
    return lines, asides


def weighed_lines(html: str) -> list[tuple[str, int]]:
    """Text and weight of the blocks that take part."""
    wrappers: frozenset[int] = frozenset()
    while True:
        lines, asides = lines_of(html, wrappers)
        # An element that holds nearly all text outside links is no aside, whatever its name; so look inside.
        total = sum(line.weight for line in lines) + sum(a.weight for a in asides)
        around = {a.start for a in asides if a.may_wrap and a.weight * 5 > total * 4}
        if not around:
            break
        wrappers = wrappers | around
    found = [(line.text(), line.weight, line.zone) for line in lines]
    found = [f for f in found if f[0] and f[2] >= 0]
    inside = sum(weight for _, weight, zone in found if zone == 1)
    if inside and inside * 5 >= 2 * sum(weight for _, weight, _ in found):
        return [(text, len(text)) for text, _, zone in found if zone == 1]
    return [(text, weight) for text, weight, _ in found]


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks, joined by blank lines; empty if there is none.

    A run of lines surges if the text in some window of it reaches ``surge``, or a quarter of the
    page's largest window if that is less, and dives where a whole window has no text. All from the first
    to the last run that surges is kept, without the link-only lines ahead of its first and after its last
    line of text.
    """
    found = weighed_lines(html or "")
    weights = [weight for _, weight in found]
    sums, total = [], sum(weights[:window])
    for i, weight in enumerate(weights):
        sums.append(total)
        total += (weights[i + window] if i + window < len(weights) else 0) - weight
    runs: list[list[int]] = [[]]
    for i, weight in enumerate(weights):
        if weight or sums[i]:
            runs[-1].append(i)
        elif runs[-1]:
            runs.append([])  # a dive: no text for a whole window
    least = max(1, min(surge, max(sums, default=0) / 4))
    kept = [r for r in runs if r and max(sums[i] for i in r) >= least]
    if not kept:
        return ""
    text_at = [i for i in range(kept[0][0], kept[-1][-1] + 1) if weights[i]]
    return "\n\n".join(text for text, _ in found[text_at[0] : text_at[-1] + 1])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id_col, text)`` for every row of ``pages``.

    Character references are decoded, white space inside a block becomes one blank, blocks are
    joined in page order by an empty line.

    * Null or empty pages, and pages without text, give an empty text. Pages are read whole,
      whatever their length, and may be cut off anywhere. Repeated rows and null ids stay as
      they are. Other columns are ignored; an empty table gives an empty result.
    """
    schema = T.StructType(
        [T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("text", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(html.as_py()) for html in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=schema.names)

    return pages.select(id_col, html_col).mapInArrow(run, schema)
