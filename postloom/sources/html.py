"""A small page reader for the extraction jobs: elements, simple selectors, text and markup."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Callable, Iterable
from functools import reduce
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

from postloom.functions.text import WS_CHARS

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements whose end tag may be left out before a sibling of the same kind.
SIBLINGS = {
    "li": {"li"},
    "p": {"p"},
    "tr": {"tr"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
}


class Element:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def descendants(self):
        stack = [p for p in reversed(self.parts) if isinstance(p, Element)]
        while stack:
            node = stack.pop()
            yield node
            if node.parts:
                stack += [p for p in reversed(node.parts) if isinstance(p, Element)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.parts))
        while stack:
            part = stack.pop()
            if isinstance(part, Element):
                stack.extend(reversed(part.parts))
            elif isinstance(part, str):
                out.append(part)
        return "".join(out)

    def inner_html(self) -> str:
        out, stack = [], list(reversed(self.parts))
        raw = self.tag in ("script", "style")
        while stack:
            part = stack.pop()
            if isinstance(part, tuple):
                out.append(part[0])
            elif isinstance(part, str):
                out.append(part if raw else _escape(part))
            else:
                attrs = "".join(f' {k}="{_escape(v or "", True)}"' for k, v in part.attrs.items())
                out.append(f"<{part.tag}{attrs}>")
                if part.tag not in VOID:
                    stack.append((f"</{part.tag}>",))
                    if part.tag in ("script", "style"):
                        stack.append((part.text(),))
                    else:
                        stack.extend(reversed(part.parts))
        return "".join(out)


def _escape(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("\u00a0", "&nbsp;")
    return text.replace('"', "&quot;") if attribute else text.replace("<", "&lt;").replace(">", "&gt;")


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.node = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.node.tag in SIBLINGS.get(tag, ()):
            self.node = self.node.parent
        child = Element(tag, dict(reversed(attrs)), self.node)
        self.node.parts.append(child)
        if tag not in VOID:
            self.node = child

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.node
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.node = node.parent

    def handle_data(self, data):
        self.node.parts.append(data)

    def handle_comment(self, data):
        self.node.parts.append((f"<!--{data}-->",))


_CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9A-Fa-f]+)|(?P<name>[A-Za-z][A-Za-z0-9]*));")


class _ClosedReader(_Reader):
    """Reads ``&amp`` without its semicolon as text. A character the page does not hold stands for the ``&`` of such
    text while the page is read."""

    def __init__(self, mark):
        super().__init__()
        self.mark = mark

    def handle_starttag(self, tag, attrs):
        plain = lambda x: x and x.replace(self.mark, "&")
        super().handle_starttag(plain(tag), [(plain(k), plain(v)) for k, v in attrs])

    def handle_data(self, data):
        super().handle_data(data.replace(self.mark, "&"))

    def handle_comment(self, data):
        super().handle_comment(data.replace(self.mark, "&"))


def _is_closed(html: str, at: int) -> bool:
    found = _CLOSED.match(html, at)
    return found is not None and (found["name"] is None or found["name"] + ";" in html5)


# Markup that can be cut up by one expression: tags whose attributes all have a value in quotes, each with the text after it.
_ATTRIBUTE = r"""[ \t\n\r\f]+([A-Za-z][A-Za-z0-9_-]*)=(?:"([^"<>]*)"|'([^'<>]*)')"""
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_TAGS = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9-]*)((?:{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*)[ \t\n\r\f]*>([^<]*)")
# Elements whose content is not markup, in some version of the library's reader.
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
_attribute_text = getattr(html.parser, "_unescape_attrvalue", unescape)


_known_attributes: dict[str, dict[str, str]] = {}


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag. Those of few letters recur all over a page, so they are kept; nobody changes them."""
    if (known := _known_attributes.get(text)) is not None:
        return known
    found = _ATTRIBUTES.findall(text)
    found.reverse()  # the first of a name counts
    read = {name.lower(): _attribute_text(v) if "&" in (v := one or other) else v for name, one, other in found}
    if len(text) <= 40:
        if len(_known_attributes) >= 4096:
            _known_attributes.clear()
        _known_attributes[text] = read
    return read


def _read_plain(page: str) -> Element | None:
    """What :class:`_Reader` makes of a page, in a fraction of its time; None if the page holds anything but
    plain tags and text."""
    found = _TAGS.findall(page)
    if page.count("<") != len(found):  # no tag holds a second one, so all of the page is in the pieces
        return None
    root = node = Element("", {}, None)
    if lead := page[: page.index("<")] if found else page:
        root.parts.append(unescape(lead))
    for closes, tag, attrs, text in found:
        tag = tag.lower()
        if closes:
            ended = node
            while ended.parent is not None and ended.tag != tag:
                ended = ended.parent
            node = ended.parent or node
        elif tag in RAW:
            return None
        else:
            if node.tag in SIBLINGS.get(tag, ()):
                node = node.parent
            child = Element(tag, _attributes(attrs) if attrs else {}, node)
            node.parts.append(child)
            if tag not in VOID:
                node = child
        if text:
            node.parts.append(unescape(text) if "&" in text else text)
    return root


def parse(html: str | None, closed_references: bool = False) -> Element:
    """The page as elements. Character references may lack their semicolon, as in browsers; with
    ``closed_references`` those that do are left as they are written."""
    html = html or ""
    if not (closed_references and "&" in html) and (root := _read_plain(html)) is not None:
        return root
    reader = _Reader()
    if closed_references and "&" in html:
        mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in html)
        reader = _ClosedReader(mark)
        html = re.sub("&", lambda m: "&" if _is_closed(html, m.start()) else mark, html)
    reader.feed(html)
    reader.close()
    return reader.root


_STEP = re.compile(
    r"(?P<tag>[A-Za-z][A-Za-z0-9-]*|\*)"
    r"|\.(?P<cls>[\w-]+)"
    r"|#(?P<id>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[\^*]?=)(?P<quote>['\"]?)(?P<value>.*?)(?P=quote))?\]"
    r"|:has-text\((?P<tq>['\"])(?P<has>.*?)(?P=tq)\)"
)


def selector_error(selector: str | None) -> str | None:
    """Why a selector cannot be used; None if it can."""
    if not selector or not selector.strip():
        return "no card selector"
    try:
        compiled(selector)
    except ValueError as error:
        return str(error)
    return None


Test = Callable[[Element], bool]
_compiled: dict[str, Test] = {}


def _test(t: dict[str, str]) -> Test:
    """One test of a compound."""
    if "tag" in t:
        name, low = t["tag"], t["tag"].lower()
        return (lambda node: True) if name == "*" else lambda node: node.tag == low or node.tag == name
    if "cls" in t:
        cls = t["cls"]
        return lambda node: cls in (names := node.attrs.get("class") or "") and cls in names.split()
    if "id" in t:
        name = t["id"]
        return lambda node: node.attrs.get("id") == name
    if "has" in t:
        text = t["has"].lower()
        return lambda node: text in node.text().lower()
    attr, want, op = t["attr"].lower(), t.get("value", ""), t.get("op")
    if op is None:
        return lambda node: attr in node.attrs
    if op == "=":
        return lambda node: attr in node.attrs and (node.attrs[attr] or "") == want
    if op == "^=":
        return lambda node: bool(want) and (node.attrs.get(attr) or "").startswith(want)
    return lambda node: bool(want) and want in (node.attrs.get(attr) or "")


def _compound(tests: list[Test]) -> Test:
    if not tests:
        return lambda node: True
    return reduce(lambda one, other: lambda node: one(node) and other(node), tests)


def _chain(compounds: list[Test]) -> Test:
    """The last compound holds for the element, those before it for elements around it."""
    *around, own = compounds
    if not around:
        return own

    def holds(node: Element) -> bool:
        if not own(node):
            return False
        for test in reversed(around):
            node = node.parent
            while node is not None and not test(node):
                node = node.parent
            if node is None:
                return False
        return True

    return holds


def compiled(selector: str) -> Test:
    """One test for a comma list of descendant chains of compounds, each compound a list of tests."""
    if selector in _compiled:
        return _compiled[selector]
    chains = []
    for chain in re.split(r",(?![^\[(]*[\])])", selector):
        compounds = []
        for word in re.split(r"\s+(?![^\[(]*[\])])", chain.strip()):
            tests, at = [], 0
            while at < len(word):
                found = _STEP.match(word, at)
                if not found:
                    raise ValueError(f"unsupported selector: {selector}")
                tests.append(_test({k: v for k, v in found.groupdict().items() if v is not None}))
                at = found.end()
            compounds.append(_compound(tests))
        chains.append(_chain(compounds))
    test = reduce(lambda one, other: lambda node: one(node) or other(node), chains)
    _compiled[selector] = test
    return test


def first_of(nodes: Iterable[Element], test: Test | None) -> Element | None:
    """The first of some elements that passes."""
    if test is not None:
        for node in nodes:
            if test(node):
                return node
    return None


def select(root: Element, selector: str):
    """Descendants that match, in document order."""
    return filter(compiled(selector), root.descendants())


def first(root: Element, selector: str | None) -> Element | None:
    return first_of(root.descendants(), compiled(selector)) if selector else None


def trimmed(node: Element | None, default=None):
    return default if node is None else node.text().strip(WS_CHARS)
