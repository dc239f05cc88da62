"""Main text of web pages by tree scoring.

A page is read as a tolerant tree. Its text falls into blocks: runs between the
starts and ends of block elements. Each block passes points for its length and
commas to the elements around it, fewer the farther out, discounted by the share
of its text that is link text; article and main elements start with a bonus. The
element with the most points is the container, and an article or main element
around it takes its place. Beside it are kept headings, paragraphs, quotations and
figures, containers with a fifth of its points, and those whose blocks read like its
own (half its points a block); also an h1 farther out. Beside an article or main
element, paragraphs have to read like it, and containers need the fifth. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out, by element, by role and by the
words of class and id; so are lists that are mostly links.

Character references are decoded, white space in a block becomes one space, and
blocks are joined by one line break in page order. A null or empty page, and one
without text, gives the empty text. Unclosed, crossed and cut tags are allowed.
A page is read whole. Equal rows each give a row; columns of the input stay, and
the text is one column of a chosen name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import trim

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+\Z", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption head""".split())
_CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
           "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tr td th", "table"), "option": ("option", "select datalist")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_CLOSES_P = _BLOCK - frozenset("body html head li dd dt option tr td th tbody thead tfoot caption".split())

_DROP = frozenset("nav footer aside form button select datalist menu dialog object embed svg canvas audio video applet fieldset head input".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_DROP_NAMES = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar ad ads advert adverts advertisement advertising
    sponsor sponsored cookie cookies gdpr popup modal newsletter subscribe login comment comments disqus respond pagination pager widget toolbar""".split())
#: Words that also name subjects: they tell only where the rest of the name is of these or of words for boxes.
_DOUBTFUL = frozenset("""header banner aside promo promotion consent notice notices overlay signup subscription share sharing social replies reply
    related recommended recommendations tracking""".split())
_BOXES = frozenset("""area article articles bar block bottom box buttons col column container content footer global group icons inner item items js left links list main
    media network news outer page panel post posts reading right row section site stories top wrap wrapper""".split())
_COMMENTS = frozenset("comment comments disqus respond replies reply".split())
_AROUND = frozenset("html body main".split())
_INNER = frozenset("p pre td th li dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
_PROSE = frozenset("blockquote figure details".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_LISTS = frozenset("ul ol dl table menu".split())


class Element:
    __slots__ = ("tag", "parent", "out", "link", "points", "prose", "chars", "linked", "links", "blocks")

    def __init__(self, tag: str, parent: Element | None, out: bool, link: bool):
        self.tag, self.parent, self.out, self.link = tag, parent, out, link
        self.points = 25.0 if tag in ("article", "main") else 0.0
        self.prose = 0.0
        self.chars = self.linked = self.links = self.blocks = 0


def left_out(tag: str, attributes: str, inside: Element) -> bool:
    """Whether an element is no part of a main text, by its name and attributes."""
    if tag in _DROP:
        return True
    if tag == "header" and not within(inside, "article"):
        return True
    if not attributes or tag in _AROUND:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value.lower() in _DROP_ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _NAME.findall(one)]
                if not words or words[0] in ("has", "with", "no", "without"):
                    continue
                if not (_COMMENTS if tag == "article" else _DROP_NAMES).isdisjoint(words):
                    return True
                if tag != "article" and not _DOUBTFUL.isdisjoint(words) and (_DOUBTFUL | _BOXES).issuperset(words):
                    return True
    return False


def within(e: Element | None, tag: str) -> bool:
    while e is not None:
        if e.tag == tag:
            return True
        e = e.parent
    return False


class Page:
    """The elements and blocks of a page; a block is its element, text and link characters."""

    def __init__(self, html: str):
        self.root = Element("html", None, False, False)
        self.elements, self.blocks = [self.root], []
        self.at, self.pieces, self.linked = self.root, [], 0
        self.read(html)
        self.flush()

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.at, text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.at.out:
            t = unescape(raw) if "&" in raw else raw
            self.pieces.append(t)
            if self.at.link:
                self.linked += len(t.strip())

    def close(self, to: Element) -> None:
        """Leave ``to`` and all that is open in it."""
        self.flush()
        self.at = to.parent or self.root

    def find(self, tags, stop=frozenset()) -> Element | None:
        """The innermost open element of these, not beyond one of ``stop``."""
        e = self.at
        while e is not self.root and e is not None:
            if e.tag in tags:
                return e
            if e.tag in stop:
                return None
            e = e.parent
        return None

    def start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self.flush()
        if tag in _CLOSES_P and (p := self.find(("p",), ("td", "th", "table", "button", "article", "body"))):
            self.close(p)
        if tag in _CLOSES:
            closes, stop = _CLOSES[tag]
            last = None
            e = self.at
            while e is not self.root and e.tag not in stop:
                if e.tag in closes:
                    last = e
                e = e.parent
            if last:
                self.close(last)
        if tag in _VOID:
            self.pieces.append(" ") if tag in ("br", "hr") else None
            return
        if tag in ("html", "body") and (tag == "html" or within(self.at, "body")):
            return
        if tag == "body" and (head := self.find(("head",))):
            self.close(head)
        out = self.at.out or left_out(tag, attributes, self.at)
        if out and not self.at.out:
            self.flush() if tag in _BLOCK else None
        e = Element(tag, self.at, out, self.at.link or tag == "a")
        if tag == "a":
            up = self.at
            while up is not None:
                up.links += 1
                up = up.parent
        self.elements.append(e)
        self.at = e

    def end(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        elif e := self.find((tag,), frozenset() if tag in _BLOCK else _BLOCK):
            if tag in _BLOCK:
                self.close(e)
            else:
                self.at = e.parent
        elif tag in _BLOCK:
            self.flush()

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at:m.start()])
            at = m.end()
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self.end(tag)
                continue
            if tag in _RAW:
                if tag in _BLOCK:
                    self.flush()
                if not attributes.rstrip().endswith("/"):
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    at = stop.end() if stop else n
                continue
            self.start(tag, attributes)
            if attributes.endswith("/") and tag not in _BLOCK and tag not in _VOID and self.at.tag == tag:
                self.at = self.at.parent


def points_of(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    through = _INNER | _PROSE
    for e, text, linked in page.blocks:
        points = points_of(text, linked)
        up, level = e, 1
        while up is not None:
            if up.tag not in through:
                up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
                level += 1
            up.prose += points
            up.blocks += 1
            up.chars += len(text)
            up.linked += linked
            up = up.parent
    scored = [e for e in page.elements if e.chars and not e.out and e.tag not in through and e.tag not in ("tr", "tbody", "thead", "tfoot")]
    if not scored:
        return ""
    value = {id(e): e.points * (1 - e.linked / e.chars) for e in scored}
    best = max(scored, key=lambda e: value[id(e)])
    up = best
    while up is not None:
        if up.tag in ("article", "main") and up.chars:
            best = up
            break
        up = up.parent
    above = set()
    up = best.parent
    while up is not None:
        above.add(id(up))
        up = up.parent
    marked = best.tag in ("article", "main")
    alike = lambda prose, blocks: 2 * prose * best.blocks >= best.prose * blocks
    chosen = {id(best)}
    for e in page.elements:
        if e.out or not e.chars or e is best or id(e) in above or e.tag in _LISTS or 4 * e.linked >= e.chars:
            continue
        if e.parent is not best.parent:
            keep = e.tag == "h1" and not marked and id(e.parent) in above
        elif e.tag in through:
            keep = not marked or e.tag in _HEADINGS or alike(e.prose, e.blocks)
        else:
            keep = 5 * value[id(e)] >= value[id(best)] or not marked and alike(e.prose, e.blocks)
        if keep:
            chosen.add(id(e))
    out = []
    for e, text, linked in page.blocks:
        if e is best.parent and not marked and alike(points_of(text, linked), 1):
            out.append(text)
            continue
        near = e
        while near is not None:
            if near.tag in _LISTS and near.links > 2 and 2 * near.linked > near.chars:
                break
            if id(near) in chosen:
                out.append(text)
                break
            near = near.parent
    return "\n".join(out)


def extract(pages: DataFrame, out: str, html: str = "html") -> DataFrame:
    """``pages`` with the main text as ``out``."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py()) for x in batch], pa.string())
        trim()

    return pages.withColumn(out, texts(F.col(html)))
