"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its root-to-leaf path of block
elements. Text length and punctuation outside links are added up over all blocks of
a path and divided by their number. Along the page the two ratios of each block's
path are smoothed with Gaussian weights and fused with the path's own ratios by their
geometric mean; a path whose mean fused ratio reaches ``spread`` standard deviations of the page is a
content path, and its blocks are the content nodes (but for blocks that are links
for the greater part).

The article is the deepest container that holds ``share`` of the content nodes' text,
or the article or main element around it; the last h1 before it is its title. Of its blocks the content nodes stay, and what belongs to them by structure: titles,
lists, tables, quotations and short blocks that no wrapper (a generic container
without any content node) parts from the article. Blocks that are mostly links stay
between content nodes only.

Markup rules out what is no article text by its name: menus (an open one ends where an
article begins), footers, sidebars, scripts, styles and hidden elements by tag, role
or attribute; page headers but for an article's own title; and forms and elements with
a class or id that names advertising, notices, comments and the like as a whole (``related-posts``, not
``related-work`` or ``has-sidebar``), unless such an element holds three
blocks and more text than all that is not ruled out (for reader comments: unless
there is no other text). Inside such a wrapper the same holds for further ones, so a
form around the whole page hides nothing but what it would hide without the form.

Every page is worked off where it is read, nothing is shuffled; a task holds one
Arrow slice and one page's blocks, and works in time linear in the page.

Cases: null or empty html gives an empty text, so does a page without content;
unclosed, misnested and cut-off markup is read as far as it goes; repeated rows are
extracted each; null ids and urls are kept; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Element and attribute names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
NOT_TEXT = frozenset("nav footer aside button select option optgroup datalist fieldset dialog menu template object svg math canvas audio video map head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WRAPPERS = frozenset("div section article main center details header hgroup".split())
CONTAINERS = WRAPPERS | {"body", "html", "td"}
#: Words of classes and ids that name no article text, alone or with others of these and of PARTS.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion promoted banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "comment comments reply replies respond disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search "
    "share sharing social related recommended widget toolbar pagination pager skip hidden".split()
)
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
#: Of these a name at the beginning or end of a longer class is enough.
CLEAR = frozenset("advert adverts advertisement adsense sidebar navbar navigation breadcrumb breadcrumbs footer comments disqus cookie cookies newsletter popup".split())
PARTS = frozenset("site page top bottom left right main global box bar block list item items link links post posts article articles story stories button buttons icon icons container wrapper wrap area section form widget widgets content text thread slot unit inner outer side col column".split())
NEGATION = frozenset("has no with without not is non".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
ENDED_BY = {tag: frozenset({"p"} | {k for k, v in ENDS.items() if tag in v}) for tag in {t for v in ENDS.values() for t in v}}
SCOPE = frozenset("html body table ul ol dl article main section div td th".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>?", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?、。，！？…¿¡]")


def named(value: str) -> int:
    """Whether a class or id (lower case) names advertising, navigation and the like (1) or comments (3) as a whole."""
    found = 0
    for token in value.split():
        parts = [p for p in re.split(r"[^a-z]+", token) if p]
        if not parts or NAMES.isdisjoint(parts) or not NEGATION.isdisjoint(parts):
            continue
        if all(p in NAMES or p in PARTS for p in parts) or parts[0] in CLEAR or parts[-1] in CLEAR:
            found = max(found, 1 if COMMENTS.isdisjoint(parts) else 3)
    return found


def apart(tag: str, attributes: str) -> int:
    """2 if an element is no article text by its tag, role or state, 1 or 3 (comments) if its class or id says so or it is a form, else 0."""
    if tag in NOT_TEXT:
        return 2
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 1 if tag == "form" else 0
    found = 1 if tag == "form" else 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            kind = named(value) if tag not in ("html", "body", "main") else 0
            if tag != "article" or kind == 3:
                found = max(found, kind)
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return 2
    return found


class Element:
    """An open element: tag, number, path, whether it is ruled out for good, the innermost element named as no text, and where it stands."""

    __slots__ = ("anchor", "header", "hidden", "main", "name", "number", "path", "tag")

    def __init__(self, tag, number, path, hidden, name, header, main, anchor):
        self.tag, self.number, self.path, self.hidden, self.name, self.header, self.main, self.anchor = tag, number, path, hidden, name, header, main, anchor


class Block:
    """A block's text, path, link characters, innermost block element, and the innermost element (or 0) that is named as no text."""

    __slots__ = ("element", "link", "name", "path", "text")

    def __init__(self, text, path, link, element, name):
        self.text, self.path, self.link, self.element, self.name = text, path, link, element, name


class Page:
    """Blocks of a page in order; for each element its parent (a smaller number) and tag; the elements of comments; for each element named as no text the one around it (or 0)."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.tags = [0], [""]
        self.comments: set[int] = set()
        self.within: dict[int, int] = {}
        self._paths: dict[tuple[int, str], int] = {}
        self._stack = [Element("", 0, 0, False, 0, False, False, False)]
        self._open: dict[str, int] = {}
        self._parts: list[str] = []
        self._links = 0
        self._first: Element | None = None
        self._read(page)

    def _flush(self) -> None:
        if self._parts and (text := " ".join("".join(self._parts).split())):
            e = self._first
            self.blocks.append(Block(text, e.path, min(self._links, len(text)), e.number, e.name))
        self._parts, self._links, self._first = [], 0, None

    def _say(self, text: str) -> None:
        top = self._stack[-1]
        if not top.hidden and text:
            text = html.unescape(text) if "&" in text else text
            if self._first is None and text.strip():
                self._first = top
            self._parts.append(text)
            if top.anchor:
                self._links += len(text)

    def _close(self, at: int) -> None:
        if any(e.tag not in INLINE for e in self._stack[at:]):
            self._flush()
        for e in self._stack[at:]:
            self._open[e.tag] -= 1
        del self._stack[at:]

    def _end(self, tag: str) -> None:
        if not self._open.get(tag):
            if tag not in INLINE:
                self._flush()
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                self._close(i)
                return
            if tag in INLINE and self._stack[i].tag not in INLINE:
                return

    def _begin(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag in ("article", "main") and self._open.get("nav"):  # a menu that was left open
            self._end("nav")
        if tag not in INLINE:
            self._flush()
            left = {t for t in ENDED_BY.get(tag, ("p",)) if self._open.get(t)}
            i = len(stack) - 1
            while left and i > 0 and stack[i].tag not in SCOPE - left:
                if stack[i].tag in left:
                    left = {t for t in left if t != stack[i].tag}
                    self._close(i)
                i -= 1
        top = stack[-1]
        header, main = top.header or tag == "header", top.main or tag in ("article", "main")
        why = apart(tag, attributes)
        # a page header goes, but for the title of an article
        hidden = top.hidden or why == 2 or tag == "header"
        if tag in HEADINGS and header and main and why != 2 and top.tag != "" and not any(e.hidden and not e.header for e in stack[-8:]):
            hidden = False
        self.parent.append(top.number)
        self.tags.append(tag)
        if why == 3:
            self.comments.add(len(self.tags) - 1)
        number = len(self.tags) - 1
        if why in (1, 3):
            self.within[number] = top.name
        path = top.path if tag in INLINE else self._paths.setdefault((top.path, tag), len(self._paths) + 1)
        stack.append(Element(tag, number, path, hidden, number if why in (1, 3) else top.name, header, main, top.anchor or tag == "a"))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            if m is None:
                self._say(page[at:])
                break
            if m.start() > at:
                self._say(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(page, at)
                at = end.start() if end else n
                if end:
                    at = page.find(">", at) + 1 or n
            elif tag in VOID:
                if tag in ("br", "hr"):
                    self._flush()
            elif tag not in ("svg", "math") or not (m[3] or "").rstrip().endswith("/"):
                self._begin(tag, m[3] or "")
        self._flush()


def fused_ratios(found: list[Block], radius: int = 2) -> list[float]:
    """For each block the geometric mean of its path's text and punctuation ratios, as they are and smoothed along the page."""
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += len(b.text) - b.link
        s[1] += len(PUNCTUATION.findall(b.text)) if b.link < len(b.text) else 0
        s[2] += 1
    series = [(sums[b.path][0] / sums[b.path][2], sums[b.path][1] / sums[b.path][2] + 0.1) for b in found]
    weights = [math.exp(-d * d / 2) for d in range(radius + 1)]
    out = []
    for i, (own_text, own_marks) in enumerate(series):
        text = marks = total = 0.0
        for j in range(max(0, i - radius), min(len(series), i + radius + 1)):
            w = weights[abs(i - j)]
            text += w * series[j][0]
            marks += w * series[j][1]
            total += w
        out.append((text / total * (marks / total) * own_text * own_marks) ** 0.25)
    return out


def content_paths(found: list[Block], spread: float, scores=fused_ratios) -> set[int]:
    """The paths whose mean fused ratio reaches ``spread`` standard deviations of all blocks' ratios."""
    score = scores(found)
    mean = sum(score) / len(score)
    bar = spread * math.sqrt(sum((x - mean) ** 2 for x in score) / len(score))
    sums: dict[int, list[float]] = {}
    for b, x in zip(found, score, strict=True):
        s = sums.setdefault(b.path, [0.0, 0.0])
        s[0] += x
        s[1] += 1
    return {p for p, (x, n) in sums.items() if x >= bar * n}


def wrappers(page: Page) -> set[int]:
    """Elements named as no text that hold three blocks and more text than all that is not ruled out (or all text there is), in such elements only."""
    own: dict[int, list[int]] = {e: [0, 0] for e in page.within}
    plain = 0
    for b in page.blocks:
        if b.name:
            own[b.name][0] += len(b.text)
            own[b.name][1] += 1
        else:
            plain += len(b.text)
    inner = {e: list(x) for e, x in own.items()}
    for e in sorted(page.within, reverse=True):
        if up := page.within[e]:
            inner[up][0] += inner[e][0]
            inner[up][1] += inner[e][1]
    whole: set[int] = set()
    for e in sorted(page.within):  # outer ones first
        up = page.within[e]
        if up and up not in whole:
            continue
        rest = own[up][0] if up else plain
        n, k = inner[e]
        if n > rest and (not rest or k > 2 and e not in page.comments):
            whole.add(e)
    return whole


def content(page: Page, spread: float = 0.6, share: float = 0.8, scores=fused_ratios) -> list[Block]:
    """The blocks of the main text: see the module's text."""
    whole = wrappers(page)
    found = [b for b in page.blocks if not b.name or b.name in whole]
    if not found:
        return []
    paths = content_paths(found, spread, scores)
    chosen = [b for b in found if b.path in paths and 2 * b.link <= len(b.text)]
    if not chosen:
        return []
    held = [0] * len(page.tags)
    for b in chosen:
        held[b.element] += len(b.text)
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    root = max(e for e in range(len(held)) if held[e] >= share * held[0])  # such elements lie on one path, later numbers are deeper
    while root and page.tags[root] not in CONTAINERS:
        root = page.parent[root]
    up = root
    while up and page.tags[up] not in ("article", "main"):
        up = page.parent[up]
    root = up or root
    inside, parted = [False] * len(held), [False] * len(held)
    inside[root] = True
    for e in range(root + 1, len(held)):
        up = page.parent[e]
        inside[e] = inside[up]
        parted[e] = parted[up] or page.tags[e] in WRAPPERS and not held[e]
    first, last = chosen[0], chosen[-1]
    low, high = found.index(first), len(found) - 1 - found[::-1].index(last)
    title = max((i for i in range(low) if page.tags[found[i].element] == "h1"), default=-1)
    out = []
    for i, b in enumerate(found):
        if i == title or inside[b.element] and (2 * b.link <= len(b.text) and (b.path in paths or not parted[b.element]) or low < i < high and not parted[b.element]):
            out.append(b)
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    return "\n".join(b.text for b in content(Page(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
