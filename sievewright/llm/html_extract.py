"""Main-text extraction by minimum-cut labelling.

A page is cut into text blocks.  A small classifier over a block's place and form (article or menu
ancestors, class names, link density, sentence form) gives each block a cost for either label; these
become the capacities to the two terminals.  Neighbouring blocks and blocks that share a DOM
container are joined by smoothness edges.  The minimum cut separates content from boilerplate at
least total cost.

Blocks whose own cost outweighs all their edges keep their label in every minimum cut, so they are
merged into their terminal first (exact); max-flow runs on the few blocks that are left.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.durable import bounded_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*>", re.S)
_SPECIAL = re.compile("[>\"']")
_NAMED = {"class", "id", "role", "aria-label", "itemprop"}
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)

#: Fixed sets of HTML's elements.
RAW = {"script", "style", "template", "iframe", "textarea", "title", "select", "option", "noframes", "annotation", "annotation-xml", "desc", "metadata"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements of formulas and drawings, which may close themselves.
FOREIGN = {"math", "mi", "mn", "mo", "ms", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "mtext", "mspace", "mstyle", "mpadded", "mphantom", "menclose", "merror", "semantics", "svg", "g", "text", "tspan", "textpath", "path", "rect", "circle", "ellipse", "line", "polyline", "polygon", "defs", "use", "symbol", "marker", "lineargradient", "radialgradient", "stop", "clippath", "mask", "pattern", "image", "foreignobject"}
INLINE = FOREIGN | {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "noscript", "object", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Fixed words of class, id and role values; boilerplate and content.
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|side-?bar|aside|rail|widgets?|menu|nav|navbar|navigation|breadcrumbs?|toolbar|footer|foot|header|masthead|"
    r"comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|shar(?:e|ing)|social|follow|related|recommend\w*|more-?stories|trending|popular|newsletter|subscri\w*|signup|sign-?up|login|pop-?up|modal|overlay|"
    r"paywall|search|forms?|pagination|pager|tags?|copyright|legal|complementary|contentinfo|dialog|skip\w*|(?<![_-])hidden(?![_-])|sr-only|print-?only|outbrain|taboola|dropdown|languages?)(?=$|[\s_-])",
    re.I,
)
#: Parts that turn the word after them (a layout has or lacks a sidebar), and names of code listings.
_NEGATED = re.compile(r"(?:^|[_-])(?:no|not|non|has|is|with|without|hide|show)[_-]", re.I)
_LISTING = re.compile(r"languages?[_-](?!(?:switch\w*|select\w*|pick\w*|choos\w*|list|links?)$)[^_-]+$", re.I)
#: Costs of a class word that is all of a name or its last part, the first part of a class, or any other part.
_WHOLE, _FIRST, _PART = -8.0, -5.5, -2.5
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)$", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|main\w*|content|entry\w*|post-?(?:body|content|text)|story\w*|body-?(?:text|copy)|prose|text|post)(?=$|[\s_-])", re.I)
_PLACE = {"nav": -9.0, "aside": -9.0, "footer": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "button": -9.0, "header": -9.0, "fieldset": -9.0}


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), (m[2] or m[3] or m[4] or "").strip()) for m in _ATTRIBUTE.finditer(text)]


def name_cost(kind: str, name: str) -> float:
    """Soft cost of one class word, id or label: the article ancestor and the edges may outweigh it."""
    found = list(_BAD.finditer(name))
    if not found or _LISTING.match(name) or _NEGATED.search(name[: found[-1].start() + 1]):
        return 0.0
    if sum(m.end() - m.start() for m in found) == len(name) or (kind == "class" and found[-1].end() == len(name)):
        return _WHOLE
    return _FIRST if kind == "class" and found[0].start() == 0 else _PART


def _hidden(attributes: list[tuple[str, str]]) -> bool:
    """Whether a tag's own attributes hide it: ``hidden``, ``aria-hidden=true`` or ``display: none`` in its style."""
    for name, value in attributes:
        value = value.lower()
        if (name == "hidden" and value != "false") or (name == "aria-hidden" and value == "true") or (name == "style" and _NOT_SHOWN.search(htmllib.unescape(value))):
            return True
    return False


@dataclass
class Block:
    """One text block: its text, share of link text, container and the classifier's log-odds."""

    text: str
    links: float
    container: int
    odds: float


class _Element:
    """An open element, with what its blocks inherit: costs, whether it holds content, and their containers.

    ``title`` has the costs for headings, which stay with the content that a header stands in.
    """

    __slots__ = ("good", "holder", "number", "outer", "place", "soft", "tag", "title")

    def __init__(self, tag: str, number: int, parent: _Element | None, bad: float = 0.0, good: bool = False, soft: float = 0.0, header: bool = False):
        self.tag, self.number, self.good = tag, number, good
        form = bad if tag in ("form", "fieldset") else 0.0
        bad -= form
        self.place, self.soft = (bad, form), soft
        self.title = (self.place, good, soft)
        self.holder = self.outer = self
        if parent is not None:
            self.good |= parent.good
            outer_form = 0.0 if tag in ("article", "main") else parent.place[1]  # a form around an article is the page's
            self.place, self.soft = (min(bad, parent.place[0]), min(form, outer_form)), min(soft, parent.soft)
            place, in_title, title_soft = parent.title
            if header and in_title:
                self.title = parent.title
            else:
                title_form = 0.0 if tag in ("article", "main") else place[1]
                self.title = ((min(bad, place[0]), min(form, title_form)), in_title or good, min(soft, title_soft))
            if tag in INLINE:
                self.holder = parent.holder
            if tag in INLINE or tag in ("p", "li") or tag in HEADINGS:
                self.outer = parent.outer


class _Ends:
    """Where tags end: at the first ``>`` outside of quotes, or at the first one if the quotes don't close.

    Quotes that were followed in vain are remembered, so all tags of a page take time linear in it.
    """

    def __init__(self, page: str):
        self.page, self.vain, self.ahead = page, set(), -1

    def after(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose name ends at ``at``; there is one beyond it."""
        page = self.page
        first = page.find(">", at)
        if page.find('"', at, first) < 0 and page.find("'", at, first) < 0:
            return first
        seen = []
        if self.ahead < at:
            self.ahead = _SPECIAL.search(page, at).start()
        i = self.ahead
        while i not in self.vain:
            if page[i] == ">":
                return i
            seen.append(i)
            close = page.find(page[i], i + 1)
            m = _SPECIAL.search(page, close + 1) if close >= 0 else None
            if not m:
                break
            i = m.start()
        self.vain.update(seen)
        return first


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; scripts, styles, comments and hidden parts have none.

    A tag that the page's end cuts off is no text.  Takes time linear in the page.
    """
    found: list[tuple[str, float, int, str, float, bool, float]] = []
    root = _Element("", 0, None)
    stack, count = [root], 0
    opened: dict[str, int] = {}
    ends, last = _Ends(page), page.rfind(">")
    over_none: set[str] = set()
    parts: list[str] = []
    linked = total = 0
    in_link = 0
    at, end = 0, len(page)

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def close() -> None:
        nonlocal parts, linked, total
        text = "".join(parts) if total else ""
        text = " ".join((htmllib.unescape(text) if "&" in text else text).split())
        if text:
            e = stack[-1]
            tag = e.holder.tag
            (bad, form), good, soft = e.title if tag in HEADINGS else (e.place, e.good, e.soft)
            found.append((text, linked / total, e.outer.number, tag, min(bad, form), good, soft))
        parts, linked, total = [], 0, 0

    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            parts.append(piece)
            n = len(piece.strip())
            total += n
            linked += n * bool(in_link)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        if at > last:  # nothing ends this tag
            break
        stop = ends.after(at)
        inside, at = page[at:stop], stop + 1
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                in_link = max(0, in_link - (tag == "a"))
            if opened.get(tag):
                if tag not in INLINE:
                    close()
                    in_link = 0
                while stack[-1].tag != tag and (tag not in INLINE or stack[-1].tag in INLINE):
                    pop()
                if stack[-1].tag == tag:
                    pop()
            elif tag not in INLINE:
                close()
            continue
        if tag in RAW:
            if page[at - 2] != "/":
                over = None if tag in over_none else re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(page, at, last + 1)
                if not over:
                    over_none.add(tag)
                at = over.end() if over else (end if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag in ("br", "wbr", "img"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag in INLINE:
            in_link += tag == "a"
        else:
            close()
            in_link = 0
            if tag in CLOSES:
                while len(stack) > 1 and (stack[-1].tag in CLOSES[tag] or stack[-1].tag in INLINE):
                    pop()
            elif stack[-1].tag == "p" or stack[-1].tag in INLINE:  # a block ends an open paragraph
                while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in INLINE):
                    pop()
        if tag in VOID or (tag in FOREIGN and inside.endswith("/")):
            continue
        bad, good = _PLACE.get(tag, 0.0), tag in ("article", "main")
        soft, header = 0.0, tag == "header"
        if inside:
            attributes = _attributes(inside)
            for kind, value in attributes:
                if kind in _NAMED:
                    for name in value.split() if kind == "class" else ["-".join(value.split())]:
                        cost = name_cost(kind, name) if tag not in ("body", "html", "article", "main") else 0.0
                        soft = min(soft, cost)
                        header |= cost == _WHOLE and kind == "class" and bool(_HEADER.search(name))
                        good |= not cost and bool(_GOOD.search(name))
            if _hidden(attributes):
                bad = -20.0
        count += 1
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(_Element(tag, count, stack[-1], bad, good, soft, header))
    close()
    in_article = any(f[5] for f in found)
    return [Block(text, links, container, _odds(text, links, tag, bad, good, in_article, soft)) for text, links, container, tag, bad, good, soft in found]


def _odds(text: str, links: float, tag: str, bad: float, good: bool, in_article: bool, soft: float) -> float:
    """Log-odds that a block is content."""
    if bad:
        return bad
    odds = 0.5 - 3.0 * links + soft
    if good:
        odds += 3.0
    elif in_article:
        odds -= 4.0
    if tag in ("p", "blockquote", "pre", "dd", "td") or tag in HEADINGS:
        odds += 1.0
    elif tag == "li":
        odds -= 0.3
    words = text.count(" ") + 1
    if words >= 12:
        odds += 1.0
    if text[-1] in ".!?…”»\"'":
        odds += 0.5
    elif words < 4 and not good:
        odds -= 1.0
    return odds


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content side of a minimum cut: ``odds`` are terminal capacities by sign, ``edges`` smoothness."""
    near: list[list[tuple[int, float]]] = [[] for _ in odds]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label: list[bool | None] = [None] * len(odds)
    gain = list(odds)
    todo = deque(range(len(odds)))
    while todo:  # a block that outweighs its open edges is settled; its edges become terminal capacity
        i = todo.popleft()
        if label[i] is not None:
            continue
        open_weight = sum(w for j, w in near[i] if label[j] is None)
        if abs(gain[i]) >= open_weight:
            label[i] = gain[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    todo.append(j)
    left = [i for i, x in enumerate(label) if x is None]
    if left:
        side = _max_flow(left, gain, near)
        for i in left:
            label[i] = i in side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], gain: list[float], near: list[list[tuple[int, float]]]) -> set[int]:
    """Shortest augmenting paths from the content terminal; returns what it still reaches."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {i: {} for i in (source, sink, *nodes)}
    for i in nodes:
        cap[source][i], cap[i][source] = max(gain[i], 0.0), 0.0
        cap[i][sink], cap[sink][i] = max(-gain[i], 0.0), 0.0
        for j, w in near[i]:
            if j in cap:
                cap[i][j] = cap[i].get(j, 0.0) + w
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return set(came)
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= flow
            cap[b][a] += flow


def extract(page: str | None) -> str:
    """Main text of a page: its content blocks in page order, joined by one space."""
    found = blocks(page or "")
    edges = [(i, i + 1, 0.6 if a.container == b.container else 0.2) for i, (a, b) in enumerate(zip(found, found[1:], strict=False))]
    last: dict[int, int] = {}
    for i, x in enumerate(found):
        if x.container in last and last[x.container] != i - 1:
            edges.append((last[x.container], i, 0.4))
        last[x.container] = i
    return " ".join(x.text for x, content in zip(found, min_cut([x.odds for x in found], edges), strict=True) if content)


def main_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def run(html: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py()) for x in html], pa.string())

    return run(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html); other columns are ignored.

    Null or empty html, and pages without content, give an empty text.  Repeated rows are extracted
    each.  White space inside a block, no-break spaces included, becomes one space.  Row-wise, whole
    pages, no shuffle.
    """
    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", main_text(F.col("html")).alias("text"))
