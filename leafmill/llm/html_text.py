"""Main-text extraction from HTML by tree scoring.

A page is read into a tree. Each paragraph is worth points for its length and its commas;
it passes them to its parent, and half of them to its grandparent. A container's score is
discounted by its link density. The best container is the article; of its siblings those
stay that score well enough, or are blocks of running text. Inside, menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are left out.

Time is linear in the page: open elements are found by name, subtrees are summed up once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import quoted, small_batches, text_of

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea title select canvas audio video noembed noframes".split())
RAW_TEXT = frozenset("script style textarea title iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav aside footer form button input head menu dialog fieldset".split())
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html".split())
SCOPED = frozenset("table td th caption button object body html".split())
#: Words in a class, id or role that mark what is not the article.
CLUTTER = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising advertorial breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright"
    " disclaimer disqus gdpr login menu modal nav navbar navigation newsletter outbrain pager pagination paywall popup promo promoted recommended related replies reply"
    " respond search share sharing shoutbox sidebar sidebars signup skyscraper social sponsor sponsored subscribe subscription taboola tagcloud teaser toolbar tracking"
    " complementary contentinfo".split()
)
#: Such words that mark it only where nothing of LIKELY stands beside, and never on TEXTUAL elements.
DOUBTFUL = frozenset("alert banner dialog footer form header masthead notice print sign tags widget".split())
LIKELY = frozenset("article body content entry hentry main page post story text blog".split())
#: Words that say nothing of what they stand beside: with others than these a name isn't clutter's.
PLAIN = frozenset(
    "area bar block blocks bottom box button buttons card cards count feed global group head icon icons inner item items js left link links list message module nav outer"
    " panel policy posts region right section sections side site slot stories sub thread title top unit up us view wide".split()
)
#: Layout words: beside them a name says what a container holds, not what it is.
LAYOUT = frozenset("has with no without container wrapper layout grid row col column".split())
#: Elements that hold text of their own.
TEXTUAL = frozenset("p pre blockquote table dl ol ul figure figcaption h1 h2 h3 h4 h5 h6".split())
_RIGHTS = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.IGNORECASE)
_POSITIVE = {"article": 25, "main": 20, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3}
_NEGATIVE = {"ol": -3, "ul": -3, "dl": -3, "li": -3, "dd": -3, "dt": -3, "form": -3, "address": -3, "th": -5}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_UNQUOTED = re.compile(r"""[^>"']*""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.IGNORECASE) for n in RAW_TEXT}
_ATTR = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_COMMA = re.compile(r"[,،、，]")


class Node:
    """marks: words of class, id and role; clutter: whether one of their names is clutter's."""

    __slots__ = ("name", "marks", "clutter", "parent", "kids", "score", "hidden", "holds", "inside", "gone", "size", "linked")

    def __init__(self, name: str, parent: Node | None, marks: frozenset[str] = frozenset(), clutter: bool = False, hidden: bool = False):
        self.name, self.parent, self.marks, self.clutter, self.hidden = name, parent, marks, clutter, hidden
        self.kids: list[Node | str] = []
        self.score: float | None = None
        self.holds = False  # an article or main element below
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main"))
        self.gone: bool | None = None
        self.size = self.linked = 0  # length of the text below, and of that in links


def _attributes(raw: str) -> tuple[frozenset[str], bool, bool]:
    """Words of class, id and role; whether a name among them is clutter's; whether the element is hidden."""
    marks: set[str] = set()
    hidden = clutter = False
    for name, a, b, c in _ATTR.findall(raw):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
        elif name in ("class", "id", "role"):
            for one in value.split():
                parts = {p.lower() for p in _PARTS.findall(one)}
                marks |= parts
                clutter |= bool(parts & CLUTTER) and parts <= CLUTTER | DOUBTFUL | PLAIN | LIKELY | LAYOUT
    return frozenset(marks), clutter, hidden


class _Open:
    """The open elements, and where in their stack each name stands."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        i = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.name, []).append(i)
        if node.name in BLOCK:
            self.blocks.append(i)

    def close(self, i: int) -> None:
        """Close the element at place i and all inside."""
        while len(self.stack) > i:
            name = self.stack.pop().name
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def last(self, names: frozenset[str] | tuple[str, ...]) -> int:
        """The place of the innermost of some names, 0 if none is open."""
        return max((at[-1] for n in names if (at := self.at.get(n))), default=0)

    def close_inside(self, name: str, within: frozenset[str] | tuple[str, ...]) -> None:
        """Close the innermost element of a name, unless one of within is open inside it."""
        i = self.last((name,))
        if i > self.last(within):
            self.close(i)


#: Elements that end one of the same kind before them, and what they don't reach beyond.
_ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("td", "th", "tr"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Where the > of a tag is, quoted values passed over; -1 if there is none. missing: quotes that don't come any more."""
    while True:
        at = _UNQUOTED.match(page, at).end()
        if at >= len(page):
            return -1
        c = page[at]
        if c == ">":
            return at
        end = -1 if c in missing else page.find(c, at + 1)
        if end < 0:
            missing.add(c)
            return page.find(">", at)
        at = end + 1


def parse(page: str) -> Node:
    """The page's tree; unclosed and misnested elements end as browsers end them."""
    root = Node("html", None)
    open_ = _Open(root)
    at, missing = 0, set()

    def text(a: int, b: int) -> None:
        if b > a:
            t = page[a:b]
            open_.stack[-1].kids.append(html.unescape(t) if "&" in t else t)

    while True:
        begin = page.find("<", at)
        if begin < 0:
            text(at, len(page))
            return root
        c = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            text(at, begin)
            end = _COMMENT_END.search(page, begin + 4)
            at = end.end() if end else len(page)
            continue
        name = _NAME.match(page, begin + 2 if c == "/" else begin + 1)
        if not name and c not in ("!", "?"):
            text(at, begin + 1)  # a < that begins nothing
            at = begin + 1
            continue
        end = page.find(">", begin) if c in ("!", "?", "/") else _tag_end(page, name.end(), missing)
        if end < 0:
            text(at, len(page))
            return root
        text(at, begin)
        at = end + 1
        if c in ("!", "?"):
            continue
        raw, name = page[name.end() : end], name[0].lower()
        if c == "/":
            i = open_.last((name,))
            limit = open_.last(SCOPED) if name == "p" else 0
            if i and i > limit and (name in BLOCK or not open_.blocks or open_.blocks[-1] < i):  # an inline end tag doesn't close a block
                open_.close(i)
            continue
        if name in ("html", "body"):
            continue
        if name in ENDS_P:
            open_.close_inside("p", SCOPED)
        same, within = _ENDS.get(name, ((), ()))
        for x in same:
            open_.close_inside(x, within if x != "tr" else ("table",))
        if name in RAW_TEXT and not raw.endswith("/"):
            stop = _RAW_END[name].search(page, at)
            end = page.find(">", stop.end()) if stop else -1
            at = end + 1 if end >= 0 else len(page)
            continue
        marks, clutter, hidden = _attributes(raw) if raw.strip() else (frozenset(), False, False)
        here = open_.stack[-1]
        node = Node(name, here, marks, clutter, hidden)
        here.kids.append(node)
        if name in ("article", "main"):
            up = here
            while up is not None and not up.holds:
                up.holds, up = True, up.parent
        if name not in VOID and not raw.endswith("/"):
            open_.push(node)


def _unlikely(n: Node) -> bool:
    """Whether the element isn't part of an article, wherever it stands. Asked of whole trees only."""
    if n.gone is None:
        n.gone = _is_unlikely(n)
    return n.gone


def _is_unlikely(n: Node) -> bool:
    if n.hidden or n.name in DROPPED or n.name in RAW:
        return True
    if n.name == "header":
        return not n.inside
    if n.holds or n.name in ("body", "html", "article", "main") or not n.marks:
        return False
    if n.clutter:
        return not n.marks & LAYOUT
    return bool(n.marks & DOUBTFUL) and not n.marks & LIKELY and n.name not in TEXTUAL


def _up(n: Node) -> Iterator[Node]:
    while n.parent is not None:
        n = n.parent
        yield n


def _walk(root: Node) -> Iterator[Node]:
    """Elements in page order, without what _unlikely() leaves out. Not recursive: pages nest deeply."""
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += [k for k in reversed(n.kids) if isinstance(k, Node) and not _unlikely(k)]


def _texts(root: Node) -> Iterator[str]:
    """The texts below root."""
    todo: list[Node | str] = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            yield n
        elif n is root or not _unlikely(n):
            todo += reversed(n.kids)


def _sum_up(root: Node) -> None:
    """Set size and linked of every element, from the leaves up."""
    order = list(_walk(root))
    for n in reversed(order):
        for k in n.kids:
            if isinstance(k, str):
                n.size += len(_SPACE.sub(" ", k).strip())
            elif not _unlikely(k):
                n.size += k.size
                n.linked += k.linked
        if n.name == "a":
            n.linked = n.size


def _is_paragraph(n: Node) -> bool:
    """p, pre, td, and other containers that hold text of their own."""
    if n.name in ("p", "pre", "td", "blockquote"):
        return True
    return n.name in BLOCK and any(isinstance(k, str) and len(k.strip()) > 25 for k in n.kids)


def _own_size(n: Node) -> tuple[int, int]:
    """Length and commas of the paragraph's running text, without that of blocks inside."""
    size = commas = 0
    todo: list[Node | str] = list(reversed(n.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            size += len(_SPACE.sub(" ", k).strip())
            commas += len(_COMMA.findall(k))
        elif k.name not in BLOCK and not _unlikely(k):
            todo += list(reversed(k.kids))
    return size, commas


def _start(n: Node) -> float:
    return _POSITIVE.get(n.name, 0) + _NEGATIVE.get(n.name, 0) + 25 * bool(n.marks & LIKELY) - 25 * bool(n.marks & (CLUTTER | DOUBTFUL))


def best_containers(root: Node) -> list[Node]:
    """The top container and its siblings that belong to it, in page order."""
    scored: list[Node] = []
    for n in _walk(root):
        if not _is_paragraph(n):
            continue
        size, commas = _own_size(n)
        if not size:
            continue
        points = 1 + commas + min(size / 100, 3) if size >= 25 else size / 100
        for above, part in ((n.parent, 1.0), (n.parent.parent if n.parent else None, 0.5)):
            if above is not None:
                if above.score is None:
                    above.score = _start(above)
                    scored.append(above)
                above.score += points * part
    if not scored:
        return [root]
    _sum_up(root)
    for n in scored:
        n.score *= 1 - n.linked / n.size if n.size else 0
    top = max(scored, key=lambda n: n.score)
    if sum(n.name == "article" for n in _walk(root)) == 1:  # an article element around the best container, if it is the only one
        top = next((up for up in _up(top) if up.name == "article"), top)
    if top.parent is None or top.name == "article":
        return [top]
    enough = max(10.0, (top.score or 0) * 0.2)
    keep = []
    for n in top.parent.kids:
        if not isinstance(n, Node) or n is not top and _unlikely(n):
            continue
        if n is top or n.score is not None and n.score >= enough or _running_text(n):
            keep.append(n)
    return keep


def _running_text(n: Node) -> bool:
    """Whether a sibling of the best container goes with it: a heading, or a block of sentences with few links."""
    if n.name not in ("p", "h1", "h2", "blockquote", "pre", "ul", "ol", "figure", "table", "div", "section") or not n.size or n.linked / n.size >= 0.25:
        return False
    if n.name in ("h1", "h2"):
        return True
    told = "".join(_texts(n))
    if n.name in ("div", "section") and _RIGHTS.search(told):
        return False
    sentence = re.search(r"[.!?。！？](?:\s|$)", told) is not None
    if n.name in ("div", "section"):
        return sentence and (n.size > 80 or not n.linked)
    return n.size > 80 or not n.linked and sentence


def blocks(nodes: list[Node]) -> list[str]:
    """The text blocks of the containers in page order, white space collapsed."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := _SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    for root in nodes:
        todo: list[Node | str | None] = [root]
        while todo:
            n = todo.pop()
            if n is None:
                close()
            elif isinstance(n, str):
                run.append(n)
            elif n is root or not _unlikely(n):
                if n.name == "br":
                    run.append(" ")
                elif n.name in BLOCK or n is root:
                    close()
                    todo += [None, *reversed(n.kids)]
                else:
                    todo += reversed(n.kids)
        close()
    return out


def main_text(page: str | None) -> str:
    """The article's text: blocks joined by newlines; empty if there is none."""
    if not page:
        return ""
    return "\n".join(blocks(best_containers(parse(page))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages, from the whole html.

    Null html counts as empty and gives the empty text. Broken markup never fails: unclosed
    elements end with their parent. Ids and urls may be null or repeat; other columns aren't read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"), text_of(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, f"page_id {rows.schema[0].dataType.simpleString()}, url string, text string, n_chars long")
