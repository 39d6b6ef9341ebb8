"""The main text of web pages by composite text density.

Every element gets its characters, link characters, tags and link tags. Its composite density is

    d = C / T * log_b(C / LC * T / LT),  b = ln(C / NC * LC + LC / CB * C + e)

with C characters, T tags, LC and LT those inside links, NC = C - LC, and CB, LCB the body's: text with
few tags and few links is dense. An element's density sum is the sum over its children. The element
with the largest sum is found; the least density on the path from it to the body is the threshold, and
the text of the main element is the elements on that path and below that reach it (below the best
element everything is kept but what is no text of the article).

What no density can tell is told by name: scripts, styles, forms, menus, headers, footers, asides
and elements of which a whole class or id name tells of an advert, a notice, comments, a menu or a sidebar have no text,
unless an article is in them. A header in an article is a part of it.

Results for odd input: a null html gives an empty text, as does a page without a body's text; broken
mark-up is read as browsers do in simple cases (tags that never close, ends that close nothing, references without
a semicolon). Repeated rows are each returned.
"""

from __future__ import annotations

import functools
import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, slices

RESULT = "page_id long, url string, text string, n_chars long"

# Element and attribute names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
DROPPED = frozenset("script style noscript template svg math iframe object canvas head title nav header footer aside form button select textarea input option dialog menu".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: A start of the first closes an open one of the second that is nearer than the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: These end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class and id names that tell what is no part of the article, and words that may stand beside them in one name.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices popup newsletter "
    "subscribe subscription comment comments replies disqus respond menu nav navbar navigation breadcrumb breadcrumbs sidebar related share sharing social footer header "
    "masthead widget widgets pagination pager login signup skip".split()
)
BESIDE = frozenset("area bar block bottom box button buttons container content form global group holder icons inner item items left link links list main outer page post posts primary right secondary section site slot sticky stories text to top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
ARTICLE = frozenset("article main".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|[^>])*+)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPACES = re.compile(r"\s+")


@functools.lru_cache(10_000)
def _noise(name: str) -> bool:
    """Whether a whole class or id name tells of noise: all its words do, or stand beside one that does."""
    words = [x.lower() for x in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name) if x]
    return any(x in NOISE for x in words) and all(x in NOISE or x in BESIDE or x.isdigit() for x in words)


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "named", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, named: bool = False):
        self.tag, self.parent, self.parts, self.dropped, self.named = tag, parent, [], dropped or named, named
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _named(tag: str, attributes: str) -> bool:
    if tag in ("html", "body", "main") or not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "")
        if value.strip().lower() in ROLES if name.lower() == "role" else any(map(_noise, value.split())):
            return True
    return False


def parse(page: str) -> Node:
    """The page's tree; parts of a node are texts and nodes in order."""
    root = at = Node("#root", None)
    is_open: Counter = Counter()
    end, n = 0, len(page)

    def text(raw: str) -> None:
        if raw:
            at.parts.append(_html.unescape(raw) if "&" in raw else raw)

    def close(node: Node) -> Node:
        """Closes all open elements down to this one; each is closed once, so ends that close nothing cost nothing."""
        inner = at
        while inner is not node.parent:
            is_open[inner.tag] -= 1
            inner = inner.parent
        return inner

    while end < n:
        m = TOKEN.search(page, end)
        if m is None:
            text(page[end:])
            break
        text(page[end : m.start()])
        end = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                at.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if is_open[tag]:
                node = at
                while node.tag != tag:
                    node = node.parent
                at = close(node)
            continue
        if tag in ENDS_P or tag in CLOSES:
            closed, stop = CLOSES.get(tag, (("p",), ("article", "body", "button", "div", "main", "object", "section", "table", "td", "th", "li")))
            if any(is_open[x] for x in closed):
                node = at
                while node is not root and node.tag not in stop:
                    if node.tag in closed:
                        at = close(node)
                        break
                    node = node.parent
        named = _named(tag, m[3])
        # the heading of an article may stand in its header
        node = Node(tag, at, tag in DROPPED and not (tag == "header" and (is_open["article"] or is_open["main"])), named)
        if tag in ARTICLE and not named:
            # what holds an article is no notice, whatever its name
            outer = at
            while outer is not None:
                if outer.named:
                    outer.named, outer.dropped = False, outer.tag in DROPPED
                outer = outer.parent
        at.parts.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close_at = re.compile(f"</{tag}\\s*>", re.IGNORECASE).search(page, end)
            stop_at = close_at.start() if close_at else n
            node.parts.append(page[end:stop_at])
            end = close_at.end() if close_at else n
            continue
        at = node
        is_open[tag] += 1
    return root


def _post_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        if not node.dropped:
            stack.extend(x for x in node.parts if isinstance(x, Node))
    return out[::-1]


def measure(root: Node, names: bool = True) -> Node | None:
    """Computes every node's density and sum; returns the body. Without names, elements that only a name dropped come back."""
    if not names:
        stack = [root]
        while stack:
            node = stack.pop()
            if node.named and node.parent is not None and any(isinstance(x, Node) and x.tag in ("p", "div", "section") for x in node.parts):
                node.named, node.dropped = False, node.tag in DROPPED
            stack.extend(x for x in node.parts if isinstance(x, Node))
        for node in _post_order(root):
            node.chars = node.links = node.tags = node.link_tags = 0
            node.density = node.total = 0.0
    nodes = _post_order(root)
    for node in nodes:
        if node.dropped:
            continue
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(SPACES.sub("", x))
            else:
                node.chars, node.links, node.tags, node.link_tags = node.chars + x.chars, node.links + x.links, node.tags + x.tags + 1, node.link_tags + x.link_tags
        if node.tag == "a":
            node.links, node.link_tags = node.chars, node.tags + 1
    body = next((x for x in reversed(nodes) if x.tag == "body"), root)
    share = body.links / body.chars if body.chars else 0.0
    for node in nodes:
        if node.dropped or not node.chars:
            continue
        c, lc, t, lt = node.chars, node.links, max(1, node.tags), max(1, node.link_tags)
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        node.density = c / t * max(0.0, math.log(c / max(1, lc) * t / lt) / math.log(base) if base > 1 else math.log(c / max(1, lc) * t / lt))
    for node in nodes:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node))
    return body


def _blocks(node: Node) -> str:
    """The text below a node: white space inside a block as one space, blocks joined by one."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped:
            if x.tag in BLOCK:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.parts))
    return SPACES.sub(" ", "".join(out)).strip(" ")


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    body = measure(root)
    nodes = [x for x in _post_order(body) if not x.dropped and x.chars]
    if not nodes:  # all of the text is in elements with such names: then they are the page's wrappers
        body = measure(root, names=False)
        nodes = [x for x in _post_order(body) if not x.dropped and x.chars]
    if not nodes:
        return ""
    best = max(nodes, key=lambda x: (x.total, x.chars))
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min((x.density for x in path if x.density > 0), default=0.0)
    # an article holds its text whole: its parts differ in density, but the page says that they belong together
    for node in path:
        if node.tag in ARTICLE:
            return _blocks(node)
    top = best
    while top is not body and top.parent is not None and top.parent.density >= threshold and top.parent.total >= top.total and top.parent.tag not in ("#root", "html"):
        top = top.parent
    kept = []
    for x in top.parts:
        if isinstance(x, str) or x.tag not in BLOCK or x.density >= threshold or top is best:
            kept.append(x)
    whole = Node("div", None)
    whole.parts = kept
    return _blocks(whole)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, RESULT)
