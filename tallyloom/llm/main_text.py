"""Main text of HTML pages by composite text density.

A page is parsed into its tree of elements. Each element has the characters of its text (C), its tags with its own (T),
and the same inside links (LC, LT); with the body's C and LC its composite density is::

    C / T * log(C * T / (LC * LT)) / log(e + C * LC / (C - LC) + C * LCb / Cb)

(counts of 0 in a denominator are 1): text that has few tags is dense, text in links is not. The density
sum of an element adds up the densities of its children. The element with the largest sum holds the article;
the least density on its path up to the body is the page's threshold. From the body (or the article or
main element around it) down, an element below the threshold is passed over with all it holds, and of
each one that reaches it the descendant with the largest sum is text.

Elements that never hold article text (scripts, menus, headers and footers of the page, forms, notices,
adverts, comments: by tag, role or class) are not part of the tree. An article's own heading stays: a
header inside an article counts as content.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import base

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""", re.S)

# Tag names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math canvas object xmp noembed noframes".split())
SKIPPED = RAW | set("head nav footer aside form button select option dialog menu label input".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
HOLDS = {"p": "button", "li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table", "thead": "table", "tbody": "table", "tfoot": "table"}
ENDS_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = set("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
#: Words in class or id that mark what is around an article.
AROUND = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe\w*"
    r"|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|site-header|page-header|topbar|toolbar|pagination|pager"
    r"|related|recommend\w*|share|sharing|social|comments?|commentlist|disqus|respond|reply|replies|widget|login|signup|search|skip|hidden|toc)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("tag", "parts", "link", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "parent")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.link = tag == "a" or (parent is not None and parent.link)


def _around(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in SKIPPED or tag == "header" and not inside_article:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and AROUND.search(value):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def parse(page: str) -> Node:
    """The tree below the body: texts and elements, without what is never article text."""
    root = Node("body", None)
    at, where, opened, skipped, articles = 0, root, ["body"], 0, 0
    nodes = [root]
    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            where.parts.append(page[at:])
            break
        if m.start() > at:
            where.parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in opened[1:]:
                last = len(opened) - 1 - opened[::-1].index(tag)
                if tag in INLINE and any(x not in INLINE for x in opened[last + 1 :]):
                    continue  # a stray inline end tag does not close blocks
                articles -= sum(x == "article" for x in opened[last:])
                del opened[last:], nodes[last:]
                where = nodes[-1]
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES or tag in ENDS_P:
            _close(tag, opened, nodes)
            where = nodes[-1]
        if tag in VOID:
            if tag in ("br", "hr"):
                where.parts.append(Node(tag, where))
            continue
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if _around(tag, m[3] or "", articles > 0):
            at = _past(page, tag, at)
            continue
        node = Node(tag, where)
        where.parts.append(node)
        if not m[0].endswith("/>"):
            where = node
            opened.append(tag)
            nodes.append(node)
            articles += tag == "article"
    return root


def _close(tag: str, opened: list[str], nodes: list[Node]) -> None:
    """Close what the start tag ends without an end tag: an open paragraph, or its predecessor in a list or table."""
    ends, stops = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set()), set(HOLDS.get(tag, "").split())
    for i in range(len(opened) - 1, 0, -1):
        if opened[i] in ends:
            del opened[i:], nodes[i:]
            return
        if opened[i] in stops or opened[i] not in INLINE and not ends & set(opened[1:i]) or opened[i] in ("div", "section", "article", "table", "ul", "ol", "blockquote"):
            return


def _past(page: str, tag: str, at: int) -> int:
    """Behind the end of an element that is left out; an element that is never closed ends at its start tag."""
    depth, each = 1, re.compile(rf"<!--.*?-->|<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I | re.S)
    start = at
    while depth:
        m = each.search(page, at)
        if m is None:
            return start if tag not in ("head",) else at
        at = m.end()
        if m[1] is not None:
            depth += -1 if m[1] else 1
    return at


def _count(root: Node) -> None:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if not isinstance(p, str)]
    for node in reversed(order):
        chars = link_chars = tags = link_tags = 0
        for p in node.parts:
            if isinstance(p, str):
                size = len(p) - p.count(" ") - p.count("\n") if p else 0
                chars += size
                link_chars += size if node.link else 0
            else:
                chars += p.chars
                link_chars += p.link_chars
                if p.tag not in ("br", "b", "i", "em", "strong", "span"):
                    tags += p.tags + 1
                    link_tags += p.link_tags + (p.tag == "a")
                else:
                    tags += p.tags
                    link_tags += p.link_tags
        node.chars, node.link_chars, node.tags, node.link_tags = chars, link_chars, tags, link_tags
    body, body_link = max(root.chars, 1), root.link_chars
    for node in reversed(order):
        c, t, lc, lt = node.chars, node.tags + 1, node.link_chars, max(node.link_tags, 1)
        if c:
            below = math.log(math.e + c * lc / max(c - lc, 1) + c * body_link / body)
            node.density = c / t * max(math.log(max(c * t / (max(lc, 1) * lt), 1.0)), 0.0) / below
        else:
            node.density = 0.0
        node.total, node.best = 0.0, node
        own = 0.0
        for p in node.parts:
            if isinstance(p, str):
                own += 0 if node.link else len(p.strip())
            else:
                node.total += p.density
        node.total += own
        for p in node.parts:
            if not isinstance(p, str) and p.best.total > node.best.total:
                node.best = p.best


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of block elements in page order; ``out`` gets a string for each run of inline text."""
    stack = [(node, 0)]
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    while stack:
        at, i = stack.pop()
        if i == 0 and at.tag not in INLINE:
            flush()
        while i < len(at.parts):
            part = at.parts[i]
            i += 1
            if isinstance(part, str):
                run.append(part)
            elif part.tag == "br":
                run.append(" ")
            else:
                stack.append((at, i))
                stack.append((part, 0))
                break
        else:
            if at.tag not in INLINE:
                flush()
    flush()


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line; "" if the page has no text."""
    if not page:
        return ""
    root = parse(page)
    _count(root)
    best = root.best
    threshold, node = best.density, best
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    # the page says itself where the article is, if it does
    scope, node = root, best
    while node is not None:
        scope = node if node.tag in ("article", "main") else scope
        node = node.parent
    marked, todo = set(), [scope]
    while todo:
        node = todo.pop()
        if node.chars and node.density >= threshold:
            marked.add(id(node.best))
            todo += [p for p in node.parts if not isinstance(p, str)]
    out: list[str] = []
    todo = [scope]
    while todo:
        node = todo.pop()
        if id(node) in marked:
            _blocks(node, out)
        else:
            todo += [p for p in reversed(node.parts) if not isinstance(p, str)]
    return "\n\n".join(out)


def _extract(column: str, out: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in base.slices(batches, column):
            texts = [main_text(x) for x in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, out])
    return run


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``column``, with ``out``, the main text of each page's whole HTML.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
    joined by an empty line. A null, empty or textless page gives "". All rows and the other columns stay;
    a column named ``out`` is replaced. Each page is parsed by itself, so nothing is shuffled.
    """
    kept = [c for c in pages.columns if c not in (column, out)]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(out, T.StringType())])
    own = f"html-{uuid4().hex}"
    return pages.select(*kept, F.col(column).alias(own)).mapInArrow(_extract(own, out, kept), schema)
