"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import small_batches, table

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "script style textarea title noscript iframe head nav aside footer form button select option svg canvas template object menu dialog".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
SELF_CLOSING = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words in class, id or role that mark what is not article text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo "
    "related reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget alert complementary contentinfo search".split()
)
KEPT = frozenset(("html", "body", "main", "article"))


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent = tag, parent
        self.children: list = []  # nodes and texts in page order


def _noisy(tag: str, attributes: str, parent: Node | None) -> bool:
    if tag in DROPPED:
        return True
    inside = parent is not None and any(n.tag in ("article", "main") for n in _path(parent))
    if tag == "header":
        return not inside
    if not attributes or tag in KEPT:
        return False
    if re.search(r"(?i)(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attributes):
        return True
    for _, value in re.findall(r"(?i)\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", attributes):
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        if words & NOISE and not (inside and words & NOISE <= {"header"}):
            return True
    return False


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def parse(html: str) -> Node:
    """A forgiving tree of the page without noise: left-open tags are closed by what follows."""
    import html as entities

    root = Node("html", None)
    at, where, skip, size = 0, root, None, len(html)

    def put(text: str) -> None:
        if text and skip is None:
            where.children.append(entities.unescape(text))

    def leave(tag: str, stops: frozenset | set) -> None:
        nonlocal where, skip
        for n in _path(where):
            if n.tag in stops or n is root:
                return
            if n.tag == tag:
                if skip is not None and any(x is skip for x in _path(where)) and not any(x is skip for x in _path(n.parent)):
                    skip = None
                where = n.parent or root
                return

    while at < size:
        m = MARKUP.search(html, at)
        if m is None:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1] or m[4]:
            if tag == "br" and skip is None:
                where.children.append(" ")
            elif tag not in VOID:
                leave(tag, {"table"} if tag != "table" and where.tag in ("td", "th") else set())
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in VOID:
            if skip is None:
                where.children.append(Node(tag, where))
            continue
        if tag in CLOSES_P and any(n.tag == "p" for n in _path(where)):
            leave("p", {"td", "th", "table", "button", "object"})
        for other in SELF_CLOSING.get(tag, ()):
            leave(other, STOPS[tag])
        node = Node(tag, where)
        if skip is None and _noisy(tag, attributes, where):
            skip = node
        elif skip is None:
            where.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(html, at)
            if skip is None:
                node.children.append(html[at : end.start()])
            at = end.end()
            if skip is node:
                skip = None
            continue
        if not attributes.rstrip().endswith("/"):
            where = node
        elif skip is node:
            skip = None
    return root


def _measure(root: Node) -> list[Node]:
    """Characters, tags and their linked parts of every node, children first."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.children if isinstance(c, Node))
    order.reverse()
    for n in order:
        n.chars = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, Node):
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.chars if c.tag == "a" else c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
    whole, linked = root.chars, root.link_chars
    share = linked / whole if whole else 0.0
    for n in order:
        c, lc, t, lt = n.chars, n.link_chars, max(n.tags, 1), n.link_tags
        if not c:
            n.density = 0.0
        else:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            n.density = c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / base
        n.total = sum(k.density for k in n.children if isinstance(k, Node))
    return order


def main_node(root: Node) -> Node:
    """The subtree with the largest sum of child densities, widened along the path to the body.

    The least density on the path from there to the body is the threshold: while a parent has another child with
    text at or above it, that child belongs to the article too. An article or main element around it is taken whole.
    """
    order = _measure(root)
    best = max(order, key=lambda n: (n.total, n.density, n.chars))
    marked = [n for n in _path(best) if n.tag in ("article", "main")]
    if marked:
        best = marked[-1]
    threshold = min((n.density for n in _path(best) if n.tag != "html" and n.chars), default=0.0)
    while best.parent is not None:
        more = [k for k in best.parent.children if isinstance(k, str) and k.strip() or isinstance(k, Node) and k is not best and k.chars > 2 * k.link_chars and (k.density >= threshold or k.tag in ("article", "p", "h1", "h2"))]
        if not more and best.tag not in ("p", "h1", "h2", "h3", "li", "span", "b", "i", "em", "strong", "a"):
            break
        best = best.parent
    return best


def text_of(node: Node) -> str:
    """Blocks in page order, one a line; white space inside a block is one space."""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        line = " ".join("".join(run).split())
        if line:
            blocks.append(line)
        run.clear()

    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            run.append(n)
        elif n is None:
            close()
        elif n.tag == "br":
            run.append(" ")
        else:
            if n.tag in BLOCKS:
                close()
                stack.append(None)
            stack.extend(reversed(n.children))
    close()
    return "\n".join(blocks)


def extract(html: str | None) -> str:
    return text_of(main_node(parse(html))) if html else ""


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``main_text``, the article of each page (empty if there is none).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments are
    left out of the tree by tag and by the words of class, id and role; what is left is chosen by density. Null,
    empty and tagless html are allowed: text without tags is one block. Pages are handled one by one, so repeats and
    an empty table need no rule; a column called ``main_text`` is replaced, all others stay.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(h) for h in batch], dtype=object)

    return pages.withColumn("main_text", run(F.col(html)))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
