"""Main-text extraction by scoring the element tree.

Paragraphs pass points for their length and commas to the elements above them, fewer to those farther up. An element's
points are discounted by the share of its text that stands in links. The best element and those of its siblings that
score well enough are the article; what stands in menus, forms, notices and the like inside it is left out.

An element's name is a hint only: it removes an element that doesn't hold most of the page's paragraphs (or stands
beside an article), or, where just some of the words in the name speak against it, one that consists of links.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tonequarry.llm.common import narrow_batches, tidy

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)

# Element names and the words of class, id and role that mark what isn't the article.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"nav", "aside", "footer", "menu", "button", "select", "dialog", "label", "head"}
FORMS = {"form", "fieldset"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCKS - {"body", "caption", "head", "html", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
#: For each element the start tags that it may be closed by, or that it keeps from closing an element farther up.
BETWEEN = {"p": {"table", "td", "th", "button", "article", "div", "section", "main", "blockquote", "li"}, **SAME}
ASKED = {tag: [name for name, others in BETWEEN.items() if tag == name or tag in others] for tag in BLOCKS | {"button", "select"}}
#: Words of class, id and role that speak against an element: by themselves, only if all of a name's words do, or for comments.
PLAIN_HINTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "gdpr", "masthead", "menubar", "modal", "navbar", "newsletter", "outbrain", "pager", "pagination", "popup", "promo", "shoutbox", "sidebar", "signup", "skyscraper", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "topbar"}
WHOLE_HINTS = {"banner", "byline", "community", "complementary", "contentinfo", "extra", "footer", "footnote", "header", "legends", "login", "menu", "nav", "navigation", "notice", "notices", "promotion", "related", "remark", "rss", "search", "share", "sharing", "social", "supplemental", "widget"}
COMMENT_HINTS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
NO_HINT, WEAK, STRONG, COMMENTS, OUT = range(5)
#: Share of links from which a weak hint counts, and of the page's paragraphs up to which a strong one does.
LINKED, MOST = 0.3, 0.5
#: Points reach so many elements above a paragraph.
LEVELS = 6
LEAST_PARAGRAPH, LEAST_SIBLING = 25, 80


class Node:
    __slots__ = ("article", "hint", "inside", "length", "level", "links", "menu", "out", "parent", "points", "real", "tag")

    def __init__(self, tag: str, parent: Node | None, hint: int):
        self.tag, self.parent, self.hint, self.out = tag, parent, hint, hint == OUT or (parent is not None and parent.out)
        self.points, self.real, self.length, self.links, self.article = 0.0, 0.0, 0, 0, 0
        self.inside = self.menu = False
        self.level = 0 if parent is None else parent.level + 1


def hint_of(tag: str, attributes: str, in_article: bool) -> int:
    """What an element's name and attributes say against it; ``OUT``: it and all in it isn't part of any article."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return OUT
    found = STRONG if tag in FORMS else NO_HINT
    if tag in {"html", "body", "article", "main"} and "omment" not in attributes:
        return found
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return OUT
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return OUT
        elif name in {"class", "id", "role"}:
            for part in value.split():
                words = [w.lower() for w in WORD.findall(part)]
                if not COMMENT_HINTS.isdisjoint(words):
                    found = max(found, COMMENTS)
                elif not PLAIN_HINTS.isdisjoint(words) or (words and WHOLE_HINTS.issuperset(words)):
                    found = max(found, STRONG)
                elif not WHOLE_HINTS.isdisjoint(words):
                    found = max(found, WEAK)
    return found


def blocks_of(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """The page's text blocks in order, each with its element and the number of its letters in links; and all elements, parents first."""
    root = Node("#root", None, NO_HINT)
    nodes = [root]
    here, out, held, linked, links_open, articles = root, [], [], 0, 0, 0
    at, endless = 0, set()
    # Open elements that a start or end tag may ask for, by the name that asks: the last one closes or stands in the way.
    opened: dict[str, list[Node]] = {}

    def flush() -> None:
        nonlocal linked
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((here, text, min(linked, len(text))))
            linked = 0

    def enter(node: Node) -> None:
        nonlocal here, articles
        here = node
        nodes.append(node)
        articles += node.tag in {"article", "main"}
        for name in ASKED.get(node.tag, ()):
            opened.setdefault(name, []).append(node)
        opened.setdefault(f"/{node.tag}", []).append(node)

    def leave() -> None:
        nonlocal here, articles
        articles -= here.tag in {"article", "main"}
        for name in ASKED.get(here.tag, ()):
            opened[name].pop()
        opened[f"/{here.tag}"].pop()
        here = here.parent

    def close(tag: str, start: bool) -> None:
        """Closes the nearest open element of a name, for an end tag, or for a start tag unless another one stands between."""
        node = (opened.get(tag if start else f"/{tag}") or [None])[-1]
        if node is None or node.tag != tag:
            return
        flush()
        while here is not node:
            leave()
        leave()

    def text(value: str) -> None:
        nonlocal linked
        if value and not here.out:
            held.append(value)
            if links_open:
                linked += len(value.strip())

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        if page[at - 1] != ">":
            break  # the page ends within a tag
        tag, closing, attributes = name.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if tag == "br" or tag == "wbr":
            text(" " if tag == "br" else "")
        elif tag == "a":
            links_open = 0 if closing else 1
        elif closing:
            if tag in BLOCKS or (here.tag == tag):
                close(tag, False)
        elif tag in RAW:
            looks = tag not in endless and (tag in {"script", "style"} or not attributes.rstrip().endswith("/"))
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at) if looks else None
            if end is not None:
                at = end.end()
            elif looks:
                endless.add(tag)
                if tag in {"script", "style", "textarea", "title"}:
                    break
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in BLOCKS or hint_of(tag, attributes, True) >= STRONG:
            flush()
            if tag in CLOSES_P:
                close("p", True)
            if tag in SAME:
                close(tag, True)
            enter(Node(tag, here, hint_of(tag, attributes, articles > 0)))
            links_open = 0
    flush()
    return out, nodes


def points_of(text: str) -> float:
    """What a paragraph's length and commas are worth."""
    return 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0) if len(text) >= LEAST_PARAGRAPH else 0.25


def summed(found: list[tuple[Node, str, int]], nodes: list[Node]) -> None:
    """Each element's letters, letters in links, letters in articles, and paragraphs, with all in it."""
    for n in nodes:
        n.length, n.links, n.article, n.real = 0, 0, 0, 0.0
    for n, text, linked in found:
        n.length += len(text)
        n.links += linked
        if len(text) >= LEAST_PARAGRAPH:
            n.real += points_of(text) * (1 - linked / len(text))
    for n in reversed(nodes):
        if n.tag in {"article", "main"}:
            n.article = n.length
        if n.parent is not None:
            n.parent.article += n.article
            n.parent.length += n.length
            n.parent.links += n.links
            n.parent.real += n.real


def drop_hinted(found: list[tuple[Node, str, int]], nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """The blocks outside elements that their names and what they hold speak against."""
    summed(found, nodes)
    total, articles = nodes[0].real, nodes[0].article
    for n in nodes:
        if n.parent is not None and n.parent.out:
            n.out = True
        elif n.hint == WEAK:
            n.out = n.links > LINKED * n.length
        elif n.hint == STRONG:
            n.out = n.real <= MOST * total or articles > n.article  # text elsewhere says that it is the article
        elif n.hint == COMMENTS:  # a long discussion may outweigh its article
            n.out = total - n.real >= 2
    return [x for x in found if not x[0].out]


def extract(page: str) -> str:
    """The article's blocks in page order, joined by spaces; empty if the page has no text outside what is left out."""
    found, nodes = blocks_of(page)
    found = drop_hinted(found, nodes)
    if not found:
        return ""
    summed(found, nodes)
    reached: dict[int, Node] = {}
    for node, text, _ in found:
        n, paragraph = node, points_of(text)
        if n.tag in {"p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd", "dt", "blockquote"} and n.parent is not None:
            n = n.parent  # a paragraph's own element is no container
        for level in range(LEVELS):
            if n is None:
                break
            reached[id(n)] = n
            n.points += paragraph / (1 if level == 0 else 2 if level == 1 else 3 * level)
            n = n.parent
    final = {k: n.points * (1 - n.links / max(1, n.length)) for k, n in reached.items()}
    order = list(reached.values())
    best = max(order, key=lambda n: (final[id(n)], n.level))
    n = best
    while n is not None:  # an element that says it is the article keeps its parts together
        if n.tag in {"article", "main"}:
            best = n
            break
        n = n.parent
    least = max(2.0, 0.2 * final.get(id(best), 0))
    whole = {id(best)}
    if best.parent is not None:
        alike = {"article"} if best.tag in {"article", "main"} else None  # parts of one article
        beside = [n for n in nodes if n.parent is best.parent and not n.out and (alike is None or n.tag in alike)]
        good = [i for i, n in enumerate(beside) if n is best or final.get(id(n), 0) >= least]
        # A short one between two that are kept is part of the same text, unless it is links.
        whole |= {id(n) for i, n in enumerate(beside) if i in set(good) or (good[0] < i < good[-1] and n.links <= LINKED * n.length)} if good else set()
    for n in nodes:  # parents first
        if id(n) in whole:
            n.inside, n.menu = True, False
        elif n.parent is not None:
            n.inside = n.parent.inside
            n.menu = n.parent.menu or (n.tag in {"ul", "ol", "dl", "table", "div"} and n.links > 0.7 * n.length)
    kept = []
    for node, text, linked in found:
        beside = node is not best and node.parent is best.parent and node.tag == "p" and len(text) >= LEAST_SIBLING and linked < 0.25 * len(text)
        if beside or (node.inside and not node.menu):
            kept.append(text)
    return " ".join(kept)


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row, in one narrow pass; a null page is empty and has no text.

    Rows repeat as they stand; an empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "") for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"), pages[html_column].alias("html"))
    return narrow_batches(narrow).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
