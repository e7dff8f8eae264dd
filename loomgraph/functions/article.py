"""The article of a web page as Markdown: the block subtree with the most text that isn't in links.

A page becomes a tree of its block elements. A paragraph's worth is its text, less what is linked and
less what is too short to be prose; it counts for its parent whole and for the parent's parent by half.
The worthiest element is the article. Scripts, navigation, page heads and feet, forms and blocks whose
names say that they hold advertisements or comments are left out before, whatever they hold.

Defined results: null and empty pages have no article (null), nor has a page without prose, unless it names an
article or main element, of which the first with any text is taken; unclosed,
crossed and unknown tags are taken as browsers do, as far as that matters here: a block ends open
paragraphs, an end tag closes what is open inside, one without a start is nothing; addresses of links
are made whole with the page's own address.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "svg", "iframe", "head", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
PROSE = {"p", "pre", "blockquote", "td"}
BLOCKS = {"html", "body", "main", "article", "section", "div", "ul", "ol", "li", "table", "tr", "figure", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"} | PROSE
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|share|social|comments?|related|cookie\w*|newsletter|sidebar|breadcrumbs?)(?:$|[\s_-])", re.IGNORECASE)
LEAST_PROSE = 25
#: Elements deeper than that stay beside each other.
DEEPEST = 200
#: Blanks and line ends that stand for themselves until the whole text is tidied.
KEPT, BACK = str.maketrans(" \n", "\ue000\ue001"), str.maketrans("\ue000\ue001", " \n")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list[Node | str] = field(default_factory=list)
    up: Node | None = None
    worth: float = 0.0
    depth: int = 0


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self.ended("p", until={"td", "li", "blockquote", "article", "section", "div"})
            if tag == "li":
                self.ended("li", until={"ul", "ol"})
        node = Node(tag, {k: v or "" for k, v in attrs}, up=self.at, depth=self.at.depth + 1)
        self.at.parts.append(node)
        if tag not in VOID and node.depth < DEEPEST:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        self.ended(tag)

    def ended(self, tag: str, until: set[str] = frozenset()) -> None:
        node = self.at
        while node is not self.root and node.tag != tag and node.tag not in until:
            node = node.up
        if node.tag == tag and node is not self.root:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def left_out(node: Node) -> bool:
    return node.tag in DROPPED or bool(NAMED.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}")) and node.tag != "article"


def lengths(node: Node) -> tuple[int, int]:
    """Characters of an element outside other blocks, and how many of them are linked."""
    text = linked = 0
    for part in node.parts:
        if isinstance(part, str):
            text += len(" ".join(part.split()))
        elif part.tag not in BLOCKS and not left_out(part):
            t, a = lengths(part)
            text, linked = text + t, linked + (t if part.tag == "a" else a)
    return text, linked


def spoken(node: Node) -> bool:
    """Whether an element holds text outside of what is left out."""
    return any(bool(p.strip()) if isinstance(p, str) else not left_out(p) and spoken(p) for p in node.parts)


def best(root: Node) -> Node | None:
    """The worthiest element; of equals the first."""
    stack, order = [root], []
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not left_out(p)]
    for node in order:
        if node.tag in BLOCKS:
            text, linked = lengths(node)
            worth = text - 2 * linked
            if worth >= LEAST_PROSE:
                # a block's own text counts for itself like a paragraph's for its parent
                for share, to in ((1.0, node.up if node.tag in PROSE else node), (0.5, (node.up.up if node.up else None) if node.tag in PROSE else node.up)):
                    if to is not None:
                        to.worth += share * worth
    found = max(order, key=lambda n: n.worth, default=None)
    if found is None or found.worth <= 0:
        # what a page names its article is one, however short
        return next((n for n in order if n.tag in ("article", "main") and spoken(n)), None)
    while found.tag not in BLOCKS and found.up is not None:
        found = found.up
    # a heading or list beside the prose belongs to it, if an article or main element holds both
    above = found
    while above.up is not None and above.tag not in ("article", "main"):
        above = above.up
    return above if above.tag in ("article", "main") and above.worth + sum(n.worth for n in order if n.up is above) >= found.worth else found


def inline(node: Node, page: str) -> str:
    out = []
    for part in node.parts:
        if isinstance(part, str):
            out.append(re.sub(r"\s+", " ", part))
        elif left_out(part):
            continue
        elif part.tag == "br":
            out.append("\n")
        elif part.tag in BLOCKS:
            out.append("\n\n" + markdown(part, page) + "\n\n")
        else:
            text = inline(part, page)
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}.get(part.tag)
            if part.tag == "a" and text.strip() and part.attrs.get("href"):
                text = f"[{text.strip()}]({urljoin(page, part.attrs['href'])})"
            elif mark and text.strip() and "\n\n" not in text:
                text = f"{' ' * text[:1].isspace()}{mark}{text.strip()}{mark}{' ' * text[-1:].isspace()}"
            out.append(text)
    return "".join(out)


def markdown(node: Node, page: str) -> str:
    if node.tag in ("ul", "ol"):
        items = [p for p in node.parts if isinstance(p, Node) and not left_out(p)]
        lines = [(f"{i + 1}. " if node.tag == "ol" else "- ") + tidy(inline(x, page)).replace("\n\n", "\n").replace("\n", "\n\ue000\ue000") for i, x in enumerate(items)]
        return "\n".join(x for x in lines if x.split(" ", 1)[1])
    if node.tag == "pre":
        return "```\n" + "".join(p if isinstance(p, str) else inline(p, page) for p in node.parts).strip("\n").translate(KEPT) + "\n```"
    text = tidy(inline(node, page))
    if re.fullmatch("h[1-6]", node.tag):
        return f"{'#' * int(node.tag[1])} {' '.join(text.split())}" if text else ""
    return "\n".join(f"> {line}".rstrip() for line in text.split("\n")) if node.tag == "blockquote" and text else text


def tidy(text: str) -> str:
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]+", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def extracted(html: str | None, page: str | None = "") -> str | None:
    if not html:
        return None
    tree = Tree()
    tree.feed(html)
    tree.close()
    found = best(tree.root)
    return (tidy(markdown(found, page or "")).translate(BACK) or None) if found is not None else None


def article(html: Column, page: Column) -> Column:
    """The article of each page as Markdown."""

    @F.pandas_udf("string")
    def run(pages: pd.Series, addresses: pd.Series) -> pd.Series:
        return pd.Series([extracted(h, a) for h, a in zip(pages, addresses)], dtype=object)

    return run(html, page)
