"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements whose content is markup, not text.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes")
#: Of these, one that is never closed is taken for a slip that hides nothing.
OPEN_ENDED = frozenset(("noscript", "template", "iframe", "noframes", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
DROPPED = frozenset((*RAW, *"head nav footer aside form button select option svg math canvas object audio video dialog menu datalist map".split()))
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Cells of a row stay on one line.
CELL = frozenset(("td", "th"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag on the left ends an open element on the right.
ENDS = {t: frozenset(("p",)) for t in BLOCK - CELL - {"tr", "tbody", "thead", "tfoot", "caption", "body", "html"}}
ENDS |= {"li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p"))}
ENDS |= {"tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
#: An implied end looks no further up than these.
FENCE = frozenset("ul ol dl table div article section main body html aside nav header footer form blockquote".split())
#: Words of a class, id or role that mark what is not the article.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promotion sidebar aside menu menubar nav navbar navigation "
    "navi breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar comment comments disqus respond reply replies discussion cookie "
    "cookies consent gdpr notice notices notification alert banner popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations widget toolbar search skip copyright legal disclaimer hidden contentinfo complementary".split()
)
ARTICLE_WORDS = frozenset("article articlebody main mainarticle post postbody entry entrycontent".split())
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(/?)(?:>|\Z)""",
    re.S,
)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
SPACE = re.compile(r"\s+")
#: Characters below which text within the article bears out a name, and a page's text is hardly any.
SHORT, SCANT = 25, 80
#: A block gives points to so many elements above it at most; the last of them gets less than a hundredth.
REACH = 64


#: What marks an element as junk: a name may be wrong about an element that holds the article or is part of it, hidden
#: markup only about one that holds it, a tag is not.
BY_NAME, BY_STYLE, BY_TAG = 1, 2, 3


class Node:
    __slots__ = ("children", "junk", "linked", "own", "parent", "points", "tag", "volume")

    def __init__(self, tag: str, parent: Node | None, own: int):
        self.tag, self.parent, self.own, self.children, self.points = tag, parent, own, [], 0.0
        self.volume = self.linked = 0
        self.junk = max(own, parent.junk) if parent else own


def _unlikely(tag: str, attrs: str, by_name: bool) -> int:
    """How the attributes mark an element as junk; the id of a heading is a slug of its text and marks nothing."""
    if "=" not in attrs and "hidden" not in attrs.lower():
        return 0
    if HIDDEN.search(attrs):
        return BY_STYLE
    for m in NAME.finditer(attrs) if by_name else ():
        if tag in HEADING and m[0][:2].lower() == "id":
            continue
        for name in (m[1] or m[2] or m[3] or "").split():
            found = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if UNLIKELY.intersection(found) and not ARTICLE_WORDS.issuperset(found):
                return BY_NAME
    return 0


def parse(html: str, by_name: bool = True) -> Node:
    """A tree of nodes and texts, with the implied ends that matter for blocks."""
    root = node = Node("html", None, 0)
    at, length, articles = 0, len(html), 0
    while at < length:
        m = PIECE.search(html, at)
        if not m:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag, up = m[1].lower(), node
            if tag == "br":
                node.children.append(" ")
                continue
            if tag == "p":  # an end without its start makes an empty paragraph
                node.children.append(Node("p", node, 0))
            while up and up.tag != tag:
                if up.tag in FENCE and tag not in BLOCK:
                    up = None
                    break
                up = up.parent
            if up and up.parent:
                node = up.parent
        elif m[2]:
            tag, attrs = m[2].lower(), m[3]
            if tag == "br":
                node.children.append(" ")
                continue
            if ends := ENDS.get(tag):
                up = node
                while up and up.tag not in FENCE or up and up.tag in ends:
                    if up.tag in ends:
                        node = up.parent or up
                    up = up.parent
            if tag == "html":
                continue
            own = BY_TAG if tag in DROPPED or tag == "header" else _unlikely(tag, attrs, by_name) if tag not in ("body", "main") else 0
            if tag in ("article", "main") and not own:
                articles += 1
                up = node if articles == 1 and 0 < node.junk < BY_TAG else None
                while up:  # what holds the page's first article is not junk
                    up.junk, up.own, up = 0, 0, up.parent
            new = Node(tag, node, own)
            node.children.append(new)
            if tag in RAW and not m[4]:
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else at if tag in OPEN_ENDED else length
            elif tag not in VOID and not (m[4] and tag not in BLOCK):
                node = new
        elif m[0].startswith("<![CDATA["):
            node.children.append(m[0][9:].removesuffix("]]>"))
    return root


def _blocks(top: Node, out: list[tuple[Node, str, int]]) -> None:
    """The blocks below `top` in page order: (element, text, characters in links). Junk is left out."""
    parts: list[str] = []
    linked = 0
    owner = top

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                out.append((owner, text, linked))
            parts.clear()
        linked = 0

    stack: list = [(top, iter(top.children), False, top)]
    while stack:
        node, it, link, own = stack[-1]
        for child in it:
            if isinstance(child, str):
                parts.append(child)
                owner = own
                if link:
                    linked += len(child.strip())
                continue
            if child.junk and not _kept_heading(child):
                if child.tag in BLOCK:
                    flush()
                continue
            if child.tag in CELL:
                parts.append(" ")
            elif child.tag in BLOCK:
                flush()
            stack.append((child, iter(child.children), link or child.tag == "a", child if child.tag in BLOCK else own))
            break
        else:
            stack.pop()
            if node.tag in CELL:
                parts.append(" ")
            elif node.tag in BLOCK:
                flush()
    flush()


def _kept_heading(node: Node) -> bool:
    """Headings inside an article's own header are its title; the rest of such a header is not text."""
    up: Node | None = node
    while up and up.tag != "header":
        up = up.parent
    if not up or not up.parent or up.parent.junk or not _within_article(up):
        return False
    if node is up:
        return True
    while node is not up:
        if node.tag in HEADING or node.parent is up and node.tag not in DROPPED and any(isinstance(c, Node) and c.tag in HEADING for c in node.children):
            return True
        node = node.parent
    return False


def _within_article(node: Node | None) -> bool:
    while node := node.parent:
        if node.tag in ("article", "main"):
            return True
    return False


def _below(top: Node) -> list[Node]:
    """The elements below `top`, each after its parent."""
    found = [top]
    for node in found:
        found.extend(c for c in node.children if isinstance(c, Node))
    return found[1:]


def _spread(top: Node, junk: int) -> None:
    top.junk = junk
    for node in _below(top):
        node.junk = max(node.own, node.parent.junk)


def _clear_names(top: Node) -> bool:
    """Takes the mark of its name from each element below `top` whose text bears it out: it is neither short nor links."""
    cleared = False
    for node in reversed([n for n in _below(top) if n.own == BY_NAME]):
        node.own = 0
        _spread(node, 0)
        blocks: list[tuple[Node, str, int]] = []
        _blocks(node, blocks)
        length, linked = sum(len(t) for _, t, _ in blocks), sum(x for _, _, x in blocks)
        body = [(t, x) for own, t, x in blocks if own.tag not in HEADING]
        points = sum(_points(t, x) for t, x in body)
        if sum(len(t) for t, _ in body) < SHORT or points < 2 or 3 * linked >= length:
            node.own = BY_NAME
        else:
            cleared = True
    _spread(top, top.junk)
    return cleared


def _points(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - min(1.0, linked / len(text)))


def main_text(html: str | None) -> str:
    """The article of a page, as blocks joined by newlines; empty if there is none.

    Each block scores 1 point, 1 a comma and 1 for every hundred characters up to 3, times one less its
    link density. Its parent gets all of it, each further ancestor a smaller share. The ancestor with
    most points, discounted by the link density of all it holds, is the container, widened to the `article` or `main` around it; its
    siblings are kept if they score a fifth as much, or are headings or long paragraphs with few links.
    Equal points go to the first in page order. Within the container an element is junk by its name only if
    its text is short or much of it is links. If names leave hardly any text, the page is scored without them.
    """
    if not html:
        return ""
    text, sure = _main_text(parse(html))
    if sure or len(text) >= SCANT:
        return text
    whole, _ = _main_text(parse(html, by_name=False))
    return whole if not text or len(whole) >= 10 * len(text) else text


def _main_text(root: Node) -> tuple[str, bool]:
    """The text and whether an `article` or `main` holds it."""
    blocks: list[tuple[Node, str, int]] = []
    _blocks(root, blocks)
    if not blocks:
        return "", False
    scored: dict[int, Node] = {}
    for own, text, linked in blocks:
        points = _points(text, linked)
        up, share = own.parent if own.tag not in ("div", "article", "section", "main", "body", "html", "td") and own.parent else own, 1.0
        up.volume += len(text)
        up.linked += min(linked, len(text))
        level = 1
        while up and level <= REACH:
            scored.setdefault(id(up), up)
            up.points += points * share
            level += 1
            share = 1 / (2 * (level - 1))
            up = up.parent
    for node in reversed([root, *_below(root)]):  # what an element holds counts for its parent, too
        if node.parent:
            node.parent.volume += node.volume
            node.parent.linked += node.linked
    best = max(scored.values(), key=lambda n: n.points * (1 - n.linked / n.volume))
    up: Node | None = best
    while up:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    kept = {id(best)}
    if best.parent and best.tag not in ("article", "main", "body", "html"):
        for own, text, linked in blocks:
            near = own
            while near.parent and near.parent is not best.parent:
                near = near.parent
            if near.parent is best.parent and (
                near.points >= max(1.0, 0.2 * best.points) or near.tag in HEADING or near.tag == "p" and linked < 0.25 * len(text)
            ):
                kept.add(id(near))
    elif best.tag == "article" and best.parent:
        kept.update(id(n) for n in best.parent.children if isinstance(n, Node) and n.tag == "article" and not n.junk and n.points >= 0.2 * best.points)
    if best.tag not in ("body", "html") and _clear_names(best):
        blocks.clear()
        _blocks(root, blocks)
    out = []
    for own, text, _ in blocks:
        up = own
        while up and id(up) not in kept:
            up = up.parent
        if up:
            out.append(text)
    return "\n".join(out), best.tag in ("article", "main")


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """`pages` with the column `text` holding each page's main text; the html column is dropped, others pass through.

    Pages are independent rows: nothing is shuffled, and a lost executor repeats only its own pages. A null
    or empty page gives an empty text; a column that is already named as the result is replaced.
    """
    rest = [f for f in pages.schema if f.name not in (html, text)]
    schema = T.StructType([*rest, T.StructField(text, T.StringType())])
    names = [f.name for f in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[names].assign(**{text: [main_text(h) for h in pdf[html]]})

    return pages.select(*names, html).mapInPandas(run, schema)
