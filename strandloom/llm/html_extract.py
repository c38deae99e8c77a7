"""Main text of web pages by tree scoring.

Pages are parsed into a light tree by one tokenizer.  Menus, footers, sidebars, adverts, scripts,
styles and hidden parts are cut off by element.  Elements whose class or id names such a role
(first or last part of a whole token), and forms, are suspects: they go unless they hold most of the
page's text outside links, so that a wrapper of the article stays; reader comments go however long
they are.  Inside sentences only adverts and share links are cut.  Every remaining block passes
points for its length and its commas to its ancestors, halved at each level beyond the first,
discounted by the share of its text inside links.  The best container and those of its siblings that
score alike are the article; all of its blocks are kept, in page order.

Sums over the tree take one pass up, decisions one pass down: time is linear in the page.

Results for odd input: null or empty html has no text (empty string, 0 characters); broken markup
is closed at the end of the page; of containers that score alike the first is taken; repeated rows
give equal results; a page of any length or depth is taken whole; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

# Elements by role, and role words of classes and ids.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {"nav", "footer", "aside", "button", "select", "option", "svg", "canvas", "object", "dialog", "menu", "head", "label", "fieldset", "audio", "video"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()) | set("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
CLOSES_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"table", "ul", "ol", "dl", "select", "article", "section", "main", "div", "body", "blockquote"}
COMMENTS = {"comment", "comments", "disqus", "respond", "replies"}
ADS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion share sharing social subscribe newsletter".split())
WORDS = COMMENTS | ADS | set("banner cookie cookies consent gdpr notice alert popup modal overlay sidebar rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead header topbar signup login related recommended toolbar skip tags byline-links".split())
#: First parts that make a class a layout, and a header the article's own.
LAYOUT = {"with", "has", "no", "without", "is"}
OWN = {"entry", "post", "article", "story", "content"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
POSITIVE = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)

PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: HTML white space; other Unicode spaces from references count as white space too.
GAPS = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "article", "cut", "suspect", "block", "score", "points", "text", "linked", "plain", "whole", "state")

    def __init__(self, tag: str, parent: "Node | None", article: bool, cut: bool = False, suspect: str = ""):
        self.tag, self.parent, self.article, self.cut, self.suspect = tag, parent, article, cut, suspect
        self.block: Node = parent.block if parent and tag in INLINE else self
        self.score = self.points = 0.0  # own points; with those from below
        self.text = self.linked = self.plain = 0
        self.whole = tag in ("article", "main")  # holds an article element
        self.state = None


def role(value: str, inside: bool) -> str:
    """"", or what the class or id says of its element: "comment", "ad" or "role"."""
    found = ""
    for token in value.split():
        parts = [p.rstrip("0123456789").lower() for p in PARTS.split(token) if p]
        if not parts or len(parts) > 3 or parts[0] in LAYOUT:
            continue
        ends = {parts[0], parts[-1]}
        if ends & COMMENTS:
            return "comment"
        if "header" in ends and (inside or parts[0] in OWN):
            ends -= {"header"}
        if ends & ADS:
            found = "ad"
        elif ends & WORDS:
            found = found or "role"
    return found


def unwanted(tag: str, raw: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is none of the article for certain, and what its names say else."""
    if tag in DROPPED or tag == "header" and not inside:
        return True, ""
    suspect = "form" if tag == "form" else ""
    if raw and ("=" in raw or "hidden" in raw):
        for name, value in ATTRIBUTE.findall(raw):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES and (tag, value.lower()) != ("form", "form"):
                return True, ""
            if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, ""
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                suspect = role(value, inside) or suspect
    return tag in INLINE and suspect == "ad", suspect


def self_closed(raw: str) -> bool:
    """Whether a start tag ends with a slash that is not part of an unquoted value."""
    return raw.endswith("/") and not re.search(r"=\s*[^\s\"'>][^\s>]*$", re.sub(r"\"[^\"]*\"|'[^']*'", '""', raw))


def blocks(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, and (container, text, characters inside links) of every block, in page order."""
    root = Node("", None, False)
    nodes, stack, out = [root], [root], []
    open_: dict[str, int] = {}  # open elements by name
    buffer: list[str] = []
    links = 0  # depth of open links
    linked: list[str] = []

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = GAPS.sub(" ", "".join(buffer)).strip()
            if text:
                out.append((stack[-1].block, text, len(GAPS.sub(" ", "".join(linked)).strip()) if linked else 0))
        buffer, linked = [], []

    def push(node: Node) -> None:
        stack.append(node)
        open_[node.tag] = open_.get(node.tag, 0) + 1
        if not node.cut:
            nodes.append(node)

    def close(k: int) -> None:
        """End the open elements from the k-th on."""
        nonlocal links
        if not stack[k].cut:
            flush()
            links = 0
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    def end(tags: set[str]) -> None:
        """End the nearest open element of these, inside the scope."""
        if not any(open_.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                close(k)
                break
            if stack[k].tag in SCOPES:
                break

    def say(text: str) -> None:
        if stack[-1].cut and stack[-1].tag == "head" and text.strip():
            close(len(stack) - 1)  # text ends a head without an end tag
        if text and not stack[-1].cut:
            text = unescape(text) if "&" in text else text
            buffer.append(text)
            if links:
                linked.append(text)

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            say(html[at:])
            break
        if start > at:
            say(html[at:start])
        m = TOKEN.match(html, start)
        if m is None:
            say("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                say(m[1])
            continue
        tag = tag.lower()
        if m[2]:  # an end tag
            if tag in INLINE:
                if tag == "a" and links and not stack[-1].cut:
                    links -= 1
                for k in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                    if stack[k].tag == tag:
                        open_[tag] -= 1
                        del stack[k]
                        break
                    if stack[k].tag not in INLINE:
                        break
                continue
            for k in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
            else:
                if tag in ("p", "br") and not stack[-1].cut:
                    flush()
            continue
        empty = self_closed(m[4])
        if empty and (open_.get("svg") or open_.get("math")):
            continue  # in a drawing or a formula a slash ends an element
        if tag in RAW:
            last = re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>" if empty else rf"<(/){tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if not empty:
                at = last.end() if last else size
            elif last and last[1]:  # browsers pass over the slash
                at = last.end()
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if empty and tag in ("svg", "math"):
            continue
        # What ends by implication ends an unwanted element too.
        if stack[-1].tag == "head":
            close(len(stack) - 1)
        if tag not in INLINE:
            if tag in CLOSES_P:
                end({"p"})
            if tag in SAME:
                end(SAME[tag])
        inside = stack[-1].article
        cut, suspect = (True, "") if stack[-1].cut else unwanted(tag, m[4], inside)
        if cut:
            if tag not in INLINE and not stack[-1].cut:
                flush()
            push(Node(tag, stack[-1], inside, True))
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            push(Node(tag, stack[-1], inside))
            continue
        flush()
        links = 0
        node = Node(tag, stack[-1], inside or tag in ("article", "main"), suspect=suspect)
        if tag in ("article", "main") or ("class" in m[4] or "id" in m[4]) and POSITIVE.search(m[4]):
            node.score += 5.0
        push(node)
    flush()
    return nodes, out


def kept(nodes: list[Node], found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks without those of suspects that do not hold the article."""
    for node, text, inside in found:
        node.plain += len(text) - inside
    for node in reversed(nodes[1:]):
        node.parent.plain += node.plain
        node.parent.whole |= node.whole
    total = nodes[0].plain
    for node in nodes[1:]:  # comments count only where they hold an article element
        node.state = node.parent.state or (node.suspect == "comment" and not node.whole)
        if node.state and not node.parent.state:
            total -= node.plain
    for node in nodes[1:]:
        most = 2 * node.plain > total
        holds = {"": True, "comment": node.whole and most, "form": node.whole or most}.get(node.suspect, most)
        node.cut = node.parent.cut or not holds
    return [b for b in found if not b[0].cut]


def main_text(html: str) -> str:
    """The article's blocks, joined by blank lines."""
    nodes, found = blocks(html)
    found = kept(nodes, found)
    if not found:
        return ""
    for node in nodes:
        node.state, node.points, node.text, node.linked = None, 0.0, 0, 0
    for node, text, inside in found:
        worth = (1.0 + text.count(",") + min(len(text) / 100.0, 3.0)) * (1.0 - min(1.0, inside / len(text)))
        # A block's own element holds only itself; points start at its parent.
        up = node if node.tag in ("div", "section", "article", "main", "body", "td", "") else node.parent
        up.points += worth
        up.text += len(text)
        up.linked += inside
        up.state = True
    # Inline elements hold no blocks; points halve at each level of blocks.
    for node in reversed(nodes[1:]):
        if node.state:
            up = node.parent
            up.points += node.points / 2.0 if node.tag not in INLINE else node.points
            up.text += node.text
            up.linked += node.linked
            up.state = True
    density = lambda n: n.linked / n.text if n.text else 0.0
    final = lambda n: (n.score + n.points) * (1.0 - density(n))
    best = max((n for n in nodes if n.state), key=final)
    while best.parent is not None and best.parent.tag in ("article", "main"):
        best = best.parent
    if best.article and best.tag not in ("article", "main"):
        up = best
        while up is not None and up.tag != "article":
            up = up.parent
        best = up or best
    bar = max(10.0, 0.2 * final(best))
    # Inside the best container, or inside a sibling of it that scores alike.
    for node in nodes:
        above = node.parent.state if node.parent is not None else False
        node.state = above == "in"
        if node is best or node.state or node.parent is best.parent and best.parent is not None and final(node) >= bar and density(node) < 0.3:
            node.state = "in"

    def belongs(node: Node, text: str, inside: int) -> bool:
        return node.state == "in" or node.parent is best.parent and node.tag == "p" and len(text) > 80 and inside / len(text) < 0.25

    return "\n\n".join(text for node, text, inside in found if belongs(node, text, inside))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
