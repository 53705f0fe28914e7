"""Main text of web pages by composite text density.

A small tolerant reader builds the tree of a page. Boilerplate subtrees (by tag, role, or names in class and id) are
left out first. A name counts as a whole: all its parts must be marks or their usual affixes. A mark by name, or a form,
is overruled by the text: see :func:`overrule`. For every node the density is its characters per tag, lowered by the share of link characters; a
node's density sum is the sum of its children's densities. The node with the largest density sum is the core, on a tie
an article or main element, else the first. The lowest density on the path from the core to the body is the threshold:
ancestors are taken instead of the core as long as they add children that reach it. Where the core holds most of the
text of an article around it, the climb takes that article even if what it adds is thinner; and out of an article or
main element it only climbs over siblings of the same kind. The chosen subtree is rendered as blocks.

Defined cases: null and empty html give an empty text; a page without body is read as if it had one; unclosed and
stray tags are repaired as browsers do for paragraphs, list items and table cells; scripts, styles, comments and
hidden elements never count; pages are read whole; repeated rows give equal results; extra columns pass through
except html, and those named text or n_chars, which are replaced; deep nesting does not recurse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.columns import quoted, unused
from loomgraph.llm.text import by_weight, map_rows

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "select", "audio", "video"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "label", "input", "fieldset"}
RAW_END = {t: re.compile(f"</{t}(?![a-z0-9:-])", re.I | re.A) for t in RAW}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening tag closes when it is the innermost open element of its kind, up to the given borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Names in class or id, or roles, that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promoted",
    "promotion", "nav", "navbar", "navigation", "menu", "topmenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar",
    "aside", "rail", "widget", "widgets", "footer", "footnav", "colophon", "masthead", "topbar", "toolbar", "siteheader",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "disclaimer", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "comment", "comments", "commentlist", "commentbox", "discussion", "disqus", "replies", "respond", "reply", "share",
    "sharing", "social", "related", "recommended", "recommendations", "trending", "copyright", "search", "searchbox", "skip", "legal",
}
#: Marks that inside an article or main element are as likely part of its text.
WEAK = {"notice", "notices", "legal", "disclaimer", "discussion", "subscription", "search", "trending", "rail", "overlay"}
SAID = {"comment", "comments", "commentlist", "commentbox", "discussion", "disqus", "replies", "respond", "reply"}
#: Parts that a compound name may have beside marks; any other part (has, no, with, results, price) makes it another name.
AFFIXES = {
    "site", "page", "main", "top", "bottom", "left", "right", "global", "primary", "secondary", "header", "head", "section", "area", "block",
    "box", "bar", "list", "item", "items", "container", "wrapper", "wrap", "inner", "outer", "row", "col", "column", "panel", "group",
    "link", "links", "button", "buttons", "icons", "form", "field", "input", "text", "title", "heading", "slot", "unit", "zone", "google", "js", "mobile", "desktop",
    "content", "contents", "posts", "articles", "stories", "post", "message", "thread", "media", "policy", "to",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")
SIZES = re.compile(r"\d+x\d+")
CAMEL = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "soft", "main", "chars", "links", "tags", "density", "sums")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, main: bool = False, soft: str = ""):
        self.tag, self.parent, self.drop, self.main, self.soft = tag, parent, drop, main, soft
        self.parts: list[Node | str] = []
        self.clear()

    def clear(self) -> None:
        self.chars = self.links = self.tags = 0
        self.density = self.sums = 0.0


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) for k, v in ATTRIBUTE.findall(raw)}


def boilerplate(tag: str, raw: str, in_main: bool) -> str:
    """How a node is marked: hard, soft (a name or a form), said (a name of comments), or empty."""
    if tag in DROPPED and tag not in ("form", "fieldset"):
        return "hard"
    if tag == "header" and not in_main:
        return "hard"
    soft = "soft" if tag in DROPPED else ""
    if not raw or not raw.strip(" /"):
        return soft
    a = attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES:
        return "hard"
    style = a.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return "hard"
    found = marks(a)
    if tag in ("body", "html", "main", "article"):
        found &= {"comment", "comments", "reply", "ad", "ads", "related"} if tag == "article" else set()
        return "said" if found & SAID else "soft" if found else ""
    if in_main:
        found -= WEAK | {"header"}
    return "said" if found & SAID else "soft" if found else soft


def marks(a: dict[str, str]) -> set[str]:
    """Marks among the whole names of class and id; header is one of them."""
    out = set()
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        parts = set(WORDS.findall(SIZES.sub("", CAMEL.sub(r"\1-\2", name).lower())))
        found = parts & MARKS
        if found and parts <= MARKS | AFFIXES:
            out |= found
        elif parts and "header" in parts and parts <= {"header", "site", "page", "main", "top", "global", "container", "wrapper", "wrap", "inner", "bar"}:
            out.add("header")
    return out


def parse(html: str) -> Node:
    """Tree of the page; boilerplate subtrees are marked."""
    root = Node("html", None)
    here, at, size = root, 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            here.parts.append(html[at:])
            break
        if m.start() > at:
            here.parts.append(html[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag, raw = tag.lower(), m.group(3) or ""
        if m.group(1):
            node = here
            while node is not None and node.tag != tag:
                # an end tag of an inline element does not leave its block
                node = None if tag not in BLOCKS and node.tag in BLOCKS and tag not in DROPPED else node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            elif tag == "p":
                here.parts.append(Node("p", here))
            continue
        if tag in ("html", "body"):
            if tag == "body":
                while here.parent is not None and here.tag != "body":
                    here = here.parent
                if here.tag != "body":
                    new = Node("body", here)
                    here.parts.append(new)
                    here = new
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            node = here
            while node is not None and (node.tag not in BLOCKS or node.tag == "p"):
                if node.tag == "p":
                    here = node.parent
                    break
                node = node.parent
        if tag in CLOSES:
            ends, borders = CLOSES[tag]
            node = here
            while node is not None and node.tag not in borders:
                if node.tag in ends:
                    here = node.parent
                    break
                node = node.parent
        in_main = here.main or tag in ("article", "main")
        mark = boilerplate(tag, raw, in_main and tag != "header" or here.main)
        main = here.main or tag in ("article", "main") or (mark != "hard" and "main" in raw and attributes(raw).get("role") == "main")
        new = Node(tag, here, bool(mark), main, "" if mark == "hard" else mark)
        here.parts.append(new)
        if tag in VOID or raw.endswith("/") and tag in RAW:
            continue
        if tag in RAW:  # its text is no markup
            m = RAW_END[tag].search(html, at)
            end = m.start() if m else -1
            if end < 0 and tag in ("title", "textarea", "svg", "math", "object", "noscript"):
                continue
            at = size if end < 0 else (html.find(">", end) + 1 or size)
            continue
        here = new
    return root


def overrule(root: Node) -> None:
    """Takes back marks by name that the text speaks against: where no unmarked article or main element is elsewhere, from
    nodes that hold one or (comments apart) most of the page's unlinked text; else from nodes, comments apart, that
    hold both."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.drop or node.soft:
            nodes.append(node)
            todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    soft = [n for n in nodes if n.soft]
    if not soft:
        return
    for n in soft:
        n.drop = False
    weigh(nodes)
    holds, inside = set(), set()  # nodes with an unmarked article or main element; nodes at or under a marked one
    for n in nodes:
        if n.soft or n.parent in inside:
            inside.add(n)
    for n in reversed(nodes):
        if n.tag in ("article", "main") and not n.soft and n.chars > n.links or n in holds:
            holds.add(n)
            if n.parent is not None:
                holds.add(n.parent)
    free = any(n.tag in ("article", "main") and n not in inside and n.chars > n.links for n in nodes)
    half = (root.chars - root.links) / 2
    for n in soft:
        most = n.soft == "soft" and n.chars - n.links > half
        n.drop = not (most and n in holds if free else most or n in holds)
    for n in nodes:
        n.clear()


def order(root: Node) -> list[Node]:
    """Kept nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.drop:
            out.append(node)
            todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def weigh(nodes: list[Node]) -> None:
    """Densities and density sums, children before parents."""
    for node in reversed(nodes):
        for p in node.parts:
            if isinstance(p, str):
                n = len(SPACE.sub(" ", unescape(p) if "&" in p else p).strip())
                node.chars += n
                if node.tag == "a":
                    node.links += n
            elif not p.drop:
                node.chars += p.chars
                node.links += p.chars if node.tag == "a" else p.links
                node.tags += p.tags + (p.tag not in ("b", "i", "em", "strong", "br", "span", "sup", "sub"))
                node.sums += p.density
        plain = node.chars - node.links
        node.density = plain / max(node.tags, 1) * (plain / node.chars) if node.chars else 0.0
        if any(isinstance(p, str) and not p.isspace() for p in node.parts):
            node.sums = max(node.sums, node.density if node.tag not in ("a", "li") else 0.0)


def titled(node: Node, child: Node) -> bool:
    """Whether what stands beside ``child`` in ``node`` belongs to the same article though it is short: all of it is plain text, at
    least one heading stands before the child, and in the body itself there is no other division."""
    seen = False
    for p in node.parts:
        if not isinstance(p, Node) or p.drop or not p.chars:
            seen = seen or p is child
            continue
        if p is child:
            if not head_before(node, child):
                return False
            seen = True
        elif 2 * p.links > p.chars or node.tag in ("body", "html") and p.tag in ("div", "section", "header", "main", "article", "table"):
            return False
    return seen


def head_before(node: Node, child: Node) -> bool:
    """Whether a kept heading stands before the child, alone or in a header or group."""
    for p in node.parts:
        if p is child:
            return False
        if isinstance(p, Node) and not p.drop and p.chars > p.links:
            inner = [p, *(q for q in p.parts if isinstance(q, Node))] if p.tag in ("header", "hgroup") else [p]
            if any(q.tag in HEADINGS and not q.drop for q in inner):
                return True
    return False


def core(nodes: list[Node]) -> Node | None:
    """The chosen subtree."""
    some = [n for n in nodes if n.chars > n.links and (n.tag in BLOCKS or n.parent is None)]
    if not some:
        return None
    best = max(some, key=lambda n: (n.sums, n.tag in ("article", "main")))
    path, node = [], best
    while node is not None:
        path.append(node)
        if node.tag == "body":
            break
        node = node.parent
    threshold = min(n.density for n in path)
    plain, on_path = best.chars - best.links, set(path)
    at = 0
    for i, node in enumerate(path[1:], 1):
        if node.tag == "html":
            break
        # out of an article or main element that the climb has reached, only its like count
        edge = {n.tag for n in path[: i] if n.tag in ("article", "main")}
        inside = any(n.tag == "main" for n in path[i:])
        more = any(
            isinstance(p, Node) and not p.drop and p not in on_path and p.density >= threshold and p.chars > p.links
            and (not edge or p.tag in edge or inside and "main" not in edge)
            for p in node.parts
        )
        child = path[i - 1]
        # what stands beside the article in its own parent is judged with the parent, short as it may be
        like = "article" in edge and node.tag == "main" and any(isinstance(p, Node) and not p.drop and p is not child and p.tag == "article" and p.chars > p.links for p in node.parts)
        more = more or like or not edge and titled(node, child)
        if more or node.tag == "article" and 2 * plain >= node.chars - node.links:
            at = i
        elif edge or node.tag not in BLOCKS:
            break
    return path[at]


def rendered(root: Node) -> str:
    """Blocks of the subtree in page order, set off by empty lines."""
    blocks, line = [], []

    def close() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    todo: list[Node | str | None] = [root]
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            line.append(unescape(item) if "&" in item else item)
        elif item.tag == "br":
            line.append(" ")
        elif item.drop and item is not root:
            if item.tag in BLOCKS or item.tag in DROPPED:
                close() if item.tag not in RAW else line.append(" ")
        else:
            if item.tag in BLOCKS:
                close()
                todo.append(None)
            todo += reversed(item.parts)
    close()
    return "\n\n".join(blocks)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    overrule(root)
    nodes = order(root)
    weigh(nodes)
    best = core(nodes)
    return rendered(best) if best is not None else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, plus text and n_chars."""
    keep = [f for f in pages.schema.fields if f.name.lower() not in ("text", "n_chars") and f.name != html]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    source, = unused([f.name for f in keep], "html")
    rows = pages.select(*quoted([f.name for f in keep]), F.col(html).alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_weight(batches, source):
            text = [main_text(h) for h in b.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in keep], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=[*[f.name for f in keep], "text", "n_chars"],
            )

    return map_rows(rows, run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
