"""Main text of HTML pages by composite text density.

A page becomes a light tree of its tags.  Elements that a page marks as
something else (menus, page headers and footers, sidebars, notices, adverts,
forms, scripts, comments) are left out by their tag, role or class.  For every
other node the composite density is

    D = C / T * log_b(C / LC * T / LT),   b = ln(C * LC / NC + C * LC_body / C_body + e)

with C characters, T tags, LC characters and LT tags of links, NC characters
outside links (each at least 1).  A node's score is the sum of its children's
densities.  The node of the largest score is the centre; the smallest density
on the path from the body to it is the threshold, and the main subtree is the
highest node of that path all of whose inner nodes reach it with text of their
own: it starts at the centre and is widened upwards while the parent holds
nothing below the threshold.  Where the page marks an ``article`` or ``main``
around that subtree, or one inside it with most of its text, that is taken.

A row is parsed by one pass over its tags inside a task; rows never meet.
Defined results: null, empty or text-less html has an empty text; broken
markup is read on as far as it goes (an unknown ``<!...>`` is skipped, an
unclosed comment, script or style ends the page); repeated rows get equal
results; columns of the input named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
                    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")

# Elements of HTML by their role here
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var wbr".split())
SKIPPED = set("head nav aside footer form button select option label input fieldset dialog menu object embed audio "
              "video canvas map".split())
NEVER_SKIPPED = {"html", "body"}
SKIPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
SKIPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "outbrain pagination paywall popup promo promotion related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola toolbar widget".split())
#: these tell what an element is wherever they stand in its name, and whether it is an article
STRONG_WORDS = set("adsbygoogle advert advertisement comment comments cookie disqus promo related replies reply".split())
CLOSES_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
               "h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
                  "th": {"tr", "table"}, "option": {"select"}}
SCOPES = set("html body article main section div td th table li blockquote".split())


class _Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "skip", "density")

    def __init__(self, tag, parent, skip):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.parts = []  # texts and nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _attributes(raw: str) -> dict:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def _is_skipped(tag: str, raw: str, inside_article: bool) -> bool:
    if tag in NEVER_SKIPPED:
        return False
    if tag in SKIPPED or tag == "header" and not inside_article:
        return True
    if not raw.strip():
        return False
    attr = _attributes(raw)
    if "hidden" in attr or attr.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attr.get("style", "")):
        return True
    if attr.get("role", "").lower() in SKIPPED_ROLES:
        return True
    for name in (attr.get("class", "") + " " + attr.get("id", "")).split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
        # "with-sidebar" names what a part of the element is, "sidebar-left" and "left-sidebar" what it is
        if not words or words[0] in ("has", "with", "no", "without"):
            continue
        if STRONG_WORDS.intersection(words) or tag not in ("article", "main") and (words[0] in SKIPPED_WORDS or words[-1] in SKIPPED_WORDS):
            return True
    return False


def _tree(page: str) -> _Node:
    root = _Node("html", None, False)
    stack, at, articles = [root], 0, 0

    def pop_to(index: int) -> None:
        nonlocal articles
        articles -= sum(n.tag in ("article", "main") for n in stack[index:])
        del stack[index:]

    def add_text(text: str) -> None:
        if text and not stack[-1].skip:
            stack[-1].parts.append(html.unescape(text))

    for m in _TOKEN.finditer(page):
        add_text(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[0] == "<":
                add_text("<")
            continue
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                # an inline end tag does not close the blocks around it
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P or tag in CLOSED_BY_SAME:
            ends, bounds = (("p",), SCOPES) if tag in CLOSES_P else ((tag, "dd") if tag == "dt" else (tag, "dt") if tag == "dd" else (tag,), CLOSED_BY_SAME[tag])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    pop_to(i)
                    break
                if stack[i].tag in bounds:
                    break
        parent = stack[-1]
        node = _Node(tag, parent, parent.skip or _is_skipped(tag, m[4], articles > 0))
        if not node.skip:
            parent.parts.append(node)
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append(node)
            articles += tag in ("article", "main")
    add_text(page[at:])
    return root


def _walk(root: _Node) -> list[_Node]:
    """Nodes that are not left out, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(p for p in reversed(node.parts) if isinstance(p, _Node))
    return out


def _measure(nodes: list[_Node]) -> None:
    for node in reversed(nodes):
        node.chars += sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        c, t, lc, lt = max(n.chars, 1), max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
        base = math.log(c * lc / max(n.chars - n.link_chars, 1) + share * c + math.e)
        inner = c / lc * t / lt
        n.density = c / t * max(math.log(inner) / math.log(base), 0.0) if n.chars and base > 1 else 0.0


def _main(nodes: list[_Node]) -> _Node:
    """The main subtree: see the module's text."""
    best, top = nodes[0], -1.0
    for n in nodes:
        score = sum(p.density for p in n.parts if isinstance(p, _Node))
        if score > top:
            best, top = n, score
    if top <= 0:
        return nodes[0]
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    while best.parent is not None:
        others = [p for p in best.parent.parts if isinstance(p, _Node) and p is not best and p.chars and p.tag not in INLINE]
        if any(p.density < threshold for p in others):
            break
        best = best.parent
    return best


def _blocks(root: _Node) -> str:
    """Texts of the blocks under ``root``, white space as one space, joined by one space."""
    out: list[str] = []
    # inline elements leave the text around them in one block; any other tag ends the block
    todo: list = [root]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        elif isinstance(part, _Node):
            gap = [] if part.tag in INLINE else [" "]
            todo.extend(gap + list(reversed(part.parts)) + gap)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """Main text of one page.

    The densest subtree is widened to the outermost ``article`` or ``main``
    around it, or narrowed to one inside it that holds most of its text.
    """
    if not page:
        return ""
    root = _tree(page)
    nodes = _walk(root)
    _measure(nodes)
    best = _main(nodes)
    marked = {id(n) for n in nodes if n.tag in ("article", "main")}
    around, up = None, best
    while up is not None:
        around = up if id(up) in marked else around
        up = up.parent
    if around is None:
        inside = [n for n in _walk(best) if id(n) in marked and 2 * n.chars > best.chars]
        around = inside[0] if inside else best
    return _blocks(around)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` and ``n_chars``."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = pages.select(*[f"`{c}`" for c in kept], f"`{html_col}`")
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def step(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    part.columns[:-1] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[f.name for f in schema])

    return source.mapInArrow(step, schema)
