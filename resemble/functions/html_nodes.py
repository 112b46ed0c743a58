"""Tolerant HTML → node rows, run on executors inside ``mapInPandas``.

One pass per page emits four kinds of rows in document order:

``e`` element   tag, attributes, ``end`` (last descendant's pos), ``parent``
                (pos of its parent) and ``text``: the text before its first child
``t`` text      a text run; ``tag`` is the parent's tag (``[document]`` at top)
``c`` comment
``b`` block     a run of visible text between two block-level tag boundaries,
                with its word count and the words inside links (the shallow
                features of Kohlschütter et al. 2010); ``parent`` is its
                innermost block-level container

``pos`` and ``end`` are interval labels: the descendants of an element are the
nodes from ``pos`` + 1 to ``end``, so no node carries its ancestors and a page's
nodes grow with its length, however deep it nests.

``page_parts`` folds one page's nodes into one row: title, meta, visible texts
and blocks; what the recipes make of them is native Spark.  Parsing uses the standard library's
``html.parser``: script/style are raw text, entities are decoded (also cut
short ones), ``p``/``li``/``dt``/``dd``/``tr``/``td``/``th``/``option`` close
implicitly, void tags never hold children.

Memory per Python worker is bounded on both sides: input Arrow batches by
``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB by default), output by
yielding the node rows of a few pages at a time.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import Iterator

import pandas as pd

# ---------------------------------------------------------------------------
# HTML element classes.
# ---------------------------------------------------------------------------
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen command".split())
BLOCK_TAGS = frozenset(
    ("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
     "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section table tbody td tfoot "
     "th thead tr ul br title head").split())
CLOSES_P = frozenset(
    ("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul").split())
SIBLING_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE_TAGS = frozenset("ul ol table dl select html body".split())
INVISIBLE_PARENTS = frozenset(["style", "script", "[document]", "head", "title"])
HIDDEN_TAGS = frozenset(["style", "script", "head", "title"])
# ---------------------------------------------------------------------------

NODE_SCHEMA = (
    "page_id long, kind string, pos int, end int, tag string, depth int, "
    "attrs map<string,string>, text string, n_words int, n_link_words int, parent int, nth int"
)
PARTS_SCHEMA = (
    "page_id long, url string, html string, title string, description string, keywords string, property_description string, "
    "property_keywords string, texts array<string>, "
    "blocks array<struct<pos:int,parent:int,text:string,n_words:int,n_link_words:int>>, container int"
)


class _NodeParser(HTMLParser):
    def __init__(self, page_id: int):
        super().__init__(convert_charrefs=True)
        self.page_id = page_id
        self.rows: list[dict] = []
        self.stack: list[dict] = []   # open elements: row dicts
        self.pos = 0
        self.in_a = 0
        self.block_words: list[str] = []
        self.block_text: list[str] = []
        self.block_links = 0
        self.root_counts: dict[str, int] = {}
        self.open: dict[str, int] = {}   # how many elements of a tag are open
        self.hidden = 0                  # open elements whose text is never visible

    # --- helpers --------------------------------------------------------------
    def _next(self) -> int:
        self.pos += 1
        return self.pos

    def _parent(self) -> int:
        return self.stack[-1]["pos"] if self.stack else 0

    def _block_parent(self) -> int:
        return self.stack[-1]["_block"] if self.stack else 0

    def _flush_block(self) -> None:
        if self.block_words:
            pos = self._next()
            self.rows.append(dict(page_id=self.page_id, kind="b", pos=pos, end=pos, tag=None, depth=len(self.stack), attrs=None,
                                  text=" ".join(" ".join(self.block_text).split()), n_words=len(self.block_words),
                                  n_link_words=self.block_links, parent=self._block_parent()))
        self.block_words, self.block_text, self.block_links = [], [], 0

    def _pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            e = self.stack.pop()
            e["end"] = self.pos
            self.open[e["tag"]] -= 1
            self.hidden -= e["tag"] in HIDDEN_TAGS
            if e["tag"] == "a":
                self.in_a = max(0, self.in_a - 1)

    def _find_open(self, tags, stop=SCOPE_TAGS) -> int:
        if not any(self.open.get(t) for t in tags):
            return -1
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.stack[i]["tag"]
            if t in tags:
                return i
            if t in stop:
                return -1
        return -1

    # --- parser callbacks -----------------------------------------------------
    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            i = self._find_open({"p"})
            if i >= 0:
                self._pop_to(i)
        if tag in SIBLING_CLOSE:
            i = self._find_open(SIBLING_CLOSE[tag])
            if i >= 0:
                self._pop_to(i)
        if tag in BLOCK_TAGS:
            self._flush_block()
        counts = self.root_counts
        if self.stack:
            self.stack[-1]["_child"] = True
            counts = self.stack[-1].setdefault("_counts", {})
        counts[tag] = counts.get(tag, 0) + 1
        amap = {k: (v if v is not None else "") for k, v in attrs}
        row = dict(page_id=self.page_id, kind="e", pos=self._next(), end=0, tag=tag, depth=len(self.stack),
                   attrs=amap, text="", n_words=0, n_link_words=0, parent=self._parent(), nth=counts[tag])
        self.rows.append(row)
        if tag in VOID_TAGS:
            row["end"] = row["pos"]
            return
        row["_block"] = row["pos"] if tag in BLOCK_TAGS else self._block_parent()
        self.stack.append(row)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hidden += tag in HIDDEN_TAGS
        if tag == "a":
            self.in_a += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.stack and self.stack[-1]["tag"] == tag:
            self._pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self._flush_block()
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] == tag:
                self._pop_to(i)
                return

    def handle_data(self, data):
        parent = self.stack[-1] if self.stack else None
        ptag = parent["tag"] if parent else "[document]"
        self.rows.append(dict(page_id=self.page_id, kind="t", pos=self._next(), end=self.pos, tag=ptag, depth=len(self.stack),
                              attrs=None, text=data, n_words=0, n_link_words=0, parent=self._parent()))
        if parent is not None and not parent.get("_child"):
            parent["text"] += data
        if parent is not None and not self.hidden:
            w = data.split()
            if w:
                self.block_words.extend(w)
                self.block_text.append(data)
                if self.in_a:
                    self.block_links += len(w)

    def parse_marked_section(self, i, report=1):
        """``<![...`` with an unknown keyword is skipped up to its ``>`` or the next tag, whichever comes first."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            ends = [e for e in (self.rawdata.find(">", i) + 1, self.rawdata.find("<", i + 3)) if e > 0]
            return min(ends, default=len(self.rawdata))

    def handle_comment(self, data):
        if self.stack:
            self.stack[-1]["_child"] = True
        self.rows.append(dict(page_id=self.page_id, kind="c", pos=self._next(), end=self.pos,
                              tag=self.stack[-1]["tag"] if self.stack else "[document]", depth=len(self.stack), attrs=None, text=data,
                              n_words=0, n_link_words=0, parent=self._parent()))

    def finish(self) -> list[dict]:
        self.close()
        self._flush_block()
        self._pop_to(0)
        for r in self.rows:
            r.pop("_child", None)
            r.pop("_counts", None)
            r.pop("_block", None)
            r.setdefault("nth", 0)
        return self.rows


def parse_page(page_id: int, html: str | None) -> list[dict]:
    """Node rows of one page (empty list for empty html)."""
    if not html:
        return []
    p = _NodeParser(page_id)
    p.feed(html)
    return p.finish()


COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def nodes_of_batches(batches: Iterator[pd.DataFrame], pages_per_chunk: int = 64) -> Iterator[pd.DataFrame]:
    """``mapInPandas`` body: (page_id, html) batches → node rows, a few pages at a time."""
    for pdf in batches:
        rows: list[dict] = []
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            rows.extend(parse_page(int(pid), html))
            if len(rows) >= pages_per_chunk * 200:
                yield pd.DataFrame(rows, columns=COLUMNS)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)


_SPACE_ENDS = re.compile(r"^\s+|\s+$")
_COMMENT_TEXT = re.compile(r"<!--[^\n]*-->")


def page_parts(page_id: int, url: str | None, html: str) -> dict:
    """One page as one row: title, meta contents, visible texts in order (stripped, not blank), text blocks."""
    nodes = parse_page(page_id, html)
    out = dict(page_id=page_id, url=url, html=html, title=None, description=None, keywords=None, property_description=None, property_keywords=None)
    title = next((n for n in nodes if n["kind"] == "e" and n["tag"] == "title"), None)
    if title is not None:
        out["title"] = next((n["text"] for n in nodes if n["kind"] == "t" and n["parent"] == title["pos"]), None)
    for n in nodes:
        if n["kind"] == "e" and n["tag"] == "meta":
            for source, prefix in (("name", ""), ("property", "property_")):
                # a property counts only where there is no name
                name = (n["attrs"].get("name", n["attrs"].get("property", "")) if prefix else n["attrs"].get("name", "")).lower()
                for word in ("description", "keywords"):
                    if word in name and out[prefix + word] is None:
                        out[prefix + word] = n["attrs"].get("content", "")
    texts = (_SPACE_ENDS.sub("", n["text"]) for n in nodes
             if n["kind"] == "t" and n["tag"] not in INVISIBLE_PARENTS and not _COMMENT_TEXT.match(n["text"]))
    out["texts"] = [t for t in texts if t]
    blocks = [n for n in nodes if n["kind"] == "b"]
    score: dict[int, int] = {}
    for b in blocks:
        score[b["parent"]] = score.get(b["parent"], 0) + b["n_words"] - b["n_link_words"]
    out["blocks"] = [{k: b[k] for k in ("pos", "parent", "text", "n_words", "n_link_words")} for b in blocks]
    # the container with the most words outside links, the first of equal ones
    out["container"] = min(score, key=lambda p: (-score[p], p), default=0)
    return out


PART_COLUMNS = ["page_id", "url", "html", "title", "description", "keywords", "property_description", "property_keywords", "texts", "blocks", "container"]


def parts_of_batches(batches: Iterator[pd.DataFrame], pages_per_chunk: int = 256) -> Iterator[pd.DataFrame]:
    """``mapInPandas`` body: (page_id, url, html) batches → one row a page, some pages at a time."""
    for pdf in batches:
        rows: list[dict] = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            rows.append(page_parts(page_id, url, html))
            if len(rows) == pages_per_chunk:
                yield pd.DataFrame(rows, columns=PART_COLUMNS)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=PART_COLUMNS)
