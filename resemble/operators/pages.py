"""HTML → text extractors over a ``pages(page_id, url, html)`` table.

A page is parsed once, on the executor that reads it, and stays one row
(``page_parts``): title, meta contents, visible texts and text blocks, in order.
Every recipe is then a row-local native expression over these arrays: meta (E2),
URL words (E3), visible text (E4, F7), block classification by a block's
neighbours in the array (E6), the top container (E7, E8), the combination (E9)
and the dispatcher (E10).  Selections (E5) are matched on the parsed nodes in the
same kind of pass (``functions/selectors.py``).  So no recipe has a window, a join
or a shuffle.

``page_nodes`` gives the nodes as rows with interval labels, for user extractors.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resemble.functions.html_nodes import NODE_SCHEMA, PARTS_SCHEMA, nodes_of_batches, parse_page, parts_of_batches
from resemble.functions.selectors import SELECTOR_TYPES, compile_selector
from resemble.functions.urltext import join_parts, url_text

# ---------------------------------------------------------------------------
# Extractor names (the first is the default), selector types,
# and the block rule thresholds of Kohlschütter, Fankhauser, Nejdl (2010).
# ---------------------------------------------------------------------------
EXTRACTORS = ("dragnet", "goose", "goose_dragnet", "readability", "selective", "all_text")
MAX_LINK_DENSITY = 1 / 3
PREV_LINK_DENSITY = 5 / 9
# ---------------------------------------------------------------------------


def page_nodes(pages: DataFrame) -> DataFrame:
    """Node rows of every page (see ``NODE_SCHEMA``)."""
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")) \
        .mapInPandas(nodes_of_batches, NODE_SCHEMA)


def page_parts(pages: DataFrame) -> DataFrame:
    """One row a page: ``(page_id, url, html, title, description, keywords, ..., texts, blocks)`` (see ``PARTS_SCHEMA``)."""
    whole = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return whole.mapInPandas(parts_of_batches, PARTS_SCHEMA)


def _meta(meta_property: bool = False) -> dict[str, Column]:
    """E2 + E3 over ``page_parts``: title, description, keywords and URL words, never null.

    Title: the first text inside the first ``<title>``; description/keywords:
    the ``content`` of the first ``<meta>`` whose ``name`` contains the word,
    any case.  ``property`` is consulted only with ``meta_property=True`` and
    only where ``name`` is missing (by default never, as in the reference, Q1).
    """
    prefix = "property_" if meta_property else ""
    return {"title": F.coalesce("title", F.lit("")), "description": F.coalesce(prefix + "description", F.lit("")),
            "keywords": F.coalesce(prefix + "keywords", F.lit("")), "url_text": url_text(F.col("url"))}


def page_meta(nodes: DataFrame, meta_property: bool = False) -> DataFrame:
    """E2 over node rows, for user extractors: ``(page_id, title, description, keywords)``.

    Title: the first text inside the first ``<title>``; description/keywords:
    the ``content`` of the first ``<meta>`` whose ``name`` contains the word,
    any case.  ``property`` is consulted only with ``meta_property=True`` and
    only when ``name`` is missing (by default never, as in the reference, Q1).
    """
    first_title = nodes.where((F.col("kind") == "e") & (F.col("tag") == "title")) \
        .groupBy("page_id").agg(F.min("pos").alias("tpos"))
    title = nodes.where(F.col("kind") == "t").join(first_title, "page_id") \
        .where(F.col("parent") == F.col("tpos")).groupBy("page_id").agg(F.min_by("text", "pos").alias("title"))
    metas = nodes.where((F.col("kind") == "e") & (F.col("tag") == "meta"))
    name = F.coalesce(F.col("attrs")["name"], F.col("attrs")["property"] if meta_property else F.lit(""),
                      F.lit(""))
    content = F.coalesce(F.col("attrs")["content"], F.lit(""))
    meta = metas.groupBy("page_id").agg(
        F.min_by(F.when(name.rlike("(?i)description"), content), F.when(name.rlike("(?i)description"), F.col("pos")))
        .alias("description"),
        F.min_by(F.when(name.rlike("(?i)keywords"), content), F.when(name.rlike("(?i)keywords"), F.col("pos")))
        .alias("keywords"),
    )
    return title.join(meta, "page_id", "full")


def meta_parts(pages: DataFrame, nodes: DataFrame | None = None, meta_property: bool = False) -> DataFrame:
    """E2 + E3: ``(page_id, url, title, description, keywords, url_text)`` for every page; ``nodes`` is not needed."""
    return page_parts(pages).select("page_id", "url", *[c.alias(n) for n, c in _meta(meta_property).items()])


def _all_text() -> Column:
    """Meta parts, then every visible text (F7), each stripped, blanks dropped, joined ``', '``."""
    return join_parts(*[F.trim(c) for c in _meta().values()], F.when(F.size("texts") > 0, F.array_join("texts", ", ")))


# --- E5 selectors -------------------------------------------------------------

def selector_predicate(selector: str, selector_type: str = "css"):
    """The selector as a function of one page's nodes; ``ValueError`` if it is blank, unknown or unsupported."""
    return compile_selector(selector, selector_type)


def selective(pages: DataFrame, selector: str, selector_type: str = "css", nodes: DataFrame | None = None) -> DataFrame:
    """E5: for each match in document order, the ``.text`` of every element in its
    subtree joined by a space, plus one space after each match.

    Pages are parsed and matched in one pass; ``nodes`` is not needed.
    """
    content = compile_selector(selector, selector_type)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [content(parse_page(0, html)) for html in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "content": found})

    whole = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return whole.mapInPandas(run, "page_id long, url string, content string")


# --- E6-E9 main content -------------------------------------------------------

def _link_density(block: Column) -> Column:
    return block["n_link_words"] / block["n_words"]


def _texts(blocks: Column, sep: str) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), sep)


def density_content() -> Column:
    """E6 body: blocks kept by the shallow-feature rule, in order, joined by a space.

    A block's neighbours are the array's; the first and the last block have an empty one beside them.
    """
    blocks = F.col("blocks")

    def keep(b: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        pw, pld = F.coalesce(before["n_words"], F.lit(0)), F.coalesce(_link_density(before), F.lit(0.0))
        nw, words = F.coalesce(after["n_words"], F.lit(0)), b["n_words"]
        return (_link_density(b) <= MAX_LINK_DENSITY) & F.when(
            pld <= PREV_LINK_DENSITY, (words > 16) | (nw > 15) | (pw > 4)).otherwise((words > 40) | (nw > 17))

    return _texts(F.filter(blocks, keep), " ")


def container_content(sep: str = " ", drop_link_blocks: bool = False) -> Column:
    """E7/E8 body: the block container with the most non-link words, the first of equal ones; its blocks in order."""
    chosen = F.filter("blocks", lambda b: b["parent"] == F.col("container"))
    if drop_link_blocks:
        chosen = F.filter(chosen, lambda b: _link_density(b) <= MAX_LINK_DENSITY)
    return _texts(chosen, sep)


def _with_meta(body: Column) -> Column:
    return join_parts(*_meta().values(), body)


def _recipe(method: str) -> Column:
    """The content of a page by a named recipe, over ``page_parts``."""
    if method == "all_text":
        return _all_text()
    if method == "dragnet":
        return _with_meta(density_content())
    if method == "readability":
        return _with_meta(container_content(" "))
    if method == "goose":
        return _with_meta(container_content("\n\n", drop_link_blocks=True))
    # goose_dragnet: content first (density, else cleaned text), then meta text
    body = F.coalesce(F.nullif(density_content(), F.lit("")), container_content("\n\n", drop_link_blocks=True))
    return join_parts(body, join_parts(*_meta().values()))


_USER_EXTRACTORS: dict = {}


def register_extractor(name: str, fn) -> None:
    """V2: a user extractor ``(pages, nodes) -> DataFrame(page_id, url, content)``."""
    _USER_EXTRACTORS[name] = fn


def extract(pages: DataFrame, method: str = "dragnet", selector: str | None = None,
            selector_type: str = "css", url_fallback: bool = True,
            fallback_after_extract: bool = False) -> DataFrame:
    """``(page_id, url, content)`` by the named recipe.

    F6: empty raw html → the URL.  ``fallback_after_extract=True`` also gives
    the URL to pages whose extracted text is empty (the reference does this for
    batches over ten pages only, quirk Q3).
    """
    if method not in EXTRACTORS and method not in _USER_EXTRACTORS:
        raise ValueError("The extractor name '%s' does not support yet" % method)
    pages = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    blank = F.col("html") == ""
    if method in _USER_EXTRACTORS or method == "selective":
        # these give rows of their own; blank pages never reach them, so none is joined back
        made = pages if not url_fallback else pages.where(~blank)
        if method == "selective":
            out = selective(made, selector or "", selector_type)
        else:
            out = _USER_EXTRACTORS[method](made, page_nodes(made)).select("page_id", "url", "content")
        if url_fallback:
            out = out.unionByName(pages.where(blank).select("page_id", "url", F.col("url").alias("content")))
    else:
        content = _recipe(method)
        out = page_parts(pages).select("page_id", "url", (F.when(blank, F.col("url")).otherwise(content) if url_fallback else content).alias("content"))
    if fallback_after_extract:
        out = out.select("page_id", "url", F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.col("url"))
                         .otherwise(F.col("content")).alias("content"))
    return out
