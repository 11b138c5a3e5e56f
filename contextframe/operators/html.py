"""Optional stages over HTML: slimming, Markdown, links, crawl frontier and folder roll-up."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import folder_of, url_path
from ..options import FetchOptions
from ..sources.shared import checkpointed

# Patterns that Java, RE2 and Python read alike.
SLIM = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<(?:meta|link|base)[^>]*>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>"
SPACES = r"[ \t\r\n]+"
HREF = r'(?i)href="([^"]*)"'


def slim_html(html: Column) -> Column:
    """HTML without comments, scripts, styles, metadata, menus and footers; runs of white space are one space.

    One pass from left to right: what begins first goes, up to its first end.
    """
    return F.regexp_replace(F.regexp_replace(html, SLIM, ""), SPACES, " ")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, position, href of every link of a page."""
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("position", "href"))


def resolve(url: Column, href: Column) -> Column:
    """A link as an absolute URL without fragment."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    target = F.regexp_replace(href, "#.*$", "")
    folder = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "(://[^/]*)?/?[^/]*$", "$1")
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), target))
        .when(target.startswith("/"), F.concat(scheme, host(url), target))
        .when(target == "", F.regexp_replace(url, "#.*$", ""))
        .otherwise(F.concat(folder, F.lit("/"), target))
    )


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int, checkpoint=checkpointed) -> DataFrame:
    """(src, dst), (url) -> url, depth: the least number of links from a seed, up to ``max_depth``.

    Breadth first: each round joins the frontier with the edges and drops what
    has been seen.  ``checkpoint`` computes a round once and cuts its lineage.
    """
    edges = edges.select("src", "dst").distinct()
    if max_depth > 1:
        edges = checkpoint(edges)
    seen = frontier = checkpoint(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, frontier.url == edges.src).select(F.col("dst").alias("url")).distinct()
        frontier = checkpoint(reached.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def crawl_pages(pages: DataFrame, seeds: DataFrame, options: FetchOptions) -> DataFrame:
    """pages (page_id, url, html), seeds (url) -> url, depth, as a website fetch with these options would reach them.

    Without ``follow_links`` only the seeds are reached; with ``same_host_only``
    a link counts only if it stays on its page's host.
    """
    hrefs = links(pages).select(F.col("url").alias("src"), resolve(F.col("url"), F.col("href")).alias("dst"))
    if options.same_host_only:
        hrefs = hrefs.where(host(F.col("src")) == host(F.col("dst")))
    return crawl(hrefs, seeds, options.max_depth if options.follow_links else 0)


def folder_rollup(pages: DataFrame) -> DataFrame:
    """folder, n_items, n_chars over every ancestor folder of each page's path."""
    rel = url_path(F.col("url"))
    parts = F.split(folder_of(rel), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = pages.where(folder_of(rel) != "").select(F.explode(ancestors).alias("folder"), F.length("html").alias("chars"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n_items"), F.sum("chars").cast("long").alias("n_chars"))


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, links, emphasis and code of a page as Markdown."""

    SKIP = frozenset(("script", "style", "head", "template", "noscript"))
    BLOCK = frozenset(("p", "div", "article", "section", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "nav", "footer", "header", "aside"))
    MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = [""]
        self.skipped, self.href, self.open = 0, [], []

    def _block(self, prefix: str = ""):
        for mark in reversed(self.open):
            self.blocks[-1] += mark
        self.open.clear()
        self.blocks.append(prefix)

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        elif re.fullmatch("h[1-6]", tag):
            self._block("#" * int(tag[1]) + " ")
        elif tag == "li":
            self._block("- ")
        elif tag in self.BLOCK:
            self._block()
        elif tag == "br":
            self.blocks[-1] += "\n"
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.blocks[-1] += "["
        elif tag in self.MARKS:
            self.open.append(self.MARKS[tag])
            self.blocks[-1] += self.MARKS[tag]

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCK or tag == "li":
            self._block()
        elif tag == "a" and self.href:
            self.blocks[-1] += f"]({self.href.pop()})"
        elif tag in self.MARKS and self.MARKS[tag] in self.open:
            self.open.remove(self.MARKS[tag])
            self.blocks[-1] += self.MARKS[tag]

    def handle_data(self, data):
        if not self.skipped:
            self.blocks[-1] += re.sub(r"\s+", " ", data)


def markdown_of(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    return "\n\n".join(b for b in (x.strip() for x in parser.blocks) if b.strip("#-*` "))


def _markdown(batches):
    for batch in batches:
        texts = [markdown_of(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "markdown"])


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown; Arrow batches through the standard library's parser."""
    return pages.select("page_id", "html").mapInArrow(_markdown, "page_id long, markdown string")
