"""Main text of web pages by line-block distribution.

Markup is stripped such that every block element becomes a line.  Lines of
menus, forms, notices and the like weigh nothing, others as much as they are
long, and more within an article element.  Sums over sliding windows of lines
show where the text surges and where it dives; what stands between such points
is kept.  On pages with an article element, text outside of it counts where its
sums rise about as high as those within.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty

# Element names and words of class, id and role attributes.
RAW = "script|style|textarea|iframe|title"
SKIPPED = frozenset("noscript template select svg math object canvas audio video button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NESTED = frozenset("address article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
APART = frozenset("nav footer aside form menu dialog fieldset".split())
AD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars side rail menu nav navbar navigation topnav breadcrumb breadcrumbs "
    "footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login share sharing "
    "social follow related recommended recommendations trending popular comment comments commentlist reply replies disqus respond widget pagination pager copyright legal disclaimer search skip tags hidden".split()
)
REPLIES = frozenset("comment comments reply replies".split())
PLAIN_PARTS = frozenset(
    "area article bar block body bottom box btn button col column container content desktop div el end entry fixed foot form global group head header holder hot inline inner item js large left line link links list "
    "main mobile module new news outer page panel placeholder post primary right row section site slot small sticky text title top unit user web wrap wrapper zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile(r"[>\"']")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
COMMENT_END = re.compile(r"--\s*>")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME_PART = re.compile(r"[a-z]+")
PHRASES = frozenset("select button".split())  # skipped elements in which no block but a div can stand
PARTS = frozenset("li dt dd tr td th caption tbody thead tfoot".split())
LISTS = frozenset("dl ol table ul".split())
SENTENCE_ENDS = ".!?\u3002\uff01\uff1f"
LABEL_WORDS = 6
WINDOW = 3
ARTICLE = 2  # a line within an article or main element weighs so many times its length


class _Tags:
    """The tags of a page in order, in time proportional to its length whatever quotes and brackets are left open.

    ``start`` and ``end`` are a tag's place, ``name`` its lower-case name or None
    for comments and declarations; scripts, styles and the like come whole.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def _tag_end(self, at: int) -> int:
        """Where a tag's > stands, quoted values apart; a quote that is not closed is no quote.  -1 if there is none."""
        while at <= self.last[">"]:
            m = TAG_STOP.search(self.page, at)
            if m[0] == ">":
                return m.start()
            at = m.end()
            if at <= self.last[m[0]] and self.page[max(0, m.start() - 9) : m.start()].rstrip().endswith("="):
                at = self.page.find(m[0], at) + 1
        return -1

    def __iter__(self):
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            m = TAG_NAME.match(page, start) if start < self.last[">"] else None
            if m:
                stop = self._tag_end(m.end())
                if stop < 0:
                    continue
                name, rest, end = m[2].lower(), page[m.end() : stop], stop + 1
                if not m[1] and name in RAW_END and not rest.endswith("/"):
                    close = RAW_END[name].search(page, end)
                    name, end = None, close.end() if close else len(page)
                yield start, end, name, bool(m[1]), rest
            elif page.startswith("<!--", start):
                close = COMMENT_END.search(page, start + 4)
                end = close.end() if close else len(page)
                yield start, end, None, False, ""
            elif page[start : start + 9].upper() == "<![CDATA[":
                close = page.find("]]>", start)
                end = close + 3 if close >= 0 else len(page)
                yield start, end, None, False, page[start + 9 : end].removesuffix("]]>")
            elif page[start + 1 : start + 2] in ("!", "?", "/") and self.last[">"] > start:
                end = page.index(">", start) + 1
                yield start, end, None, False, ""
            else:
                continue
            at = end


def _says(value: str, words: frozenset) -> bool:
    """Whether a class, id or role attribute names one of the words.

    A name does if all of its parts are such words or say nothing by themselves:
    "ad-box" and "footer2" do, "legal-analysis" does not.
    """
    for token in value.split():
        parts = NAME_PART.findall(token)
        if parts and not words.isdisjoint(parts) and all(p in words or p in PLAIN_PARTS or len(p) == 1 for p in parts):
            return True
    return False


def _is_apart(name: str, rest: str, inside: bool) -> bool:
    """Whether an element holds no article text: by its name, or what its attributes call it."""
    if name in APART or name == "header" and not inside:
        return True
    if not rest or name in ("html", "body", "main"):
        return False
    words = REPLIES if name == "article" else AD_WORDS
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "role" and value in ROLES or key in ("class", "id") and _says(value, words):
            return True
    return False


def _ends_skipped(skipped: str, name: str, end: bool, within: Counter) -> bool:
    """Whether a tag ends the skipped element: its own end, the end of what holds it, or the start of what cannot stand in it."""
    if end:
        return within[name] < 1 and (name == skipped or name in BLOCKS)
    if name == "body" or name in ("article", "main") and skipped != "template":
        return True
    if skipped in ("svg", "math") and not within["foreignobject"] or skipped in PHRASES:
        return name in BLOCKS and name not in ("div", "option", "optgroup", "hr", "legend", "menu")
    return name in PARTS and not any(within[n] > 0 for n in ("ul", "ol", "dl", "menu", "table", "template"))


def lines(page: str) -> list[tuple[str, bool, bool, bool, int]]:
    """(text, apart, inside an article, whether it is a label, number of the element around it) of every block of a page, in order.

    A label is a line of links of a few words each, such as a menu has; the
    element around a line is the innermost one that is not a list or table.
    """
    out: list[tuple[str, bool, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []
    standing: Counter = Counter()  # how many of each are open
    buffer: list[str] = []
    apart = inside = False
    linked, links, in_link = 0, 0, False
    around = opened = 0
    skipped, within = "", Counter()  # the element that is skipped, and how many of each are open in it

    def close_line():
        nonlocal linked, links
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                label = linked > 0.6 * len(text) and len(text.split()) < LABEL_WORDS * max(links, 1) and text[-1] not in SENTENCE_ENDS
                out.append((text, apart, inside, label, around))
            buffer.clear()
        linked, links = 0, int(in_link)

    at = 0
    for start, end, name, closes, rest in _Tags(page):
        if start > at and not skipped:
            piece = page[at:start]
            buffer.append(piece)
            linked += in_link * len(piece)
        at = end
        if name is None:
            if rest and not skipped:
                buffer.append(html.escape(rest, quote=False))
            continue
        if skipped:
            if not _ends_skipped(skipped, name, closes, within):
                if name in BLOCKS or name in SKIPPED or name == "foreignobject":
                    within[name] += -1 if closes else not rest.endswith("/")
                continue
            skipped = ""
            within.clear()
        if name in SKIPPED:
            skipped = "" if closes or rest.endswith("/") else name
            continue
        if name == "a":
            in_link = not closes
            links += in_link
        elif name in ("br", "wbr", "img", "input"):
            buffer.append("" if name == "wbr" else " ")
        if name not in BLOCKS:
            continue
        close_line()
        if name not in NESTED:
            continue
        if not closes:
            apart = apart or _is_apart(name, rest, inside)
            inside = inside or name in ("article", "main")
            if name not in LISTS:
                opened += 1
                around = opened
            stack.append((name, apart, inside, around))
            standing[name] += 1
        elif standing[name]:
            while True:
                gone = stack.pop()[0]
                standing[gone] -= 1
                if gone == name:
                    break
            _, apart, inside, around = stack[-1] if stack else ("", False, False, 0)
    if not skipped:
        buffer.append(page[at:])
    close_line()
    return out


def _weights(rows: list[tuple[str, bool, bool, bool, int]]) -> list[int]:
    """What each line weighs: nothing if it is apart, or a label that no text holds.

    Text holds the labels between two of its lines in one element, those after
    it if they are fewer than ``WINDOW`` in a row or in an article element, and
    there fewer than ``WINDOW`` in a row anywhere.  Else they are a menu.
    """
    out = [0 if apart or label else ARTICLE * len(text) if inside else len(text) for text, apart, inside, label, _ in rows]
    shown = [i for i, row in enumerate(rows) if not row[1]]
    ends = {}  # by element, its first and last line of text
    for i in shown:
        if not rows[i][3]:
            ends.setdefault(rows[i][4], [i, i])[1] = i
    at = 0
    while at < len(shown):
        end = at
        while end < len(shown) and rows[shown[end]][3:] == rows[shown[at]][3:]:
            end += 1
        if not rows[shown[at]][3]:
            at = end
            continue
        for i in shown[at:end]:
            text, _, inside, _, around = rows[i]
            first, last = ends.get(around, (i, i))
            few = end - at < WINDOW
            if first < i and (i < last or inside or few) or inside and few:
                out[i] = ARTICLE * len(text) if inside else len(text)
        at = end
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by newlines; empty where a page has none, or is null or empty."""
    if not page:
        return ""
    rows = lines(page)
    weight = _weights(rows)
    n = len(weight)
    sums = [sum(weight[i : i + WINDOW]) for i in range(n)]  # the line-block distribution
    # stretches between a surge (the first line that weighs something) and a dive (a whole window that weighs nothing, or the edge of an article)
    stretches, begin = [], None
    for i in range(n):
        if begin is not None and (not sums[i] or rows[i][2] != rows[begin][2]):
            stretches.append((begin, i))
            begin = None
        if begin is None and weight[i]:
            begin = i
    if begin is not None:
        last = max(i for i in range(n) if weight[i])
        stretches.append((begin, last + 1))
    # beside an article, a stretch outside counts if it surges as an article does: to half the middle one of its window sums
    inner = sorted(s for s, row in zip(sums, rows, strict=True) if row[2] and s)
    least = inner[len(inner) // 2] / ARTICLE / 2 if inner else 0
    kept = [(a, b) for a, b in stretches if rows[a][2] or max(sum(weight[i : min(i + WINDOW, b)]) for i in range(a, b)) >= least]
    # within a stretch, lines that weigh nothing are kept too, unless they are apart
    return "\n".join(rows[i][0] for a, b in kept for i in range(a, b) if not rows[i][1])


def surge_points(page: str) -> list[tuple[int, int]]:
    """(line, window sum) where the distribution changes, for inspection."""
    weight = [0 if apart else len(text) for text, apart, *_ in lines(page)]
    sums = [0, *(sum(weight[i : i + WINDOW]) for i in range(len(weight)))]
    return [(i, b) for i, (a, b) in enumerate(pairwise(sums)) if a != b]


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars.

    Pages are independent: repeated rows, ties and null ids pass through.  A
    null or empty page, or one without an article, has an empty text.  Columns
    beyond these three are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
