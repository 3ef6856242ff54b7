"""Main text of web pages by differencing with the nearest page.

Pages are put in order of host, path and id, and cut into ranges of that order; each range also gets the page before and the page
after it, so how many ranges there are changes nothing. Of the pages before and after it on its host a page takes the one whose
path begins like its own for longer (on a tie the one before). Both are cut into lines (blocks of text with the elements they stand
in), the lines are aligned by a longest common subsequence, and what both have is the template's and goes.

Two kinds of lines are beyond differencing, so elements decide them: lines that a template fills anew on each page (menus,
adverts, footers and the like, by element or by a class that says so), which go although no neighbour has them, and lines of the page's
article, which stay although its neighbour republishes them. A page that marks no article is judged by the alignment.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import bounded_sample, give_back, shuffle_partitions
from tidebar.llm.url_filter import split_url

# Elements by their role in HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "xmp", "noembed", "noframes"}
NOT_TEXT = {"head", "title", "nav", "footer", "aside", "form", "button", "dialog", "menu", "label", "input", "option", "fieldset", "datalist"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
#: Elements whose start ends an open paragraph.
AFTER_P = HEADINGS | {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "main",
    "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}
#: Elements whose end tag may be left out: what start ends them, and the elements that a search for them does not leave.
ENDS = {
    "p": (AFTER_P, {"td", "th", "table", "button", "caption", "object"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "tbody", "thead", "tfoot"}, {"table"}),
    "td": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}), "th": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}), "option": ({"option", "optgroup"}, {"select", "datalist"}),
}
#: Words of a class, id or role that mark what is not the article.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsbox", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "menubar",
    "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "complementary", "contentinfo", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "popup", "modal", "overlay", "comment", "comments", "disqus", "respond", "reply", "replies", "related", "recommended", "share", "sharing", "social", "subscribe", "newsletter",
    "signup", "login", "search", "widget", "toolbar", "pagination", "pager", "skip", "hidden",
}
#: Words that make a header or footer one of the article: `entry-header`.
OWN = {"article", "entry", "post", "story", "content", "body", "text"}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
#: Rows of the alignment that are kept at each level, so that its space grows with the lines, not with their product.
CUTS = 16
#: Sampled keys by which the order is cut into ranges, and ranges for each task.
SAMPLE_KEYS, RANGES = 5_000, 3

#: Lines of a page (text, in the article, in an element that is not text), and whether it marks an article.
Lines = tuple[list[tuple[str, bool, bool]], bool]


def marked(attributes: str) -> bool:
    for _, *values in ATTRIBUTE.findall(attributes):
        for name in " ".join(values).lower().split():
            words = {*SPLIT.split(name)}
            if words & MARKS and not (words & OWN and words & MARKS <= {"header", "footer"}):
                return True
    return False


def lines(page: str) -> Lines:
    """Lines of a page. A start tag ends paragraphs, items and cells whose own end tag is left out."""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # element, and with all that it stands in: not text, article
    open_: Counter[str] = Counter()
    found = False
    at, end = 0, len(page)

    def close_line() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, stack[-1][2], stack[-1][1]))

    def close_down_to(depth: int) -> None:
        for name, _, _ in stack[depth:]:
            open_[name] -= 1
        del stack[depth:]

    def close(names: set[str], stay: set[str]) -> None:
        """Ends the innermost of names, unless one of stay lies within it."""
        if any(open_[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    close_down_to(i)
                    return
                if stack[i][0] in stay:
                    return

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in INLINE:
            continue
        close_line()
        if m[1]:
            close({name}, set())
        elif name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
        else:
            for left_out, (starts, stay) in ENDS.items():
                if name in starts and open_[left_out]:
                    close({left_out}, stay)
            if name not in VOID and not (m[3] or "").endswith("/"):
                main = name in MAIN
                found |= main
                _, not_text, article = stack[-1]
                # a header inside an article heads the article
                boiler = name in NOT_TEXT or (name == "header" and not article)
                boiler |= not main and name not in HEADINGS and name not in ("body", "html") and marked(m[3] or "")
                stack.append((name, not_text or boiler, article or main))
                open_[name] += 1
    close_line()
    return out, found


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of a that a longest common subsequence of a and b takes."""
    start, stop_a, stop_b = 0, len(a), len(b)
    while start < min(stop_a, stop_b) and a[start] == b[start]:
        start += 1
    while stop_a > start and stop_b > start and a[stop_a - 1] == b[stop_b - 1]:
        stop_a, stop_b = stop_a - 1, stop_b - 1
    out = {*range(start), *range(stop_a, len(a))}
    # lines that only one side has take no part
    common = set(a[start:stop_a]) & set(b[start:stop_b])
    x = [i for i in range(start, stop_a) if a[i] in common]
    y = [j for j in range(start, stop_b) if b[j] in common]
    if not x:
        return out
    number = {line: k for k, line in enumerate(common)}
    left, right = [number[a[i]] for i in x], np.array([number[b[j]] for j in y])

    def above(i: int, below: np.ndarray) -> np.ndarray:
        """Lengths from row i on, for each start in y, from those of the row below."""
        row = below.copy()
        row[:-1] = np.where(right == left[i], below[1:] + 1, below[:-1])
        return np.maximum.accumulate(row[::-1])[::-1]

    def walk(top: int, end: int, below: np.ndarray, j: int) -> int:
        """Takes rows top to end from place j on; below is row end. Keeps CUTS rows a level and finds the others again."""
        step = -(-(end - top) // CUTS)
        rows = {end: below}
        for i in range(end - 1, top - 1, -1):
            below = above(i, below)
            if (i - top) % step == 0:
                rows[i] = below
        for i in range(top, end, step):
            if step > 1:
                j = walk(i, min(i + step, end), rows[min(i + step, end)], j)
                continue
            while j < len(y):
                if left[i] == right[j]:
                    out.add(x[i])
                    j += 1
                    break
                if rows[i + 1][j] >= rows[i][j + 1]:
                    break
                j += 1
        return j

    walk(0, len(x), np.zeros(len(y) + 1, np.int32), 0)
    return out


def main_text(own: Lines, other: Lines | None) -> str:
    """The lines left of a page, joined by one space."""
    found, has_article = own
    repeated = shared([x[0] for x in found], [x[0] for x in other[0]]) if other else set()
    kept = []
    for i, (text, in_article, boiler) in enumerate(found):
        if boiler or (has_article and not in_article) or (i in repeated and not in_article):
            continue
        kept.append(text)
    return " ".join(kept)


def common_start(a: str, b: str) -> int:
    """Characters with which both begin."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


class _Page:
    def __init__(self, row: tuple):
        self.page_id, self.url, page, self.host, self.path, self.range, self.guest = row
        self.lines = lines(page or "")

    def row(self, before: _Page | None, after: _Page | None) -> tuple:
        """page_id, url, text, n_chars, by the nearer of two pages in the order."""
        mates = [x for x in (before, after) if x is not None and x.range == self.range and x.host == self.host]
        text = main_text(self.lines, max(mates, key=lambda x: common_start(self.path, x.path)).lines if mates else None)
        return self.page_id, self.url, text, len(text)


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages come by range, and within it in their order; a page is judged when the next one is here."""

    def judged() -> Iterator[tuple]:
        before = own = None
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                after = _Page(row)
                if own is not None and not own.guest:
                    yield own.row(before, after)
                before, own = own, after
        if own is not None and not own.guest:
            yield own.row(before, None)

    held: list[tuple] = []
    for row in judged():
        held.append(row)
        if len(held) == 200:
            yield _frame(held)
            held = []
    if held:
        yield _frame(held)
    give_back()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": object})


def _in_ranges(keyed: DataFrame, ranges: int) -> DataFrame:
    """keyed (page_id, url, html, host, path, key) with range, and the pages next to each range once more as guest rows."""
    kind = keyed.schema["key"].dataType
    sample = bounded_sample(keyed.select("key"), ["key"], SAMPLE_KEYS).collect()
    keys = sorted((tuple(x["key"]) for x in sample), key=lambda k: (k[0].encode(), k[1].encode(), k[2] is not None, k[2]))
    edges = dict.fromkeys(keys[len(keys) * i // ranges] for i in range(1, ranges)) if keys else ()

    def literal(key: tuple) -> Column:
        return F.struct(*[F.lit(value).cast(field.dataType).alias(field.name) for value, field in zip(key, kind.fields, strict=True)])

    bounds = F.array(*map(literal, edges)) if edges else F.array().cast(f"array<{kind.simpleString()}>")
    dealt = keyed.withColumn("range", F.size(F.filter(bounds, lambda b: b <= F.col("key"))))
    # two keys a range: what its neighbours have to see
    ends = sorted(dealt.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect(), key=lambda x: x["range"])
    visits = [x for a, b in zip(ends, ends[1:]) for x in ((tuple(a["high"]), b["range"]), (tuple(b["low"]), a["range"]))]
    visits = keyed.sparkSession.createDataFrame(visits, f"key {kind.simpleString()}, visited int")
    guests = dealt.join(F.broadcast(visits), "key").withColumns({"range": F.col("visited"), "guest": F.lit(True)})
    # rows that share host, path and id are one guest
    guests = guests.dropDuplicates(["key", "range"]).select(*dealt.columns, "guest")
    return dealt.withColumn("guest", F.lit(False)).unionByName(guests)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page of pages (page_id, url, html).

    A page's neighbour is the nearer of those before and after it on its host, by (path, page_id); a host with one page has none, and
    its lines are judged by their elements alone. Null or empty html gives an empty text. URLs without a host share the empty
    host. Repeated rows are neighbours of each other; rows that share URL and id but not html come in any order. Character references are decoded; white space in a line becomes one space.
    Other columns of pages are not read. No rows in, no rows out.
    """
    host, path = split_url(F.col("url"))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("key", F.struct("host", "path", "page_id"))
    tasks = shuffle_partitions(pages.sparkSession)
    dealt = _in_ranges(keyed, RANGES * tasks).repartition("range").sortWithinPartitions("range", "host", "path", "page_id")
    kind = pages.schema["page_id"].dataType.simpleString()
    return dealt.select("page_id", "url", "html", "host", "path", "range", "guest").mapInPandas(_difference, f"page_id {kind}, url string, text string, n_chars long")
