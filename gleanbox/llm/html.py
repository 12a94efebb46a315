"""Main text of web pages by structure and by differencing with the nearest page of the host.

Pages of a host stand in order of their URL path. Each is paired with the neighbour that
shares the longer start of the path (the earlier one at a tie); their text lines are aligned
by longest common subsequence, and shared lines are deleted. What a host repeats on every
page goes this way without being named. All other lines are the text, whether they stand
inside <article> or <main> or not, but for marked ones.

Two things are kept from harm. A line inside <article> or <main> is deleted only if the two
nearest pages share it and the same is true of it on ``RECURS`` of the pages of its host, or
of its section (the first part of the path), and on ``RECURS_PAGES`` at least: what a few
articles have is a quotation, what nearly all have is the template's. And a pair that shares half or more of either page's text, and of which the rest is alike too or
nothing is left, is a pair of copies and deletes nothing: lines are alike that begin or end
with the same ``ENDS`` words. Menus that differ from page to page escape differencing, so
element names, roles and class names mark the rest; the README says more.

Hosts of any size are handled: a range partitioning in order of host and path splits a host
among tasks. Neighbours across the edge of two partitions are paired from one row per edge.

Defined cases: null html is an empty text; a null URL is a host of its own without path;
unclosed elements end where their parent ends, an unclosed script or style at the end of the
page, and other raw elements that nobody closes are empty; repeated rows give a row each, and
are one page to differencing; an empty table gives an empty result. Character references are
decoded within a run of text, so a tag in the middle of one leaves it as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanbox.llm.common import join_checked, materialize, partitions

COPY_SHARE = 0.5
RECURS, RECURS_PAGES = 0.8, 3
ENDS = 5
MENU_CHARS = 100

# HTML's element names by the part they play.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
AWAY = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "head", "fieldset", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "alertdialog"}
CONTENT = {"article", "main"}
SCOPES = {"article", "main", "section", "div", "td", "th", "table", "nav", "footer", "header", "aside", "form", "button", "li", "blockquote"}

_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad(?:s|box|unit|slot|space)?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"sidebar|side|widget\w*|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|foot|comments?|commentlist|replies|reply|respond|disqus|"
    r"share|sharing|social|related|recommend\w*|toc|pagination|pager|login|signup|search|skip|hidden|disclaimer)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LAYOUT = re.compile(r"(?:has|with|no|without|is|hide|show)[_-]")
_REMARK = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|teaser|related)(?:$|[\s_-])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ENDS_PARAGRAPH = {"p", "div", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "header", "footer", "nav", "aside", "form", "blockquote", "pre", "hr", "dl", "dt", "dd", "figure", "address"}


#: Parts of a class name that say where or how, after the part that says what.
_PLACES = set("wrap wrapper container area section block box item items list inner outer content body unit slot top bottom left right middle inline native sticky mobile desktop large small wide link links button buttons form bar posts stories articles message text label row col holder main primary secondary".split())


def names_boilerplate(name: str, in_content: bool) -> bool:
    """Does a class name or id name boilerplate? Within content the last part that says what must."""
    if _LAYOUT.match(name):
        return False
    if not in_content:
        return bool(_BOILER.search(name))
    parts = [x for x in re.split(r"[_-]+", name) if x]
    while parts and (parts[-1] in _PLACES or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and bool(_BOILER.search(parts[-1]))


def is_boilerplate(name: str, attributes: str, in_content: bool) -> bool:
    """Does an element's name, role, class or id say that it is not content?"""
    if name in AWAY and not (name == "header" and in_content):
        return True
    if not attributes or name in ("main", "html", "body"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).strip().lower()
        if name == "article":
            # an article is content, but for a remark or a teaser in an article's form
            if key in ("class", "id") and _REMARK.search(value):
                return True
            continue
        if key in ("class", "id"):
            named = [x for x in value.split() if names_boilerplate(x, in_content)]
            if named and not (in_content and all("header" in x for x in named)):
                return True
        elif (key == "role" and value in ROLES) or (key == "hidden" and value != "until-found") or (key == "aria-hidden" and value == "true"):
            return True
        elif key == "style" and _UNSEEN.search(value):
            return True
    return False


class PageLines:
    """Text lines of a page in order: (text, inside a content element, marked as boilerplate)."""

    def __init__(self, html: str):
        self.lines: list[tuple[str, bool, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []  # element, in content, marked
        self.named: dict[str, list[int]] = {}  # places of the open elements of a name
        self.scopes: list[int] = []  # places of open scopes, and of open elements that part lines
        self.parting: list[int] = []
        self.held: list[str] = []
        self.linked = 0
        at, end = 0, len(html)
        endless: set[str] = set()  # raw elements of which no end comes any more
        while at < end:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                run = html[at:stop]
                self.held.append(unescape(run) if "&" in run else run)  # references don't reach across tags
                if self.named.get("a"):
                    self.linked += stop - at
            if not m:
                break
            at = m.end()
            name = m[2] and m[2].lower()
            if not name:
                continue
            if m[1]:
                self.close(name)
            elif name in RAW:
                close = None if name in endless else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if close:
                    at = close.end()
                elif name in ("script", "style") and not (m[3] or "").endswith("/"):
                    at = end
                else:  # a frame that nobody closes, or one that closes itself, has no content
                    endless.add(name)
            elif name == "br":
                self.held.append(" ")
            elif name not in VOID:
                self.start(name, m[3] or "")
            elif name == "hr":
                self.flush()
        self.flush()

    def state(self) -> tuple[bool, bool]:
        return self.open[-1][1:] if self.open else (False, False)

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            content, marked = self.state()
            # outside a content element, a short line that is all link is a menu's
            menu = not content and len(text) < MENU_CHARS and self.linked >= 0.8 * len(text)
            self.lines.append((text, content, marked or menu))
        self.held.clear()
        self.linked = 0

    def start(self, name: str, attributes: str) -> None:
        content, marked = self.state()
        away = is_boilerplate(name, attributes, content)
        if name not in INLINE or away:
            self.flush()
        if name in ENDS_PARAGRAPH:
            self.close("p", only_if_open=True)
            content, marked = self.state()
        for places, there in ((self.named.setdefault(name, []), True), (self.scopes, name in SCOPES), (self.parting, name not in INLINE)):
            if there:
                places.append(len(self.open))
        self.open.append((name, content or name in CONTENT, marked or away))

    def close(self, name: str, only_if_open: bool = False) -> None:
        """End the innermost element of that name, and what is open in it."""
        held = self.named.get(name)
        at = held[-1] if held else None
        if at is not None and (name in INLINE or name == "p") and self.scopes and self.scopes[-1] > at:
            at = None
        if at is None:
            if name not in INLINE and not only_if_open:
                self.flush()
            return
        if (self.parting and self.parting[-1] >= at) or self.open[at][2] != (self.open[at - 1][2] if at else False):
            self.flush()
        while len(self.open) > at:
            gone = self.open.pop()[0]
            self.named[gone].pop()
            for places in (self.scopes, self.parting):
                if places and places[-1] == len(self.open):
                    places.pop()


def page_lines(html: str) -> list[tuple[str, bool, bool]]:
    return PageLines(html).lines


def main_text(html: str | None, gone: list[int] | None = None) -> tuple[str, int]:
    """(main text, lines that differencing deleted); ``gone`` numbers the lines to delete."""
    lines = page_lines(html) if html else []
    deleted = set(gone) if gone is not None else set()
    return " ".join(t for k, (t, _, marked) in enumerate(lines) if not marked and k not in deleted), len(deleted)


def line_columns(html: str | None) -> tuple[list[int], list[int], int, list[bool], list[int]]:
    """Of a page's lines: hashes, lengths, all characters, whether in a content element, and
    two hashes a line, of its first and of its last words."""
    lines = page_lines(html) if html else []
    ends = [xxhash.xxh3_64_intdigest(x) >> 1 for t, _, _ in lines for x in (" ".join(t.split(" ", ENDS)[:ENDS]), "\n" + " ".join(t.rsplit(" ", ENDS)[-ENDS:]))]
    return [xxhash.xxh3_64_intdigest(t) >> 1 for t, _, _ in lines], [len(t) for t, _, _ in lines], sum(len(t) for t, _, _ in lines), [c for _, c, _ in lines], ends


def last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of all of x with each start of y."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def common_places(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x of a longest common subsequence with y, in memory of one row (x is halved again and again)."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            if (y[c:d] == x[a]).any():
                out.append(a)
            continue
        mid = (a + b) // 2
        best = c + int(np.argmax(last_row(x[a:mid], y[c:d]) + last_row(x[mid:b][::-1], y[c:d][::-1])[::-1]))
        todo += [(a, mid, c, best), (mid, b, best, d)]
    return out


def shared_places(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    both = set(x) & set(y)
    xs = [i for i, v in enumerate(x) if v in both]
    found = common_places(np.array([x[i] for i in xs], dtype=np.int64), np.array([v for v in y if v in both], dtype=np.int64))
    return [*range(lead), *sorted(lead + xs[i] for i in found), *range(len(a) - tail, len(a))]


def shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_lines(page: tuple, other: tuple) -> list[int] | None:
    """Places of a page's lines that another page shares; None if the two are copies."""
    gone = shared_places(list(page[3]), list(other[3]))
    if sum(page[4][i] for i in gone) < COPY_SHARE * min(page[5], other[5]):
        return gone
    held = {page[3][i] for i in gone}
    mine, theirs = ({e for i, h in enumerate(p[3]) if h not in held for e in p[7][2 * i : 2 * i + 2]} for p in (page, other))
    return gone if 2 * len(mine & theirs) < min(len(mine), len(theirs)) else None


def deletions(page: tuple, *around: tuple | None) -> tuple[list[int], list[int]]:
    """Places of a page's lines to delete, and of those to delete if they recur, given the pages around it.

    A page is (page_id, host, path, hashes, lengths, all characters, in content, ends). A
    line outside a content element goes if the nearest page of the host shares it; one inside
    may go if the two nearest do. Copies are passed over.
    """
    near = [p for p in around if p is not None and p[1] == page[1]]
    near.sort(key=lambda p: -shared_start(page[2], p[2]))
    found = [gone for other in near if (gone := shared_lines(page, other)) is not None]
    twice = set(found[0]).intersection(found[1]) if len(found) > 1 else set()
    return [i for i in found[0] if not page[6][i]] if found else [], sorted(i for i in twice if page[6][i])


def path_levels(path: str) -> list[str]:
    """What a page is part of: its host, and the section that the first part of its path names."""
    section, further, _ = path.partition("/")
    return ["", section + "/"] if further else [""]


def host_and_path(url: str | None) -> tuple[str, str]:
    rest = re.sub(r"^[a-zA-Z][\w+.-]*:", "", url or "").removeprefix("//")
    host, _, path = rest.partition("/")
    return host.lower(), re.split(r"[?#]", path)[0]


_PAGE = "page_key long, host string, path string, hashes array<long>, lengths array<int>, chars long"
_LINES = _PAGE + ", inside array<boolean>, ends array<long>"
_FIELDS = ["page_key", "host", "path", "hashes", "lengths", "chars", "inside", "ends"]


def with_neighbours(pages: DataFrame) -> DataFrame:
    """Adds before, after and second: neighbours in order of host, path and key.

    Second is the neighbour but one on the side where the host has pages, for the first and
    last page of a host. A range partitioning cuts the order into parts; the two first and
    last pages of each part are also dealt to the parts beside it, so windows over one part
    see every neighbour. Four keys for each part come to the driver.
    """
    order = ["host", "path", "page_key"]
    fields = pages.columns
    parts = pages.repartitionByRange(partitions(pages.sparkSession), *order).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "page-order")
    key = F.struct(*order)
    ends = parts.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    inner = parts.join(F.broadcast(ends), "part").filter((key != F.col("first")) & (key != F.col("last")))
    ends = ends.select("part", F.explode(F.array("first", "last")).alias("k")).unionByName(inner.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).select("part", F.explode(F.array("first", "last")).alias("k")))
    rows = ends.distinct().orderBy("part", "k").select("part", F.col("k.page_key").alias("page_key")).collect()
    guests: dict[int, list[int]] = {}
    first = {}
    for at, r in enumerate(rows):
        first.setdefault(r["part"], at)
    stops = [*first.values(), len(rows)]
    for part, start, stop in zip(first, stops, stops[1:], strict=False):
        for r in rows[max(start - 2, 0) : start] + rows[stop : stop + 2]:
            guests.setdefault(r["page_key"], []).append(part)
    ghosts = pages.sparkSession.createDataFrame([(k, v) for k, v in guests.items()], "page_key long, to array<int>")
    dealt = parts.join(F.broadcast(ghosts), "page_key", "left")
    to = F.concat(F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own"))), F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda p: F.struct(p.alias("part"), F.lit(False).alias("own"))))
    dealt = dealt.select(*fields, F.explode(to).alias("at"))
    window = Window.partitionBy("at.part").orderBy(*order)
    page = F.struct(*fields)
    same = lambda column: F.coalesce(column == F.col("host"), F.lit(False))
    before, after = same(F.lag("host").over(window)), same(F.lead("host").over(window))
    second = F.when(before & ~after, F.lag(page, 2).over(window)).when(after & ~before, F.lead(page, 2).over(window))
    return dealt.withColumns({"before": F.lag(page).over(window), "after": F.lead(page).over(window), "second": second}).filter("at.own").drop("at")


def compared(pages: DataFrame) -> DataFrame:
    """A row for each different page: page_key, host, levels, gone, and ``repeats``: the lines
    inside content that the two nearest pages share, each once with its places."""

    def lined(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = [(k, *host_and_path(u), *line_columns(h)) for k, u, h in zip(pdf["page_key"], pdf["url"], pdf["html"], strict=True)]
            yield pd.DataFrame(out, columns=_FIELDS)

    def compare(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_page = lambda x: tuple(x[f] for f in _FIELDS) if x is not None else None
        for pdf in rows:
            out = []
            for page, *around in zip(pdf[_FIELDS].itertuples(index=False, name=None), pdf["before"], pdf["after"], pdf["second"], strict=True):
                gone, maybe = deletions(page, *map(as_page, around))
                places: dict[int, list[int]] = {}
                for i in maybe:
                    places.setdefault(int(page[3][i]), []).append(i)
                out.append((page[0], page[1], path_levels(page[2]), gone, [{"line": h, "places": at} for h, at in places.items()]))
            yield pd.DataFrame(out, columns=["page_key", "host", "levels", "gone", "repeats"])

    slim = pages.select("page_key", "url", "html").mapInPandas(lined, _LINES).dropDuplicates(["page_key"])
    return with_neighbours(slim).mapInPandas(compare, "page_key long, host string, levels array<string>, gone array<int>, repeats array<struct<line:long,places:array<int>>>")


def paired_deletions(pages: DataFrame) -> DataFrame:
    """page_key and the places of lines to delete, for pages that have such lines.

    How often a line is repeated is counted for each host and section; only counts and the
    lines that pass are shuffled, never texts.
    """
    there = materialize(compared(pages), "compared")
    sizes = there.select("host", F.explode("levels").alias("level")).groupBy("host", "level").agg(F.count(F.lit(1)).alias("pages"))
    repeats = there.select("page_key", "host", "levels", F.explode("repeats").alias("r")).select("page_key", "host", F.explode("levels").alias("level"), "r.line", "r.places")
    counts = repeats.groupBy("host", "level", "line").agg(F.count(F.lit(1)).alias("n"))
    recurs = (F.col("n") >= RECURS_PAGES) & (F.col("n") >= RECURS * F.col("pages"))
    recurring = materialize(counts.join(sizes, ["host", "level"]).filter(recurs).select("host", "level", "line"), "recurring")
    inside = join_checked(repeats, recurring, ["host", "level", "line"]).select("page_key", F.col("places").alias("gone"))
    every = there.select("page_key", "gone").filter(F.size("gone") > 0).unionByName(inside)
    return every.groupBy("page_key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, and n_shared: lines that differencing deleted."""
    pages = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("page_key"))
    gone = materialize(paired_deletions(pages), "deletions")

    def extract(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            made = [main_text(h, g) for h, g in zip(pdf["html"], pdf["gone"], strict=True)]
            texts = [t for t, _ in made]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_shared": [n for _, n in made]})

    joined = join_checked(pages, gone, "page_key", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "gone")
    return joined.mapInPandas(extract, "page_id long, url string, text string, n_chars long, n_shared long")
