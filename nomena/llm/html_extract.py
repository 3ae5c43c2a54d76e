"""Main text of web pages: block structure, then nearest-URL page differencing.

A page is cut into blocks. Blocks inside what markup names as menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments go. Of the rest, blocks inside the page's article (or main) element are its content; all others,
in pages with an article too, are open to doubt. Pages are paired with their neighbour by address (path and parameters) within the host, and their lines are
aligned by a longest common subsequence: shared lines in doubt are template and go. Lines of an article stay even if shared: two articles may
quote the same passage. A neighbour that shares four fifths or more of all lines, those of articles counted, may be a copy: the next ones, up to NEAR, are asked. If all share as much, the one
that shares least shows the template; if all are equal, nothing is deleted.

Cases: null and empty html give an empty text; pages without a url form a host of their own, in which each is an address of its own; unclosed, nested and stray tags, broken character references and
markup cut off at the end are read as browsers do; repeated rows are compared with pages of another address or not at all; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, table

#: Elements whose text is never read (as raw text up to the closing tag).
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
#: Elements that are not part of an article.
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "math", "object", "audio", "video", "canvas", "map", "head", "fieldset"}
BLOCKS = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | OUTSIDE
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
IN_HEAD = {"meta", "link", "base", "script", "style", "title", "noscript", "template", "head", "basefont", "bgsound"}
#: Opening one of these closes an open element of the second set first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "dl", "select", "article", "main", "body", "div", "section", "td", "th", "nav", "aside", "form", "header", "footer", "blockquote"}
#: Words of a class, id or role that name what is not part of an article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|menu|nav\w*|breadcrumbs?|sidebar|side-?bar|comments?|commentlist|replies|reply|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|footer|header|masthead|toolbar|pagination|pager|widget|skip-?link|contentinfo|complementary|navigation|search|form|copyright|tracking)(?:$|[\s_-])",
    re.I,
)
NEVER = re.compile(r"comment|sidebar|\bads?\b|advert|footer|shar(?:e|ing)|related|nav|menu|promo|newsletter|cookie|notice|banner|form\b", re.I)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:$|[\s_-])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")

CONTENT, DOUBT = "c", "d"
COPIES = 0.8
#: Neighbours that are asked, at most.
NEAR = 4
#: Pages of one comparison run, about; and runs that large hosts may be cut into, about. A run begins at each MARKS-th of the paths that a digest picks.
RUN, LISTED, MARKS = 64, 10_000, 8


def _leaves(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is not part of the article. inside: it lies in the article, where a header has the headline."""
    if tag in OUTSIDE:
        return not (inside and tag == "header")
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role") and NAMED.search(value) and not (name != "role" and ARTICLE_NAMES.search(value) and tag in ("section", "div") and not NEVER.search(value)):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(kind, line) of the blocks that may be main text, in page order; kind is CONTENT in an article, DOUBT outside."""
    page = page or ""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, left out, article
    gone = inner = 0

    def flush() -> None:
        line = _SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
        if line:
            out.append((CONTENT if inner else DOUBT, line))
        text.clear()

    def pop() -> str:
        nonlocal gone, inner
        tag, left, art = stack.pop()
        gone, inner = gone - left, inner - art
        return tag

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not gone:
            rest = page[at : m.start() if m else end]
            if not m and (cut := re.search(r"<[a-zA-Z/!][^<]*$", rest)):  # markup that is cut off
                rest = rest[: cut.start()]
            text.append(rest)
        if not m:
            break
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if closing:
            if any(x[0] == tag for x in stack):
                while True:
                    if stack[-1][0] in BLOCKS:
                        flush()
                    if pop() == tag:
                        break
            continue
        if tag not in IN_HEAD and any(x[0] == "head" for x in stack):  # what can't be in a head closes it
            while pop() != "head":
                pass
        if tag in ("article", "main"):  # an open menu or header ends here
            for i, x in enumerate(stack):
                if x[0] in ("nav", "header", "menu"):
                    while len(stack) > i:
                        pop()
                    break
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES.get(tag, ()):
                while len(stack) > i:
                    pop()
                break
            if stack[i][0] in SCOPES:
                break
        if tag == "p":  # an open paragraph ends here, with what is open in it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        left = _leaves(tag, attrs, inner > 0)
        if left:
            flush()
        art = tag in ("article", "main") or "role" in attrs and bool(re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attrs))
        stack.append((tag, left, art and not gone))
        gone, inner = gone + left, inner + (art and not gone)
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a are in a longest common subsequence of a and b.

    Bit-parallel: a row of the table is one whole number of len(b) bits, whose zeros mark where the length grows. Only lines that
    both have take part.
    """
    both = set(a) & set(b)
    rows = [i for i, x in enumerate(a) if x in both]
    cols = [x for x in b if x in both]
    out = [False] * len(a)
    if not rows:
        return out
    where: dict[str, int] = {}
    for j, x in enumerate(cols):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(cols)) - 1
    v, table_ = full, []
    for i in rows:
        m = v & where[a[i]]
        v = ((v + m) | (v - m)) & full
        table_.append(v)
    j = len(cols) - 1  # the table is read backwards: step i is used where its row gains what the row before had not
    length = lambda v, j: j + 1 - (v & ((1 << (j + 1)) - 1)).bit_count() if j >= 0 else 0
    for r in range(len(rows) - 1, -1, -1):
        if j < 0:
            break
        before = length(table_[r - 1], j) if r else 0
        if length(table_[r], j) == before:
            continue
        while j >= 0 and length(table_[r], j - 1) == length(table_[r], j):
            j -= 1
        out[rows[r]] = True
        j -= 1
    return out


class Pairing:
    """The choice of the neighbour that a page is compared with: the first that is no copy, or else the one that shares least."""

    def __init__(self, row: tuple):
        self.row, self.asked, self.least, self.shared = row, 0, 1.0, None
        self.done = not any(kind == DOUBT for kind, _ in row[4])

    def ask(self, other: tuple) -> None:
        if self.done or not other[4]:
            return
        shared = shared_lines([line for _, line in self.row[4]], [line for _, line in other[4]])
        share = sum(shared) / max(len(shared), len(other[4]))
        self.asked += 1
        if share < self.least:
            self.least, self.shared = share, shared
        self.done = share < COPIES or self.asked == NEAR

    def lines(self) -> list[str]:
        """The lines of the page less its lines in doubt that are aligned with equal ones of the chosen page."""
        page = self.row[4]
        return [line for s, (kind, line) in zip(self.shared or [False] * len(page), page, strict=True) if kind == CONTENT or not s]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    An address is the path with its parameters in order; a page without one goes by its page_id. Runs: a host's pages in order of address; a host with more pages than a run is cut into ranges of addresses, so no task gets all of it, and each
    run also gets a page of each of the last NEAR paths of the run before. A page is compared with the ones before it, then, at the start of a host,
    with the ones after. Only the blocks go through the shuffle, compressed.
    """
    spark = pages.sparkSession
    Batches.small(spark, 256)
    host = F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))), r"^www\.", "")
    d = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    hosts = d.groupBy("host").agg(F.count("*").alias("n"))
    n = d.count()
    limit = max(RUN, n // LISTED)
    large = hosts.filter(F.col("n") > limit).select(F.col("host").alias("h"))
    path = F.regexp_replace(F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.col("url"), F.lit("")), "/+$", "")
    asked = F.array_join(F.array_sort(F.array_remove(F.split(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*\?([^#]*)", 1), "&"), "")), "&")  # parameters in order
    path = F.when(F.trim(F.coalesce("url", F.lit(""))) == "", F.coalesce("page_id", F.lit(""))).otherwise(F.concat(path, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked))))
    d = d.withColumn("path", path)
    long = d.drop("html").join(F.broadcast(large), F.col("host") == F.col("h"), "left_semi")  # fewer than LISTED hosts, or n / RUN where n is small
    marks: dict[str, list[str]] = {}
    for h, x in long.filter(F.pmod(F.xxhash64("path"), F.lit(max(1, limit // MARKS))) == 0).select("host", "path").distinct().collect():  # about MARKS * LISTED at most
        marks.setdefault(h, []).append(x)
    bounds = {h: sorted(x)[MARKS::MARKS] for h, x in marks.items()}

    @F.pandas_udf("long")
    def run_of(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds.get(h, ()), x) for h, x in zip(hosts, paths, strict=True)], dtype="int64")

    ends = long.select("host", "path", "url", "page_id", run_of("host", "path").alias("run")).groupBy("host", "run", "path").agg(F.max(F.struct("url", "page_id")).alias("e"))
    ends = ends.withColumn("r", F.row_number().over(Window.partitionBy("host", "run").orderBy(F.desc("path")))).filter(F.col("r") <= NEAR)
    handed = {tuple(r) for r in ends.select("host", "path", "e.url", "e.page_id").collect()} if any(bounds.values()) else set()  # NEAR for each run of the large hosts

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            b = b.assign(run=[bisect_right(bounds.get(h, ()), x) for h, x in zip(b["host"], b["path"], strict=True)], own=True)
            b = b.assign(blob=[pack.compress("\n".join(k + x for k, x in blocks(h)).encode("utf-8", "surrogatepass")) for h in b["html"]]).drop(columns="html")
            yield b
            last = [(h, x, u, i) in handed for h, x, u, i in zip(b["host"], b["path"], b["url"], b["page_id"], strict=True)] if handed else []
            if any(last):
                more = b[last]
                yield more.assign(run=more["run"] + 1, own=False)

    d = d.select("page_id", "url", "host", "path", "html").mapInPandas(cut, "page_id string, url string, host string, path string, run long, own boolean, blob binary")
    d = d.repartition("host", "run").sortWithinPartitions("host", "run", "path", "url", "page_id")

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple]:
            for b in batches:
                for r in zip(b["page_id"], b["url"], b["host"], b["run"], b["path"], b["blob"], b["own"], strict=True):
                    text = unpack.decompress(r[5]).decode("utf-8", "surrogatepass")
                    yield r[0], r[1], (r[2], r[3]), r[4], [(x[0], x[1:]) for x in text.split("\n")] if text else [], r[6]

        def result(p: Pairing) -> tuple:
            text = "\n".join(p.lines())
            return p.row[0], p.row[1], text, len(text)

        def paired() -> Iterator[tuple]:
            before: deque[tuple] = deque(maxlen=NEAR)  # the last page of each path before
            waiting: list[Pairing] = []  # pages with fewer paths before them, which ask the ones after
            last = None

            def ended(row: tuple | None) -> Iterator[tuple]:
                """All rows of a path have been read; row: the last."""
                if row is None:
                    return
                before.append(row)
                for p in waiting:
                    if p.row[3] != row[3]:
                        p.ask(row)
                yield from (result(p) for p in waiting if p.done)
                waiting[:] = [p for p in waiting if not p.done]

            for row in rows():
                if last is None or last[2] != row[2]:
                    yield from ended(last)
                    yield from (result(p) for p in waiting)
                    waiting.clear()
                    before.clear()
                elif last[3] != row[3]:
                    yield from ended(last)
                last = row
                if not row[5]:
                    continue
                p = Pairing(row)
                for other in reversed(before):
                    p.ask(other)
                if p.done or len(before) == NEAR:
                    yield result(p)
                else:
                    waiting.append(p)
            yield from ended(last)
            yield from (result(p) for p in waiting)

        out = []
        for x in paired():
            out.append(x)
            if len(out) >= 256:
                yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"])

    out = d.mapInPandas(differ, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
