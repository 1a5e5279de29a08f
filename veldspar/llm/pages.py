r"""Main text of web pages with a site style tree.

Pages of one host are merged by style path (block elements with their ids and classes, from the body down).  A
style node's presentation importance is the entropy of its pages' child sequences, its content importance the
entropy of their texts, both with the number of pages as base: 1 if every page differs, 0 if all agree.  Nodes
that enough pages share and whose importance is low are furniture of the site; their branches go, inside articles
too, unless they hold more than half of a page's text.

Names are a prior: branches that say by tag, role, class or id that they are a menu, header, footer, sidebar, notice,
advert, form or comments go, since menus that change from page to page have high entropies.  A class, an id or a
form goes for nothing if its branch has more than ``MAIN`` times the text that would be left.  On hosts with too
few pages for entropies, an article (or main) element with more than half of the text is all that is read.

Counts are aggregated by (host, path, content) before and after the shuffle, so a host with a third of all pages is no
list in one task.  The furniture of all hosts is broadcast if its size, which is checked, is small; else joined.

Parsing is linear in a page's size: a style path is a number made from its parent's, texts are counted from the leaves
up, and searches that found no end tag are not made again.

Defined results for odd input: a null or empty page gives empty text; broken markup is read as far as it goes; a null
url counts as a host of its own; repeated rows give equal rows; columns besides those named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, texts

MIN_PAGES = 5
LOW = 0.2
MAIN = 10
BROADCAST_BYTES = 8_000_000

#: HTML's own vocabulary. Fixed values.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
RAW = frozenset("script style noscript template textarea iframe svg select head title button noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav header footer aside form dialog menu search fieldset".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Words of class and id names that mark furniture.
NOISE_WORDS = frozenset("""
ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner banners
nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager
header masthead topbar footer sidebar sidebars aside widget widgets
cookie cookies consent gdpr notice notices popup modal alert disclaimer copyright
comment comments commentlist disqus replies respond
share sharing social subscribe subscription newsletter signup login search form
""".split())

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_PART = re.compile(r"[^a-z]+")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Node:
    """An open element; ``path`` is the number of its style path, ``mark`` the innermost element around it that names itself furniture."""

    __slots__ = ("tag", "path", "mark", "inside")

    def __init__(self, tag: str, path: int, mark: _Mark | None, inside: bool):
        self.tag, self.path, self.mark, self.inside = tag, path, mark, inside


class _Mark:
    """``firm``: whether any of it and those around it says so by more than a form, a class or an id."""

    __slots__ = ("up", "firm", "at")

    def __init__(self, up: _Mark | None, firm: bool, at: int):
        self.up, self.firm, self.at = up, firm or bool(up and up.firm), at


ROOT = 0


def _path(up: int, key: str) -> int:
    return xxhash.xxh3_64_intdigest(key, seed=up) - (1 << 63)


def _style(tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool]:
    """Style key of an element, whether it names itself furniture, and whether only by a form, a class or an id."""
    key, firm, soft = tag, tag in NOISE_TAGS and tag != "form", tag == "form"
    if not attrs or attrs == "/":
        return key, firm or soft, not firm
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name == "role":
            firm |= value.strip().lower() in NOISE_ROLES
        elif name in ("class", "id"):
            key += ("." if name == "class" else "#") + ".".join(sorted(re.sub(r"\d+", "0", v) for v in value.split()))
            if tag not in ("html", "body", "main", "article") and not (inside and tag in TEXT_TAGS):
                soft |= any(w in NOISE_WORDS for v in value.split() for w in _PART.split(_SPLIT.sub(" ", v).lower()))
    return key, firm or soft, not firm


class Page:
    """Text blocks in page order with the node each stands in, and the style paths they hang from."""

    def __init__(self) -> None:
        self.blocks: list[tuple[_Node, str]] = []
        self.up: dict[int, int] = {}  # in the order of their first element, so that parents come before children
        self.children: dict[int, list[str]] = {}
        self.marks: list[_Mark] = []


def blocks(html: str) -> Page:
    page, root = Page(), _Node("", ROOT, None, False)
    stack, open_, endless = [root], Counter(), set()
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                page.blocks.append((stack[-1], text))

    def close(i: int):
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]

    at, find = 0, _TOKEN.search
    while True:
        m = find(html, at)
        if not m:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        closing, tag, attrs = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if attrs.endswith("/") and tag == "svg":
                continue
            end = None
            if tag not in endless:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at) if tag != "head" else re.compile(r"</head\b[^>]*>|<body\b", re.I).search(html, at)
                if not end:
                    endless.add(tag)
            if tag == "head" and end and end.group()[1] != "/":
                at = end.start()
            else:
                at = end.end() if end else len(html) if tag not in ("head", "select", "button", "noscript") else at
            held.append(" ")
        elif tag == "br":
            held.append(" ")
        elif tag not in BLOCK:
            if tag in ("img", "input"):
                held.append(" ")
        elif closing:
            flush()
            if open_[tag]:
                close(next(i for i in _backwards(stack) if stack[i].tag == tag))
        else:
            flush()
            _close_before(stack, tag, open_, close)
            up = stack[-1]
            key, noise, soft = _style(tag, attrs, up.inside)
            mark = up.mark
            if noise:
                mark = _Mark(mark, not soft, len(page.marks))
                page.marks.append(mark)
            node = _Node(tag, _path(up.path, key), mark, up.inside or tag in ("article", "main"))
            page.up.setdefault(node.path, up.path)
            page.children.setdefault(up.path, []).append(key)
            if tag not in VOID:
                stack.append(node)
                open_[tag] += 1
    flush()
    return page


def _backwards(stack: list[_Node]) -> Iterator[int]:
    return iter(range(len(stack) - 1, 0, -1))


def _close_before(stack: list[_Node], tag: str, open_: Counter, close: Callable[[int], None]) -> None:
    """End tags that a start tag implies."""
    if open_["p"] and (stack[-1].tag == "p" or tag not in CLOSES):
        for i in _backwards(stack):
            if stack[i].tag == "p":
                close(i)
                break
            if stack[i].tag in ("td", "th", "table", "div", "article", "section", "li", "body"):
                break
    if not any(open_[t] for t in CLOSES.get(tag, ())):
        return
    for i in _backwards(stack):
        if stack[i].tag in SCOPES[tag]:
            break
        if stack[i].tag in CLOSES[tag]:
            close(i)
            break


def extract(html: str, furniture: frozenset[int] = frozenset(), judged: bool = False) -> str:
    """Main text of one page, given its host's low-importance style paths, if the host has pages enough to be judged."""
    page = blocks(html)
    found = unmarked(page)
    if furniture:
        # The outermost low branch that each path lies under; parents come first.
        under: dict[int, int | None] = {ROOT: None}
        for path, up in page.up.items():
            under[path] = under[up] if under[up] is not None else path if path in furniture else None
        size: Counter = Counter()
        for n, t in found:
            size[under[n.path]] += len(t)
        half = sum(size.values()) / 2
        found = [(n, t) for n, t in found if (low := under[n.path]) is None or size[low] > half]
    if not judged:
        inside = [(n, t) for n, t in found if n.inside]
        if 2 * sum(len(t) for _, t in inside) > sum(len(t) for _, t in found):
            found = inside
    return "\n".join(t for _, t in found)


def unmarked(page: Page) -> list[tuple[_Node, str]]:
    """Blocks outside elements that name themselves furniture; names that would take the main text go for nothing."""
    wrong: set[int] = set()
    while True:
        outer: list[_Mark | None] = []  # by mark: the outermost around it that counts
        for mark in page.marks:
            above = outer[mark.up.at] if mark.up else None
            outer.append(above or (None if mark.at in wrong else mark))
        left, size = [], Counter()
        for n, t in page.blocks:
            top = outer[n.mark.at] if n.mark else None
            if top is None:
                left.append((n, t))
            elif not n.mark.firm:
                size[top.at] += len(t)
        most = MAIN * sum(len(t) for _, t in left)
        largest = max(size, key=size.__getitem__, default=None)
        if largest is None or size[largest] <= most:
            return left
        wrong.add(largest)


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, shape, content, c): how many pages of a host that differ elsewhere have a path with this shape and content.

    Pages count once if they agree in all text that doesn't name itself furniture, and only for branches that
    leave some of it: copies of one page are no template.
    """

    def run(batches):
        for batch in batches:
            held: dict[tuple[str, int, int, int, int], None] = {}
            for part in slices(batch, "html"):
                hosts = part.column(part.schema.get_field_index("host")).to_pylist()
                for host, b in zip(hosts, texts(part, "html"), strict=True):
                    page = blocks(b.decode("utf-8", "replace"))
                    found = unmarked(page)
                    whole = _name(text for _, text in found)
                    # What stands under each path: how many blocks, and a sum over them that tells contents apart.
                    many, content = Counter(), Counter()
                    for node, text in found:
                        many[node.path] += 1
                        content[node.path] += xxhash.xxh3_64_intdigest(text)
                    for path in reversed(page.up):
                        if many[path]:
                            many[page.up[path]] += many[path]
                            content[page.up[path]] += content[path]
                    for path in page.up:
                        if 0 < many[path] < len(found):
                            held[host, path, _name(page.children.get(path, ())), content[path] % (1 << 64) - (1 << 63), whole] = None
            cols = list(zip(*held, strict=True)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_pydict({"host": pa.array(cols[0], pa.string())} | {c: pa.array(x, pa.int64()) for c, x in zip(("path", "shape", "content", "whole"), cols[1:], strict=True)})

    key = ["host", "path", "shape", "content"]
    found = pages.select("host", "html").mapInArrow(run, "host string, path long, shape long, content long, whole long")
    return found.distinct().groupBy(*key).agg(F.count("*").alias("c"))


def _name(parts) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(parts)) - (1 << 63)


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, m, presentation, content): entropies to the base of the number of pages m; 1 for a single page."""

    def entropy(column: str) -> DataFrame:
        each = nodes.groupBy("host", "path", column).agg(F.sum("c").alias("c"))
        # H = log m - sum(c log c) / m
        by = each.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        return by.select("host", "path", "m", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(F.lit(1.0)).alias(column))

    return entropy("shape").withColumnRenamed("shape", "presentation").join(entropy("content").drop("m"), ["host", "path"])


def furniture(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """(host, paths) of hosts with ``min_pages`` pages that share a path: those of low importance."""
    found = importance(stored(style_nodes(pages), "style-nodes"))
    found = found.where(F.col("m") >= min_pages)
    return found.groupBy("host").agg(F.collect_list(F.when(F.greatest("presentation", "content") <= low, F.col("path"))).alias("paths"))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    low_paths = stored(furniture(pages, min_pages, low), "furniture")
    size = low_paths.agg(F.coalesce(F.sum(F.length("host") + 8 * F.size("paths")), F.lit(0))).first()[0]
    sent = spark.sparkContext.broadcast({r.host: frozenset(r.paths) for r in low_paths.collect()}) if size <= BROADCAST_BYTES else None
    if sent is None:
        pages = pages.join(low_paths, "host", "left")
    else:
        pages = pages.withColumn("paths", F.lit(None).cast("array<long>"))

    def run(batches):
        known = sent.value if sent is not None else None
        for batch in batches:
            for part in slices(batch, "html"):
                cols = {n: part.column(part.schema.get_field_index(n)) for n in ("page_id", "url")}
                if known is not None:
                    paths = [known.get(h) for h in part.column(part.schema.get_field_index("host")).to_pylist()]
                else:
                    paths = [None if p is None else frozenset(p) for p in part.column(part.schema.get_field_index("paths")).to_pylist()]
                out = [extract(b.decode("utf-8", "replace"), p or frozenset(), p is not None) for b, p in zip(texts(part, "html"), paths, strict=True)]
                yield pa.RecordBatch.from_pydict(cols | {"text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html", "host", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages as these tables have them: one article element, blocks h1 and p, a few character references.
SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(?:b|i|em|strong|a|span|br)(?:\s[^>]*)?>', ' ', 'g'), '</?(?:h1|p)(?:\s[^>]*)?>', chr(1), 'g') AS x FROM a
), c AS (
  SELECT page_id, url, list_filter(list_transform(string_split(x, chr(1)), lambda s: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(s, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'),
    '\s+', ' ', 'g'))), lambda s: s <> '') AS l FROM b
)
SELECT page_id, url, coalesce(array_to_string(l, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(l, chr(10)), '')) AS BIGINT) AS n_chars FROM c
"""
