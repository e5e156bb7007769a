"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node for each path of containers (tag, class), with counts of the presentations seen
below it (sequences of child containers) and of the contents seen in it (hashes of text blocks). A node whose presentation hardly
varies and whose contents recur on many pages of the host is furniture. Importance combines both entropies, as in the literature on
noise in web sites; branches below the threshold are removed from each page, inside the article too. Branches beside the article stay
where the tree finds them important.

What the markup itself calls a menu, header, footer, sidebar, notice, advert, form or comment has importance 0 on any host, and what it
calls the article is kept but for branches that the tree rejects. Importance is drawn towards a prior that counts as some pages, so a
host with few pages goes by its markup.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small

PRIOR_PAGES = 4  # weight of the prior, in pages
THRESHOLD = 0.25  # of importance, drawn to 0.5: branches below go
BESIDE = 0.5  # of importance, drawn to 0: branches beside an article stay from here on
DECAY, LEAST_WEIGHT = 0.9, 0.5  # weight of contents against presentation, a level, and at least: deep nodes may have no child containers

DEPTH = 64  # containers within containers; what is nested deeper counts as part of the last, as a browser's own limit does

_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>\"']*)([^>\"']*)>")  # without quotes
_WHOLE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>\"']*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")  # with closed ones
_TAG_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"(class|id|role|style|aria-hidden|hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_UNFINISHED = re.compile(r"<[A-Za-z/!][^>]*\Z")
_CUE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|adslot|adbox|sponsor(?:ed)?|teasers?|promos?|promotion|banners?|sidebars?|side|comments?|commentlist|disqus|respond|repl(?:y|ies)|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|nav|navbar|navigation|menus?|breadcrumbs?|footer|header|masthead|popup|modal|overlay|search|forms?|widgets?|pagination|pager|toolbar|skip)(?=$|[\s_\d-])",
    re.I,
)
#: Of these, what a class inside the article must say to be noise there; a side note or a search result is left to the tree.
_CUE_INSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|adslot|adbox|sponsor(?:ed)?|teasers?|promos?|promotion|sidebars?|comments?|commentlist|disqus|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|recommendations|nav|navbar|navigation|menus?|breadcrumbs?|footer|popup|pagination|pager)(?=$|[\s_\d-])",
    re.I,
)
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
#: Class names that only tell how a page is laid out: no-sidebar, has-comments, search-result-page; and a heading's box in an article.
_LAYOUT = re.compile(r"(?:(?:no|not|has|have|with|without|hide)[_-].*|.*[_-](?:page|layout|template))", re.I)
_HEADING = re.compile(r"(?:[\w-]*[_-])?(?:header|masthead)", re.I)
CUE, INNER, SURE = 1, 2, 3  # noise by a class outside the article, by one inside it, by tag, role or style
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
NOISE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "object", "canvas", "head", "audio", "video", "label", "fieldset"}
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("article aside body div dl footer form header main nav ol section table ul".split())
MAIN = {"article", "main"}


def _closing(text: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(text, at)
    return m.end() if m else len(text)


def _describe(tag: str, attrs: str, main: bool = False) -> tuple[int, str]:
    """How the attributes mark noise, 0 if they don't, and the node's name: tag and first class or id, without digits."""
    if not attrs.strip():
        return 0, tag
    cue, noise, name = False, False, tag
    other = re.search(r"[\w-]hidden", attrs)
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            cue = cue or any((_CUE_INSIDE if main else _CUE).search(x) and not _LAYOUT.fullmatch(x) and not (main and _HEADING.fullmatch(x)) for x in value.split())
            if name == tag and value.split():
                name = f"{tag}.{re.sub(r'[0-9]+', '', value.split()[0])}"
        elif key == "role":
            noise = noise or value.lower() in _ROLES
        elif key == "style":
            noise = noise or "display:none" in value.replace(" ", "").lower()
        elif key == "aria-hidden":
            noise = noise or value.lower() == "true"
        else:
            noise = noise or m[2] is None and not other
    return SURE if noise else (INNER if main else CUE) if cue else 0, name


class Node:
    """A path of containers: its names from the top, as a hash that goes on from the one above."""

    __slots__ = ("parent", "name", "depth", "key", "main", "body", "inner", "below")

    def __init__(self, parent: Node | None, name: str):
        self.parent, self.name, self.inner, self.below = parent, name, {}, []
        if parent is None:
            self.depth, self.key, self.main, self.body = 0, 0, 0, False
            return
        self.depth = parent.depth + 1
        self.key = xxhash.xxh64_intdigest(name.encode(), seed=parent.key + (1 << 63) if parent.depth else 0) - (1 << 63)
        self.main = parent.main or (self.depth if name.split(".")[0] in MAIN else 0)  # depth of the article
        self.body = parent.body or self.depth == 1 and name == "body"

    def child(self, name: str) -> Node:
        """The path one container further down, which may occur often; too deep, this one."""
        if self.depth >= DEPTH:
            return self
        self.below.append(name)
        if name not in self.inner:
            self.inner[name] = Node(self, name)
        return self.inner[name]


class _Tags:
    """The markup of a page from left to right: comments, tags and declarations. Quotes hide what is in them, unless they stay open: then a tag
    ends at the next sign for it. A place outside of quotes from which no end was found is not tried again, so work is linear."""

    def __init__(self, page: str):
        self.page, self.last, self.hopeless = page, page.rfind(">"), set()
        self.last_quote = {q: page.rfind(q) for q in "\"'"}

    def _quoted_end(self, at: int) -> int:
        """Where the tag that is open at ``at`` ends, with quotes taken as such; -1 if it doesn't."""
        tried = []
        while at not in self.hopeless:
            tried.append(at)
            m = _MARK.search(self.page, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            if self.last_quote[m[0]] <= m.start():
                break
            at = self.page.find(m[0], m.end()) + 1
        self.hopeless.update(tried)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name and attributes of the next tag from ``at`` on; without a name, other markup."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), False, "", ""
            if at > self.last:
                at += 1
                continue
            # Where a quote has stayed open once, this could look through the page for each tag.
            if m := (_PLAIN_TAG if self.hopeless else _WHOLE_TAG).match(page, at):
                return at, m.end(), bool(m[1]), m[2].lower(), m[3]
            if m := _TAG_NAME.match(page, at):
                end = self._quoted_end(m.end())
                end = page.find(">", m.end()) if end < 0 else end
                return at, end + 1, page[at + 1] == "/", m[1].lower(), page[m.end() : end]
            if page[at + 1] in "!?":
                return at, page.find(">", at) + 1, False, "", ""
            at += 1
        return None


class _Open:
    """Open elements, with the places of each tag, so that the nearest one is found at once."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, int, bool, Node]] = [("", 0, False, root)]  # tag, noise, in the article, path
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, noise: int, main: bool, node: Node) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, noise, main, node))

    def pop(self) -> None:
        self.places[self.stack.pop()[0]].pop()

    def close(self, tag: str, stop: set[str]) -> None:
        """Closes the nearest element of that tag and all inside it, if none of ``stop`` is nearer."""
        nearest = self.places.get(tag)
        if nearest and not any(self.places.get(x) and self.places[x][-1] > nearest[-1] for x in stop):
            for _ in range(len(self.stack) - nearest[-1]):
                self.pop()


_CELLS, _ROWS = {"td", "table"}, {"ul", "ol", "dl", "table", "select"}


def blocks_of(page: str) -> tuple[list[tuple[str, int, bool, Node, bool]], Node]:
    """Text blocks in page order, each with its text, how markup calls it noise, whether it is in the article, its path of containers and
    whether all of it lies in links; and the top of the paths. Open elements and paths are kept by reference, so that work is linear in the
    page, also where nothing is closed."""
    out: list[tuple[str, int, bool, Node, bool]] = []
    root, tags = Node(None, ""), _Tags(page)
    open_ = _Open(root)
    parts: list[str] = []
    link, plain = False, False  # inside a link; whether the block has text outside of links
    at = 0

    def add(raw: str) -> None:
        nonlocal plain
        parts.append(html.unescape(raw))
        plain = plain or not link and not raw.isspace()

    def flush() -> None:
        nonlocal plain
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, noise, main, node = open_.stack[-1]
                out.append((text, noise, main, node, not plain))
        plain = False

    n = len(page)
    while at < n:
        found = tags.next(at)
        if not found:
            add(_UNFINISHED.sub("", page[at:]))
            break
        start, end, closes, tag, attrs = found
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        link = not closes if tag == "a" else link
        if closes:
            if tag in BLOCKS:
                flush()
                open_.close(tag, _CELLS if tag not in ("table", "tr", "td", "tbody", "thead", "tfoot", "body", "html") else set())
            elif open_.stack[-1][0] == tag:
                flush()
                open_.pop()
            continue
        if tag in RAW:
            at = _closing(page, tag, at)
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            if tag == "hr":
                flush()
            continue
        noisy, name = _describe(tag, attrs, open_.stack[-1][2])
        if tag in BLOCKS:
            flush()
            if open_.stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                open_.pop()
            if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
                open_.close(tag, _ROWS | ({"tr"} if tag in ("td", "th") else set()))
            if tag in ("body", "html"):
                noisy = 0
            _, noise, main, node = open_.stack[-1]
            if tag in CONTAINERS:
                node = node.child(name)
            inside = main or tag in MAIN
            sure = SURE if tag in NOISE or tag == "header" and not main else 0
            open_.push(tag, max(noise, noisy, sure), inside, node)
        elif noisy or tag in NOISE:  # inline furniture
            flush()
            _, noise, main, node = open_.stack[-1]
            open_.push(tag, max(noise, noisy, SURE if tag in NOISE else 0), main, node)
    flush()
    return out, root


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def main_text(page: str, low: frozenset[int] | set[int], high: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's text without noise; ``low`` are keys of this host's paths that are not important, ``high`` of those that are.

    A class on the article or around it is noise only where the page has another article without one, as teasers and comments do. An
    article that would lose all its text keeps it: its copies on other pages don't make it furniture. A page without an article loses
    list items that are nothing but links, and a last block that claims rights, unless nothing else is there."""
    blocks, _ = blocks_of(page)
    article = any(main and not noise for _, noise, main, *_ in blocks)
    if not article and any(main and noise == CUE for _, noise, main, *_ in blocks):
        article, blocks = True, [(text, 0 if main and noise == CUE else noise, main, *rest) for text, noise, main, *rest in blocks]
    shown = [(text, main, path, linked) for text, noise, main, path, linked in blocks if not noise and (not article or main or path.key in high)]
    if not article:
        body = [x for x in shown if not (x[3] and x[2].name.split(".")[0] in ("ul", "ol"))]
        if len(body) > 1 and _RIGHTS.match(body[-1][0]):
            del body[-1]
        shown = body or shown
    if not low:
        return " ".join(x[0] for x in shown)
    dropped: dict[Node, bool] = {}

    def drops(node: Node) -> bool:
        if node.depth and node not in dropped:
            dropped[node] = node.key in low or drops(node.parent)
        return bool(node.depth) and dropped[node]

    kept = [x for x in shown if not drops(x[2])]
    if article and not any(x[1] for x in kept):
        kept = [x for x in shown if x[1]]
    return " ".join(x[0] for x in kept)


def style_tree(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One row for each host and node: host and path keys, pages, depth, presentation, contents and importance.

    A node's contents are the blocks in and below it. With m pages, presentation is the entropy of its child sequences to base m; a
    block on c of them carries the information of log c to base m, and contents are 1 minus its mean. Nodes that hold the article, or
    that only the body's own paragraphs make up, are never judged; those inside the article are."""
    schema = "host long, path long, depth int, kind int, feature long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for u, h in zip(b.column("__url").to_pylist(), b.column("__html").to_pylist(), strict=True):
                host = _key(host_of(u))
                blocks, _ = blocks_of(h or "")
                nodes: dict[Node, set[int]] = {}
                given: set[Node] = set()  # never judged
                for text, _, main, node, _ in blocks:
                    holds = (node.main or node.depth) if main else 0
                    top, feature = 1 + node.body, _key(text)
                    while node.depth >= top:
                        nodes.setdefault(node, set()).add(feature)
                        if node.depth <= holds:
                            given.add(node)
                        node = node.parent
                for node, features in nodes.items():
                    if node not in given:
                        seen[host, node.key, node.depth, 0, _key("|", *node.below)] += 1
                        for f in features:
                            seen[host, node.key, node.depth, 1, f] += 1
            cols = list(zip(*seen.keys(), strict=True)) if seen else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.array(c, "i8"), pa.int64()).cast(k) for c, k in zip(cols, kinds, strict=True)), pa.array(list(seen.values()), pa.int64())], names=["host", "path", "depth", "kind", "feature", "n"])

    counts = pages.select(pages[url].cast("string").alias("__url"), pages[page].cast("string").alias("__html")).mapInArrow(count, schema)
    counts = counts.groupBy("host", "path", "depth", "kind", "feature").agg(F.sum("n").alias("n"))
    shape, block = F.col("kind") == 0, F.col("kind") == 1
    node = counts.groupBy("host", "path", "depth").agg(
        F.sum(F.when(shape, F.col("n"))).alias("pages"),
        F.sum(F.when(shape, F.col("n") * F.log("n"))).alias("a"),
        F.sum(F.when(block, F.col("n"))).alias("blocks"),
        F.sum(F.when(block, F.col("n") * F.log("n"))).alias("b"),
    )
    m = F.greatest(F.log(F.col("pages")), F.lit(1e-9))
    node = node.withColumn("presentation", F.when(F.col("pages") > 1, (F.log("pages") - F.col("a") / F.col("pages")) / m).otherwise(1.0))
    node = node.withColumn("contents", F.when(F.col("pages") > 1, 1 - F.col("b") / F.col("blocks") / m).otherwise(1.0))
    weight = F.greatest(F.pow(F.lit(DECAY), F.col("depth")), F.lit(LEAST_WEIGHT))
    return node.withColumn("importance", (1 - weight) * F.col("presentation") + weight * F.col("contents")).drop("a", "b")


def extract_main_text(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``, the main text of the whole page; it is empty for null or empty pages and for those without any text.

    Null urls make one host of their own. Each row is a page, repeated ones too. A column named as ``out`` is replaced, others stay."""
    tree = style_tree(pages, url, page)
    part = F.col("pages") / (F.col("pages") + PRIOR_PAGES)
    is_low = part * F.col("importance") + (1 - part) * 0.5 < THRESHOLD
    is_high = part * F.col("importance") >= BESIDE
    low = tree.filter(is_low | is_high).groupBy("host").agg(F.collect_set(F.when(is_low, F.col("path"))).alias("__site_low"), F.collect_set(F.when(is_high, F.col("path"))).alias("__site_high"))
    low = materialize(low.withColumnRenamed("host", "__site_key"), "low")
    kept = [f for f in pages.schema.fields if f.name != out]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])
    host_schema = T.StructType([*kept, T.StructField("__site_key", T.LongType())])

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("__site_key", pa.array([_key(host_of(u)) for u in b.column(url).cast(pa.string()).to_pylist()], pa.int64()))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(page).cast(pa.string()).to_pylist(), b.column("__site_low").to_pylist(), b.column("__site_high").to_pylist(), strict=True)
            texts = [main_text(h or "", set(x or ()), set(y or ())) for h, x, y in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string())], names=schema.fieldNames())

    keyed = pages.select(*[pages[c] for c in names]).mapInArrow(hosts, host_schema)
    return keyed.join(small(low), "__site_key", "left").select(*names, "__site_low", "__site_high").mapInArrow(extract, schema)
