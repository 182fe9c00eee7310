"""Main text of web pages: structural rules and the removal of site templates.

Each page is read once into pieces of text, each with the element it stands in. Every element
subtree has a hash; Spark counts, per host, on how many different pages a subtree occurs, and
those that recur across many pages of their host are deleted, with all text below them. What
is left, less the elements that never hold main text, is the page's text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewgrain.llm.common import text_of, with_row_key
from viewgrain.plans.settle import settle

#: A subtree is a template if it is on at least so many different pages of its host, and on
#: at least this share of them, of few pages. The share falls as the host grows: of n pages,
#: no more than the root of LEAST_PAGES * LEAST_SHARE * n are asked for (123 of 10,000), so the
#: block of one section counts on a large host too.
LEAST_PAGES, LEAST_SHARE = 5, 0.3

# Element names of HTML by their role here.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = RAW | {"head", "nav", "menu", "footer", "aside", "form", "button", "select", "option", "dialog", "svg", "canvas", "audio", "video", "object", "map", "label", "fieldset"}
BLOCKS = {
    *("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption").split(),
    *("figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option").split(),
    *("p pre search section select summary table tbody td tfoot th thead tr ul").split(),
}
#: Inside the article the template rule reaches these containers only, so that a paragraph,
#: heading or phrase that many articles share stays.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "header", "hgroup", "details", "center", "address"}
#: Start tags that end an open element of the same kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
#: Elements past which such an implied end does not look.
FENCES = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body", "html", "blockquote", "nav", "aside", "footer", "header", "form"}
#: Words of class, id and role that mark what is not main text, unless it holds an article.
MARKED = {
    *("ad ads advert advertisement advertisements adverts adsense sponsor sponsored promo promotion banner").split(),
    *("cookie cookies consent gdpr notice notices popup modal overlay disclaimer").split(),
    *("nav navbar navigation navigations menu menus breadcrumb breadcrumbs pagination pager toolbar").split(),
    *("sidebar sidebars aside related recommended share sharing social newsletter subscribe subscription").split(),
    *("footer masthead comment comments commentlist disqus respond reply replies contentinfo complementary search").split(),
}
#: Words that also drop an element inside an article: adverts and comments any element, the
#: others containers only, so that a paragraph of the text never goes for its class. What may
#: be part of a text there (a reply, a notice, a search, a related part) stays.
MARKED_INSIDE = {
    *("ad ads advert advertisement advertisements adverts adsense sponsor sponsored").split(),
    *("comment comments commentlist disqus").split(),
}
CONTAINERS_INSIDE = {
    *("cookie cookies consent gdpr nav navbar navigation navigations menu menus breadcrumb breadcrumbs pagination pager").split(),
    *("sidebar sidebars share sharing newsletter footer").split(),
}
#: Words that mark an article as a reader's comment.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
#: Marked only outside the article, where it is the head of the page rather than of the text.
PAGE_HEADS = {"header", "topbar"}
#: A class, id or role is marked as a whole, or by its first part (``sidebar-left``), past parts
#: that say where on the page it is (``site-footer``); not where its last part is a state of the
#: page (``comments-open``).
PLACES = {"site", "page", "main", "left", "right", "top", "bottom", "primary", "secondary", "global", "wp", "widget"}
STATES = {"open", "opened", "closed", "enabled", "disabled", "active", "inactive", "none", "off", "on", "free"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[-_:.]+")


def _marks(attrs: str, among: set[str]) -> bool:
    for found in _MARK.finditer(attrs):
        for token in "".join(g or "" for g in found.groups()).lower().split():
            parts = [p for p in _PART.split(token) if p]
            while len(parts) > 1 and parts[0] in PLACES:
                del parts[0]
            if parts and parts[0] in among and (len(parts) == 1 or parts[-1] not in STATES):
                return True
    return False


@dataclass
class Page:
    """Elements in page order, and pieces of text that stand in them."""

    names: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    in_main: list[bool] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)
    pieces: list[list[str]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    heads: list[bool] = field(default_factory=list)
    comments: list[bool] = field(default_factory=list)

    def add(self, name: str, parent: int, attrs: str) -> int:
        among = MARKED_INSIDE | CONTAINERS_INSIDE if name in CONTAINERS else MARKED_INSIDE
        self.names.append(name)
        self.parents.append(parent)
        self.marked.append(_marks(attrs, MARKED))
        self.inside.append(self.marked[-1] and _marks(attrs, among))
        self.heads.append(name in PAGE_HEADS or _marks(attrs, PAGE_HEADS))
        self.comments.append(_marks(attrs, COMMENTS))
        return len(self.names) - 1

    def _main(self) -> list[bool]:
        """Which elements are articles or mains, and no reader's comment.

        An article is a comment if it is marked so, stands in an element marked so that holds no
        main, or stands in an article that has text of its own.
        """
        holds_main = [name == "main" for name in self.names]
        article: list[int] = []  # the innermost article at or above an element
        for n, up in enumerate(self.parents):
            article.append(n if self.names[n] == "article" else article[up] if up >= 0 else -1)
        own_text = {article[n] for n, text in zip(self.nodes, self.texts) if text.strip()}
        for n in range(len(self.names) - 1, -1, -1):  # children come after their parents
            if holds_main[n] and self.parents[n] >= 0:
                holds_main[self.parents[n]] = True
        main, said = [], []  # said: at or below what is marked as comments, or an article with text
        for n, (name, up) in enumerate(zip(self.names, self.parents)):
            above = up >= 0 and said[up]
            comment = name == "article" and (above or self.comments[n])
            main.append(name == "main" or (name == "article" and not comment))
            marked = self.comments[n] and not holds_main[n] and name not in ("html", "body")
            said.append(above or marked or (name == "article" and n in own_text))
        return main

    def settle(self) -> Page:
        """Decide what is dropped, once it is known which elements hold an article."""
        self.texts = ["".join(parts) for parts in self.pieces]
        main = self._main()
        holds = list(main)
        for n in range(len(holds) - 1, -1, -1):  # children come after their parents
            if holds[n] and self.parents[n] >= 0:
                holds[self.parents[n]] = True
        for n, name in enumerate(self.names):
            up = self.parents[n]
            up_main = up >= 0 and self.in_main[up]
            marked = self.inside[n] if up_main else self.marked[n] or self.heads[n]
            out = name in NEVER or (name == "article" and not main[n]) or (not holds[n] and marked)
            if name in ("html", "body"):
                out = False
            self.dropped.append(out or (up >= 0 and self.dropped[up]))
            self.in_main.append(up_main or (main[n] and not self.dropped[-1]))
        return self


def _parts(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes); kind is text, start or end. Raw elements are skipped."""
    at = 0
    while True:
        found = _TOKEN.search(source, at)
        if not found:
            yield "text", source[at:], ""
            return
        if found.start() > at:
            yield "text", source[at : found.start()], ""
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["end"]:
            yield "end", name, ""
            continue
        yield "start", name, found["attrs"]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else len(source)
            yield "end", name, ""


def parse(source: str) -> Page:
    """A page's elements and text, however its tags are nested or left open."""
    page, block = Page(), 0
    stack: list[int] = []
    open_at: dict[str, list[int]] = {}  # places in the stack by name, so that no tag has to look through it

    def cut(place: int) -> None:
        while len(stack) > place:
            open_at[page.names[stack.pop()]].pop()

    def last(names: set[str]) -> int:
        return max((open_at[name][-1] for name in names if open_at.get(name)), default=-1)

    def piece(text: str) -> None:
        node = stack[-1] if stack else opened("body", "")
        if page.nodes and page.nodes[-1] == node and page.blocks[-1] == block:
            page.pieces[-1].append(text)
        else:
            page.blocks.append(block)
            page.nodes.append(node)
            page.pieces.append([text])

    def opened(name: str, attrs: str) -> int:
        open_at.setdefault(name, []).append(len(stack))
        stack.append(page.add(name, stack[-1] if stack else -1, attrs))
        return stack[-1]

    for kind, what, attrs in _parts(source):
        if kind == "text":
            piece(what)
            continue
        if what in BLOCKS:
            block += 1
        if kind == "end":
            if open_at.get(what):
                cut(open_at[what][-1])
            continue
        if what == "br":
            piece(" ")
        if what in VOID:
            continue
        closes = CLOSES.get(what, {"p"} if what in BLOCKS else set())
        ended = last(closes)
        if ended >= 0 and ended >= last(FENCES):
            cut(ended)
        opened(what, attrs)
    return page.settle()


def subtree_hashes(page: Page) -> list[int]:
    """A hash of each element's name, text and children, in order; 0 if it holds no text."""
    content: list[list[bytes]] = [[] for _ in page.names]
    placed = sorted([(n, 0, i) for i, n in enumerate(page.nodes)])
    for n, _, i in placed:
        text = " ".join(page.texts[i].split())
        if text:
            content[n].append(text.encode())
    hashes = [0] * len(page.names)
    for n in range(len(page.names) - 1, -1, -1):  # children come after their parents
        parts = content[n]
        if parts:
            value = xxhash.xxh64_intdigest(b"\x00".join([page.names[n].encode(), *parts]))
            hashes[n] = value - (1 << 64) if value >= 1 << 63 else value
            if page.parents[n] >= 0:
                content[page.parents[n]].append(b"\x01" + value.to_bytes(8, "little"))
    return hashes


def identity(page: Page, hashes: list[int]) -> int:
    """A hash of all that stands outermost on a page, which may lack html or body tags."""
    roots = [hashes[n] for n, up in enumerate(page.parents) if up < 0 and hashes[n]]
    value = xxhash.xxh64_intdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in roots))
    return value - (1 << 64) if value >= 1 << 63 else value


def _read(batches):
    """For each page: its key, host counts' input, and what is needed to write its text."""
    for batch in batches:
        rows = {k: [] for k in ("hashes", "body", "parents", "block", "node", "piece")}
        for source in batch.column("html").to_pylist():
            page = parse(source)
            hashes = subtree_hashes(page)
            main = any(page.in_main[n] and not page.dropped[n] and t.strip() for n, t in zip(page.nodes, page.texts))
            keep = [
                i for i, n in enumerate(page.nodes) if not page.dropped[n] and (page.in_main[n] or not main)
            ]
            # Only elements above kept text matter.
            wanted = set()
            for i in keep:
                n = page.nodes[i]
                while n >= 0 and n not in wanted:
                    wanted.add(n)
                    n = page.parents[n]
            order = sorted(wanted)
            place = {n: k for k, n in enumerate(order)}
            exempt = [
                page.names[n] in ("article", "main", "body", "html") or (page.in_main[n] and page.names[n] not in CONTAINERS)
                for n in order
            ]
            rows["hashes"].append([0 if free else hashes[n] for n, free in zip(order, exempt)])
            rows["body"].append(identity(page, hashes))
            rows["parents"].append([place.get(page.parents[n], -1) for n in order])
            rows["block"].append([page.blocks[i] for i in keep])
            rows["node"].append([place[page.nodes[i]] for i in keep])
            rows["piece"].append([html.unescape(page.texts[i]) for i in keep])
        kinds = (pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
        arrays = [pa.array(v, k) for v, k in zip(rows.values(), kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("page"), *arrays], ["page", *rows])


def _written(parents: pd.Series, block: pd.Series, node: pd.Series, piece: pd.Series, deleted: pd.Series) -> pd.Series:
    """Blocks joined by new lines, without the pieces below a deleted element."""

    def text(parents, blocks, nodes, pieces, gone):
        out = [False] * len(parents)
        hit = set() if gone is None else {int(g) for g in gone}
        for n, up in enumerate(parents):
            out[n] = n in hit or (up >= 0 and out[up])
        joined: dict[int, list[str]] = {}
        for b, n, p in zip(blocks, nodes, pieces):
            if not out[n]:
                joined.setdefault(b, []).append(p)
        lines = (" ".join("".join(parts).split()) for parts in joined.values())
        return "\n".join(line for line in lines if line)

    return pd.Series([text(*row) for row in zip(parents, block, node, piece, deleted)], dtype=object)


def main_text(
    pages: DataFrame,
    source: str = "html",
    url: str = "url",
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """All columns of ``pages`` under ``page``, with host and text.

    Pages of one content count once, so copies of a page make no template. Where a page has
    an article or main element with text, only what is in it counts; running text there is
    never a template. Articles that are marked as comments, stand in what is marked so, or in
    an article with text of its own are comments. NULL html and pages without main text give the empty text. A URL
    without a host belongs to the host NULL. Rows that repeat get a row each; an empty table
    gives an empty one.
    """
    columns = [F.col(f"`{c}`") for c in pages.columns if c != source]
    host = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    named = pages.select(
        F.struct(F.struct(*columns).alias("row"), F.nullif(host, F.lit("")).alias("host")).alias("page"),
        text_of(source).alias("html"),
    )
    found = "hashes array<long>, body long, parents array<int>, block array<int>, node array<int>, piece array<string>"
    schema = T.StructType([named.schema["page"], *T.StructType.fromDDL(found)])
    read = with_row_key(named.mapInArrow(_read, schema))
    return _without_templates(read, least_pages, least_share).select("page.row", "page.host", "text")


def _without_templates(read: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    different = read.select(F.col("page.host").alias("host"), "body").distinct()
    n_pages = different.groupBy(F.col("host").alias("__host")).agg(F.count(F.lit(1)).alias("n_pages"))
    seen = read.select("row", F.col("page.host").alias("host"), "body", F.posexplode("hashes").alias("at", "hash")).where("hash <> 0")
    enough = F.least(F.col("n_pages") * least_share, F.sqrt(F.col("n_pages") * (least_pages * least_share)))
    on_pages = seen.select("host", "hash", "body").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    recurring = settle(
        on_pages.where(F.col("n") >= least_pages)
        .join(n_pages, F.col("host").eqNullSafe(F.col("__host")))
        .where(F.col("n") >= enough)
        .select(F.col("host").alias("__host"), F.col("hash").alias("__hash"))
    )
    hits = seen.join(recurring, F.col("host").eqNullSafe(F.col("__host")) & (F.col("hash") == F.col("__hash")))
    # Settled, so that the planner knows its size: where few pages have a template left in what
    # they keep, their texts need no shuffle.
    deleted = settle(hits.groupBy(F.col("row").alias("__row")).agg(F.collect_list("at").alias("deleted")))  # of one page
    joined = read.join(deleted, F.col("row") == F.col("__row"), "left")
    written = F.pandas_udf(_written, "string")
    return joined.withColumn("text", written("parents", "block", "node", "piece", "deleted"))
