"""Main text of web pages by removal of site templates.

A task reads each page once and returns its text blocks, each with the element around it, and of each element the one
around it and a hash of its subtree: a row grows with the page, however deep elements nest. Spark counts on how many
pages of a host each subtree occurs; blocks in a subtree that recurs on many pages of the host are deleted. Elements that are never article text by their kind (menus,
footers, forms, adverts, reader comments and so on) go as well, which also serves hosts with few pages.

Copies of a page count once. Inside an article or main element a subtree has to be in more of the host's different
articles, as articles may repeat a line. Blocks outside an article are left to the counts; only where a host has too
few pages to count does a page's single article stand for its text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import small_batches, table, written

#: A subtree is part of the template if it is on so many different pages of the host, and on this share of them; on MANY
#: pages it is whatever their share, as a large host has templates for its sections.
LEAST_PAGES, SHARE, MANY = 4, 0.2, 20
#: Inside articles it has to be in this share of the host's different articles.
ARTICLE_SHARE = 0.5
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "textarea", "button", "option", "datalist"}
NOT_ARTICLE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Words in a class, id or role that mark what is no article text.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "replies", "search", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo", "dialog", "alert", "respond", "responses", "overlay", "skip", "topbar",
}
#: Words that may stand beside one of MARKS in a class, id or role (has-sidebar and search-results mark nothing).
NEUTRAL = {"area", "bar", "block", "box", "container", "inner", "item", "items", "left", "link", "links", "list", "outer", "page", "panel", "posts", "right", "section", "site", "slot", "unit", "wrap", "wrapper"}
#: A start tag ends an open element of these kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "footer", "header", "nav", "main", "form", "blockquote", "pre", "figure", "figcaption", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "address", "fieldset", "details", "menu"}
_SPLIT = re.compile(r"[^a-z0-9]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Element:
    __slots__ = ("tag", "attrs", "parts", "node", "bad", "in_article", "silent", "mark")

    def __init__(self, tag, attrs, bad, in_article, silent, node, mark=-1):
        self.tag, self.attrs, self.bad, self.in_article, self.silent, self.node = tag, attrs, bad, in_article, silent, node
        self.mark = mark
        self.parts: list[str] = []


class PageReader(HTMLParser):
    """Blocks of a page: [text, dropped by kind, in an article, innermost node around it or -1, innermost marked element].

    Nodes are the elements that may be template: `around` has the node around each (-1: none), `hashes` the hash of its
    subtree (None where it is empty). Hashes inside an article are complemented, so that they are counted apart, and
    have only nodes of the same article around them. Each tag costs the same however many elements are open.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.articles = 0
        self.free_article = False
        self.held: list[str] = []
        self.marked: list[int] = []  # of each marked element: the marked element around it, or -1
        self.around: list[int] = []
        self.hashes: list[int | None] = []
        self.stack = [_Element("", "", False, False, False, -1)]
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of a tag

    def end_block(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held = []
            top = self.stack[-1]
            if text:
                self.blocks.append([text, top.bad, top.in_article, top.node, top.mark])

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag not in INLINE:
                self.end_block()
            return
        if tag in _ENDS_P:
            self.close_open({"p"}, {"button", "td", "th", "li", "article", "section", "div", "body", "blockquote"})
        if tag in _ENDS:
            self.close_open(_ENDS[tag], {"ul", "ol", "dl", "table"})
        if tag not in INLINE:
            self.end_block()
        top = self.stack[-1]
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")) if attrs else ""
        tokens = [{w for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", t).lower()) if w} for t in marks.split()]
        hidden = any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "")) or (k == "aria-hidden" and v == "true") for k, v in attrs)
        article = tag in ("article", "main") or any(k == "role" and v == "main" for k, v in attrs)
        bad = top.bad or tag in NOT_ARTICLE or (tag == "header" and not top.in_article) or hidden
        mark = top.mark
        if tag not in ("body", "html") and not article and any(t & MARKS and t <= MARKS | NEUTRAL for t in tokens):
            self.marked.append(mark)
            mark = len(self.marked) - 1
        if article and not bad and not top.in_article:
            self.articles += 1
            self.free_article = self.free_article or mark < 0
        inside = top.in_article or (article and not bad)
        node = top.node if inside == top.in_article else -1
        if tag not in INLINE and tag not in ("html", "body"):
            self.around.append(node)
            self.hashes.append(None)
            node = len(self.hashes) - 1
        self.open[tag].append(len(self.stack))
        self.stack.append(_Element(tag, marks, bad, inside, top.silent or tag in SILENT, node, mark))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe", "script"):
            self.handle_endtag(tag)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def close_open(self, kinds: set[str], barrier: set[str]) -> None:
        i = self.last(kinds)
        if i and i > self.last(barrier - kinds):
            self.close_to(i)

    def close_to(self, i: int) -> None:
        while len(self.stack) > i:
            top = self.stack[-1]
            if top.tag not in INLINE:
                self.end_block()
            self.stack.pop()
            self.open[top.tag].pop()
            h = _hash(top.tag, top.attrs, *top.parts)
            self.stack[-1].parts.append(str(h))
            if top.tag not in INLINE and top.parts and top.tag not in ("html", "body"):
                self.hashes[top.node] = ~h if top.in_article else h

    def handle_endtag(self, tag: str) -> None:
        i = self.last((tag,))
        if i and not (tag in INLINE | {"p", "li"} and self.last(("article", "main", "body")) > i):
            self.close_to(i)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if not top.silent:
            self.held.append(data)
            if data.strip():
                top.parts.append(" ".join(data.split()))

    def finish(self) -> None:
        self.close()
        self.end_block()
        self.close_to(1)
        # a marked element goes, unless it is what holds the page: most of its text, and no article is elsewhere
        held = [0] * len(self.marked)
        for text, bad, _, _, mark in self.blocks:
            if mark >= 0 and not bad:
                held[mark] += len(text)
        for i in range(len(held) - 1, -1, -1):
            if self.marked[i] >= 0:
                held[self.marked[i]] += held[i]
        whole = sum(len(b[0]) for b in self.blocks if not b[1])
        goes: list[bool] = []
        for outer, n in zip(self.marked, held, strict=True):
            goes.append((outer >= 0 and goes[outer]) or self.free_article or 2 * n <= whole)
        for block in self.blocks:
            block[1] = block[1] or (block[4] >= 0 and goes[block[4]])


def _read(html: str) -> tuple[list[tuple[str, bool, bool, int]], list[int], list[int | None]]:
    """(blocks not dropped by kind: (text, in an article, main text as far as the page alone tells, node around it), the
    node around each node, hashes of the nodes that hold such a block: None for the others)."""
    reader = PageReader()
    reader.feed(html)
    reader.finish()
    kept = [(text, in_article, node) for text, bad, in_article, node, _ in reader.blocks if not bad]
    inside = sum(len(text) for text, in_article, _ in kept if in_article)
    # several articles with less text than stands beside them are teasers
    articles = reader.articles if inside else 0
    only = articles == 1 or (articles > 1 and 2 * inside >= sum(len(text) for text, _, _ in kept))
    holds = [False] * len(reader.around)
    for _, _, node in kept:
        while node >= 0 and not holds[node]:
            holds[node] = True
            node = reader.around[node]
    hashes = [h if held else None for h, held in zip(reader.hashes, holds, strict=True)]
    return [(text, in_article, in_article or not only, node) for text, in_article, node in kept], reader.around, hashes


def read_page(html: str) -> tuple[list[list], set[int]]:
    """(blocks that may be main text: [text, hashes around it], all these hashes)."""
    blocks, around, hashes = _read(html)

    def up(node: int) -> list[int]:
        out = []
        while node >= 0:
            out += [hashes[node]] if hashes[node] is not None else []
            node = around[node]
        return out

    return [[text, up(node)] for text, _, alone, node in blocks if alone], {h for h in hashes if h is not None}


def left(texts: list[str], alone: list[bool], nodes: list[int], around: list[int], hashes: list[int | None], gone: set[int | None] | None) -> str:
    """The page's text without the blocks in deleted subtrees; as the page alone tells where nothing is known (None)."""
    if gone is None:
        return "\n\n".join(t for t, a in zip(texts, alone, strict=True) if a)
    dead: list[bool] = []
    for node, h in zip(around, hashes, strict=True):  # what is around a node comes before it
        dead.append((h is not None and h in gone) or (node >= 0 and dead[node]))
    return "\n\n".join(t for t, node in zip(texts, nodes, strict=True) if node < 0 or not dead[node])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAGES, share: float = SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """(page_id, url, text), one row per input row.

    text has the page's blocks in order, joined by an empty line; white space inside a block is one space. Null
    and empty html, or html without main text, give an empty text. Pages without a readable host (null url) have
    no template. Broken html is read as far as it goes. Repeated rows stay repeated; an empty table gives none.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1))
    x = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    id_type = x.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for html in batch.column(3):
                blocks, around, hashes = _read(html.as_py())
                own = {h for h in hashes if h is not None}
                # a block's element is inside an article where the block is, and so are the nodes around it
                inside, todo = set(), [b[3] for b in blocks if b[1]]
                seen: set[int] = set()
                for node in todo:
                    while node >= 0 and node not in seen:
                        seen.add(node)
                        inside |= {hashes[node]} - {None}
                        node = around[node]
                rows.append((n, [b[0] for b in blocks], [b[2] for b in blocks], [b[3] for b in blocks], around, hashes, sorted(own - inside), sorted(inside), _hash(*(b[0] for b in blocks)), _hash(*(b[0] for b in blocks if b[1]))))
                n += 1
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), ints, ints, longs, longs, longs, pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], ["page_id", "url", "host", "key", "texts", "alone", "nodes", "around", "hashes", "outer", "inner", "page", "article"])

    schema = f"page_id {id_type}, url string, host string, key long, texts array<string>, alone array<boolean>, nodes array<int>, around array<int>, hashes array<long>, outer array<long>, inner array<long>, page long, article long"
    read_ = written(x.mapInArrow(read, schema), "page-blocks")
    named = read_.where("host <> ''")

    # in how many different pages or articles of its host each subtree is: counted before the shuffle, so a hot host is no hot group
    def recurring(hashes: str, content: str, enough: Column) -> DataFrame:
        seen = named.select("host", F.explode(hashes).alias("h"), content).groupBy("host", "h").agg(F.count_distinct(content).alias("n"))
        totals = (named.where(F.size(hashes) > 0) if content == "article" else named).groupBy("host").agg(F.count_distinct(content).alias("all"))
        return seen.where(F.col("n") >= least).join(totals, "host").where(enough).select("host", "h")

    gone = written(recurring("outer", "page", (F.col("n") >= MANY) | (F.col("n") >= share * F.col("all"))).unionByName(recurring("inner", "article", F.col("n") >= article_share * F.col("all"))), "page-template")
    asked = named.select("key", "host", F.explode(F.concat("outer", "inner")).alias("h")).join(gone, ["host", "h"]).select("key", "h")
    # where a host has pages enough, its counts tell what to do with blocks beside an article
    known = named.groupBy("host").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least).select("host")
    beside = named.where(F.exists("alone", lambda b: ~b)).select("key", "host").join(known, "host").select("key", F.lit(None).cast("long").alias("h"))
    # written, so that Spark knows its size: pages need no shuffle where few of them have anything to lose
    gone = written(asked.unionByName(beside).groupBy("key").agg(F.collect_set("h").alias("gone")), "page-gone")
    out = read_.select("page_id", "url", "key", "texts", "alone", "nodes", "around", "hashes").join(gone, "key", "left")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for *page, lost, known in zip(*(batch.column(k).to_pylist() for k in range(2, 9)), strict=True):
                texts.append(left(*page, set(lost) if known else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = out.select("page_id", "url", "texts", "alone", "nodes", "around", "hashes", F.coalesce("gone", F.array().cast("array<long>")).alias("gone"), F.col("gone").isNotNull().alias("known"))
    return out.mapInArrow(put, f"page_id {id_type}, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its number of code points."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
