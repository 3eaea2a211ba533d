"""Main text of web pages with a site style tree.

1. Every page is parsed into a tree of elements; end tags that HTML lets out are put in.  A node is the path of tags with
   their classes, ids and roles (numbers masked).  The trees of all pages of a host merge: for each node, on how many
   pages it stands, and on how many of those each of its contents (blocks of text) does.
2. Importance of a node is presentation importance times content importance.  Content importance is
   1 - sum(n log n) / (sum(n) log m) over the contents of the node, n of its m pages having one of them: 0 where all
   pages say the same, 1 where none does; on fewer than PAGES pages nothing is known and it is 1.
   Presentation importance is 0 for menus, headers, footers, side bars, notices, adverts, forms and
   comments of readers, by tag, class, id or role; OUTSIDE for what stands outside ``article`` and ``main`` on a page that has one;
   1 otherwise.
3. Composite importance of an element is the largest of the nodes below it.  Blocks of nodes below LOW are removed, and so are
   all blocks in a branch whose composite importance is below LOW, also those of its rare nodes.
4. A content that more than 1 - LOW of a node's pages share (and PAGES at least) is a content node of low importance and is
   removed where it stands, as notices within articles are.
5. An article that a host repeats is still its pages' text: inside ``article`` and ``main`` pages with the same article count
   once, headings directly in it and ``h1`` stay, and an article of which nothing would be left stays whole.

The counts are combined before the shuffle, so a host may hold any part of the pages.  Elements nested deeper than DEPTH belong to
the node at that depth.  A null or empty page has an empty text.  A null URL, or one without a host, belongs to the host "".
Repeated rows: each keeps a row, and counts.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, map_arrow, maybe_broadcast, table

PAGES, LOW, OUTSIDE = 5, 0.3, 0.25
DEPTH = 512

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+")

RAW = frozenset("script style template noscript iframe textarea title svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
OUT_TAGS = frozenset("head nav header footer aside form menu dialog button select search".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead comment comments reply replies disqus share sharing social related recommended newsletter subscribe signup login popup modal overlay complementary contentinfo search".split())
#: Words that may stand beside those; another word makes a name mean something else.
PLAIN_NAMES = frozenset(
    "area article bar block bottom box button buttons card center col column container content entry fixed form global group holder icons inner item items left link links list main mobile outer page panel "
    "post posts primary right row section secondary site slot sticky text thread title top unit user widget widgets wrap wrapper".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start closes an open p.
P_ENDS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SCOPE = frozenset("table td th caption".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
IN_HEAD = frozenset("head base link meta".split())


def _starts() -> dict[str, tuple[frozenset[str], frozenset[str]]]:
    """Name of a start tag -> the open elements it closes, and those past which it closes none."""
    special = BLOCKS - {"address", "div", "p"}
    out = {x: (frozenset(("p",)), P_ENDS - {"p"} | SCOPE | {"button"}) for x in P_ENDS - {"li", "dd", "dt"}}
    for group in (("li",), ("dd", "dt")):
        out |= {x: (frozenset((*group, "p")), special - set(group)) for x in group}
    cells, rows = frozenset("td th caption".split()), frozenset("td th caption tr".split())
    out |= dict.fromkeys(("td", "th"), (cells, frozenset("table tbody thead tfoot tr".split())))
    out["tr"] = rows, frozenset("table tbody thead tfoot".split())
    out |= dict.fromkeys(("tbody", "thead", "tfoot"), (rows | {"tbody", "thead", "tfoot"}, frozenset(("table",))))
    out["button"] = frozenset(("button",)), SCOPE
    return out


STARTS = _starts()


class Node(NamedTuple):
    id: int
    parent: int  # its place in the page's nodes; the root's is -1
    weight: float  # presentation importance by tags and names alone
    main: bool  # article, main or below one
    top: bool  # that element itself
    heading: bool  # a main heading
    depth: int


class Page(NamedTuple):
    nodes: list[Node]
    blocks: list[tuple[int, str]]  # (place of the node, text) in page order
    has_main: bool

    def weight(self, node: int) -> float:
        x = self.nodes[node]
        return x.weight if x.main or not self.has_main else min(x.weight, OUTSIDE)

    def above(self, node: int) -> list[int]:
        """Places of the nodes above, from the nearest."""
        out, at = [], self.nodes[node].parent
        while at >= 0:
            out.append(at)
            at = self.nodes[at].parent
        return out

    def article(self) -> str:
        return "\n".join(t for n, t in self.blocks if self.nodes[n].main)


@lru_cache(1 << 14)
def _node_id(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent} {label}".encode(), digest_size=8).digest(), "big", signed=True)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@lru_cache(1 << 14)
def _no_text(name: str, names: str) -> bool:
    """Whether an element presents itself as no main text."""
    if name in OUT_TAGS:
        return True
    if name in MAIN or name in ("html", "body"):
        return False
    for x in names.split():
        words = _WORD.findall(x)
        out = [w for w in words if w in OUT_NAMES and not (name in HEADINGS and w in ("header", "banner", "masthead"))]
        if out and all(w in OUT_NAMES or w in PLAIN_NAMES or len(w) == 1 for w in words):
            return True
    return False


def _closed_by_start(name: str, open_: list) -> int:
    """How many of the open elements stay open at a start tag."""
    n = len(open_)
    if n and name not in IN_HEAD and name not in RAW:
        for i in range(min(n, 3)):
            if open_[i][0] == "head":
                return i
    end = n
    if name in STARTS:
        targets, barriers = STARTS[name]
        for i in range(n - 1, -1, -1):
            x = open_[i][0]
            if x in targets:
                end = i
            elif x in barriers:
                break
    if name in HEADINGS and end == n and n and open_[-1][0] in HEADINGS:
        end = n - 1
    return end


def _closed_by_end(name: str, open_: list, nodes: list[Node]) -> int:
    """How many of the open elements stay open at an end tag."""
    inline, heading = name not in BLOCKS, name in HEADINGS
    blocked = False
    for i in range(len(open_) - 1, -1, -1):
        x, node, own = open_[i]
        if x == name or heading and x in HEADINGS:
            if not blocked or own and nodes[node].weight == 0:
                return i
        elif inline:
            blocked = blocked or x in BLOCKS
        elif x == "table" if name in TABLE else x in SCOPE or name == "p" and x in P_ENDS or name == "li" and x in ("ul", "ol", "menu", "dir"):
            break
    return len(open_)


def parse(page: str) -> Page:
    nodes = [Node(0, -1, 1.0, False, False, False, 0)]
    out: list[tuple[int, str]] = []
    open_: list[tuple[str, int, bool]] = []  # (name, place of its node, whether the node is its own)
    parts: list[str] = []
    seen: dict[int, int] = {}
    at, has_main, here = 0, False, 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((here, text))

    def close(left: int) -> None:
        nonlocal here
        if left < len(open_):
            if any(own for _, _, own in open_[left:]):
                flush()
            del open_[left:]
            here = open_[-1][1] if open_ else 0

    find = _TAG.search
    while True:
        m = find(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if m[1] != "/" and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if m[1] == "/":
            if name in BLOCKS:
                flush()
            close(_closed_by_end(name, open_, nodes))
            continue
        close(_closed_by_start(name, open_))
        block = name in BLOCKS
        if block:
            flush()
        if name in VOID:
            continue
        names = " ".join((a or b or c).lower() for _, a, b, c in _ATTR.findall(m[3])) if m[3] else ""
        drop = _no_text(name, names)
        if len(open_) >= 4 * DEPTH:
            continue
        above = nodes[here]
        if not (block or drop) or above.depth >= DEPTH:
            open_.append((name, here, False))
            continue
        flush()
        label = f"{name}.{'.'.join(sorted(_NUMBER.sub('#', names).split()))}" if names else name
        id_ = _node_id(above.id, label)
        place = seen.get(id_)
        if place is None:
            main = name in MAIN and above.weight > 0 and not drop
            has_main = has_main or main
            nodes.append(Node(id_, here, 0.0 if drop else above.weight, main or above.main, main and not above.main,
                              name == "h1" or name in HEADINGS and bool(open_) and open_[-1][0] in MAIN, above.depth + 1))
            place = seen[id_] = len(nodes) - 1
        here = place
        open_.append((name, here, True))
    flush()
    return Page(nodes, out, has_main)


_TREE = "host string, node long, above array<long>, beside array<long>, content long, body long, weight double"


def _nodes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node with text of each page a row without content and one of each content of it.

    above: the nodes above within the same article, or all; beside: those above the article; body: hash of the page's article for nodes in it.
    """
    names = [x.split()[0] for x in _TREE.split(", ")]
    for batch in it:
        rows: list[tuple] = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = parse(html or "")
            key = _hash(page.article()) if page.has_main else None
            per: dict[int, set[int]] = {}
            for n, text in page.blocks:
                per.setdefault(n, set()).add(_hash(text))
            for n, contents in per.items():
                x = page.nodes[n]
                above = [page.nodes[i] for i in page.above(n)]
                inside = [y.id for y in above if y.main == x.main]
                outside = [y.id for y in above if y.main != x.main]
                body = key if x.main else None
                rows.append((host, x.id, inside, outside, None, body, page.weight(n)))
                rows += [(host, x.id, None, None, c, body, None) for c in contents]
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged trees of pages (host, html): nodes (host, node, pages, importance, composite), and content nodes (host, node, content, importance).

    A node without text of its own has a composite importance only.
    """
    each = map_arrow(pages.select("host", "html"), _nodes, _TREE)
    each = each.groupBy("host", "node", "content", "body").agg(F.count("*").alias("n"), F.first("above", True).alias("above"), F.first("beside", True).alias("beside"), F.max("weight").alias("weight"))
    each = each.groupBy("host", "node", "content").agg(
        F.sum(F.when(F.col("body").isNull(), F.col("n")).otherwise(1)).alias("n"), F.first("above", True).alias("above"), F.first("beside", True).alias("beside"), F.max("weight").alias("weight"))
    each = cut(each, "contents")
    n, some = F.col("n").cast("double"), F.col("content").isNotNull()
    own = each.groupBy("host", "node").agg(
        F.max(F.when(~some, F.col("n"))).alias("pages"), F.sum(F.when(some, n)).alias("all"), F.sum(F.when(some, n * F.log(n))).alias("s"),
        F.first("above", True).alias("above"), F.first("beside", True).alias("beside"), F.max("weight").alias("weight"))
    content = F.when(F.col("pages") >= PAGES, F.greatest(1 - F.col("s") / (F.col("all") * F.log(F.col("pages"))), F.lit(0.0))).otherwise(1.0)
    own = own.withColumn("importance", F.col("weight") * content)
    # what is known of a node counts for those above it; an article makes all above it important
    sure, none = F.col("pages") >= PAGES, F.lit(None)
    one = lambda id_, x, sure, pages, own: F.struct(id_.alias("node"), x.alias("x"), sure.alias("sure"), pages.cast("long").alias("pages"), own.cast("double").alias("importance"))
    up = F.concat(F.array(one(F.col("node"), F.col("importance"), sure, F.col("pages"), F.col("importance"))),
                  F.transform("above", lambda a: one(a, F.col("importance"), sure, none, none)), F.transform("beside", lambda a: one(a, F.lit(1.0), F.lit(True), none, none)))
    tree = own.select("host", F.explode(up).alias("u")).select("host", "u.*")
    tree = tree.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.max("importance").alias("importance"), F.max(F.when(F.col("sure"), F.col("x"))).alias("composite"))
    sizes = own.where(F.col("pages") >= PAGES).select(F.col("host").alias("h"), F.col("node").alias("k"), "pages")
    often = each.where(some & (F.col("n") >= PAGES)).select("host", "node", "content", "n")
    shared = often.join(sizes, (F.col("host") == F.col("h")) & (F.col("node") == F.col("k"))).select("host", "node", "content", (1 - F.col("n") / F.col("pages")).alias("importance"))
    return tree, shared


def main_text(page: Page, own: set[int], branches: set[int], contents: set[tuple[int, int]]) -> str:
    """Text of a page without the nodes, branches and contents of low importance."""
    gone: list[bool] = []
    for i, x in enumerate(page.nodes):  # parents come first
        gone.append(x.parent >= 0 and gone[x.parent] and not x.top or x.id in branches and not (x.main and x.heading) or page.weight(i) < LOW)
    keep = []
    for n, text in page.blocks:
        x = page.nodes[n]
        low = x.id in own or bool(contents) and not x.heading and (x.id, _hash(text)) in contents
        keep.append(not gone[n] and (not low or x.main and x.heading))
    if page.has_main and all(page.nodes[n].heading for (n, _), ok in zip(page.blocks, keep, strict=True) if ok):
        keep = [page.nodes[n].main and page.nodes[n].weight > 0 for n, _ in page.blocks]
    return " ".join(t for (_, t), ok in zip(page.blocks, keep, strict=True) if ok)


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = []
        for html, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            low = low or ()
            own = {x["node"] for x in low if x["content"] is None and not x["branch"]}
            branches = {x["node"] for x in low if x["content"] is None and x["branch"]}
            contents = {(x["node"], x["content"]) for x in low if x["content"] is not None}
            texts.append(main_text(parse(html or ""), own, branches, contents))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def with_host(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return pages.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages."""
    pages = with_host(pages, page_id, url, html)
    tree, shared = style_tree(pages)
    branch = F.coalesce(F.col("composite") < LOW, F.lit(False))
    nodes = tree.where(branch | (F.col("pages") >= PAGES) & (F.col("importance") < LOW)).select("host", "node", F.lit(None).cast("long").alias("content"), branch.alias("branch"))
    contents = shared.where(F.col("importance") < LOW).select("host", "node", "content", F.lit(False).alias("branch"))
    low = nodes.unionByName(contents).groupBy(F.col("host").alias("low_host")).agg(F.collect_list(F.struct("node", "content", "branch")).alias("low"))
    low = cut(low, "style")
    size = low.agg(F.count("*"), F.sum(F.size("low"))).first()
    low = maybe_broadcast(low, (size[0] or 0) * 64 + (size[1] or 0) * 32, 1)
    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.join(low, F.col("host") == F.col("low_host"), "left").select("page_id", "url", "html", "low"), _texts, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
