"""Main text of web pages by site template removal.

The markup of a page is read into blocks of text, each with the chain of elements around it.
Elements that never hold the article (menus, headers and footers of the page, forms, scripts and
the like, by element, role or class name) are left out; a form or a class name drops nothing that
wraps the article or most of the page's prose. What remains of a site's template is
found by counting: every element subtree is hashed with its text, and Spark counts for each host
on how many different pages a hash occurs. Subtrees recurring on many pages are deleted. Prose
inside <article> or <main> may be copied or quoted by other pages: a whole paragraph, heading, list,
quote or table there goes only if it is in most of the host's different articles; words within a
paragraph, items and cells never go alone. Pages with the same whole content count once, and for
prose those with the same articles, so that copies of one article are no template.

A hash list per host is bounded: a subtree has to be on a share of the host's pages, so no list
is longer than the subtrees of a page over that share. Null markup is empty, a null or strange
url makes a host of its own, repeated rows are extracted each, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.llm.common import over_batches, written

#: A subtree is template if it is on at least MIN_PAGES different pages of the host and on this share.
MIN_PAGES = 10
SHARE = 0.05
#: The share of the host's different articles for prose inside them.
PROSE_SHARE = 0.5

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas select textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements whose open sibling ends where one of the same group starts.
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
DROPPED = frozenset("head nav aside footer button dialog menu label".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu "
                          "menubar toolbar".split())
#: Parts of class and id names (between - and _ and blanks) of what is no article.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets related recommended "
    "share sharing social cookie cookies consent notice notices newsletter subscribe subscription signup login popup "
    "modal overlay comment comments disqus replies reply pagination pager tags toolbar skip".split())
#: Names that an article's own heading may have, and those of what readers wrote.
HEADING_NAMES = frozenset("header masthead".split())
READER_NAMES = frozenset("comment comments disqus replies reply".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption tbody thead tfoot tr td th figure figcaption "
                  "b i em strong span a code q cite u s small sub sup mark abbr".split())
#: Prose that stands by itself; all other prose goes or stays with what it is part of.
WHOLE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())


@dataclass
class Node:
    tag: str
    dropped: bool
    article: bool
    #: Inside prose, or <article> or <main> itself.
    part: bool
    parts: list = field(default_factory=list)
    #: Dropped unless it wraps the article: a form, or by the names of class and id.
    names: frozenset = frozenset()


class Reader(HTMLParser):
    """Builds the tree of elements, mending missing and stray end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", False, False, False)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._end("p", stop={"table", "td", "th", "li", "article", "section", "div", "blockquote"})
        if tag in SIBLING:
            for other in SIBLING[tag]:
                self._end(other, stop={"ul", "ol", "dl", "table"})
        parent = self.open[-1]
        article = parent.article or tag in ("article", "main")
        node = Node(tag, _dropped(tag, attrs, parent.article), article,
                    parent.tag in PROSE or parent.part and parent.tag not in ("article", "main")
                    or tag in ("article", "main"), names=_names(tag, attrs, parent.article))
        parent.parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "math"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].parts.append(Node("br", False, False, True))
        else:
            self._end(tag, stop=set() if tag in BLOCK else BLOCK)

    def _end(self, tag: str, stop: set[str] | frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _dropped(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in DROPPED_ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _names(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> frozenset:
    if tag in ("html", "body", "article", "main"):
        return frozenset()
    words = {w for name, value in attrs if name in ("class", "id")
             for w in (value or "").lower().replace("-", " ").replace("_", " ").split()}
    return frozenset(words & DROPPED_NAMES - (HEADING_NAMES if in_article else frozenset()) | {tag} & {"form"})


def read(html: str | None) -> Node:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    _settle(reader.root)
    return reader.root


def _settle(root: Node) -> None:
    """Drops elements by name unless they wrap the article, and all inside dropped ones.

    An element wraps the article if in it is <main>, an <article> at least half as long as the
    page's longest, or prose that is most of the page's text (of readers' comments: never).
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if not node.dropped:
            stack.extend(x for x in node.parts if isinstance(x, Node))
    text: dict[int, int] = {}
    prose: dict[int, int] = {}
    longest: dict[int, float] = {}
    for node in reversed(order):
        i = id(node)
        text[i] = prose[i] = 0
        longest[i] = -1
        if node.dropped:
            continue
        for x in node.parts:
            if isinstance(x, str):
                text[i] += len("".join(x.split()))
            else:
                text[i] += text[id(x)]
                prose[i] += prose[id(x)]
                longest[i] = max(longest[i], longest[id(x)])
        if node.tag in WHOLE - {"ul", "ol"}:
            prose[i] = text[i]
        if node.tag == "main":
            longest[i] = float("inf")
        elif node.tag == "article":
            longest[i] = max(longest[i], text[i])
    most, half = longest[id(root)], text[id(root)] / 2
    for node in order:
        i = id(node)
        if node.names and not (longest[i] >= 0 and longest[i] >= most / 2
                               or prose[i] > half and not node.names & READER_NAMES):
            node.dropped = True
    stack = [root]
    while stack:
        node = stack.pop()
        for x in node.parts:
            if isinstance(x, Node):
                x.dropped = x.dropped or node.dropped
                stack.append(x)


def _hash(tag: str, content: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tag}\0{content}".encode("utf-8", "replace"), digest_size=8).digest(),
                          "little", signed=True)


def subtrees(root: Node) -> tuple[dict[int, int], int]:
    """Hashes of all kept element subtrees with text, by identity of node, and that of the page."""
    hashes: dict[int, int] = {}
    # Children before parents, without recursion: pages may nest deeply.
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.parts if isinstance(x, Node) and not x.dropped)
    for node in reversed(order):
        bits = []
        for x in node.parts:
            if isinstance(x, str):
                bits.append(" ".join(x.split()))
            elif not x.dropped:
                if id(x) in hashes:
                    bits.append(str(hashes[id(x)]))
        bits = [b for b in bits if b]
        if bits:
            hashes[id(node)] = _hash(node.tag, "\1".join(bits))
    return hashes, hashes.get(id(root), 0)


def _key(node: Node, hashes: dict[int, int]) -> int | None:
    """What the node is counted by; none if it never goes by count."""
    h = hashes.get(id(node))
    if h is None or node.tag in ("", "html", "body", "article", "main"):
        return None
    if not (node.article and node.tag in PROSE):
        return h
    return _hash("prose", str(h)) if node.tag in WHOLE and not node.part else None


def blocks(root: Node, template: set[int], hashes: dict[int, int]) -> list[str]:
    """The kept blocks of text in page order."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [None, *reversed(_tops(root))]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.dropped or template and _key(x, hashes) in template:
            if x.tag in BLOCK:
                flush()
        elif x.tag in ("br", "wbr"):
            now.append(" " if x.tag == "br" else "")
        else:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    return out


def _tops(root: Node) -> list[Node]:
    """The outermost kept <main> elements if every kept <article> is in one, else the root."""
    mains, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.dropped:
            continue
        if node.tag == "main":
            mains.append(node)
            continue
        if node.tag == "article":
            return [root]
        stack.extend(reversed([x for x in node.parts if isinstance(x, Node)]))
    return mains or [root]


def host() -> F.Column:
    """The url's host in lower case without port and user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")),
                                    r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE,
              prose_share: float = PROSE_SHARE) -> DataFrame:
    """host, hashes: the subtrees that recur on many different pages of each host.

    Only subtrees that extraction would delete are counted. Prose of articles has a row of its own
    a page, by which the same articles on different pages count once.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, prose, whole, found = [], [], [], []
        for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            root = read(html)
            hashes, page = subtrees(root)
            kinds: tuple[set, set] = (set(), set())
            articles, stack = [], [root]
            while stack:
                node = stack.pop()
                key = _key(node, hashes)
                if key is not None:
                    kinds[node.article and node.tag in PROSE].add(key)
                elif node.tag in ("article", "main") and id(node) in hashes:
                    articles.append(hashes[id(node)])
                stack.extend(x for x in node.parts if isinstance(x, Node) and not x.dropped)
            rows = [(False, page, kinds[0])]
            if articles:
                rows.append((True, _hash("", "\1".join(map(str, sorted(articles)))), kinds[1]))
            for inside, content, keys in rows:
                hosts.append(name)
                prose.append(inside)
                whole.append(content)
                found.append(sorted(keys))
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(prose, pa.bool_()), pa.array(whole, pa.int64()),
             pa.array(found, pa.list_(pa.int64()))], ["host", "prose", "page", "found"])

    seen = over_batches(pages.select(host().alias("host"), "html"), run,
                        "host string, prose boolean, page bigint, found array<bigint>").dropDuplicates(
        ["host", "prose", "page"])
    counts = seen.select("host", "prose", F.explode(F.array_append("found", F.lit(None).cast("long"))).alias("h")).groupBy(
        "host", "prose", "h").agg(F.count("*").alias("n"))
    # The null row of a host counts its pages.
    total = counts.where("h IS NULL").select("host", "prose", F.col("n").alias("pages"))
    often = counts.where(F.col("h").isNotNull() & (F.col("n") >= min_pages)).join(total, ["host", "prose"]).where(
        F.col("n") >= F.when(F.col("prose"), prose_share).otherwise(share) * F.col("pages"))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("h")).alias("hashes"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text for every page."""
    known = written(templates(pages, min_pages, share), "html-templates")
    frame = pages.select("page_id", "url", "html", host().alias("host")).join(known, "host", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for html, template in zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            root = read(html)
            hashes = subtrees(root)[0] if template else {}
            texts.append("\n\n".join(blocks(root, set(template or ()), hashes)))
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return over_batches(frame.select("page_id", "url", "html", "hashes"), run,
                        f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
