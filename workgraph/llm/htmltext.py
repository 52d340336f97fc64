"""Main text of web pages by site template removal: element subtrees that recur on many pages of a host are deleted."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, pieces, written

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never belong to the article.
DROP = frozenset("nav aside footer form menu dialog button select option input label fieldset head".split())
#: An open element (value) that a start tag (key) closes, as far up as no element of the third kind stands between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl select body article section div main".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that, inside the article, are text even where pages share them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dl dd dt table tbody tr td th figcaption".split())
# Words of class, id, role or aria-label values. A name counts only if all its parts are among these.
STRONG = frozenset("ad ads adsbygoogle advert adverts advertisement advertisements sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription paywall menu navbar nav navigation breadcrumb breadcrumbs pagination pager sidebar related comment comments commentlist disqus replies reply respond footer complementary contentinfo popup modal".split())
#: Names that may as well be a subject: inside an article they need other pages that repeat the element.
WEAK = frozenset("notice notices alert overlay promo promos promotion promotions advertising signup login widget recommend recommended recommendations trending popular share sharing social search form skip toc tags".split())
HEADS = frozenset("header masthead topbar banner".split())
NEUTRAL = frozenset("site page main left right top bottom inner outer wrap wrapper container content box block bar area section list item items link links panel region module zone unit slot holder row col column group post posts article articles entry global primary secondary desktop mobile sticky fixed small large js blog story news web inline body text icon icons button buttons btn head to this on".split())
_PART = re.compile(r"[A-Za-z]+")
_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>|[!?][^>]*(?:>|\Z))""", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)


@lru_cache(maxsize=4096)
def name_level(mark: str) -> int:
    """What names say about an element: 3 not the article, 2 the page's head, 1 perhaps not the article, 0 nothing. Each
    name counts as a whole: one with any other part, as in popular-science, says nothing."""
    level = 0
    for name in mark.split():
        parts = {p.lower() for p in _PART.findall(name)}
        if parts and parts <= STRONG | WEAK | HEADS | NEUTRAL:
            level = max(level, 3 if parts & STRONG else 2 if parts & HEADS else 1 if parts & WEAK else 0)
    return level


class Node:
    __slots__ = ("tag", "mark", "hidden", "kids", "code", "holds", "h1", "size")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag = tag
        found = _MARK.findall(attrs) if "=" in attrs else []
        # a label is one name, however many words it has
        self.mark = " ".join("-".join(v.split()) if name.lower() == "aria-label" else v for name, *values in found for v in values if v)
        self.hidden = bool(attrs) and bool(_HIDDEN.search(attrs))
        self.kids: list = []
        self.code = 0
        self.holds = tag in ("article", "main") and name_level(self.mark) < 3  # it is, or holds, an article
        self.h1 = tag == "h1"  # it is, or holds, a title
        self.size = 0  # characters of text inside


def parse(page: str) -> Node:
    """A page as a tree: text and elements, tolerant of unclosed, stray and misnested tags."""
    root = Node("#")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].kids.append(page[at:lt])
        if lt == n:
            break
        m = _TAG.match(page, lt) or _PLAIN_TAG.match(page, lt)
        if not m:
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # an inline end tag closes nothing beyond its block
            continue
        attrs = m[3] or ""
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:  # a block ends an open paragraph, and what is inline in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    low = k
                    while stack[low - 1].tag in CLOSES[tag] and low > 1:
                        low -= 1
                    del stack[low:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def _walk(root: Node) -> list[Node]:
    """All elements, each after those inside it."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [k for k in x.kids if isinstance(k, Node)]
    return out[::-1]


def hash_subtrees(root: Node, site: str) -> None:
    """Sets each element's code: a 64-bit hash of the site, tag, marks, and the text and codes inside it."""
    for x in _walk(root):
        h = blake2b(f"{site}\0{x.tag}\0{x.mark}".encode("utf-8", "surrogatepass"), digest_size=8)
        for k in x.kids:
            h.update(k.code.to_bytes(8, "big", signed=True) if isinstance(k, Node) else " ".join(k.split()).encode("utf-8", "surrogatepass"))
            if isinstance(k, Node):
                x.holds, x.h1, x.size = x.holds or k.holds, x.h1 or k.h1, x.size + k.size
            else:
                x.size += len(k)
        x.code = int.from_bytes(h.digest(), "big", signed=True)


def subtree_codes(root: Node) -> set[int]:
    """Codes of the block elements that hold anything."""
    return {x.code for x in _walk(root) if x.tag in BLOCK and x.tag not in ("html", "body") and any(isinstance(k, Node) or k.strip() for k in x.kids)}


def _outside(x: Node, within: bool, articles: bool, again: bool) -> bool:
    """Whether an element is something other than the article, by its tag, its names, or both. What holds the article is
    not, whatever its name says. Weak names count in an article only for what other pages repeat (again); a head counts
    unless it stands in the article, or has the title of a page without an article element."""
    if x.hidden or x.tag in ("html", "body", "main"):
        return x.hidden
    if x.holds and not within:
        return False
    level = name_level(x.mark) if x.mark else 0
    if x.tag in DROP or level == 3 or (level == 1 and (again or not within)):
        return True
    return (x.tag == "header" or level == 2) and not within and not (x.h1 and not articles)


def _prune(x: Node, templates: set[int], repeats: set[int]) -> None:
    """Takes out subtrees that the host repeats over different pages, whatever they are called, and then what is marked as
    something else. Inside the article a repeated heading or paragraph is text that several pages quote, so there only
    other containers count as template."""
    todo = [(x, False)]
    while todo:
        node, within = todo.pop()
        kept = []
        for k in node.kids:
            if isinstance(k, Node):
                repeated = k.code in templates and not k.holds and not (within and k.tag in TEXTUAL)
                if repeated or _outside(k, within, x.holds, k.code in repeats):
                    kept.append(" ") if k.tag in INLINE else kept.append(Node("hr"))
                    continue
                todo.append((k, within or k.tag in ("article", "main")))
            kept.append(k)
        node.kids = kept


def _top(root: Node) -> list[Node]:
    """The article: all outermost articles in page order, else the main elements, else the page."""
    for test in (lambda y: y.tag == "article", lambda y: y.tag == "main" or "main" in y.mark.split()):
        found, todo = [], [root]
        while todo:
            y = todo.pop()
            if test(y):
                found.append(y)
            else:
                todo += [k for k in reversed(y.kids) if isinstance(k, Node)]
        if found:
            return found
    return [root]


_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)


def identity(root: Node, page: str) -> int:
    """What tells a page from another: its title and h1 texts, and its longest text. An article that is published again
    under other menus has the same one, so its own parts do not count as repeated."""
    title = _TITLE.search(page)
    longest, heads = "", []
    for x in _walk(root):
        own = " ".join(" ".join(k for k in x.kids if isinstance(k, str)).split())
        if len(own) > len(longest):
            longest = own
        if x.tag == "h1":
            heads.append(own)
    parts = [" ".join(title[1].split()) if title else "", *sorted(heads), longest]
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def blocks(x: Node) -> list[str]:
    """The texts of the blocks below x in page order, white space as one space each."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                out.append(text)
            line.clear()

    todo: list = [x]
    while todo:
        y = todo.pop()
        if y is None:
            flush()
        elif isinstance(y, str):
            line.append(y)
        elif y.tag == "br":
            line.append("\n")
        else:
            own = y.tag in BLOCK
            if own:
                flush()
                todo.append(None)
            todo += reversed(y.kids)
    flush()
    return out


def main_text(page: str | None, site: str, templates: set[int], repeats: set[int] = frozenset()) -> str:
    """A page's article without the site's repeated subtrees and what is marked as something else."""
    if not page:
        return ""
    root = parse(page)
    hash_subtrees(root, site)
    _prune(root, templates, repeats)
    return "\n\n".join(b for x in _top(root) for b in blocks(x))


def host(url: Column) -> Column:
    """The host part of a URL in lower case, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, n in pieces([batch.column(3)], 256, 4 << 20):
            part = batch.slice(start, n)
            idents, codes = [], []
            for site, page in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                root = parse(page)
                hash_subtrees(root, site)
                idents.append(identity(root, page))
                codes.append(list(subtree_codes(root)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(idents, pa.int64()), pa.array(codes, pa.list_(pa.int64()))], ["k1", "k2", "ident", "codes"])


def _keys(html_col: str, url_col: str) -> list[Column]:
    """Two hashes that name a page by its host and html."""
    return [F.xxhash64(F.lit(i), host(F.col(url_col)), F.col(html_col)) for i in (1, 2)]


def page_templates(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_pages: int = 4) -> DataFrame:
    """(k1, k2, templates, repeats): for each page, by its hashes, the codes of its subtrees that stand on min_pages
    different pages of its host or more, and of those that stand on two or more.

    Codes hold their host, and are counted over distinct identities with partial sums: a count does not depend on the
    host's size, nor on how often an article is published again. Only a page's own codes come back to it.
    """
    html = pages.filter(F.length(html_col) > 0).select(*[k.alias(f"k{i}") for i, k in enumerate(_keys(html_col, url_col), 1)], host(F.col(url_col)).alias("site"), F.col(html_col).alias("html"))
    found = written(html.mapInArrow(_codes, "k1 long, k2 long, ident long, codes array<long>"))
    counts = found.select("ident", F.explode("codes").alias("code")).distinct().groupBy("code").count().filter("count >= 2")
    counts = written(counts.select("code", (F.col("count") >= min_pages).alias("often")))
    own = found.select("k1", "k2", F.explode("codes").alias("code")).join(counts, "code")
    return written(own.groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("often"), F.col("code"))).alias("templates"), F.collect_set("code").alias("repeats")))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "text", min_pages: int = 4) -> DataFrame:
    """pages with the article's text in column out.

    A first pass counts hashed element subtrees per host (page_templates); a second deletes those that recur from each
    page, then elements whose tag or whole name marks them as navigation, notices, adverts, forms or comments, and joins
    the text of the article's blocks. Each page meets only its own codes, by two hashes of its content: Spark broadcasts
    that table where its size allows and else splits pages of which there are many copies.

    Null or empty html: ''. Null url, or one without a host: the pages without a host are a site of their own. Broken
    markup is read as far as it goes; very long pages are parsed whole, one at a time. Repeated pages get equal texts and
    count once. Ties: several outermost articles are all kept, in page order. Empty table: empty result. Other columns
    pass unchanged; one named as out is replaced, in its place.
    """
    k = fresh(pages, "_k1", "_k2", "_p1", "_p2", "_templates", "_repeats")
    known = page_templates(pages, html_col, url_col, min_pages).toDF(k[2], k[3], k[4], k[5])
    keyed = pages.withColumns(dict(zip(k, _keys(html_col, url_col), strict=False)))
    joined = keyed.join(known, (F.col(k[0]) == F.col(k[2])) & (F.col(k[1]) == F.col(k[3])), "left")

    @F.pandas_udf("string")
    def run(page, at, templates, repeats):
        import pandas as pd

        some = lambda x: frozenset() if x is None else frozenset(x.tolist())
        return pd.Series([main_text(p, a, some(t), some(r)) for p, a, t, r in zip(page, at, templates, repeats, strict=True)], dtype=object)

    return joined.withColumn(out, run(F.col(html_col), host(F.col(url_col)), F.col(k[4]), F.col(k[5]))).drop(*k)
