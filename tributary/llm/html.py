"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: a node is an element path (tags
with class and id), and it keeps the ways it is presented (sequences of child
elements) and its content features (the clauses of its own text, its link or
image address) with how often each page has them. A feature that one page has
alone has entropy 0, and one that all pages have alike has entropy 1, to the
base of the number of pages with the node. A node's content importance is 1
less the mean entropy of its features' occurrences; its presentation importance
is the entropy of its presentations; the two are weighted by its number of
presentations, and both are drawn to 1 by PRIOR_PAGES pages, so that few pages
prove little. A node is low if importance and content importance are below LOW.
Branches of which all elements are low are noise of the site and are removed
from each page; contents that differ keep an element, whatever its
presentations.

Elements that declare what they are (nav, footer, aside, form, script, a class
naming an advert, a notice or comments, ...) are noise from the start, and
those that declare the article are kept, as is all in it that does not declare
noise. A class or id declares noise if one of its names has a word for it and
none that says something else, so `related-posts` does and `related-work` does
not; in an article fewer words do.

Only hashes of paths, presentations and features are shuffled, counted map-side
first; the pages of a large host are counted by all tasks. What comes back to
each page is the list of its host's low paths.

Defined cases: null or empty html gives empty text; a null address belongs to
the host "" like all addresses without one; equal pages of a host weigh as one
page in its tree; an h1 outside the article is its heading if it has none; an
unclosed or cut off tag is markup, and any depth of nesting is read; a page
whose blocks are all noise has empty text; repeated rows each get their row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, bound_batches, materialize

#: Importance below which a node is low, weight of the content of one presentation, pages that draw importance to 1.
LOW, GAMMA, PRIOR_PAGES = 0.2, 0.9, 2.0

# Element names of the HTML standard, by what they mean here.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe svg math canvas button select textarea object embed audio video dialog menu head title menuitem applet map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PAGE_TAGS = frozenset("html body article main".split())
ARTICLE_TAGS = frozenset("article main".split())
# Words in class and id that name noise anywhere, and those that do so outside articles only.
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot colophon masthead topbar toolbar pagination pager
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login
    comment comments reply replies respond disqus share sharing social related recommended recommendations widget widgets searchbox""".split()
)
OUTER_WORDS = frozenset("discussion search copyright disclaimer legal skip".split())
HEADER_WORDS = frozenset("header head topheader siteheader".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
# Words that say where something is or what shape it has, not what it is.
PLACE_WORDS = frozenset(
    """site main top bottom left right primary secondary page global sub mini box block area section list container wrapper wrap inner outer
    item items link links bar slot unit panel pane group row col column region zone module button buttons fixed sticky mobile desktop strip
    rail recent small large the my id div form message msg article articles post posts content body text entry blog story news user reader
    thread count to in on us js""".split()
)
KNOWN_WORDS = NOISE_WORDS | OUTER_WORDS | HEADER_WORDS | PLACE_WORDS
#: An opening tag of the key closes an open element of these.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which an implied end is not looked for.
SCOPE = frozenset("html body article main section div ul ol dl table aside nav footer header form td th".split())

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What separates clauses, the features of texts.
CLAUSE_ENDS = ".!?;:,|·•"
#: The end of an element whose content is not markup, in any case of letters.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in RAW}


def named(names: str, words: frozenset[str]) -> bool:
    """Whether one of the names has any of these words, and no word that is not known."""
    for name in names.split():
        found = {w.lower() for w in WORDS.findall(name)}
        if found & words and found <= KNOWN_WORDS:
            return True
    return False


@lru_cache(maxsize=4096)
def element(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool, str]:
    """Of an opening tag: its name in paths; whether it declares noise anywhere, noise outside articles, a header, or
    comments; and the address it links to or shows."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    comments = named(names, COMMENT_WORDS)
    page = tag in PAGE_TAGS
    noise = tag in NOISE_TAGS or role in NOISE_ROLES or hidden or comments or (not page and named(names, NOISE_WORDS))
    outer = not page and named(names, OUTER_WORDS)
    header = tag == "header" or (not page and named(names, HEADER_WORDS))
    style = tag + "".join(f".{w}" for w in sorted(found.get("class", "").split())) + (f"#{found['id']}" if found.get("id") else "")
    return style, noise, outer, header, comments, found.get("href") or found.get("src") or ""


class Node:
    """An element of a page: path is the hash of its style path; parts are its texts and elements in page order."""

    __slots__ = ("tag", "style", "path", "noise", "parts", "inside", "address", "low", "holds")

    def __init__(self, tag: str, style: str, path: int, noise: bool, inside: bool, address: str):
        self.tag, self.style, self.path, self.noise, self.inside, self.address = tag, style, path, noise, inside, address
        self.parts: list[Node | str] = []
        self.low = self.holds = False


def signed64(text: str) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(text)
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=65536)
def under(path: int, style: str) -> int:
    """Hash of the path one step down, as a signed 64-bit number."""
    return signed64(f"{path}/{style}")


class Open:
    """The open elements, with the places of each tag and of those that bound implied ends: every step is O(1), or
    pays for what it closes."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        """The innermost place of a tag, 0 if it is not open."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def close(self, place: int) -> None:
        while len(self.stack) > place > 0:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()


def tree(text: str) -> list[Node]:
    """The elements of a page in the order of their beginnings, the root first; tolerant of unclosed tags."""
    root = Node("#root", "#root", 0, False, False, "")
    nodes, open_ = [root], Open(root)
    at, n = 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if not m:
            open_.stack[-1].parts.append(entities.unescape(text[at:]))
            break
        if m.start() > at:
            open_.stack[-1].parts.append(entities.unescape(text[at : m.start()]))
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            place = open_.last(tag)
            if place and not (tag in INLINE and open_.scopes[-1] > place):
                open_.close(place)
            continue
        if tag not in INLINE and tag not in VOID and tag not in RAW:
            bound = open_.scopes[-1]
            place = max((open_.last(t) for t in IMPLIED.get(tag, ())), default=0)
            for p in (place, open_.last("p")):
                if p and p >= bound:
                    open_.close(p)
                    break
        if tag in ARTICLE_TAGS:  # a menu or header left open
            places = [open_.at[t][0] for t in ("nav", "header") if open_.at.get(t)]
            if places:
                open_.close(min(places))
        style, noise, outer, header, comments, address = element(tag, attributes.rstrip("/").strip() if tag in VOID else attributes.strip())
        up = open_.stack[-1]
        node = Node(tag, style, under(up.path, style), noise or ((outer or header) and not up.inside), (up.inside or tag in ARTICLE_TAGS) and not comments, address)
        up.parts.append(node)
        nodes.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(text, at)
            at = n if not end else text.find(">", end.end()) + 1 or n
        elif tag not in VOID:
            open_.push(node)
    return nodes


def settle(nodes: list[Node], low: frozenset[int]) -> None:
    """Set low (the element and all in it are noise) and holds (an article is in it) of all elements."""
    for node in reversed(nodes):  # what is in an element comes after it
        inner = [p for p in node.parts if isinstance(p, Node)]
        node.low = node.noise or (node.path in low and node.tag not in PAGE_TAGS and all(p.low for p in inner))
        node.holds = not node.noise and (node.tag in ARTICLE_TAGS or any(p.holds for p in inner))


def outermost(root: Node, tags: frozenset[str] | set[str]) -> list[Node]:
    """The outermost elements of these tags that are not inside noise, in page order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in tags:
            found.append(node)
        else:
            todo.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.noise)
    return found


def blocks(top: Node, keep: bool) -> list[list[str]]:
    """Texts of the blocks below an element, without noise; `keep`: it declares itself the article."""
    out: list[list[str]] = [[]]
    todo: list[Iterator[Node | str] | None] = [iter(top.parts)]
    while todo:
        parts = todo[-1]
        if parts is None:  # a block ends
            todo.pop()
            out.append([])
            continue
        for part in parts:
            if isinstance(part, str):
                out[-1].append(part)
            elif part.noise or (not keep and part.low and not part.holds):
                out.append([])
            else:
                if part.tag not in INLINE:
                    out.append([])
                    todo.append(None)
                todo.append(iter(part.parts))
                break
        else:
            todo.pop()
    return out


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The article's text: blocks joined by a space, white space inside them as one space."""
    nodes = tree(page or "")
    settle(nodes, low)
    tops = outermost(nodes[0], {"article"}) or outermost(nodes[0], {"main"})
    if tops and not any(outermost(t, {"h1"}) for t in tops):
        tops = [t for t in outermost(nodes[0], {"h1", tops[0].tag}) if t.tag != "h1" or not t.low]
    out: list[str] = []
    for top in tops or nodes[:1]:
        for b in blocks(top, bool(tops)):
            if words := "".join(b).split():
                out.append(" ".join(words))
    return " ".join(out)


def clauses(text: str) -> list[str]:
    """The clauses of a text, white space as one space."""
    text = " ".join(text.split())
    for c in CLAUSE_ENDS:
        if c in text:
            text = text.replace(c, "\n")
    return [c for x in text.split("\n") if (c := x.strip())]


def features(page: str | None) -> dict[tuple[int, int, int], int]:
    """{(path, kind, value): count} of a page, numbers unsigned: of every path, its presentation (kind 0, once) and its
    features (kind 1); elements of one path are one node."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    shapes: dict[int, list[str]] = {}
    out: dict[tuple[int, int, int], int] = {}
    for node in tree(page or "")[1:]:
        path = node.path
        styles: dict[str, None] = {}  # repeated children count once: a list of three or of four items is presented alike
        own = [f"@{node.address}"] if node.address else []
        for p in node.parts:
            if isinstance(p, str):
                own += clauses(p)
            else:
                styles[p.style] = None
        if path in shapes:
            shapes[path] += styles
        else:
            shapes[path] = list(styles)
        for f in own:
            key = (path, 1, digest(f))
            out[key] = out.get(key, 0) + 1
    for path, styles in shapes.items():
        out[path, 0, digest("|".join(styles))] = 1
    return out


def style_nodes(page: str | None) -> list[tuple[int, int, int, int]]:
    """(path, kind, value, count) of a page's features, numbers signed."""
    return [(path, kind, value - (1 << 64) if value >> 63 else value, n) for (path, kind, value), n in features(page).items()]


FIELDS = ("path", "kind", "value", "n")
NODES = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in FIELDS]))
NODES_ARROW = pa.struct([(x, pa.int64()) for x in FIELDS])


@F.arrow_udf(NODES)
def nodes_of(pages: pa.Array) -> pa.Array:
    each = [features(p) for p in pages.to_pylist()]
    ends = np.cumsum([0, *map(len, each)])
    keys = np.array([k[2] for x in each for k in x], np.uint64).view(np.int64)
    paths = np.array([k[0] for x in each for k in x], np.int64)
    kinds = np.array([k[1] for x in each for k in x], np.int64)
    counts = np.array([n for x in each for n in x.values()], np.int64)
    rows = pa.StructArray.from_arrays([pa.array(c) for c in (paths, kinds, keys, counts)], fields=list(NODES_ARROW))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, pages, content, importance) of the style tree's nodes. pages has (url, html)."""
    own = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    copies = materialize(own.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "html-copies")
    seen = attach(own.select("host", "page", nodes_of("html").alias("nodes")), copies, ["host", "page"], "left")
    # every copy of a page weighs its part of one page
    seen = seen.select("host", (1 / F.coalesce("copies", F.lit(1))).alias("w"), F.explode("nodes").alias("n")).select("host", "w", "n.*")
    # of a feature with counts c on its pages and sum N: its entropy is log N - sum(c log c) / N
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.sum(F.col("w") * F.col("n")).alias("N"), F.sum(F.col("w") * F.col("n") * F.log("n")).alias("s"))
    shape, feature = F.col("kind") == 0, F.col("kind") == 1
    per = counts.groupBy("host", "path").agg(
        F.sum(F.when(shape, F.col("N"))).alias("pages"),
        F.count(F.when(shape, 1)).alias("presentations"),
        F.sum(F.when(shape, F.col("N") * F.log("N"))).alias("shaped"),
        F.sum(F.when(feature, F.col("N"))).alias("said"),
        F.sum(F.when(feature, F.col("N") * F.log("N") - F.col("s"))).alias("spread"),  # occurrences times entropy
    )
    base = F.when(F.col("pages") > 1.5, F.log("pages"))
    proof = F.col("pages") / (F.col("pages") + PRIOR_PAGES)
    alike = lambda entropy: F.round(1 - proof * entropy, 9)
    content = F.coalesce(alike(F.col("spread") / F.col("said") / base), F.when(F.col("said").isNull() & base.isNotNull(), alike(F.lit(1.0))), F.lit(1.0))
    presented = F.coalesce(alike(1 - (F.log("pages") - F.col("shaped") / F.col("pages")) / base), F.lit(1.0))
    weight = F.pow(F.lit(GAMMA), F.col("presentations"))
    return per.withColumns({"content": content, "presented": presented}).select("host", "path", "pages", "content", ((1 - weight) * F.col("presented") + weight * F.col("content")).alias("importance"))


def noise_paths(pages: DataFrame) -> DataFrame:
    """(host, low): the low paths of the host's style tree."""
    low = importances(pages).filter((F.col("importance") < LOW) & (F.col("content") < LOW))
    return materialize(low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")), "html-noise")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p, frozenset(low or ())) for p, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    bound_batches(pages.sparkSession)
    base = pages.select("page_id", "url", "html")
    known = attach(base.withColumn("host", host_of(F.col("url"))), noise_paths(base), ["host"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    texts = known.select("page_id", "url", "html", "low").mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
