"""HTML extraction by wrapper induction.

Pages of a host are compared by article: pages whose long blocks (of `LONG` characters or more; all blocks where
there is none) have the same texts show one article, under however many urls, and count once. A block of text is template where it
stands at one path in more than `SHARE` of a host's articles, and in `LEAST` at least (in both, where a host has two);
blocks of all pages are counted, by 64-bit hashes of path and text. Other text varies and is content, so a page that is
mirrored with another date or view counter keeps its article.
For each host pages of up to `EXEMPLARS` articles are parsed to DOM trees and aligned by simple tree matching (siblings
with one label are one slot; of two nodes with equal paths, those child slots are aligned that stand in one order in both,
as many nodes as possible), and the deepest aligned node that holds all varying text of all
of them is the host's content slot. The wrapper of a host is that slot and its template blocks. Extraction takes the slot of each page
without template blocks and without parts whose element or class names a role other
than content: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments. (Those vary from page
to page as articles do; no alignment tells them from content. roles=False leaves all but the wrapper out.)
Only where the slot is not on the page, or its host has none, <article> and <main> decide, and without them the page is taken whole.

Slots of one label are one node, so that a child has one possible partner and the best order is a longest
increasing subsequence: a page costs n log n, at any depth, and nothing is recursive.

Exemplars are pages of the first articles in the order of their hashes. Counts are added up in each
task before they travel, and so are exemplars chosen, so that a host with a third of all pages is no load on one task.
Wrappers go to the pages by a broadcast where their measured size allows it, and by a join that adaptive
execution can split otherwise.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; a host with one
article has no template blocks, however many pages show it; what two articles of a host have in common at one path is template
if it has but two; unclosed and cut-off markup is read as
browsers do; repeated rows are extracted each for itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut, table

EXEMPLARS = 5
SHARE = 0.5  #: of a host's articles; a block in more of them is template
LEAST = 3  #: and in so many at least, or in both of two
LONG = 64  #: characters of a block that tells articles apart
BROADCAST_BYTES = 16 << 20

#: Fixed lists: elements without content or end tag, elements whose content is no markup, blocks, and what starting a block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("html body table ul ol dl article main section div aside nav header footer form blockquote select".split())
#: Elements and class words that name another role than content.
OUTSIDE = frozenset("head nav header footer aside form button select dialog menu svg canvas object audio video".split()) | RAW
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies respond reactions share sharing social related recommended "
    "widget toolbar pagination pager login signup signin search copyright disclaimer skip side rail crumbs responses discussion feedback adsbygoogle adslot".split()
)
LAYOUT = frozenset("with has no without".split())
ARIA = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|/?[a-zA-Z][^>]*(>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Page:
    """A parsed page: nodes (parent, tag, label, outside) and, in page order, texts (node, text) and breaks (node, None)."""

    __slots__ = ("events", "nodes", "_open", "_roles")

    def __init__(self, source: str, roles: bool = True):
        self.nodes: list[tuple[int, str, str, bool]] = [(-1, "", "", False)]
        self.events: list[tuple[int, str | None]] = []
        self._open: Counter = Counter()  # open elements by tag, so that a search of the stack is made only for what is there
        self._roles = roles
        self._parse(source)

    def _parse(self, source: str) -> None:
        nodes, events = self.nodes, self.events
        stack: list[int] = [0]
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                events.append((stack[-1], source[at:]))
                break
            if m.start() > at:
                events.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[2]
            if name is None:
                continue
            tag = name.lower()
            if m[1]:
                for depth in range(len(stack) - 1, 0, -1) if self._open[tag] else ():
                    if nodes[stack[depth]][1] == tag:
                        self._drop(stack, depth)
                        break
                if tag not in INLINE:
                    events.append((stack[-1], None))
                continue
            if tag in CLOSES_P:
                self._close(stack, {"p"})
            elif tag in SAME:
                self._close(stack, SAME[tag])
            elif tag == "body":
                self._close(stack, {"head"}, over=True)
            if tag == "br":  # parts words, not blocks
                events.append((stack[-1], " "))
                continue
            if tag not in INLINE:
                events.append((stack[-1], None))
            if tag in VOID:
                continue
            outside, label = self._role(tag, m[3])
            nodes.append((stack[-1], tag, label, outside))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                continue
            stack.append(len(nodes) - 1)
            self._open[tag] += 1

    def _drop(self, stack: list[int], depth: int) -> None:
        self._open.subtract(self.nodes[i][1] for i in stack[depth:])
        del stack[depth:]

    def _close(self, stack: list[int], tags: set, over: bool = False) -> None:
        if not any(self._open[tag] for tag in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.nodes[stack[depth]][1]
            if tag in tags:
                self._drop(stack, depth)
                return
            if tag in SCOPE and not over:
                return

    def _role(self, tag: str, attrs: str) -> tuple[bool, str]:
        if tag in RAW or tag == "head" or (self._roles and tag in OUTSIDE):
            return True, tag
        if not attrs or "=" not in attrs and "hidden" not in attrs:
            return False, tag
        words: list[str] = []
        out, label = False, tag
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for one in value.split():
                    own = [x.lower() for x in _PART.split(one)]
                    # "with-sidebar", "no-ads" and the like describe a layout, not a role.
                    words += [] if LAYOUT.intersection(own) else own
                label += ("." if key == "class" else "#") + re.sub(r"\d+", "0", value)
            elif key == "role":
                out |= self._roles and value.lower() in ARIA
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                out = True
            elif key == "style":
                out |= "display:none" in value.replace(" ", "").lower()
        if tag not in ("html", "body", "article", "main") or "comment" in words:
            out |= self._roles and not ROLE_WORDS.isdisjoint(words)
        return out, label

    def outside(self) -> list[bool]:
        flags: list[bool] = []
        for parent, _, _, out in self.nodes:
            flags.append(out or (parent >= 0 and flags[parent]))
        return flags

    def paths(self) -> list[int]:
        """A hash of the labels from the root down to each node; inline elements have their parent's, as in `tree`."""
        found: list[int] = []
        known: dict[tuple[int, str], int] = {}
        for parent, tag, label, _ in self.nodes:
            if parent < 0:
                found.append(key(0, ""))
            elif tag in INLINE:
                found.append(found[parent])
            else:
                at = (found[parent], label)
                if at not in known:
                    known[at] = key(*at)
                found.append(known[at])
        return found

    def block_of(self) -> list[int]:
        """Each node's nearest ancestor (or self) that is no inline element."""
        found: list[int] = []
        for i, (parent, tag, _, _) in enumerate(self.nodes):
            found.append(found[parent] if tag in INLINE and parent >= 0 else i)
        return found

    def blocks(self, use: list[bool], block_of: list[int]) -> Iterator[tuple[int, str]]:
        """(node, text) of the blocks whose texts are in nodes to use, in page order."""
        held: list[str] = []
        at = 0
        for node, text in self.events:
            if text is None:
                if held:
                    if whole := _clean("".join(held)):
                        yield at, whole
                    held = []
            elif use[node]:
                if not held:
                    at = block_of[node]
                held.append(text)
        if held and (whole := _clean("".join(held))):
            yield at, whole


def _clean(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


# Alignment --------------------------------------------------------------------------------------


def key(path: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Tree:
    """A page's slots by path, without the parts that are outside: children in the order of their first appearance, and parents."""

    __slots__ = ("blocks", "children", "parent")

    def __init__(self, page: Page):
        out, paths, block_of = page.outside(), page.paths(), page.block_of()
        self.children: dict[int, list[int]] = {paths[0]: []}
        self.parent: dict[int, tuple[int | None, str]] = {paths[0]: (None, "")}
        for i, (parent, _, label, _) in enumerate(page.nodes):
            if i and not out[i] and block_of[i] == i and paths[i] not in self.children:
                self.children[paths[i]] = []
                self.children[paths[parent]].append(paths[i])
                self.parent[paths[i]] = (paths[parent], label)
        self.blocks = [(paths[node], text) for node, text in page.blocks([not x for x in out], block_of)]


def ordered(places: list[int], weights: list[int]) -> tuple[int, list[int]]:
    """The heaviest increasing subsequence of different places: (weight, indexes)."""
    if all(x < y for x, y in zip(places, places[1:], strict=False)):
        return sum(weights), list(range(len(places)))
    # Ends of subsequences, by place, of growing weight: no later end is as light as an earlier one.
    ends: list[int] = []
    best: list[tuple[int, int]] = []
    before: list[int] = []
    for i, (place, weight) in enumerate(zip(places, weights, strict=True)):
        at = bisect_left(ends, place)
        total, last = best[at - 1] if at else (0, -1)
        total += weight
        before.append(last)
        to = at
        while to < len(ends) and best[to][0] <= total:
            to += 1
        ends[at:to], best[at:to] = [place], [(total, i)]
    total, i = best[-1]
    kept = []
    while i >= 0:
        kept.append(i)
        i = before[i]
    return total, kept[::-1]


def match(a: Tree, b: Tree) -> tuple[int, set[int]]:
    """Simple tree matching: (size of the best match, paths that are aligned)."""
    size: dict[int, int] = {}
    kept: dict[int, list[int]] = {}
    for path in reversed(a.children):  # children come after their parents
        if path in b.children:
            place = {x: i for i, x in enumerate(b.children[path])}
            both = [x for x in a.children[path] if x in place]
            total, chosen = ordered([place[x] for x in both], [size[x] for x in both]) if both else (0, [])
            size[path], kept[path] = 1 + total, [both[i] for i in chosen]
    root = next(iter(a.children))
    aligned, stack = set(), [root]
    while stack:
        path = stack.pop()
        aligned.add(path)
        stack += kept[path]
    return size[root], aligned


def block_keys(source: str) -> tuple[int, list[int]]:
    """(which article a page shows, keys of its different blocks that are not outside)."""
    page = Page(source)
    paths = page.paths()
    blocks = set(page.blocks([not x for x in page.outside()], page.block_of()))
    long = {text for _, text in blocks if len(text) >= LONG} or {text for _, text in blocks}
    return key(0, "\0".join(sorted(long))), list({key(paths[node], text) for node, text in blocks})


def induce(pages: list[str], known: set[int] | None = None, roles: bool = True) -> dict:
    """The wrapper of pages of one host: `known` (keys of template blocks), `slot` (path of the content slot) and `at` (its hash).

    known: keys of the template blocks of all the host's pages; without them, what is alike at one path in all the given pages.
    """
    trees: list[Tree] = []
    for source in pages:
        t = Tree(Page(source, roles))
        if all(t.parent.keys() != x.parent.keys() or t.blocks != x.blocks for x in trees):
            trees.append(t)
    if len(trees) < 2:
        return {"known": sorted(known)} if known else {}
    first, *others = trees
    aligned = set.intersection(*(match(first, x)[1] for x in others))
    if known is None:
        known = {key(*x) for x in set(first.blocks).intersection(*(x.blocks for x in others)) if x[0] in aligned}
    found: dict = {"known": sorted(known)}
    parent = {path: x for t in trees for path, x in t.parent.items()}
    varying = {path for t in trees for path, text in t.blocks if key(path, text) not in known}
    if varying:
        slot, path = [], varying.pop()
        while path is not None:
            slot.append(path)
            path = parent[path][0]
        slot.reverse()
        meets = {x: i for i, x in enumerate(slot)}  # how far down the way to the slot a path goes along
        for path in varying:
            climbed = []
            while path not in meets:
                climbed.append(path)
                path = parent[path][0]
            meets.update(dict.fromkeys(climbed, meets[path]))
            slot = slot[: meets[path] + 1]
        labels = [parent[x][1] for x in slot]
        n = len(slot)
        while n > 1 and (slot[n - 1] not in aligned or re.split("[.#]", labels[n - 1])[0] not in SCOPE):
            n -= 1
        found |= {"slot": "/".join(labels[:n]), "at": slot[n - 1]}
    return found


# Extraction -------------------------------------------------------------------------------------


def extract(source: str, wrapper: dict, roles: bool = True) -> str:
    if not source:
        return ""
    page = Page(source, roles)
    out, paths = page.outside(), page.paths()
    slot = wrapper.get("at")
    roots = [i for i, p in enumerate(paths) if p == slot and not out[i]]
    if not roots:
        roots = [i for i, (_, tag, _, _) in enumerate(page.nodes) if tag in ("article", "main") and not out[i]]
    inside = [False] * len(page.nodes)
    for i in roots or [0]:
        inside[i] = True
    for i, (parent, _, _, _) in enumerate(page.nodes):
        if parent >= 0 and inside[parent]:
            inside[i] = True
    known = wrapper.get("known", ())
    blocks = page.blocks([x and not y for x, y in zip(inside, out, strict=True)], page.block_of())
    return " ".join(text for node, text in blocks if not known or key(paths[node], text) not in known)


def host() -> F.Column:
    return F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def small(df: DataFrame, bytes_a_row: F.Column) -> DataFrame:
    """df, broadcast if its measured size allows it."""
    return F.broadcast(df) if (df.agg(F.sum(bytes_a_row).alias("n")).first().n or 0) <= BROADCAST_BYTES else df


def page_blocks(pages: DataFrame) -> DataFrame:
    """host, page (hash), article (hash), blocks (keys) of each page that is not empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [block_keys(x) for x in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "page": batch["page"], "article": [x for x, _ in read], "blocks": [y for _, y in read]})

    filled = pages.select(host().alias("host"), F.xxhash64("html").alias("page"), "html").filter(F.col("html").rlike(r"\S"))
    return filled.mapInPandas(run, "host string, page bigint, article bigint, blocks array<bigint>")


def wrappers(pages: DataFrame, exemplars: int = EXEMPLARS) -> DataFrame:
    """host, wrapper (JSON)."""
    seen = cut(page_blocks(pages), "blocks")
    shown = seen.groupBy("host", "article").agg(F.min("page").alias("page"))
    n_articles = shown.groupBy("host").agg(F.count("*").alias("n_articles"))
    counted = seen.select("host", "article", F.explode("blocks").alias("block")).distinct().groupBy("host", "block").agg(F.count("*").alias("n")).filter("n > 1")
    template = (F.col("n") > F.col("n_articles") * SHARE) & (F.col("n") >= F.least(F.lit(LEAST), F.col("n_articles")))
    known = counted.join(n_articles, "host").filter(template).groupBy("host").agg(F.collect_list("block").alias("known"))
    # Ranks within a host are limited in each task before they travel.
    first = Window.partitionBy("host").orderBy("article")
    chosen = cut(shown.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= exemplars).drop("rank").join(known, "host", "left"), "exemplars")
    picked = small(chosen.select("host", "page"), F.octet_length("host") + 32)
    sources = pages.select(host().alias("host"), F.xxhash64("html").alias("page"), "html").join(picked, ["host", "page"]).groupBy("host", "page").agg(F.min("html").alias("html"))

    def run(by: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # At most `exemplars` pages.
        ordered, blocks = group.sort_values("article"), group["known"].iloc[0]
        found = induce(ordered["html"].tolist(), set() if blocks is None else set(map(int, blocks)))
        return pd.DataFrame({"host": [by[0]], "wrapper": [json.dumps(found)]})

    return sources.join(chosen, ["host", "page"]).groupBy("host").applyInPandas(run, "host string, wrapper string")


def extract_pages(pages: DataFrame, exemplars: int = EXEMPLARS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = cut(wrappers(pages, exemplars), "wrappers")
    joined = pages.select("page_id", "url", "html", host().alias("host")).join(small(found, F.octet_length("wrapper") + 64), "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for source, wrapper in zip(batch["html"], batch["wrapper"], strict=True):
                if len(read) > 5000:
                    read.clear()
                if isinstance(wrapper, str) and wrapper not in read:
                    read[wrapper] = json.loads(wrapper)
                    read[wrapper]["known"] = set(read[wrapper].get("known", ()))
                texts.append(extract(source if isinstance(source, str) else "", read.get(wrapper, {})))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    return joined.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
