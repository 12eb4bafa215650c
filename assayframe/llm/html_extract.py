"""Main text of web pages by wrapper induction.

(1) Every distinct page is parsed into blocks of text, each in a slot: its path of tags and classes, in which runs of
equal siblings are one. The tree of its slots is the page's layout. (2) For each host, every layout, however rare or
large, is aligned with the fullest by simple tree matching of tags, so slots that are matched count as one although classes on
their paths differ; slots that both have stand for themselves, and where layouts differ, the most frequent one's match counts. (3) Over all distinct pages of the host, the texts of each slot are counted. A text
that comes on ``LEAST`` pages or more, and on ``SHARE`` of the pages that have the slot, is constant and belongs to the
host's template; what varies is content. (4) Every page is read with its host's wrapper: a block is dropped if its text is
the template's in its slot.

Layouts are aligned one by one, so a host's layouts are many tasks' work, and each page gets only those entries of the template
that it has, so a host's template may be of any size. Matching takes time in proportion to the product of two layouts' sizes at
worst, which is in the nature of the task, and a few rows of its table in memory; equal parts of two layouts take none.

Wrappers alone would keep menus and adverts that vary by page, so of what they leave, elements that are furniture by
tag, role or class are dropped as well: outside articles by any part of a class or id, inside them only by names of adverts and comments; an element of an
article that is called like other furniture (related, notice, promo-guide) goes only if half of its text or more is links. Articles (``article``, ``main``, or such a role) are the content where they hold at least half of the text
that varies; else they are teasers and all of it counts. Paragraphs and headings of such an article stay even if they
are constant: the same passage may be real text of many pages. Character references are decoded, white space inside a
block becomes one space, blocks are trimmed and joined by an empty line.

Parsing takes time in proportion to a page's length, and no recursion.

Defined cases: a null or empty html gives an empty text; unclosed elements end with their parent, a cut-off tag at the end
is dropped; a quote delimits only where an attribute's value begins, and one that never closes ends with its tag; markup in comments, scripts and styles is never text; a null
or odd url gives a host of its own kind (empty); equal pages of a host count once for its wrapper; repeated rows give
repeated results; an empty table gives no row; extra columns are kept by ``extract_text`` if asked for, and one that is
called ``text`` or ``n_chars`` comes back as ``kept_`` and its name.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm._shared import bounded_batches, give_back, written

LEAST, SHARE = 4, 0.2
#: wrappers, and hosts' fullest layouts, are broadcast up to this many bytes, and joined otherwise
BROADCAST_BYTES = 16 << 20

#: elements whose content has no tags, and is never main text
_RAW = ("script", "style", "textarea", "title", "iframe")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
_RAW_START = re.compile(rf"<({'|'.join(_RAW)})(?=[\s/>])", re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
# the parts of a tag: what stands between attributes, a name (which may begin with an equals sign), the sign before a value, a value without quotes
_GAP, _ATTRIBUTE, _EQUALS, _BARE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_MARKED = frozenset(("class", "id", "role"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SPACES = frozenset("br td th img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption".split())
_ENDED_BY_BLOCK = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
_FURNITURE_TAGS = frozenset("nav footer aside form script style noscript template head title button select option textarea iframe object svg canvas menu dialog".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer foot comment comments commentlist disqus reply replies respond discussion share sharing social related recommended newsletter subscribe signup login popup modal overlay toolbar pagination pager widget widgets skip".split()
)
#: inside an article these parts of a name drop an element whatever is in it, and these whole names; others only where it is mostly links
_DROPPED_PARTS = frozenset("ad ads advert adverts advertisement advertisements sponsored comments commentlist disqus".split())
_DROPPED_NAMES = _DROPPED_PARTS | frozenset("comment sponsor cookie cookies newsletter breadcrumb breadcrumbs pagination pager".split())
_ARTICLE_ROLES = frozenset(("main", "article"))
_HEADERS = frozenset("header masthead".split())


def _tag_end(page: str, at: int, gone: set[str], found: list[tuple[str, str]] | None = None) -> int:
    """The place behind the ``>`` that ends the tag whose attributes begin at ``at``, or -1. A quote delimits only where a value begins.

    ``gone`` holds quotes that do not occur any more, so that looking for them takes time once a page; a value that such a quote begins ends at the next bracket.
    ``found`` gets (name, value) of each attribute.
    """
    n = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n:
            return -1
        if page[at] == ">":
            return at + 1
        name = _ATTRIBUTE.match(page, at)
        at, value = name.end(), ""
        sign = _EQUALS.match(page, at)
        if sign:
            at = sign.end()
            quote = page[at : at + 1]
            if quote in ('"', "'"):
                close = -1 if quote in gone else page.find(quote, at + 1)
                if close < 0:
                    gone.add(quote)
                    close = page.find(">", at)
                    return close + 1 if close >= 0 else -1
                value, at = page[at + 1 : close], close + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        if found is not None:
            found.append((name[0].lower(), value))


def _label(tag: str, raw: str) -> tuple[str, frozenset[str]]:
    """An element's name in paths (tag and classes), and the words of its class, id and role."""
    if "=" not in raw:
        return tag, frozenset()
    found: list[tuple[str, str]] = []
    _tag_end(raw, _NAME.match(raw).end(), set(), found)
    marks = " ".join(v for k, v in {k: v for k, v in reversed(found)}.items() if k in _MARKED)  # the first of a name counts
    if not marks.strip():
        return tag, frozenset()
    words = frozenset(marks.lower().split())
    return f"{tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '', w) for w in words))}", words


def _is_furniture(tag: str, words: frozenset[str], in_article: bool) -> bool | None:
    """Whether an element is no content by its tag and names; None if that depends on what is in it: a name that an article's own parts may have."""
    if tag in _FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if not words or tag in ("html", "body"):
        return False
    if words & _FURNITURE_ROLES:
        return True
    parts = words | {x for w in words for x in re.split(r"[-_]+", w)}
    if not in_article:
        return bool(parts & _FURNITURE_WORDS or parts & _HEADERS)
    if parts & _DROPPED_PARTS or words & _DROPPED_NAMES:
        return True
    return None if parts & _FURNITURE_WORDS else False


def _parts(page: str) -> Iterator[tuple[bool, str]]:
    """(is markup, text) in order: tags, and comments, declarations, scripts and styles as a whole. A cut-off tag at the end is left out."""
    at, n, gone = 0, len(page), set()
    while at < n:
        start = page.find("<", at)
        while 0 <= start < n - 1 and not (page[start + 1] in "!?/" or page[start + 1].isalpha() and page[start + 1].isascii()):
            start = page.find("<", start + 1)
        if start < 0 or start == n - 1:
            yield False, page[at:] if start < 0 else page[at:n]
            return
        if start > at:
            yield False, page[at:start]
        if page.startswith("<!--", start):
            if page.startswith((">", "->"), start + 4):
                end = page.find(">", start + 4) + 1
            else:
                end = page.find("-->", start + 4) + 3
                if end < 3:
                    return
        elif raw := _RAW_START.match(page, start):
            close = _RAW_END[raw[1].lower()].search(page, raw.end())
            if close is None:
                return
            end = close.end()
        elif name := _NAME.match(page, start):
            end = _tag_end(page, name.end(), gone)
        else:
            end = page.find(">", start + 2) + 1 or -1
        if end < 0:
            return
        yield True, page[start:end]
        at = end


class Node:
    """A slot of a page's layout; equal siblings in a row are one node."""

    __slots__ = ("label", "key", "children", "held")

    def __init__(self, label: str, key: bytes):
        self.label, self.key, self.children, self.held = label, key, [], False

    def child(self, label: str) -> Node:
        if not self.children or self.children[-1].label != label:
            self.children.append(Node(label, blake2b(self.key + label.encode("utf-8", "replace"), digest_size=8).digest()))
        return self.children[-1]


class Doubt:
    """An element of an article whose name furniture has as well: its characters, and those of them in links."""

    __slots__ = ("outer", "chars", "links", "furniture")

    def __init__(self, outer: Doubt | None):
        self.outer, self.chars, self.links, self.furniture = outer, 0, 0, False


class Block:
    __slots__ = ("node", "tag", "article", "dropped", "text", "doubt")

    def __init__(self, node: Node, tag: str, article: bool, dropped: bool, text: str, doubt: Doubt | None):
        self.node, self.tag, self.article, self.dropped, self.text, self.doubt = node, tag, article, dropped, text, doubt

    @property
    def slot(self) -> int:
        return int.from_bytes(self.node.key, "little", signed=True)

    @property
    def digest(self) -> int:
        return int.from_bytes(blake2b(self.text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)

    @property
    def counts(self) -> bool:
        """Whether the wrapper may decide on it."""
        return not (self.article and self.tag in _PARAGRAPHS)


class _Open:
    """An open element; its node is made when text is found in it."""

    __slots__ = ("tag", "label", "article", "dropped", "doubt", "node")

    def __init__(self, tag: str, label: str, article: bool, dropped: bool, doubt: Doubt | None = None, node: Node | None = None):
        self.tag, self.label, self.article, self.dropped, self.doubt, self.node = tag, label, article, dropped, doubt, node


def blocks_of(page: str | None) -> tuple[Node, list[Block]]:
    """The layout of a page, and its blocks with text in page order."""
    root, out = Node("", b""), []
    stack, opened = [_Open("", "", False, False, None, root)], Counter()
    held: list[str] = []
    in_link, linked = False, 0
    doubts: list[Doubt] = []  # outer ones first

    def flush() -> None:
        nonlocal linked
        if held:
            text = "".join(held)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            held.clear()
            if text:
                k = len(stack) - 1
                while stack[k].node is None:
                    k -= 1
                for own in stack[k + 1 :]:
                    own.node = stack[k].node.child(own.label)
                    k += 1
                top = stack[-1]
                top.node.held = True
                out.append(Block(top.node, top.tag, top.article, top.dropped, text, top.doubt))
                if top.doubt is not None:
                    top.doubt.chars += len(text)
                    top.doubt.links += min(linked, len(text))
            linked = 0

    def close(k: int) -> None:
        for own in stack[k:]:
            opened[own.tag] -= 1
        del stack[k:]

    def open_(tag: str, label: str, article: bool, dropped: bool, doubt: Doubt | None) -> None:
        stack.append(_Open(tag, label, article, dropped, doubt))
        opened[tag] += 1

    for markup, part in _parts(page or ""):
        if not markup:
            held.append(part)
            if in_link:
                linked += len(part)
            continue
        name = _NAME.match(part)
        if name is None:
            continue  # a comment or declaration
        tag, ends, top = name[1].lower(), part[1] == "/", stack[-1]
        if tag == "a":
            in_link = not ends
        if tag in _INLINE or tag in _RAW and not ends:
            # an inline element is not on the path, unless it is furniture
            if tag in _INLINE and not ends and "=" in part and _is_furniture(tag, (marks := _label(tag, part))[1], top.article):
                flush()
                open_(tag, marks[0], top.article, True, top.doubt)
            elif ends and top.tag == tag:
                flush()
                close(len(stack) - 1)
            continue
        if tag in _SPACES:
            held.append(" ")
            continue
        flush()
        if ends:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in _VOID or part.endswith("/>"):
            continue
        while len(stack) > 1 and (stack[-1].tag in _ENDED_BY_BLOCK or stack[-1].tag == tag in ("li", "dt", "dd", "option", "tr")):
            close(len(stack) - 1)
        label, words = _label(tag, part)
        top = stack[-1]
        furniture = _is_furniture(tag, words, top.article)
        dropped = top.dropped or bool(furniture)
        doubt = top.doubt
        if furniture is None:
            doubts.append(doubt := Doubt(doubt))
        open_(tag, label, top.article or (not dropped and (tag in ("article", "main") or bool(words & _ARTICLE_ROLES))), dropped, doubt)
    flush()
    for doubt in reversed(doubts):  # what is in an element is in those around it
        if doubt.outer is not None:
            doubt.outer.chars += doubt.chars
            doubt.outer.links += doubt.links
    for doubt in doubts:
        doubt.furniture = 2 * doubt.links >= doubt.chars or (doubt.outer is not None and doubt.outer.furniture)
    for block in out:
        block.dropped = block.dropped or (block.doubt is not None and block.doubt.furniture)
    return root, out


def main_text(page: str | None, template: frozenset[tuple[int, int]] | set[tuple[int, int]] = frozenset()) -> str:
    """The main text of a page, given the (slot, digest of text) pairs of its host's template."""
    blocks = blocks_of(page)[1]
    if template:
        blocks = [b for b in blocks if not (b.counts and (b.slot, b.digest) in template)]
    blocks = [b for b in blocks if not b.dropped]
    inside = [b for b in blocks if b.article]
    if 2 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in blocks):
        blocks = inside
    return "\n\n".join(b.text for b in blocks)


def layout_of(root: Node) -> str:
    """A layout as JSON, [label, key, parent's place] of its nodes in page order."""
    out, todo = [], [(root, -1)]
    while todo:
        node, parent = todo.pop()
        at = len(out)
        out.append([node.label, int.from_bytes(node.key, "little", signed=True), parent])
        todo += [(c, at) for c in reversed(node.children)]
    return json.dumps(out)


class Tree:
    """A layout as read back: labels and keys of nodes, and the places of their children."""

    def __init__(self, layout: str):
        rows = json.loads(layout)
        self.labels, self.keys = [r[0] for r in rows], [r[1] for r in rows]
        self.children: list[list[int]] = [[] for _ in rows]
        for i, (_, _, parent) in enumerate(rows):
            if parent >= 0:
                self.children[parent].append(i)


class Subtrees:
    """The kinds of subtrees of two layouts, equal ones being one kind: label, tag, kinds of children and number of nodes of each.

    A pair of nodes with equal tags weighs ``pair``, and one more if their classes are equal too: with ``pair`` above the number of
    nodes, the heaviest matching is one with the most pairs, and among those one with the most equal labels.
    """

    def __init__(self, pair: int):
        self.pair = pair
        self.labels: list[str] = []
        self.tags: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.nodes: list[int] = []
        self._kinds: dict[tuple[str, tuple[int, ...]], int] = {}
        self._best: dict[tuple[int, int], int] = {}

    def kinds(self, tree: Tree) -> list[int]:
        """The kind of each node's subtree."""
        out = [0] * len(tree.labels)
        for i in range(len(out) - 1, -1, -1):  # children come after their parents
            own = tree.labels[i], tuple(out[c] for c in tree.children[i])
            if own not in self._kinds:
                self._kinds[own] = len(self.labels)
                self.labels.append(own[0])
                self.tags.append(own[0].split(".", 1)[0])
                self.children.append(own[1])
                self.nodes.append(1 + sum(self.nodes[c] for c in own[1]))
            out[i] = self._kinds[own]
        return out

    def _plain(self, p: int, q: int) -> bool:
        """Whether the best matching of two kinds with equal tags needs no table."""
        return p == q or not self.children[p] or not self.children[q]

    def weight(self, p: int, q: int) -> int:
        """The weight of the best matching of two kinds with equal tags, if ``solve`` has come by."""
        if p == q:
            return self.nodes[p] * (self.pair + 1)
        return self.pair + (self.labels[p] == self.labels[q]) if self._plain(p, q) else self._best[p, q]

    def solve(self, p: int, q: int) -> int:
        """The weight of the best matching of two kinds with equal tags."""
        todo = [(p, q, False)]
        while todo:
            i, j, ready = todo.pop()
            if self._plain(i, j) or (i, j) in self._best:
                continue
            if ready:
                for last in self.rows(i, j):
                    pass
                self._best[i, j] = self.pair + (self.labels[i] == self.labels[j]) + int(last[-1])
                continue
            todo.append((i, j, True))
            named: dict[str, list[int]] = {}
            for y in dict.fromkeys(self.children[j]):
                if self.children[y]:
                    named.setdefault(self.tags[y], []).append(y)
            todo += [(x, y, False) for x in dict.fromkeys(self.children[i]) if self.children[x] for y in named.get(self.tags[x], ()) if x != y]
        return self.weight(p, q)

    def rows(self, i: int, j: int, row: np.ndarray | None = None, begin: int = 0, end: int | None = None) -> Iterator[np.ndarray]:
        """Rows begin + 1 to end of the table of best matchings of first children of i and j, after ``row``, that of begin."""
        ys = self.children[j]
        places: dict[str, list[int]] = {}
        for m, y in enumerate(ys):
            places.setdefault(self.tags[y], []).append(m)
        weights: dict[int, tuple[list[int], np.ndarray]] = {}
        row = np.zeros(len(ys) + 1, np.int64) if row is None else row
        for x in self.children[i][begin:end]:
            if x not in weights:
                if len(weights) * len(ys) > 1 << 20:
                    weights.clear()
                at = places.get(self.tags[x], [])
                weights[x] = at, np.array([self.weight(x, ys[m]) for m in at], np.int64)
            at, own = weights[x]
            if at:
                after = row.copy()
                after[1:][at] = np.maximum(after[1:][at], row[at] + own)
                row = np.maximum.accumulate(after)
            yield row

    def matched(self, i: int, j: int) -> list[tuple[int, int]]:
        """Places of the children of i and j that a best matching pairs, last ones first; of a large table, blocks of rows are made anew from the row before each."""
        k, m = len(self.children[i]), len(self.children[j])
        block = k if k * m <= 1 << 20 else isqrt(k) + 1
        starts = {0: np.zeros(m + 1, np.int64)}
        if block < k:
            starts |= {n: row for n, row in enumerate(self.rows(i, j), 1) if n % block == 0}
        out = []
        while k and m:
            begin = (k - 1) // block * block
            table = [starts[begin], *self.rows(i, j, starts[begin], begin, k)]
            while k > begin and m:
                if table[k - begin][m] == table[k - begin - 1][m]:
                    k -= 1
                elif table[k - begin][m] == table[k - begin][m - 1]:
                    m -= 1
                else:
                    k, m = k - 1, m - 1
                    out.append((k, m))
        return out


def match_trees(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most pairs of nodes with equal tags, in order, under matched parents; of the ways to do so one with the most equal classes."""
    if a.labels[0] != b.labels[0]:
        return 0, []
    trees = Subtrees(1 + max(len(a.labels), len(b.labels)))
    of_a, of_b = trees.kinds(a), trees.kinds(b)
    trees.solve(of_a[0], of_b[0])
    pairs, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        p, q = of_a[i], of_b[j]
        if p == q:  # a subtree's nodes stand in a row
            pairs += zip(range(i, i + trees.nodes[p]), range(j, j + trees.nodes[q]))
            continue
        pairs.append((i, j))
        todo += [(a.children[i][k], b.children[j][m]) for k, m in trees.matched(p, q)]
    return len(pairs), pairs


def aligned(full: Tree, tree: Tree) -> list[tuple[int, int]]:
    """(slot, slot of the full layout that it is matched with), for a layout's slots that the full one lacks."""
    own = set(full.keys)
    if own.issuperset(tree.keys):
        return []
    out: dict[int, int] = {}
    for i, j in match_trees(full, tree)[1]:
        if tree.keys[j] not in own:
            out.setdefault(tree.keys[j], full.keys[i])
    return sorted(out.items())


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def _joined(rows: DataFrame, table: DataFrame, on: list[str], how: str, size) -> DataFrame:
    """rows joined with a table, which is broadcast if it is small; ``size`` are a row's bytes."""
    if (table.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return rows.join(table, on, how)


def aligned_slots(layouts: DataFrame) -> DataFrame:
    """host, slot and same, the slot of the host's fullest layout that it is matched with, of layouts (host, layout, n)."""
    # of equally full layouts the most frequent one
    fullest = written(layouts.groupBy("host").agg(F.max_by("layout", F.struct(F.json_array_length("layout"), "n", F.bitwise_not(F.xxhash64("layout")))).alias("full")), "fullest")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = full = None
        for batch in batches:
            rows = []
            for host, layout, place, fullest in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "place", "full"))):
                if fullest != layout:
                    if fullest != last:
                        last, full = fullest, Tree(fullest)
                    rows += [(host, slot, same, place) for slot, same in aligned(full, Tree(layout))]
            kinds = (pa.string(), pa.int64(), pa.int64(), batch.schema.field("place").type)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["host", "slot", "same", "place"])
        give_back()

    pairs = _joined(layouts, fullest, ["host"], "inner", F.octet_length("host") + F.octet_length("full")).select("host", "layout", F.struct((-F.col("n")).alias("n"), F.xxhash64("layout").alias("h")).alias("place"), "full")
    # where layouts differ in what a slot is, the most frequent one counts
    return pairs.mapInArrow(align, "host string, slot bigint, same bigint, place struct<n: bigint, h: bigint>").groupBy("host", "slot").agg(F.min_by("same", "place").alias("same"))


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """host, page (hash of host and html), and slots and digests of its blocks that its host's template has, for every distinct one of pages (url, html) that has any."""
    # equal pages tell nothing about each other; pages are compared by hash and read once more by those that are kept
    distinct = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("html <> ''").withColumn("page", F.xxhash64("host", "html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, layouts = [], Counter()
            for host, page, text in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                root, blocks = blocks_of(text)
                own = [b for b in blocks if b.counts]
                # what no wrapper could decide on has no row; a layout matters only where there is something to decide
                if own:
                    layouts[host, layout_of(root)] += 1
                    rows += [(host, page, None, None, slot, digest) for slot, digest in {(b.slot, b.digest) for b in own}]
            rows += [(host, None, layout, n, None, None) for (host, layout), n in layouts.items()]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "page", "layout", "n", "slot", "digest"])
        give_back()

    found = written(distinct.mapInArrow(scan, "host string, page bigint, layout string, n bigint, slot bigint, digest bigint"), "slots")
    layouts = written(found.where("layout is not null").groupBy("host", "layout").agg(F.sum("n").alias("n")), "layouts")
    same = written(aligned_slots(layouts), "aligned")
    # a page counts once for a slot, and once for a text of it
    held = found.where("slot is not null").join(same, ["host", "slot"], "left").select("host", "page", "slot", F.coalesce("same", "slot").alias("one"), "digest")
    texts = held.groupBy("host", "one", "digest", "page").agg(F.min("slot").alias("slot")).groupBy("host", "one", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    every = held.select("host", "one", "page").distinct().groupBy("host", "one").agg(F.count("*").alias("pages"))
    constant = texts.join(every, ["host", "one"]).where(F.col("n") >= SHARE * F.col("pages")).select("host", "one", "digest")
    constant_of = held.join(constant, ["host", "one", "digest"], "left_semi")
    return constant_of.groupBy("host", "page").agg(F.collect_set(F.struct("slot", "digest")).alias("_own")).select("host", "page", F.col("_own.slot").alias("slots"), F.col("_own.digest").alias("digests"))


RESULTS = ("text", "n_chars")


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text and n_chars (code points) of every page."""
    bounded_batches(pages.sparkSession)
    wrappers = written(induce_wrappers(pages), "wrappers")
    rows = pages.select(F.struct(*[pages[c] for c in keep]).alias("_row"), F.col("html").cast("string").alias("_html"), host_of(F.col("url")).alias("host")).withColumn("page", F.xxhash64("host", "_html"))
    rows = _joined(rows, wrappers, ["host", "page"], "left", F.octet_length("host") + 16 * F.size("slots")).drop("host", "page")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, slots, digests in zip(*(batch.column(c).to_pylist() for c in ("_html", "slots", "digests"))):
                texts.append(main_text(page, set(zip(slots, digests)) if slots else frozenset()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_row", "text", "n_chars"])
        give_back()

    kind = rows.schema["_row"].dataType.simpleString()
    kept = [F.col("_row").getField(c).alias(f"kept_{c}" if c in RESULTS else c) for c in keep]
    return rows.mapInArrow(extract, f"_row {kind}, text string, n_chars bigint").select(*kept, *RESULTS)
