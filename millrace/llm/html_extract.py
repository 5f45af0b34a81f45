"""Main text of web pages by wrapper induction over the pages of a host.

Pages are parsed to trees of block-level nodes.  A host's wrapper starts as the
tree of its commonest shape of page and grows by the nodes that all its other
shapes have beside it; nodes that half of its articles or fewer have are left
out.  Then every page of the host is aligned with it by simple tree matching: two
nodes match if their labels do, and their children are matched in order so that
the most nodes are paired, and of such matchings the most that say the same.
A text that stands at one node of the wrapper on most pages of a host, whatever
their articles are, is template; what varies is content.  Markup that names its
role (menus, footers, adverts and so on) is left out as well.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty
from millrace.sources.storage import discard, materialize

#: A text is template if over this share of a host's distinct articles, and at least so many, have it at one node.
SHARE, LEAST_ARTICLES = 0.5, 2
#: Trees of a host that are put together in one task; more are put together in several rounds.
TOGETHER = 64
#: Pairs of children from which on their matching is computed in whole rows.
IN_ROWS = 1024

# Names of the HTML standard, and words that sites name such parts with.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output picture q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul".split()
)
DROPPED = frozenset(
    "head nav footer aside form button select option datalist template svg math canvas object audio video dialog menu map input "
    "script style textarea title xmp iframe noembed noframes noscript".split()
)
TABLE = frozenset("table thead tbody tfoot tr td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status note".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense banner cookie cookies consent gdpr notice notices notification alert "
    "newsletter subscribe subscription signup login comment comments disqus respond reply replies sidebar aside widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer share sharing social related recommended recommendations popup modal overlay toolbar pagination pager paywall hidden disclaimer".split()
)
HEADS = frozenset("header masthead topbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NESTED = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    __slots__ = ("tag", "label", "items", "kids", "drop", "soft", "why", "number", "said", "whole", "own", "held")

    def __init__(self, tag: str, label: str, drop: bool = False, soft: bool = False) -> None:
        self.tag, self.label, self.drop, self.soft = tag, label, drop, soft
        self.items: list[Node | str] = []
        # Children that are blocks themselves.
        self.kids: list[Node] = []
        self.why = ""
        self.number = -1
        # Hash of the node's own text in the article, and of all that its subtree is and says; what the subtree weighs.
        self.said = self.whole = self.own = 0
        # Of a growing wrapper: articles that have the node, at most.
        self.held = 0.0

    def children(self) -> list[Node]:
        return [x for x in self.items if type(x) is Node]


@lru_cache(maxsize=4096)
def _role(tag: str, raw: str) -> tuple[str, str]:
    """Label of an element and why it may be left out: '', 'drop', 'head' (a page's head, unless in an article) or 'name' (by class or id)."""
    attributes = {}
    for name, value in _ATTRIBUTE.findall(raw):
        attributes.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    label = f"{tag} {names.strip()}" if names.strip() else tag
    why = "drop" if tag in DROPPED else "head" if tag == "header" else ""
    if tag in ("html", "body", "main", "article"):
        why = ""
        if tag != "article":
            return label, why
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return label, "drop"
    if attributes.get("role", "").lower() in ROLES:
        return label, "drop"
    words = set(_WORDS.findall(_CAMEL.sub(" ", names).lower()))
    if PARTS.intersection(names.lower().split()):
        return label, why or "name"
    if words & HEADS:
        return label, why or "head"
    return label, why


def parse(page: str) -> Node:
    """The tree of block-level nodes, however deep; inline markup is dissolved in its block's text."""
    root = Node("", "")
    stack = [root]
    # How many elements of a tag are open, so that ends without a start cost nothing.
    open_tags: Counter[str] = Counter()
    at = 0

    def text(raw: str) -> None:
        if raw:
            stack[-1].items.append(entities.unescape(raw) if "&" in raw else raw)

    def close(k: int) -> None:
        for node in stack[k:]:
            open_tags[node.tag] -= 1
        del stack[k:]

    def close_nearest(tags: tuple[str, ...], borders: tuple[str, ...]) -> None:
        if any(open_tags[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    close(k)
                    break
                if stack[k].tag in borders:
                    break

    def put(node: Node, opens: bool) -> None:
        stack[-1].items.append(node)
        if not node.soft:
            stack[-1].kids.append(node)
        if opens:
            stack.append(node)
            open_tags[node.tag] += 1

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            return root
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if not open_tags[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in TABLE and tag not in TABLE and tag not in ("body", "html"):
                    break
            continue
        raw = m[3] if m[2] else m[6]
        label, why = _role(tag, raw)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in ("iframe", "textarea"):
                text(" ")
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in INLINE:
            if why and tag not in VOID and not raw.rstrip().endswith("/"):
                put(Node(tag, label, True, True), True)
            continue
        # A block ends inline parts that were left open, and what the standard says it ends.
        while stack[-1].soft:
            close(len(stack) - 1)
        if tag in CLOSES_P:
            close_nearest(("p",), ("button", "td", "th", "table", "article", "section", "div"))
        if tag in _ENDS:
            close_nearest(_ENDS[tag], _NESTED[tag])
        node = Node(tag, label, why == "drop")
        node.why = why
        put(node, tag not in VOID and not raw.rstrip().endswith("/>"))


def _walk(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.children())


def _settle(root: Node) -> tuple[Node, list[Node]]:
    """Decide which nodes go, and return the region of the article."""
    nodes = list(_walk(root))
    parent = {id(c): n for n in nodes for c in n.children()}
    holds: set[int] = set()
    for n in nodes:
        if n.tag in ("article", "main") and n.why != "name":
            up = n
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = parent.get(id(up))
    sizes: dict[int, int] = {}
    for n in reversed(nodes):
        sizes[id(n)] = sum(len(x.strip()) if type(x) is str else sizes[id(x)] for x in n.items)
    inside: set[int] = set()
    for n in nodes:
        up = parent.get(id(n))
        if (up is not None and id(up) in inside) or n.tag == "article":
            inside.add(id(n))
        # What holds most of the page's text is no menu or advert, whatever its name.
        if n.why == "name" and id(n) not in holds and (id(n) in inside or 2 * sizes[id(n)] <= sizes[id(root)]):
            n.drop = True
        elif n.why == "head" and id(n) not in holds and id(n) not in inside:
            n.drop = True
    for wanted in ("article", "main"):
        found = []
        todo = [root]
        while todo:
            n = todo.pop()
            if not n.drop:
                if n.tag == wanted:
                    found.append((sum(len(t) for _, t in runs(n)), n))
                else:
                    todo += n.children()
        most, region = max(found, key=lambda x: x[0], default=(0, root))
        if not most:
            continue
        if 2 * most < sum(size for size, _ in found):
            # None of several is the article, so they are parts of one: what holds them all is the region.
            paths = []
            for _, n in found:
                path = [n]
                while id(path[-1]) in parent:
                    path.append(parent[id(path[-1])])
                paths.append(path[::-1])
            region = [level[0] for level in zip(*paths) if all(x is level[0] for x in level)][-1]
        return region, nodes
    return root, nodes


def runs(region: Node) -> list[tuple[Node, str]]:
    """``(node, text)`` of every block of text in page order: white space is one space, ends are trimmed."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []

    def close(node: Node) -> None:
        said = " ".join("".join(held).split())
        if said:
            out.append((node, said))
        held.clear()

    # Explicit stack of (node, next item), since pages may nest deeply.
    stack = [(region, 0)]
    while stack:
        node, k = stack.pop()
        if k == len(node.items):
            if not node.soft:
                close(node)
            continue
        stack.append((node, k + 1))
        item = node.items[k]
        if type(item) is str:
            held.append(item)
        elif item.soft:
            if not item.drop:
                stack.append((item, 0))
        else:
            close(node)
            if not item.drop:
                stack.append((item, 0))
    return out


def skeleton(root: Node) -> str:
    """The tree with hashes in place of its texts, as JSON: ``[label, said, whole, number of children]`` of each node before its children."""
    return json.dumps([[n.label, n.said, n.whole, len(n.kids)] for n in _blocks(root)])


def _blocks(root: Node) -> Iterator[Node]:
    """The nodes that are blocks, in the order of the page."""
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.kids)


@lru_cache(maxsize=256)
def reference(text: str) -> tuple[Node, list[Node]]:
    """The tree of a skeleton and its nodes by number, in the order of the page."""
    return _loaded(json.loads(text))


def _loaded(rows: list[list]) -> tuple[Node, list[Node]]:
    nodes, wanting = [], []
    for label, said, whole, kids in rows:
        node = Node("", label)
        node.said, node.whole, node.number = said, whole, len(nodes)
        nodes.append(node)
        if wanting:
            wanting[-1][0].kids.append(node)
            wanting[-1][1] -= 1
        wanting.append([node, kids])
        while wanting and not wanting[-1][1]:
            wanting.pop()
    _weigh(nodes)
    return nodes[0], nodes


def _weigh(nodes: list[Node]) -> None:
    """What each subtree weighs if it is matched with its like: two for each node and one more for what it says."""
    for n in reversed(nodes):
        n.own = 2 + (n.said != 0) + sum(k.own for k in n.kids)


def _trimmed(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """Children that are alike in shape and text at both ends need no weighing."""
    short = min(len(x), len(y))
    head = 0
    while head < short and x[head].whole == y[head].whole:
        head += 1
    tail = 0
    while tail < short - head and x[-1 - tail].whole == y[-1 - tail].whole:
        tail += 1
    return head, tail


class Matching:
    """Simple tree matching of two trees: a pair of nodes weighs two, and one more if both say the same."""

    def __init__(self) -> None:
        self.memo: dict[tuple[int, int], int] = {}

    def one(self, a: Node, b: Node) -> int:
        """The weight of the best matching of two subtrees; that of subtrees with children is known by then."""
        if a.label != b.label:
            return 0
        if a.whole == b.whole:
            return a.own
        if not a.kids or not b.kids:
            return 2 + (a.said == b.said != 0)
        return self.memo[id(a), id(b)]

    def weigh(self, pairs: list[tuple[Node, Node]]) -> None:
        """Fill in the weights of pairs, deepest first, on a stack of its own since pages may nest deeply."""
        todo = list(pairs)
        while todo:
            a, b = todo[-1]
            if (id(a), id(b)) in self.memo:
                todo.pop()
                continue
            head, tail = _trimmed(a.kids, b.kids)
            x, y = a.kids[head : len(a.kids) - tail], b.kids[head : len(b.kids) - tail]
            wanting = self.wanting(x, y)
            if wanting:
                todo += wanting
                continue
            sure = sum(k.own for k in a.kids[:head]) + sum(k.own for k in a.kids[len(a.kids) - tail :])
            self.memo[id(a), id(b)] = 2 + (a.said == b.said != 0) + sure + self.total(x, y)
            todo.pop()

    def wanting(self, x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        by_label: dict[str, list[Node]] = {}
        for q in y:
            if q.kids:
                by_label.setdefault(q.label, []).append(q)
        memo = self.memo
        return [(p, q) for p in x if p.kids for q in by_label.get(p.label, ()) if p.whole != q.whole and (id(p), id(q)) not in memo] if by_label else []

    def _rows(self, x: list[Node], y: list[Node]) -> Iterator[np.ndarray]:
        """The weights of each child of ``x`` with all of ``y``."""
        codes: dict[str, int] = {}
        labels = np.array([codes.setdefault(q.label, len(codes)) for q in y], np.int64)
        said = np.array([q.said for q in y], np.int64)
        nested: dict[str, list[int]] = {}
        for j, q in enumerate(y):
            if q.kids:
                nested.setdefault(q.label, []).append(j)
        for p in x:
            like = labels == codes.get(p.label, -1)
            row = 2 * like + (like & (said == p.said) & (p.said != 0))
            if p.kids:
                for j in nested.get(p.label, ()):
                    row[j] = self.one(p, y[j])
            yield row

    @staticmethod
    def _next(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
        row = above.copy()
        row[1:] = np.maximum(row[1:], above[:-1] + weights)
        return np.maximum.accumulate(row)

    def _table(self, x: list[Node], y: list[Node]) -> list[list[int]]:
        table, one = [[0] * (len(y) + 1)], self.one
        for p in x:
            above, row = table[-1], [0]
            for j, q in enumerate(y):
                row.append(max(row[j], above[j + 1], above[j] + one(p, q)))
            table.append(row)
        return table

    def total(self, x: list[Node], y: list[Node]) -> int:
        if not x or not y:
            return 0
        if len(x) * len(y) <= IN_ROWS:
            return self._table(x, y)[-1][-1]
        row = np.zeros(len(y) + 1, np.int64)
        for weights in self._rows(x, y):
            row = self._next(row, weights)
        return int(row[-1])

    def matched(self, x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        """The pairs of the best matching of two lists of children in order."""
        out = []
        i, j = len(x), len(y)
        if len(x) * len(y) <= IN_ROWS:
            table, first = self._table(x, y), 0
        else:
            # Every few rows are kept, and those between them computed anew on the way back.
            step, marks, row = max(16, isqrt(len(x))), [], np.zeros(len(y) + 1, np.int64)
            for k, weights in enumerate(self._rows(x, y)):
                if k % step == 0:
                    marks.append(row)
                row = self._next(row, weights)
            table, first = [], len(x)
        while i and j:
            if i <= first:
                first = (i - 1) // step * step
                table = [marks[first // step]]
                for weights in self._rows(x[first:i], y):
                    table.append(self._next(table[-1], weights))
            here, above = table[i - first], table[i - first - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
        return out


def align(page: Node, wrapper: Node) -> None:
    """Give every node of the page the number of the wrapper's node that it is paired with."""
    if page.label != wrapper.label:
        return
    matching = Matching()
    todo = [(page, wrapper)]
    while todo:
        p, q = todo.pop()
        p.number = q.number
        if not p.kids or not q.kids:
            continue
        head, tail = _trimmed(p.kids, q.kids)
        todo += zip(p.kids[:head], q.kids[:head])
        if tail:
            todo += zip(p.kids[-tail:], q.kids[-tail:])
        x, y = p.kids[head : len(p.kids) - tail], q.kids[head : len(q.kids) - tail]
        if x and y:
            matching.weigh(matching.wanting(x, y))
            todo += matching.matched(x, y)


def grow(root: Node, other: Node, lacked: float, other_lacked: float) -> None:
    """Let a wrapper take in the nodes that only the other tree has, each after the one that it follows there.

    ``held`` of each node bounds the articles that have it: a node that the
    wrapper lacks was left out of it for at most ``lacked`` articles, one that
    the other lacks for at most ``other_lacked``.
    """
    nodes = list(_blocks(root))
    theirs = list(_blocks(other))
    # Subtrees that no page has as a whole are like none in the other tree.
    for number, n in enumerate(nodes):
        n.number, n.whole = number, max(n.whole, 0)
    for n in theirs:
        n.number, n.whole = -1, n.whole if n.whole > 0 else -1
    align(other, root)
    met = set()
    for p in theirs:
        if p.number < 0:
            p.held += lacked
        else:
            nodes[p.number].held += p.held
            met.add(p.number)
    for n in nodes:
        if n.number not in met:
            n.held += other_lacked
    for p in theirs:
        if p.number >= 0 and any(k.number < 0 for k in p.kids):
            place = {k.number: i for i, k in enumerate(nodes[p.number].kids)}
            after: dict[int, list[Node]] = {}
            at = -1
            for k in p.kids:
                if k.number < 0:
                    after.setdefault(at, []).append(k)
                else:
                    at = place[k.number]
            mine = nodes[p.number]
            mine.kids = after.get(-1, []) + [x for i, q in enumerate(mine.kids) for x in (q, *after.get(i, ()))]
            # A node that has got more children is none that a page has as a whole.
            mine.whole = 0


def prune(root: Node, least: float) -> None:
    """Leave out the nodes that ``least`` articles have, or fewer."""
    for n in reversed(list(_blocks(root))):
        kids = [k for k in n.kids if k.held > least]
        if len(kids) < len(n.kids) or not all(k.whole > 0 for k in kids):
            n.whole = 0
        n.kids = kids


def put_together(trees: list[tuple[str, str | None, int, int]], lost: float, least: float) -> tuple[str, str, int]:
    """One tree of ``(skeleton, held, weight, articles)``, as ``(skeleton, held, weight)``.

    ``held`` has a number for each node, or is null where all nodes are on all
    the ``articles`` that have the tree.  A tree may lack nodes that a share
    ``lost`` of its weight have; the result lacks those that a share ``least``
    of its weight have, or fewer.
    """
    root, weight = None, 0
    for text, held, own, articles in trees:
        other, nodes = _loaded(json.loads(text))
        for n, x in zip(nodes, json.loads(held) if held else [articles] * len(nodes)):
            n.held = x
        if root is None:
            root = other
        else:
            grow(root, other, lost * weight, lost * own)
        weight += own
    prune(root, least * weight)
    return skeleton(root), json.dumps([n.held for n in _blocks(root)]), weight


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def read(page: str | None) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of a page and the texts of its region."""
    root = parse(page or "")
    region, nodes = _settle(root)
    texts = runs(region)
    for node, said in texts:
        node.said = _hash(f"{node.said}{said}")
    for n in reversed(nodes):
        n.whole = zlib.crc32(repr((n.label, n.said, [k.whole for k in n.kids])).encode("utf-8", "surrogatepass")) or 1
    _weigh(nodes)
    return root, texts


def _article(texts: list[tuple[Node, str]]) -> int:
    return _hash("\n".join(t for _, t in texts))


def located(page: str | None, wrapper: str | None) -> tuple[int, list[tuple[int, int, str]]]:
    """A hash of the page's main text, and ``(node of the wrapper or -1, hash, text)`` of each block of it."""
    root, texts = read(page)
    if wrapper:
        align(root, reference(wrapper)[0])
    return _article(texts), [(n.number, _hash(t), t) for n, t in texts]


def host_of(url_col: str):
    return F.lower(F.regexp_extract(text_or_empty(url_col), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def shapes(pages: DataFrame) -> DataFrame:
    """``(host, shape, weight, articles, skeleton)``: every shape of page that a host of ``pages``, ``(host, h, html)``, has.

    Pages are of one shape if their trees have the same labels; the page with
    the least hash stands for them.  ``articles`` counts the distinct articles
    of a shape, ``weight`` those that are on no lesser shape of the host too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kinds, articles, least = [], [], {}
            for k, (host, h, page) in enumerate(zip(hosts, hashes, batch.column(2).to_pylist())):
                root, texts = read(page)
                articles.append(_article(texts))
                kinds.append(_hash(repr([(n.label, len(n.kids)) for n in _blocks(root)])))
                found = least.get((host, kinds[-1]))
                if found is None or h < found[0]:
                    least[host, kinds[-1]] = h, k, skeleton(root)
            texts = [None] * len(hosts)
            for _, k, text in least.values():
                texts[k] = text
            columns = [pa.array(kinds, pa.int64()), pa.array(articles, pa.int64()), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["host", "shape", "article", "h", "skeleton"])

    rows = pages.select("host", "h", "html").mapInArrow(run, "host string, shape bigint, article bigint, h bigint, skeleton string")
    best = F.min(F.when(F.col("skeleton").isNotNull(), F.struct("h", "skeleton"))).alias("best")
    once = materialize(rows.groupBy("host", "shape", "article").agg(best), "shapes")
    owner = once.groupBy("host", "article").agg(F.min("shape").alias("shape")).groupBy("host", "shape").agg(F.count(F.lit(1)).alias("weight"))
    counted = once.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("articles"), F.min("best").alias("best")).join(owner, ["host", "shape"], "left")
    return counted.select("host", "shape", F.coalesce("weight", F.lit(0)).alias("weight"), "articles", F.col("best.skeleton").alias("skeleton"))


def _joined(lost: float, least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Puts the trees of a group together; if it is the only one of its host, what ``SHARE`` of the articles have, or fewer, is left out."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["articles", "part"], ascending=[False, True])
        trees = list(zip(group["skeleton"], group["held"], group["weight"].tolist(), group["articles"].tolist()))
        text, held, weight = put_together(trees, lost, SHARE if group["groups"].iloc[0] == 1 else least)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "part": [group["to"].iloc[0]], "weight": [weight], "articles": [weight], "skeleton": [text], "held": [held]})

    return join


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` for every host of ``pages``, ``(host, h, html)``, that has two different articles at least.

    A wrapper grows over all shapes of the host's pages, about ``TOGETHER`` of
    them in a task and as many of the results in the next round.  It lacks only
    nodes that ``SHARE`` of the host's articles have, or fewer, so what is on
    more of them has its node.  Rounds before the last leave out nodes of a
    lesser share of the articles that they have seen, which grows from round to
    round: what a share above ``SHARE`` of all has, one of the parts has.
    """
    every = materialize(shapes(pages).select("host", F.col("shape").alias("part"), "weight", "articles", "skeleton", F.lit(None).cast("string").alias("held")), "trees")
    several = every.groupBy("host").agg(F.sum("weight").alias("all")).where(F.col("all") >= LEAST_ARTICLES).select("host")
    rows = materialize(every.join(several, "host", "left_semi"), "trees")
    discard(every)
    lost, kind = 0.0, "host string, part bigint, weight bigint, articles bigint, skeleton string, held string"
    while True:
        groups = materialize(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("bigint").alias("groups")), "groups")
        most = groups.agg(F.max("groups")).first()[0]
        least = (SHARE + lost) / 2
        dealt = rows.join(groups, "host").withColumn("to", F.pmod(F.xxhash64("part"), "groups"))
        before, rows = rows, materialize(dealt.groupBy("host", "to").applyInPandas(_joined(lost, least), kind), "trees")
        discard(before, groups)
        if not most or most == 1:
            return rows.select("host", F.col("skeleton").alias("wrapper"))
        lost = least


BLOCK = "node int, h bigint, text string"


def locate_pages(pages: DataFrame, id_type: str, url_type: str) -> DataFrame:
    """``(id, url, host, article, blocks)``: each page parsed once and aligned with its host's wrapper."""
    kinds = pa.list_(pa.struct([("node", pa.int32()), ("h", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            articles, blocks = [], []
            for page, wrapper in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                article, found = located(page, wrapper)
                articles.append(article)
                blocks.append([{"node": n, "h": h, "text": t} for n, h, t in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(articles, pa.int64()), pa.array(blocks, kinds)], ["id", "url", "host", "article", "blocks"])

    joined = pages.join(wrappers(pages.select("host", "h", "html")), "host", "left").select("id", "url", "host", "html", "wrapper")
    return materialize(joined.mapInArrow(run, f"id {id_type}, url {url_type}, host string, article bigint, blocks array<struct<{BLOCK}>>"), "located")


def templates(located_pages: DataFrame) -> DataFrame:
    """``(host, template)``: the ``(node, h)`` of each text that is template.

    A text counts once for each distinct article that it stands beside, so
    copies of one article don't make it template.
    """
    seen = located_pages.select("host", "article", F.explode("blocks").alias("b")).where("b.node >= 0").select("host", "b.node", "b.h", "article").distinct()
    counts = seen.groupBy("host", "node", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ARTICLES)
    articles = located_pages.select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    # Over half of the articles have it, so a node has one such text at most and a host's list is no longer than its wrapper.
    fixed = counts.join(articles, "host").where(F.col("n") > SHARE * F.col("articles"))
    return materialize(fixed.groupBy("host").agg(F.collect_list(F.struct("node", "h")).alias("template")), "templates")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, blocks)`` for every page: the blocks of its main text in page order.

    Null and empty pages have no blocks.  Pages of any length, depth and number
    of children are read and aligned whole.  Rows without a URL, or with one
    that names no host, count as pages of one nameless host.  Repeated rows are
    repeated; other columns are ignored; an empty table has no rows.
    """
    html = text_or_empty(html_col)
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.xxhash64(html).alias("h"), html.alias("html"))
    found = locate_pages(keyed, pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString())
    met = found.join(templates(found), "host", "left")
    fixed = lambda b: F.coalesce(F.array_contains("template", F.struct(b["node"], b["h"])), F.lit(False))
    blocks = F.transform(F.filter("blocks", lambda b: ~fixed(b)), lambda b: b["text"])
    return met.select(F.col("id").alias(id_col), F.col("url").alias(url_col), blocks.alias("blocks"))
