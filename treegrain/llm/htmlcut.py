"""Main text of web pages by minimum cut: blocks are nodes, a classifier's log odds terminal capacities, page order and DOM proximity smoothness edges."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treegrain.llm.textblock import tidy
from treegrain.session import ship_code, spread

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("annotation mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark math meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_SEARCH = frozenset("ul ol dl table div section article body main form".split())
#: Log odds that a tag around a block takes from it, and that words in names do: the second group also occurs in articles' own names.
_TAGS = {"nav": 4.0, "menu": 4.0, "footer": 4.0, "aside": 4.0, "form": 4.0, "button": 4.0, "select": 4.0, "dialog": 4.0, "fieldset": 4.0, "header": 3.0}
_NAMES = dict.fromkeys("comment comments respond replies disqus".split(), 8.0)
_NAMES |= dict.fromkeys("nav navbar navigation menu menubar sidebar sidenav aside footer foot masthead breadcrumb breadcrumbs cookie cookies consent gdpr ads adv advert adverts advertisement advertising sponsor sponsored share sharing disqus newsletter subscribe subscription signup modal overlay pagination pager skip paywall".split(), 5.5)
_NAMES |= {"ad": 4.0} | dict.fromkeys("banner header notice notices alert promo promotion social reply discussion related recommended login search widget popup toolbar copyright toc".split(), 3.0)
_GOOD = frozenset("article content main post entry story body text prose".split())
_ROLES = frozenset("navigation complementary contentinfo search dialog alert".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What the classifier sees of a block, and the weights that it has before it has learned anything.
FEATURES = {"bias": -0.3, "link_density": -4.0, "length": 1.2, "short": -0.7, "sentence": 0.8, "heading": 0.7, "item": -0.3, "group_share": 1.0, "group_links": -1.5, "copyright": -1.5, "good_name": 1.0, "inside": 2.5, "outside": -1.5, "tags": -1.0, "names": -1.0}
#: Features that are learned; the rest, read from tags and names, tell which blocks to learn from.
LEARNED = 10
#: Pages that training looks at, more or less, and blocks that it reads at most; how much a thousand of them count against the weights given.
PAGES, TRAIN_BLOCKS, EVIDENCE = 1000, 20_000, 0.5
#: Capacity of one unit of log odds, and of edges: siblings, cousins, other neighbours, and next but one under the same parent.
SCALE = 10
_SIBLING, _COUSIN, _NEIGHBOUR, _NEAR = 8, 4, 1, 2


@functools.lru_cache(4096)
def _cue(tag: str, attrs: str) -> tuple[bool, float, bool]:
    """Of an element: whether it is hidden, what its names take from what is in it, whether they speak of content."""
    against, good = 0.0, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0.0, False
        if name == "role" and value.lower() in _ROLES:
            against = max(against, 4.0)
        if name == "class" or name in ("id", "itemprop", "aria-label"):
            for word in value.split() if name == "class" else [value]:
                parts = [p.lower() for p in _PARTS.findall(word)]
                if parts:
                    # Of a compound name the boilerplate word is one part among others.
                    against = max(against, max(_NAMES.get(p, 0.0) for p in parts) * (1 + sum(p in _NAMES for p in parts) / len(parts)) / 2)
                    good |= not _GOOD.isdisjoint(parts)
    return False, against, good


class Node:
    """An open element. What a block needs to know of its ancestors is handed down when an element opens, so depth costs nothing."""

    __slots__ = ("tag", "number", "parent", "block", "links", "heading", "item", "hidden", "inside", "good", "by_tag", "by_name", "holds", "tags", "names")

    def __init__(self, tag: str, number: int, parent: "Node | None", attrs: str = ""):
        self.tag, self.number, self.parent = tag, number, parent
        hidden, self.by_name, good = _cue(tag, attrs) if attrs else (False, 0.0, False)
        above = parent or self
        if parent is None:
            self.links, self.heading, self.item, self.hidden, self.inside, self.good, self.block = 0, False, False, False, False, False, self
        else:
            self.links = above.links + (tag == "a")
            self.heading, self.item = above.heading or tag in _HEADINGS, above.item or tag in ("li", "option", "dt", "dd")
            self.hidden, self.good = above.hidden or hidden, above.good or good
            self.inside = above.inside or tag == "article" or tag == "main"
            self.block = above.block if tag in INLINE else self
        # The header of an article is the article's.
        self.by_tag = 0.0 if tag == "header" and above.inside else _TAGS.get(tag, 0.0)
        self.holds, self.tags, self.names = False, 0.0, 0.0


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def blocks_of(page: str) -> tuple[list[Block], bool]:
    """Text blocks of a page in order: runs of text between block-level tags, character references decoded, white space made one space, hidden elements left out;
    and whether the page has a main part or an article. Time is linear in the page's length, however deep it is nested."""
    root = Node("", 0, None)
    nodes = [root]
    opened: dict[str, int] = {}
    centre: dict[str, Node] = {}
    node = root
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text and not node.hidden:
                out.append(Block(text, node.block, min(linked, len(text))))
            parts.clear()
        linked = 0

    def leave(to: Node):
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not node.hidden:
            parts.append(page[at:stop])
            if node.links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if not (m[1] or m[4]):
            attrs = ((m[3] if m[2] else m[6]) or "").strip()
            if tag in RAW:
                if tag != "svg" or not attrs.endswith("/"):
                    end = _raw_end(tag).search(page, at)
                    at = end.end() if end else n
                if tag not in INLINE:
                    flush()
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in INLINE:
                flush()
                drop = _SAME.get(tag) or (("p",) if tag in _P_ENDS else ())
                if any(opened.get(t) for t in drop):
                    x = node
                    while x.number and x.tag not in _ENDS_SEARCH:
                        if x.tag in drop:
                            leave(x.parent)
                            break
                        x = x.parent
            if tag in VOID:
                continue
            node = Node(tag, len(nodes), node, "" if tag in ("html", "body") else attrs)
            nodes.append(node)
            opened[tag] = opened.get(tag, 0) + 1
            if tag in ("article", "main", "h1") and tag not in centre and not node.by_name and (tag != "article" or not _within(node.parent)):
                centre[tag] = node
        else:
            if tag not in INLINE:
                flush()
            if opened.get(tag):
                x = node
                while x.tag != tag:
                    x = x.parent
                leave(x.parent)
    flush()
    # The page's centre is its main part, else its first article that isn't part of something else, else its first heading. What is around it isn't judged by its name.
    x = next((centre[t] for t in ("main", "article", "h1") if t in centre), None)
    while x is not None:
        x.holds = True
        x = x.parent
    for x in nodes[1:]:
        x.tags, x.names = (max(above, 0.0 if x.holds else own) for above, own in ((x.parent.tags, x.by_tag), (x.parent.names, x.by_name)))
    return out, "main" in centre or "article" in centre


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I)


def _within(node: Node | None) -> bool:
    """Whether something around is named like boilerplate (forms aside, which may be wrapped around whole pages). Only asked until a page's first article is found."""
    while node is not None:
        if (node.by_tag or node.by_name) and node.tag != "form":
            return True
        node = node.parent
    return False


def features(blocks: list[Block], has_centre: bool) -> np.ndarray:
    """A row of FEATURES for each block. A block's group are the blocks under the same parent: its share of the page's text outside links, and its own share of links."""
    group = np.array([(b.node.parent or b.node).number for b in blocks])
    size, linked = np.array([len(b.text) for b in blocks], float), np.array([b.linked for b in blocks], float)
    _, group = np.unique(group, return_inverse=True)
    total, links = np.bincount(group, size), np.bincount(group, linked)
    nodes = [b.node for b in blocks]
    flag = lambda f: np.array([f(x) for x in nodes], float)
    heading, inside = flag(lambda x: x.heading), flag(lambda x: x.inside)
    return np.stack(
        [
            np.ones(len(blocks)), linked / size, np.minimum(size, 200) / 200, (size < 25) * (1 - heading), np.array([b.text[-1] in ".!?…。" for b in blocks], float), heading, flag(lambda x: x.item),
            (total - links)[group] / max(1.0, (size - linked).sum()), links[group] / total[group], np.array(["©" in b.text or "(c)" in b.text[:4].lower() for b in blocks], float),
            flag(lambda x: x.good), inside, (1 - inside) * has_centre, flag(lambda x: x.tags), flag(lambda x: x.names),
        ],
        1,
    )


PRIOR = np.array(list(FEATURES.values()))


def train(rows: np.ndarray, *, evidence: float = EVIDENCE, steps: int = 300) -> np.ndarray:
    """Weights fitted by logistic regression to blocks whose tags and names leave no doubt, from what else there is to see of them.

    Those labels are no input of what is learned, so it also serves where tags and names say nothing. Weights start as FEATURES has them and are drawn back to that;
    without blocks of both kinds they stay so.
    """
    if not len(rows):
        return PRIOR.copy()
    cues = rows[:, LEARNED:] @ PRIOR[LEARNED:]
    rows, label = rows[np.abs(cues) >= 2, :LEARNED], (cues[np.abs(cues) >= 2] > 0).astype(float)
    if label.min(initial=1) == label.max(initial=0):
        return PRIOR.copy()
    # Both kinds count alike, however many blocks of a kind there are.
    each = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum()) * evidence * min(len(rows) / 1000, 10)
    w = PRIOR[:LEARNED].copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        w -= 0.3 * (rows.T @ (each * (p - label)) + 0.05 * (w - PRIOR[:LEARNED]))
    return np.append(w, PRIOR[LEARNED:])


def costs(rows: np.ndarray, weights: np.ndarray = PRIOR) -> tuple[list[int], list[int]]:
    """Capacities from the content terminal and to the boilerplate terminal: a block's log odds, for or against, to a tenth."""
    z = np.rint(np.clip(rows @ weights, -50, 50) * SCALE).astype(int)
    return np.maximum(z, 0).tolist(), np.maximum(-z, 0).tolist()


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity): neighbours in page order, stronger for siblings and cousins; and next but one under the same parent."""
    up = lambda x: x.parent or x
    own = [b.node for b in blocks]
    parent = [up(x) for x in own]
    above = [up(x) for x in parent]
    out = []
    for i in range(len(blocks) - 1):
        same = own[i] is own[i + 1] or parent[i] is parent[i + 1]
        out.append((i, i + 1, _SIBLING if same else _COUSIN if above[i] is above[i + 1] else _NEIGHBOUR))
        if i + 2 < len(blocks) and parent[i] is parent[i + 2]:
            out.append((i, i + 2, _NEAR))
    return out


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node, whether it lies on the source's side of a minimum cut (nodes that could lie on either side: the source's, unless nothing joins them to it).

    Flow along source - node - sink is taken first; the rest is Dinic's algorithm between nodes with capacity left, with explicit stacks.
    """
    n = len(source)
    both = [min(a, b) for a, b in zip(source, sink)]
    left, drain = [a - c for a, c in zip(source, both)], [b - c for b, c in zip(sink, both)]
    if not any(drain):
        return [True] * n
    graph: list[list[list]] = [[] for _ in range(n)]
    for i, j, c in edges:
        a, b = [j, c, None], [i, c, None]
        a[2], b[2] = b, a
        graph[i].append(a)
        graph[j].append(b)
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if left[i] > 0]
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:
            reached |= drain[i] > 0
            for e in graph[i]:
                if e[1] > 0 and level[e[0]] < 0:
                    level[e[0]] = level[i] + 1
                    queue.append(e[0])
        if not reached:
            break
        nexts = [0] * n
        for s in [i for i in range(n) if left[i] > 0 and level[i] == 0]:
            while left[s] > 0:
                path, i = [], s
                while True:
                    if drain[i] > 0:
                        break
                    edges_i, k = graph[i], nexts[i]
                    while k < len(edges_i) and not (edges_i[k][1] > 0 and level[edges_i[k][0]] == level[i] + 1):
                        k += 1
                    nexts[i] = k
                    if k < len(edges_i):
                        path.append(edges_i[k])
                        i = edges_i[k][0]
                    elif path:
                        i = path.pop()[2][0]
                        nexts[i] += 1
                    else:
                        i = -1
                        break
                if i < 0:
                    break
                flow = min([left[s], drain[i], *(e[1] for e in path)])
                left[s] -= flow
                drain[i] -= flow
                for e in path:
                    e[1] -= flow
                    e[2][1] += flow
    # Everything that can still reach the sink is on its side.
    side = [True] * n
    stack = [i for i in range(n) if drain[i] > 0]
    for i in stack:
        side[i] = False
    while stack:
        i = stack.pop()
        for e in graph[i]:
            if side[e[0]] and e[2][1] > 0:
                side[e[0]] = False
                stack.append(e[0])
    return side


def extract(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """Content blocks of a page, joined by newlines; empty if there are none. Nesting of any depth takes time in proportion to the page's length."""
    blocks, has_centre = blocks_of(page) if page else ([], False)
    if not blocks:
        return ""
    source, sink = costs(features(blocks, has_centre), weights)
    return "\n".join(b.text for b, keep in zip(blocks, minimum_cut(source, sink, edges_of(blocks))) if keep)


def fit(pages: DataFrame, *, limit: int = TRAIN_BLOCKS) -> np.ndarray:
    """Weights from at most `limit` blocks of about PAGES pages, chosen by a hash of page_id and url in the tasks that read them. Pages that agree in both count once; an empty table gives PRIOR."""
    ship_code(pages.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks, has_centre = blocks_of(page or "")
                if blocks:
                    rows = features(blocks, has_centre)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array(np.arange(len(rows))), pa.array(list(rows), pa.list_(pa.float64()))], names=["h", "i", "x"])

    every = max(1, pages.count() // PAGES)
    keyed = pages.select(F.xxhash64("page_id", "url").alias("h"), "html")
    chosen = keyed.where(F.pmod("h", F.lit(every)) == 0).groupBy("h").agg(F.max("html").alias("html"))
    rows = chosen.mapInArrow(tidy(each), "h long, i long, x array<double>").orderBy("h", "i").limit(limit).collect()
    return train(np.array([r["x"] for r in rows]))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page's whole html; one narrow pass, no shuffle, after the classifier has been fitted to a sample (see fit()).

    Null and empty html, and pages without content, give an empty text. Repeated rows stay apart, null ids and urls stay null, an empty table
    gives no rows, other columns are ignored.
    """
    spark = pages.sparkSession
    ship_code(spark)
    weights = fit(pages)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [extract(h, weights) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return spread(pages.select("page_id", "url", "html")).mapInArrow(tidy(each), "page_id long, url string, text string, n_chars long")
