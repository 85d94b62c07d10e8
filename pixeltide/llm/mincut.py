"""Main text of HTML pages by minimum cut: block costs are terminal capacities, order and DOM nearness are smoothness edges."""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the block classifier is fitted on (a documented bound; every page is then cut).
TRAIN_PAGES = 2000
#: Strength of an edge between blocks that follow each other, and between blocks of one parent element.
NEXT, SIBLING = 0.6, 0.9

# Element groups, fixed values of the HTML standard.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td"
    " template tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NO_TEXT = frozenset("script style head title template textarea iframe noembed noframes noscript select option button object audio video canvas svg math".split())
_CLOSES_P = _BLOCK - frozenset("html head body title noscript template option button caption tbody td tfoot th thead tr legend".split())
_ENDED_BY = {
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
_SCOPE = frozenset("ul ol dl table td th body html article section main aside nav div form blockquote select".split())

# What element names and the words of class, id and role say: a hand-written prior that the fit starts from.
_GOOD_TAGS = frozenset("article main".split())
_BAD_TAGS = frozenset("nav footer aside form button select label dialog menu".split())
_GOOD_WORDS = frozenset("article content entry main post story body text articlebody".split())
_BAD_WORDS = frozenset(
    "ad ads adv advert advertisement adverts alert banner bar breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright"
    " disclaimer discussion disqus footer form gdpr header links login masthead menu modal nav navbar navigation newsletter notice notices overlay"
    " pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip"
    " social sponsor sponsored subscribe tags toolbar toc topbar widget widgets".split()
)
_CUES = ("good_tag", "bad_tag", "good_word", "bad_word", "page_header")
_PLAIN = ("bias", "heading", "paragraph", "item", "linked", "half_linked", "short", "long", "sentence", "many_words")
_NAMES = _CUES + _PLAIN
_PRIOR = np.array([3.0, -4.0, 1.5, -4.0, -4.0, 0.0, 1.0, 1.5, -0.5, -3.0, -1.0, -0.5, 0.8, 0.5, 0.8])

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAME = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    tag: str
    parent: Element | None
    cues: int = 0
    silent: bool = False
    inside_main: bool = False


@dataclass
class Block:
    text: str
    element: Element
    linked: float


def _open(tag: str, attributes: str, parent: Element | None) -> Element:
    cues = parent.cues if parent else 0
    silent = (parent.silent if parent else False) or tag in _NO_TEXT
    inside = (parent.inside_main if parent else False) or tag in _GOOD_TAGS
    if tag in _GOOD_TAGS:
        cues |= 1
    if tag in _BAD_TAGS:
        cues |= 2
    if tag == "header" and not inside:
        cues |= 16
    if attributes:
        for name, value in _NAME.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("hidden", "aria-hidden"):
                silent |= value != "false" and (name == "hidden" or value == "true")
            elif name == "style":
                silent |= bool(_HIDES.search(value))
            elif tag not in ("html", "body"):
                words = _WORD.findall(value)
                if not _GOOD_WORDS.isdisjoint(words):
                    cues |= 4
                if not _BAD_WORDS.isdisjoint(words):
                    cues |= 8
    return Element(tag, parent, cues, silent, inside)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order. Whatever is malformed is read as leniently as browsers do; nothing fails."""
    root = top = Element("#page", None)
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    holder = root
    links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, holder, min(1.0, linked / max(len(text), 1))))
            parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not top.silent:
            if not parts:
                holder = top
                while holder.tag not in _BLOCK and holder.parent:
                    holder = holder.parent
            chunk = page[at:end]
            parts.append(chunk)
            if links:
                linked += len(chunk.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            node = top
            while node is not root and node.tag != name and not (name not in _BLOCK and node.tag in _SCOPE):
                node = node.parent
            if name in _BLOCK or name == "br":
                flush() if name in _BLOCK else parts.append(" ")
            if node is not root and node.tag == name:
                while top is not node:
                    links -= top.tag == "a"
                    top = top.parent
                links -= top.tag == "a"
                top = node.parent
            continue
        attributes = m[3] if m[2] else m[6]
        if name == "br":
            parts.append(" ") if parts else None
            continue
        if name in _BLOCK:
            flush()
        enders = _ENDED_BY.get(name)
        node = top
        while node is not root and (enders or name in _CLOSES_P):
            if (name in _CLOSES_P and node.tag == "p") or (enders and node.tag in enders):
                while top is not node:
                    links -= top.tag == "a"
                    top = top.parent
                top = node.parent
                if not (enders and node.tag == "p"):
                    break
                node = top
                continue
            if node.tag in _SCOPE:
                break
            node = node.parent
        if name in _VOID:
            continue
        if name == "body":
            while top is not root and top.tag != "html":
                top = top.parent
        top = _open(name, attributes, top)
        links += name == "a"
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            top = top.parent
    flush()
    return found


def _features(block: Block) -> list[int]:
    cues, text = block.element.cues, block.text
    words = text.count(" ") + 1
    tag = block.element.tag
    return [
        *((cues >> k) & 1 for k in range(5)),
        1,
        tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
        tag in ("p", "blockquote", "pre", "figcaption", "td", "dd"),
        tag in ("li", "dt"),
        block.linked > 0.8,
        0.3 < block.linked <= 0.8,
        words <= 3,
        words >= 15,
        text[-1] in ".!?…。\"'”»",
        words >= 50,
    ]


def _label(block: Block) -> int | None:
    """What plain markup says of a block: content, boilerplate, or nothing."""
    cues = block.element.cues
    if cues & 0b11010:
        return 0
    return 1 if cues & 0b00101 else None


def fit_costs(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES, pull: float = 200.0) -> np.ndarray:
    """Weights of a logistic block classifier.

    Blocks that plain markup decides (inside article or main, inside nav, footer, form, adverts, ...) of about ``train_pages`` pages
    are its labelled rows; each also counts once with the markup cues hidden, so the shape of a block learns to speak for pages
    without such markup. Distinct feature rows and their counts (a few thousand at most) reach the driver. ``pull`` holds the weights
    to the written prior, which alone decides where there is nothing to learn from.
    """
    total = pages.count()
    draw = F.pmod(F.xxhash64(html_col), F.lit(1_000_000)) < int(1_000_000 * train_pages / max(total, 1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for b in blocks(page or ""):
                    label = _label(b)
                    if label is not None:
                        code = sum(int(x) << k for k, x in enumerate(_features(b)))
                        counts[code, label] = counts.get((code, label), 0) + 1
        rows = list(counts.items())
        columns = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [n for _, n in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["code", "label", "n"])

    seen = pages.filter(draw).select(F.col(html_col).cast("string")).mapInArrow(run, "code long, label long, n long")
    rows = seen.groupBy("code", "label").agg(F.sum("n").alias("n")).collect()
    weights = _PRIOR.copy()
    if not rows:
        return weights
    x = np.array([[(r.code >> k) & 1 for k in range(len(_NAMES))] for r in rows], float)
    y, n = np.array([r.label for r in rows], float), np.array([r.n for r in rows], float)
    hidden = x.copy()
    hidden[:, : len(_CUES)] = 0
    x, y, n = np.r_[x, hidden], np.r_[y, y], np.r_[n, n] / n.sum() * 1000
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ weights))
        slope = x.T @ (n * (p - y)) + pull * (weights - _PRIOR)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(weights))
        weights = weights - np.linalg.solve(curve, slope)
    return weights


def min_cut(content: list[float], boilerplate: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Per node whether it lies on the content side of the minimum cut.

    content[i] is paid if i is called boilerplate, boilerplate[i] if it is called content, edges[i, j] if the two differ.
    """
    n = len(content)
    source, sink = n, n + 1
    graph: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i in range(n):
        # Only the difference of a node's two costs can be part of a choice.
        least = min(content[i], boilerplate[i])
        if content[i] > least:
            graph[source][i], graph[i][source] = content[i] - least, 0.0
        if boilerplate[i] > least:
            graph[i][sink], graph[sink][i] = boilerplate[i] - least, 0.0
    for (i, j), w in edges.items():
        graph[i][j] = graph[i].get(j, 0.0) + w
        graph[j][i] = graph[j].get(i, 0.0) + w
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, room in graph[u].items():
                if room > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [i in level for i in range(n)]
        todo = {u: iter(list(graph[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(graph[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    graph[a][b] -= flow
                    graph[b][a] += flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if graph[a][b] <= 1e-12)
                del path[cut + 1 :]
                continue
            for v in todo[u]:
                if graph[u][v] > 1e-12 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                if path:
                    level[u] = -1


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    # Neighbours under one parent that look alike form one node: their costs add up, and no cut runs between them.
    nodes: list[tuple[tuple, Element | None, list[Block], float]] = []
    for b in found:
        f = tuple(int(x) for x in _features(b)[: len(_CUES)])
        parent = b.element.parent
        cost = float(weights @ np.array(_features(b), float)) * min(4.0, math.log2(2 + len(b.text)) / 3)
        if nodes and nodes[-1][0] == f and nodes[-1][1] is parent and (cost > 0) == (nodes[-1][3] > 0):
            nodes[-1][2].append(b)
            nodes[-1] = (f, parent, nodes[-1][2], nodes[-1][3] + cost)
        else:
            nodes.append((f, parent, [b], cost))
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, (_, parent, _, _) in enumerate(nodes):
        if i:
            edges[i - 1, i] = edges.get((i - 1, i), 0.0) + NEXT * (1.0 if parent is nodes[i - 1][1] else 0.5)
        if id(parent) in last_of:
            j = last_of[id(parent)]
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING
        last_of[id(parent)] = i
    side = min_cut([max(c, 0.0) for *_, c in nodes], [max(-c, 0.0) for *_, c in nodes], edges)
    return "\n".join(b.text for (_, _, own, _), keep in zip(nodes, side, strict=True) if keep for b in own)


def main_texts(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, weights: np.ndarray | None = None) -> DataFrame:
    """Columns ``keep`` of pages (default all) and text: blocks of the main content, one per line.

    A null or empty page, or one without content, gives an empty text. Repeated rows give repeated results. A column named text
    is replaced. Pages are cut one by one where they lie; nothing is shuffled.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    weights = fit_costs(pages, html_col) if weights is None else weights
    source = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    schema = pages.select(*keep, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)
