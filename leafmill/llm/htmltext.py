"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements; runs of text are its leaves.  Each node has features of its
subtree (text, links, tags, punctuation), of its attributes' tokens, of its depth and place, of its
siblings and of its ancestors.  Boosted trees give the probability that a node holds main text.  The
decoder picks the likeliest labelling in which nothing is kept below a node that is dropped.

The model is trained here by Spark's ``GBTClassifier`` on pages that a seeded generator lays out and
labels (``n_pages`` of them, a fixed bound), once in a session; its trees are small and travel with the
tasks.  Scripts, styles, the head, form controls, pictures and comments in the markup are never text; a
control without an end is passed over, and what follows it stays.

Defined results: null or empty html gives an empty text; broken markup is closed where a browser would
close it, roughly; repeated rows are extracted again; an empty table gives an empty result; columns of
the input named like a result column are replaced.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import bounded_batches

# Fixed values of HTML.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
SILENT = set("select option button svg object datalist canvas audio video".split())
NESTING = {"svg", "object"}
ENDS_P = BLOCK - {"html", "body"}
P_SCOPE = ENDS_P - {"p"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

GOOD = ("article", "content", "main", "post", "entry", "story", "text", "body", "prose")
POOR = ("nav", "menu", "header", "footer", "foot", "side", "sidebar", "widget", "banner", "cookie", "consent", "notice", "popup", "modal", "share", "social", "related", "recommend", "more", "breadcrumb", "tags", "meta", "subscribe", "newsletter", "login", "search", "pagination", "copyright", "toolbar", "alert", "gdpr", "legal")
ADS = ("ad", "ads", "advert", "advertisement", "promo", "sponsor", "sponsored", "adsense")
TALK = ("comment", "comments", "reply", "replies", "discussion", "respond", "disqus")
GROUPS = ({"#run"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"p", "blockquote", "pre", "figcaption"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}, {"div", "section"}, {"article", "main"}, {"nav", "header", "footer", "aside"}, {"form", "fieldset"})
GROUP = {t: i for i, g in enumerate(GROUPS) for t in g}
N_FEATURES = 44


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "text", "links", "start", "label")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple = ()):
        self.tag, self.parent, self.children, self.tokens = tag, parent, [], tokens
        self.text, self.links, self.start, self.label = "", 0, 0, 0


def parse(html: str) -> Node:
    """The tree of block elements; text runs are ``#run`` leaves, with the characters inside links counted."""
    root = Node("body", None)
    at, size, now, buffer, in_head = 0, len(html), root, [], False
    in_link, link_chars = None, 0
    unclosed: set[str] = set()
    # The open elements from the root down, and for each tag their places in that path.
    path, opened = [root], {}

    def flush() -> None:
        nonlocal link_chars
        if buffer:
            words = html_lib.unescape("".join(buffer)).split()
            buffer.clear()
            if words:
                run = Node("#run", now)
                run.text, run.links = " ".join(words), link_chars
                now.children.append(run)
        link_chars = 0

    def say(text: str) -> None:
        nonlocal link_chars
        if text and not in_head:
            buffer.append(text)
            if in_link is now:
                link_chars += len(text.strip())

    def close(names: set, scope: set) -> None:
        """Close the nearest open element of ``names`` that no element of ``scope`` encloses."""
        nonlocal now
        at = max((opened[t][-1] for t in names if opened.get(t)), default=0)
        if not at or at < len(path) - 1 and any(opened[t][-1] > at for t in scope if opened.get(t)):
            return
        flush()
        for n in path[at:]:
            opened[n.tag].pop()
        del path[at:]
        now = path[-1]

    def end_of(tag: str, at: int) -> int:
        """Where an element of this kind that opens before ``at`` ends; ``at`` if it has no end of its own."""
        depth, here = 1, at
        if tag in unclosed:
            return at
        for m in re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).finditer(html, at):
            depth += -1 if m[1] else 1
            if depth == 0:
                stop = html.find(">", m.end())
                return size if stop < 0 else stop + 1
            if not m[1] and tag not in NESTING:
                return here
        unclosed.add(tag)
        return here

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = TAG.match(html, lt)
        if not m:
            after = html[lt + 1 : lt + 3].lstrip("/")[:1]
            end = html.find(">", lt)
            if after.isalpha() and end >= 0:  # a tag with an open quote
                at = end + 1
            elif after.isalpha():
                break
            else:
                say("<")
                at = lt + 1
            continue
        at, shut, tag = m.end(), bool(m[1]), m[2].lower()
        if tag in RAW and not shut:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            stop = html.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else size
        elif tag in SILENT:
            if not shut and not m[3].endswith("/"):
                at = end_of(tag, at)
        elif tag == "head":
            in_head = not shut
        elif tag in ("html", "body"):
            if not shut:
                in_head = False
                flush()
        elif tag in BLOCK:
            in_head = False
            if shut:
                flush()
                close({tag}, set() if tag != "p" else P_SCOPE)
            else:
                flush()
                if tag in ENDS_P:
                    close({"p"}, P_SCOPE)
                if tag in ENDS:
                    close(ENDS[tag], SCOPE[tag])
                if tag != "hr":
                    tokens = tuple(w for a in ATTR.findall(m[3]) for w in re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", a).lower()))
                    child = Node(tag, now, tokens)
                    now.children.append(child)
                    now = child
                    opened.setdefault(tag, []).append(len(path))
                    path.append(child)
        elif tag == "a":
            in_link = None if shut else now
        elif tag == "br":
            say(" ")
    flush()
    return root


def flatten(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.children))
    return out


def _has(tokens: tuple, words: tuple) -> bool:
    return any(w in tokens for w in words)


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features for each node."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    up = [-1 if x.parent is None else index[id(x.parent)] for x in nodes]
    chars, links, tags, stops, words, paras, mark = ([0] * n for _ in range(7))
    start, depth = [0] * n, [0] * n
    seen = 0
    for i, x in enumerate(nodes):
        start[i] = seen
        if x.text:
            chars[i], links[i], words[i] = len(x.text), min(x.links, len(x.text)), x.text.count(" ") + 1
            stops[i] = sum(map(x.text.count, ".,;:!?"))
            mark[i] = int("\xa9" in x.text)
            seen += chars[i]
        tags[i], paras[i] = int(x.tag != "#run"), int(x.tag == "p")
    for i in range(n - 1, 0, -1):
        for a in (chars, links, tags, stops, words, paras, mark):
            a[up[i]] += a[i]
    total = max(1, seen)
    log = math.log1p
    out = np.zeros((n, N_FEATURES))
    flags: list[tuple] = []
    for i, x in enumerate(nodes):
        p = up[i]
        depth[i] = depth[p] + 1 if p >= 0 else 0
        tag = GROUP.get(x.tag, -1)
        own = (_has(x.tokens, GOOD), _has(x.tokens, POOR), _has(x.tokens, ADS), _has(x.tokens, TALK), tag == 7, tag == 8, tag == 9)
        above = flags[p] if p >= 0 else (False,) * 7
        flags.append(tuple(a or b for a, b in zip(own, above)))
        r = out[i]
        r[0], r[1], r[2], r[3] = log(chars[i]), links[i] / max(1, chars[i]), log(tags[i]), log(chars[i] / (tags[i] + 1))
        r[4], r[7], r[8], r[9] = depth[i], chars[i] / total, start[i] / total, (start[i] + chars[i]) / total
        r[10], r[11], r[12], r[13] = stops[i] / max(1, words[i]), log(words[i]), mark[i], log(paras[i])
        r[14:21] = own
        r[21:28] = above
        if tag >= 0:
            r[28 + tag] = 1
        if p >= 0:
            kin = nodes[p].children
            k = len(kin)
            r[6] = log(k)
            r[38] = (log(chars[p] - chars[i])) / max(1, k - 1) if k > 1 else 0
            r[39] = GROUP.get(nodes[p].tag, -1)
            r[40] = chars[i] / max(1, chars[p])
            r[41] = links[p] / max(1, chars[p])
            r[42] = log(chars[p])
            r[43] = log(paras[p])
        for j, c in enumerate(x.children):
            out[index[id(c)], 5] = j / len(x.children)
    return out


@dataclass(frozen=True)
class Forest:
    """Boosted trees as arrays: feature, threshold, left, right, value of each node; roots and weights of the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            margin += weight * self.value[at]
        return 1 / (1 + np.exp(-2 * margin))


def forest_of(model) -> Forest:
    """The arrays of a fitted ``GBTClassificationModel``, read from its printed trees."""
    nodes: list[list] = []
    roots = []

    def read(lines: list[tuple[int, str]]) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, 0.0])
        depth, line = lines.pop(0)
        if line.startswith("Predict:"):
            nodes[me][4] = float(line[8:])
        else:
            f, t = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
            nodes[me][:2] = int(f), float(t)
            nodes[me][2] = read(lines)
            lines.pop(0)  # Else
            nodes[me][3] = read(lines)
        return me

    for text in re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", "\n" + model.toDebugString.split("\n", 1)[1])[1:]:
        roots.append(read([(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip()]))
    cols = [np.array(c) for c in zip(*nodes)]
    return Forest(cols[0].astype(int), cols[1].astype(float), cols[2].astype(int), cols[3].astype(int), cols[4].astype(float), np.array(roots), np.array(model.treeWeights))


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """Keep or drop for each node, the likeliest labelling where a dropped node has no kept descendant."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weight = np.array([1.0 + math.log1p(len(x.text)) if x.tag == "#run" else 1.0 for x in nodes])
    keep, drop = weight * np.log(p), weight * np.log1p(-p)
    for i in range(n - 1, 0, -1):
        up = index[id(nodes[i].parent)]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    out = [False] * n
    for i, x in enumerate(nodes):
        out[i] = bool((i == 0 or out[index[id(x.parent)]]) and keep[i] > drop[i])
    return out


def main_blocks(htmls: list[str | None], forest: Forest, together: int = 200) -> list[list[str]]:
    """The texts of the main blocks of each page, in its order; ``together`` pages are scored at a time."""
    out = []
    for at in range(0, len(htmls), together):
        trees = [flatten(parse(h)) if isinstance(h, str) else [] for h in htmls[at : at + together]]
        scores = forest.probability(np.concatenate([np.zeros((0, N_FEATURES)), *[features(t) for t in trees if t]]))
        ends = np.cumsum([len(t) for t in trees])
        for nodes, end in zip(trees, ends):
            kept = decode(nodes, scores[end - len(nodes) : end]) if nodes else []
            out.append([x.text for x, k in zip(nodes, kept) if k and x.tag == "#run"])
    return out


@dataclass(frozen=True)
class HtmlParams:
    n_pages: int = 500
    seed: int = 11
    trees: int = 20
    depth: int = 5
    step: float = 0.3


def labelled_pages(n: int, seed: int, held_out: bool = False) -> list[str]:
    """Pages of many layouts; main text is marked by U+0001 at the start of each of its runs."""
    from leafmill.llm.htmlpages import page

    rng = random.Random(seed)
    return [page(rng, held_out) for _ in range(n)]


def labelled_nodes(html: str) -> tuple[np.ndarray, list[int]]:
    nodes = flatten(parse(html))
    for x in nodes:
        if x.text.startswith("\x01"):
            x.text = x.text[1:].lstrip()
            a = x
            while a is not None:
                a.label, a = 1, a.parent
    return features(nodes), [x.label for x in nodes]


_TRAINED: dict = {}


def train(spark: SparkSession, params: HtmlParams = HtmlParams()) -> Forest:
    """Boosted trees fitted by Spark on generated pages; the same for the same parameters."""
    key = (spark.sparkContext.applicationId, params)
    if key not in _TRAINED:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import array_to_vector

        rows = []
        for html in labelled_pages(params.n_pages, params.seed):
            x, y = labelled_nodes(html)
            rows += [(r.tolist(), float(v)) for r, v in zip(x, y)]
        data = spark.createDataFrame(pd.DataFrame(rows, columns=["x", "label"]), "x array<double>, label double").repartition(spark.sparkContext.defaultParallelism)
        gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=params.trees, maxDepth=params.depth, stepSize=params.step, seed=params.seed, maxBins=64, cacheNodeIds=True)
        _TRAINED[key] = forest_of(gbt.fit(data.select(array_to_vector("x").alias("features"), "label")))
    return _TRAINED[key]


def extract_text(pages: DataFrame, forest: Forest | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with ``blocks``, the texts of the main blocks, and ``text``, those joined by line feeds."""
    forest = forest or train(pages.sparkSession)
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("array<string>")
    def blocks(htmls: pd.Series) -> pd.Series:
        return pd.Series(main_blocks(list(htmls), forest), dtype=object)

    return pages.withColumn("blocks", blocks.asNondeterministic()(F.col(html_col))).withColumn("text", F.array_join("blocks", "\n"))
