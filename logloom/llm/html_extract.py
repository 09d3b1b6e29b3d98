"""HTML extraction: a tree-structured graphical model over DOM blocks.

Each block of a page is a node that is content or not. What a block is like (tag, words of class, id and role,
length of its text, share of links, whether it stands in a block marked as a menu, advert and the like) gives its own potential;
parent-child potentials tie neighbours together. Sum-product messages up and then down the tree give the marginals; the
text of the blocks that are content with probability over one half is the page's text. The potentials are log-linear
and trained by likelihood, whose gradient is what the labels have less what the marginals expect, on pages whose mark-up
labels them: blocks within <article> or <main> and in none of its navigation, forms, asides and the like are content. These two
tags are hidden from the features, and pages are learnt from with and without them, so that the model finds the content of pages that lack them.
"""

from __future__ import annotations

import html as _html
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored, table

#: Labelled pages that the potentials are trained on: at most so many, those of the smallest hashes of their ids.
SAMPLE = 2000
ROUNDS = 16  # steps of training, at most
SETTLED = 3  # steps one after the other that leave no block of the sample on the wrong side, after which training ends
WRONG = ""  # beside the features in a gradient: the blocks on the wrong side
SUPPORT = 5  # pages of the sample that must have a feature

#: Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title textarea select button svg iframe object canvas audio video datalist math".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
#: A start tag closes an open element of these, up to one of the others.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Words of a class, id or role that mark blocks that are not content, or content.
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies "
    "copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination "
    "popup promo promoted promotion rail related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar warning widget alert".split()
)
CONTENT = frozenset("article articlebody body content entry main post postbody story text".split())
NOT_CONTENT_TAGS = frozenset("nav header footer aside form menu dialog search fieldset".split())

#: Beside words of both kinds, these make a block a mere wrapper of both.
WRAPS = frozenset("container has layout no with wrap wrapper".split())
TOPS = frozenset(("#", "html", "body"))
LABELS = frozenset(("article", "main"))  # the tags that label training pages

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S
)
_ATTR = re.compile(r"(?i)\b(class|id|role)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = re.compile(r"[.!?…。](?:\s|$)")


class Block:
    __slots__ = ("tag", "parts", "parent", "text", "linked", "plain", "under")

    def __init__(self, tag: str, parts: frozenset, parent: int):
        self.tag, self.parts, self.parent = tag, parts, parent
        self.text: list[str] = []
        self.linked = self.plain = 0  # characters inside and outside links
        self.under = False  # whether this or what it is part of is marked as not content


class _Open:
    """The open elements, with what is asked of them at each tag kept up to date, so that deep pages cost no more than flat ones."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = [("#", 0, 0)]  # tag, its block, number of block elements up to here
        self.at: dict[str, list[int]] = {}  # places of each tag
        self.skip = 0  # hidden elements

    def has(self, tag: str) -> bool:
        return bool(self.at.get(tag))

    def push(self, tag: str, block: int):
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, block, self.stack[-1][2] + (tag in BLOCKS)))
        self.skip += tag in HIDDEN

    def cut(self, i: int):
        """Close all elements from place i on."""
        while len(self.stack) > i:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            self.skip -= tag in HIDDEN

    def blocks_after(self, i: int) -> int:
        return self.stack[-1][2] - self.stack[i][2]


def parse(html: str | None) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks, parents before children, and the runs of text with their blocks, in page order. Time goes with the page's length."""
    blocks = [Block("#", frozenset(), -1)]
    runs: list[tuple[int, str]] = []
    open_ = _Open()
    at, n, html = 0, len(html or ""), html or ""

    def text(s: str):
        if s and not open_.skip:
            own = open_.stack[-1][1]
            b, s = blocks[own], _html.unescape(s)
            k = len(s) - s.count(" ")
            if open_.has("a"):
                b.linked += k
            else:
                b.plain += k
            b.text.append(s)
            runs.append((own, s))

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = _TOKEN.match(html, lt)
        if not m:
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if tag == "br":
            text("\n")
            continue
        if m[1]:
            if open_.has(tag):
                i = open_.at[tag][-1]
                if tag in BLOCKS or tag == "a" or tag in HIDDEN or not open_.blocks_after(i):
                    open_.cut(i)
            continue
        if tag in CLOSES_P and open_.has("p"):
            open_.cut(open_.at["p"][0])
        if tag in SIBLINGS:
            closes, stops = SIBLINGS[tag]
            top = max((open_.at[t][-1] for t in stops if open_.has(t)), default=0)
            over = [i for t in closes for i in (open_.at.get(t) or [])[-1:] if i > top]
            while over:
                open_.cut(max(over))
                over = [i for t in closes for i in (open_.at.get(t) or [])[-1:] if i > top]
        if tag == "a" and open_.has("a") and not open_.blocks_after(open_.at["a"][-1]):
            open_.cut(open_.at["a"][-1])
        own = open_.stack[-1][1]
        if tag in BLOCKS:
            attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3])}
            parts = frozenset(_PART.findall(_CAMEL.sub(" ", " ".join(attrs.get(k, "") for k in ("class", "id", "role"))).lower()))
            blocks.append(Block(tag, parts, own))
            own = len(blocks) - 1
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag != "a":
            continue
        open_.push(tag, own)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = close.start() if close else n
    within = [b.linked + b.plain for b in blocks]
    for i in range(len(blocks) - 1, 0, -1):
        within[blocks[i].parent] += within[i]
    for b, k in zip(blocks[1:], within[1:], strict=True):  # a form that most of the page stands in is no form to fill in
        b.under = blocks[b.parent].under or mark(b) == "not" and not (b.tag == "form" and 2 * k > within[0])
    return blocks, runs


def mark(b: Block) -> str:
    """'not' or 'yes' where tag, class, id or role say so, else ''. <article> and <main> say nothing but by their class, id or role."""
    if b.tag in LABELS:
        return "not" if b.parts & {"comment", "comments", "reply"} else ""
    if b.tag in NOT_CONTENT_TAGS:
        return "not"
    yes, no = bool(b.parts & CONTENT), bool(b.parts & NOT_CONTENT)
    if b.tag in TOPS or yes and no and b.parts & WRAPS:
        return ""
    return "not" if no else "yes" if yes else ""


def features(b: Block) -> list[str]:
    """What a block is like. What stands in a marked block has features of its own, so that it is not judged by what is outside."""
    if b.tag in TOPS:
        return []
    m = mark(b)
    out = [f"tag={'section' if b.tag in LABELS else b.tag}", *(f"word={w}" for w in b.parts)]
    n = b.linked + b.plain
    if n:
        out.append(f"length={min(int(math.log2(n)), 9)}")
        out.append(f"links={round(3 * b.linked / n)}")
        out.append(f"ends={bool(_END.search(''.join(b.text)))}")
    if b.under:
        return ["in", *(["mark=not"] if m == "not" else []), *("in " + f for f in out)]
    return [*out, *(["mark=yes"] if m == "yes" else [])]


def labels(blocks: list[Block]) -> list[bool] | None:
    """Content or not for each block, as the page's own mark-up says; None where it has no article or main."""
    out: list[bool] = []
    for b in blocks:
        out.append(not b.under and (b.parent >= 0 and out[b.parent] or b.tag in LABELS))
    return out if any(out) else None


def edge(blocks: list[Block], b: Block) -> str:
    """The kind of tie between a block and its parent."""
    up = blocks[b.parent]
    return "top" if up.tag in TOPS else "in" if up.under else "out" if b.under else "yes" if mark(b) else "plain"


#: The weights' prior means, what is known of HTML before any page is seen; 0 where nothing is said.
PRIOR = {
    "in": -2.0, "mark=not": -1.5, "mark=yes": 1.5, "in ends=True": -0.5, "in links=3": -0.5,
    "tag=p": 1.0, "tag=h1": 0.5, "tag=h2": 0.5, "tag=h3": 0.5, "tag=blockquote": 0.5, "tag=pre": 0.5,
    "links=0": 0.5, "links=2": -1.0, "links=3": -1.5, "ends=True": 0.5, "ends=False": -0.5,
    **{f"length={i}": -0.3 if i < 5 else 0.0 if i < 7 else 0.5 for i in range(10)},
}
#: Prior means of the ties, by kind, for (parent, child) of (0, 0), (0, 1), (1, 0), (1, 1).
PRIOR_EDGES = {"plain": (2.5, -2.5, -2.5, 2.5), "in": (1.5, -1.5, 0.0, 0.0), "out": (0.5, -0.5, 0.5, -0.5), "yes": (0.0, 0.0, 0.0, 0.0), "top": (0.0, 0.0, 0.0, 0.0)}
#: The prior's weight: that of so many observations, whatever the number of pages.
PRIOR_COUNTS = 4.0


def _exp(x: float) -> float:
    return math.exp(max(-300.0, min(300.0, x)))


def messages(own: list[float], parent: list[int], ties: list[tuple[float, ...]]) -> tuple[list[float], list[float], list[float]]:
    """(log odds of each node, its log odds without what comes from above, its parent's without what comes from it).

    own: log odds of each node by itself, parents before children; ties: four log potentials of each node and its parent.
    Messages go from the leaves to the root, then back.
    """
    n = len(own)
    up, low, rest, out = [0.0] * n, own[:], [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        e = _exp(low[i])
        t = ties[i]
        up[i] = math.log((_exp(t[2]) + _exp(t[3]) * e) / (_exp(t[0]) + _exp(t[1]) * e))
        low[parent[i]] += up[i]
    out[0] = low[0]
    for i in range(1, n):
        rest[i] = out[parent[i]] - up[i]
        e = _exp(rest[i])
        t = ties[i]
        out[i] = low[i] + math.log((_exp(t[1]) + _exp(t[3]) * e) / (_exp(t[0]) + _exp(t[2]) * e))
    return out, low, rest


def _probability(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


class Model:
    """Weights of features, and of the ties as "kind:parent child" ("plain:01"); those not given are as in the prior."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = prior() | (weights or {})
        self.edges = {k: tuple(self.weights[f"{k}:{y}"] for y in _TIES) for k in PRIOR_EDGES}

    def potential(self, b: Block) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(b))

    def marginals(self, blocks: list[Block]) -> list[float]:
        """P(content) of each block."""
        own = [self.potential(b) for b in blocks]
        ties = [self.edges[edge(blocks, b)] if i else (0.0,) * 4 for i, b in enumerate(blocks)]
        return [_probability(x) for x in messages(own, [b.parent for b in blocks], ties)[0]]


_TIES = ("00", "01", "10", "11")


def prior() -> dict[str, float]:
    return PRIOR | {f"{k}:{y}": v for k, ties in PRIOR_EDGES.items() for y, v in zip(_TIES, ties, strict=True)}


def main_text(model: Model, html: str | None) -> str:
    """Text of the content blocks in page order; white space within a block is one space, and so are blocks' ends."""
    blocks, runs = parse(html)
    if not runs:
        return ""
    keep = [p > 0.5 for p in model.marginals(blocks)]
    out, last = [], -1
    for b, s in runs:
        if b != last:
            out.append(" ")
            last = b
        if keep[b]:
            out.append(s)
    return " ".join("".join(out).split())


def _unwrapped(blocks: list[Block], y: list[bool]) -> tuple[list[Block], list[bool]]:
    """The page as it would be without its <article> and <main>: what they hold stands in what holds them."""
    at, kept, left = {}, [], []
    for i, b in enumerate(blocks):
        if b.tag in LABELS:
            at[i] = at[b.parent]
            continue
        at[i] = len(kept)
        new = Block(b.tag, b.parts, at[b.parent] if i else -1)
        new.text, new.linked, new.plain, new.under = b.text, b.linked, b.plain, b.under
        kept.append(new)
        left.append(y[i])
    return kept, left


def _labelled(batches):
    """(features, parents, ties, labels) of each page that its mark-up labels, with and without the tags that do so; features as one string a block."""
    for pdf in batches:
        out = []
        for h in pdf["html"]:
            blocks, _ = parse(h)
            y = labels(blocks)
            for blocks, y in ((blocks, y), _unwrapped(blocks, y)) if y else ():
                out.append((["\t".join(features(b)) for b in blocks], [b.parent for b in blocks], [edge(blocks, b) if i else "" for i, b in enumerate(blocks)], y))
        yield pd.DataFrame(out, columns=["features", "parents", "ties", "labels"])


def gradient(weights: dict[str, float], pages) -> dict[str, float]:
    """For each weight, what the labels have less what the marginals expect, summed over pages; under WRONG the blocks whose marginals contradict their labels."""
    total: dict[str, float] = {}
    edges = {k: tuple(weights[f"{k}:{y}"] for y in _TIES) for k in PRIOR_EDGES}
    none = (0.0,) * 4

    def add(key: str, seen: float, p: float):
        total[key] = total.get(key, 0.0) + seen - p

    for fs, parents, kinds, ys in pages:
        names = [f.split("\t") if f else () for f in fs]
        own = [sum(weights.get(f, 0.0) for f in x) for x in names]
        ties = [edges.get(k, none) for k in kinds]
        out, low, rest = messages(own, parents, ties)
        for i, (x, y) in enumerate(zip(names, ys, strict=True)):
            p = _probability(out[i])
            if (p > 0.5) != y:
                total[WRONG] = total.get(WRONG, 0.0) + 1
            for f in x:
                if f in weights:
                    add(f, y, p)
            if i:
                w = [_exp(t + rest[i] * (k > 1) + low[i] * (k % 2) - max(0.0, rest[i]) - max(0.0, low[i])) for k, t in enumerate(ties[i])]
                for k, v in enumerate(w):
                    add(f"{kinds[i]}:{_TIES[k]}", k == 2 * ys[parents[i]] + y, v / sum(w))
    return total


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Potentials of the greatest likelihood, with a prior of the weight of PRIOR_COUNTS observations, on at most `sample` labelled pages.

    The sample is of pages with an id, a page each. Pages whose mark-up labels nothing add nothing; without labelled pages the prior stands.
    Each round is one pass over the sample's parsed pages, and the last is the third one after the other that found all of its blocks on the right side; what comes to the driver is two sums for each feature that SUPPORT pages of the sample have.
    """
    ids = pages.select(quoted(id_col).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = pages.select(quoted(id_col).alias("_id"), quoted(html_col).alias("html")).join(F.broadcast(ids), "_id")
    rows = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("html"), "html")).alias("r")).select("r.html")
    parsed = stored(rows.mapInPandas(_labelled, "features array<string>, parents array<int>, ties array<string>, labels array<boolean>"))
    known = parsed.select(F.explode(F.array_distinct(F.flatten(F.transform("features", lambda f: F.split(f, "\t"))))).alias("f")).where("f <> ''")
    known = known.groupBy("f").count().where(F.col("count") >= SUPPORT).select("f").toArrow()["f"].to_pylist()
    mean = {f: 0.0 for f in known} | prior()
    weights, steps, last = dict(mean), dict.fromkeys(mean, 0.25), dict.fromkeys(mean, 0.0)
    right = 0
    for _ in range(rounds if known else 0):
        shared = parsed.sparkSession.sparkContext.broadcast(weights)

        def sums(batches, shared=shared):
            for pdf in batches:
                got = gradient(shared.value, zip(pdf["features"], (x.tolist() for x in pdf["parents"]), pdf["ties"], (x.tolist() for x in pdf["labels"]), strict=True))
                yield pd.DataFrame({"f": pd.Series([*got], dtype=object), "g": pd.Series([*got.values()], dtype=float)})

        got = parsed.mapInPandas(sums, "f string, g double").groupBy("f").agg(F.sum("g").alias("g")).toArrow()
        got = dict(zip(got["f"].to_pylist(), got["g"].to_pylist(), strict=True))
        for f, w in weights.items():  # resilient steps: longer while the gradient keeps its sign, shorter when it turns
            g = got.get(f, 0.0) - PRIOR_COUNTS * (w - mean[f])
            turned = g * last[f] < 0
            steps[f] = max(steps[f] / 2, 1e-3) if turned else min(steps[f] * 1.2, 1.0) if g * last[f] > 0 else steps[f]
            last[f] = 0.0 if turned else g
            weights[f] = w + steps[f] * float(np.sign(last[f]))
        weights = dict(weights)
        shared.unpersist()
        right = 0 if got.get(WRONG) else right + 1
        if right == SETTLED:
            break
    return Model(weights)


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """pages with `text` and `n_chars` (code points) in place of the html and of columns of these names. A row for each row, repeated ones too.

    Null, empty and contentless html: '' and 0. Pages of any length and depth are parsed whole.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(shared.value, h) for h in htmls], dtype=object)

    kept = [quoted(c) for c in pages.columns if c not in (html_col, text_col, chars_col)]
    return pages.select(*kept, run(quoted(html_col)).alias(text_col)).withColumn(chars_col, F.length(quoted(text_col)).cast("long"))


def op9(spark, sf_dir):
    """(page_id, url, text, n_chars), a row for each row of pages, null ids and repeated rows included; null and empty html: '' and 0.

    The model is trained on SAMPLE of the same pages, labelled by their own mark-up.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages))
