"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node that is content or not.  A node's own evidence (its name, the words in its class
and id, how much text it has and how much of that is links, its share of the page's text outside menus, headers and the like,
how much of that stands in paragraphs right below it or beside it) and potentials between parent and child, which differ by kind
of child, make one distribution over the whole tree.  Sum-product messages, upward and then downward, give the exact
marginal of every node; a page's text is the text of its nodes that are content more likely than not.  The weights are
fitted to labelled pages with the exact gradient that the same messages give.  All pages of a batch are one forest, and
messages are sent level by level in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import CARRIED, carried
from sievework.llm.dom import Node, Page, parse
from sievework.llm.html_labels import labelled_pages

# Element names by role, and the words that name a role in classes and ids.
GROUPS = {
    "nav": "nav menu",
    "header": "header hgroup",
    "footer": "footer",
    "aside": "aside",
    "form": "form button label legend fieldset option optgroup select search dialog",
    "article": "article",
    "main": "main",
    "heading": "h1 h2 h3 h4 h5 h6",
    "text": "p blockquote pre xmp figure figcaption address details summary center",
    "list": "ul ol dl dir",
    "item": "li dt dd",
    "table": "table tbody thead tfoot tr td th caption",
    "box": "div section",
    "page": "html body head #page",
}
WORDS = {
    "w-nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip",
    "w-head": "header masthead topbar banner logo brand title-bar site-title",
    "w-foot": "footer copyright colophon legal imprint",
    "w-side": "sidebar side aside widget widgets rail related recommended recommendations more",
    "w-notice": "cookie cookies consent notice notices gdpr alert popup modal overlay message paywall disclaimer hidden",
    "w-ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion adslot banner",
    "w-comment": "comment comments reply replies respond responses response discussion disqus feedback reader",
    "w-social": "share sharing social follow tags newsletter subscribe subscription signup search login",
    "w-meta": "meta byline author date timestamp",
    "w-good": "article content post entry story main body text maincontent page-content",
}
_GROUP_OF = {name: g for g, names in GROUPS.items() for name in names.split()}
_WORDS_OF: dict[str, list[str]] = {}
for _kind, _names in WORDS.items():
    for _name in _names.split():
        _WORDS_OF.setdefault(_name, []).append(_kind)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
CHARS, ALL_CHARS, LINKS = (1, 20, 80, 250), (1, 60, 250, 1000), (0.01, 0.3, 0.7)
SHARES, PARAGRAPHS = (0.05, 0.25, 0.5, 0.8), (0.05, 0.4, 0.8)
_ROLES = [*GROUPS, *WORDS]
_AMOUNTS = [f"{kind}{i}" for kind, n in (("chars", 5), ("links", 4), ("all-chars", 5), ("all-links", 4), ("blocks", 3), ("share", 5), ("paragraphs", 4), ("among", 4)) for i in range(n)]
FEATURES = ["one", *_ROLES, *[f"under-{r}" for r in _ROLES], *_AMOUNTS]
INDEX = {name: i for i, name in enumerate(FEATURES)}
ISLANDS = frozenset(["nav", "header", "footer", "aside", "form", *[w for w in WORDS if w != "w-good"]])
EDGES = ("flow", "box", "island")


def roles(node: Node) -> list[str]:
    """The role of an element's name and those its class, id and role attribute speak of."""
    marks = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')} {node.attributes.get('role', '')}"
    if node.name == "template" or "hidden" in node.attributes or "display:none" in node.attributes.get("style", "").replace(" ", ""):
        marks += " hidden"
    kinds = {k for w in _SPLIT.split(marks) if w for k in _WORDS_OF.get(w.lower(), ())} if not marks.isspace() else ()
    return [_GROUP_OF.get(node.name, "box"), *sorted(kinds)]


def evidence(page: Page) -> tuple[list[list[int]], list[int]]:
    """Numbers of the features of each node, and the kind of its edge to the parent."""
    nodes = page.nodes
    inside = [[n.chars, n.link_chars, int(n.chars > 0)] for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        above = inside[nodes[i].parent]
        for k, v in enumerate(inside[i]):
            above[k] += v
    told = [roles(n) for n in nodes]
    # text outside menus, headers, asides and the like, and the part of it that stands in paragraphs right below a node
    apart = [bool(ISLANDS.intersection(own)) for own in told]
    free, below = [0] * len(nodes), [0] * len(nodes)
    for i, node in enumerate(nodes):
        apart[i] = apart[i] or (i > 0 and apart[node.parent])
    for i in range(len(nodes) - 1, -1, -1):
        if not apart[i]:
            free[i] += nodes[i].chars - nodes[i].link_chars
            if i:
                free[nodes[i].parent] += free[i]
                if told[i][0] in ("text", "heading", "list"):
                    below[nodes[i].parent] += free[i]
    total = free[0] or 1
    features, edges = [], []
    for i, (node, own, (chars, links, blocks)) in enumerate(zip(nodes, told, inside)):
        names = ["one", *own, *([f"under-{r}" for r in told[node.parent]] if node.parent >= 0 else [])]
        names += [f"chars{sum(node.chars >= c for c in CHARS)}", f"all-chars{sum(chars >= c for c in ALL_CHARS)}"]
        if node.chars:
            names.append(f"links{sum(node.link_chars >= c * node.chars for c in LINKS)}")
        if chars:
            names.append(f"all-links{sum(links >= c * chars for c in LINKS)}")
        names.append(f"blocks{(blocks > 1) + (blocks > 3)}")
        if not apart[i]:
            names.append(f"share{sum(free[i] >= c * total for c in SHARES)}")
            names.append(f"paragraphs{sum(below[i] > c * (free[i] or 1) for c in PARAGRAPHS)}")
            if i:
                names.append(f"among{sum(below[node.parent] > c * (free[node.parent] or 1) for c in PARAGRAPHS)}")
        features.append([INDEX[n] for n in names])
        edges.append(2 if ISLANDS.intersection(own) else 0 if own[0] in ("heading", "text", "list", "item", "table") else 1)
    return features, edges


@dataclass
class Forest:
    """Nodes of many pages, parents by position, and the nodes of each level from the roots down."""

    features: np.ndarray  # numbers of the features of all nodes, one node after the other
    counts: np.ndarray  # how many each node has, one at least
    parent: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, pages: list[Page]) -> Forest:
        rows, parent, edge, depth = [], [], [], []
        for page in pages:
            base = len(rows)
            found, kinds = evidence(page)
            rows += found
            edge += kinds
            parent += [base + n.parent if n.parent >= 0 else -1 for n in page.nodes]
            depth += [n.depth for n in page.nodes]
        features, lengths = np.fromiter((f for r in rows for f in r), np.int16), np.fromiter(map(len, rows), np.int64, len(rows))
        order = np.argsort(depth, kind="stable")
        counts = np.bincount(depth) if depth else np.zeros(0, int)
        levels = np.split(order, np.cumsum(counts)[:-1]) if len(counts) else []
        return cls(features, lengths, np.array(parent, np.int64), np.array(edge, np.int64), levels)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each node's features."""
        return np.add.reduceat(weights[self.features], np.cumsum(self.counts) - self.counts)

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of the nodes that have a feature, for each feature."""
        return np.bincount(self.features, np.repeat(values, self.counts), len(FEATURES))


def _logadd(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(np.take(x, 0, axis), np.take(x, 1, axis))


def messages(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each node, and of each (parent, child) pair under the child's number."""
    n = len(unary)
    own = np.zeros((n, 2))
    own[:, 1] = unary
    factor = pair[forest.edge]
    up = own.copy()  # own evidence and all messages from below
    to_parent = np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):
        to_parent[level] = _logadd(factor[level] + up[level][:, None, :], 2)
        np.add.at(up, forest.parent[level], to_parent[level])
    belief = up.copy()
    joint = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        cavity = belief[forest.parent[level]] - to_parent[level]
        belief[level] = up[level] + _logadd(factor[level] + cavity[:, :, None], 1)
        joint[level] = cavity[:, :, None] + factor[level] + up[level][:, None, :]
    belief -= _logadd(belief, 1)[:, None]
    flat = joint.reshape(n, 4)
    flat -= flat.max(axis=1, keepdims=True)
    joint = np.exp(flat)
    return np.exp(belief), (joint / joint.sum(axis=1, keepdims=True)).reshape(n, 2, 2)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of content for each node of each page."""
        forest = Forest.of(pages)
        marginal, _ = messages(forest, forest.scores(self.weights), self.pair)
        return np.split(marginal[:, 1], np.cumsum([len(p.nodes) for p in pages])[:-1])


def gold(page: Page) -> np.ndarray:
    """Labels of a labelled page; what is not marked, frames around the article included, is not content."""
    return np.array(["data-keep" in n.attributes for n in page.nodes], float)


def fit(sources: list[str], rounds: int = 200, decay: float = 1e-5, rate: float = 0.2) -> Model:
    """Penalised maximum likelihood over whole trees."""
    pages = [parse(s) for s in sources]
    forest, label = Forest.of(pages), np.concatenate([gold(p) for p in pages])
    children = forest.parent >= 0
    seen = np.zeros((len(label), 2, 2))
    at = np.flatnonzero(children)
    seen[at, label[forest.parent[at]].astype(int), label[at].astype(int)] = 1
    weights = [np.zeros(len(FEATURES)), np.zeros((len(EDGES), 2, 2))]
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for t in range(1, rounds + 1):
        marginal, joint = messages(forest, forest.scores(weights[0]), weights[1])
        slope = [forest.totals(label - marginal[:, 1]), np.zeros_like(weights[1])]
        for e in range(len(EDGES)):
            some = children & (forest.edge == e)
            slope[1][e] = (seen[some] - joint[some]).sum(axis=0)
        for w, g, (m, v) in zip(weights, slope, moment):
            g = g / len(pages) - decay * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(*weights)


@lru_cache(maxsize=1)
def model() -> Model:
    """Fitted to the labelled pages, a table of fixed size; deterministic."""
    return fit(labelled_pages())


def main_text(pages: list[Page], fitted: Model) -> list[str]:
    out = []
    for page, content in zip(pages, fitted.content(pages)):
        out.append("\n\n".join(text for node, text in page.blocks if content[node] >= 0.5))
    return out


def extract(pages: DataFrame, carry: list[str] | None = None, source: str = "html", chars: int = 1_000_000) -> DataFrame:
    """``carry`` (all columns by default), ``text`` and ``n_chars`` (code points) of every page.

    Blocks of the article in page order, joined by empty lines; white space inside a block is one space.  Null and empty
    pages, and pages without an article, have an empty text; broken markup is read as far as it goes; repeated rows are
    read each; an empty table gives no rows; an input column named as a result is replaced.
    """
    kept = [c for c in (carry or pages.columns) if c not in ("text", "n_chars")]
    fitted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            waiting, size = [], 0
            for value in batch.column(1):
                body = value.as_py() or ""
                waiting.append(parse(body))
                size += len(body)
                if size > chars:
                    texts += main_text(waiting, fitted)
                    waiting, size = [], 0
            if waiting:
                texts += main_text(waiting, fitted)
            clean = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(map(len, clean), pa.int64())], names=[CARRIED, "text", "n_chars"])

    taken = pages.select(carried(kept), F.col(source).alias("_source"))
    schema = taken.select(CARRIED, F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("n_chars")).schema
    return taken.mapInArrow(run, schema).select(f"{CARRIED}.*", "text", "n_chars")
