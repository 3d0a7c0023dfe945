"""Main text of pages by a tree-structured graphical model.

Each element of a page is a binary variable: article or not. A node potential comes from the element's features (name,
words of class, id and role, size and links of its text), a parent-child potential from the pair of states and the child's
kind. Sum-product message passing, upward by depth and then downward, gives exact marginals, for all pages of a batch at
once. Weights are trained on labelled pages by gradient ascent on the exact log-likelihood, with the same messages.

Defined results: a null or empty page has empty text, as has a page without article elements; long pages are whole;
repeated rows get one row each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.llm.common import column, read, small_batches
from popshift.llm.html_labels import labelled_pages
from popshift.llm.html_tree import INLINE, Node, joined, parse

FEATURES = 1024
STEPS, RATE, DECAY = 250, 0.5, 1e-4
#: Kinds of a child for the parent-child potential.
INLINE_CHILD, PARAGRAPH, REGION, OTHER = range(4)
_PARAGRAPHS = frozenset("p li h2 h3 h4 h5 h6 pre blockquote td th tr table tbody ul ol dl dt dd figcaption figure".split())
_REGIONS = frozenset("article main section div body html nav aside footer header form h1".split())
_WORD = re.compile(r"[a-z]+")


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % FEATURES


_slot = lru_cache(maxsize=1 << 16)(_slot)


def kind(name: str) -> int:
    return INLINE_CHILD if name in INLINE else PARAGRAPH if name in _PARAGRAPHS else REGION if name in _REGIONS else OTHER


def features(nodes: list[Node]) -> list[list[int]]:
    """Feature numbers of each element; labels are no part of them."""
    size, linked = [n.own for n in nodes], [n.own if n.name == "a" else 0 for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        size[p] += size[i]
        linked[p] += size[i] if nodes[i].name == "a" else linked[i]
    out = []
    for n, s, a in zip(nodes, size, linked, strict=True):
        f = [_slot("bias"), _slot("name " + n.name), _slot(f"size {n.name in INLINE} {min(s, 4095).bit_length() // 2}"), _slot(f"links {0 if not s else 1 + min(3, 4 * a // s)}")]
        if n.raw:
            said = n.attributes()
            for key in ("class", "id", "role"):
                if key in said:
                    f += [_slot("word " + w) for w in set(_WORD.findall(said[key].lower()))]
        out.append(f)
    return out


class Batch:
    """Elements of several pages as arrays: a page's first element has no parent."""

    def __init__(self, pages: list[list[Node]]):
        sizes = [len(p) for p in pages]
        begin = np.cumsum([0, *sizes])
        self.begin = begin
        self.parent = np.array([n.parent + b if n.parent >= 0 else -1 for p, b in zip(pages, begin, strict=False) for n in p], np.int64)
        self.depth = np.array([n.depth for p in pages for n in p], np.int64)
        self.kind = np.array([kind(n.name) for p in pages for n in p], np.int64)
        rows = [f for p in pages for f in features(p)]
        self.row = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
        self.feature = np.array([x for f in rows for x in f], np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max() + 2 if len(order) else 1))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def marginals(self, node_weights: np.ndarray, edge_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(article) of each element, and P(parent's state, own state) of each element that has a parent.

        node_weights: by feature, the log-odds; edge_weights: by the child's kind, parent's state and child's state.
        """
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.row, node_weights[self.feature], n)
        edge = edge_weights[self.kind]
        up = own.copy()  # own potential and the messages from below
        message = np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            message[level] = np.logaddexp(edge[level, :, 0] + up[level, None, 0], edge[level, :, 1] + up[level, None, 1])
            for s in (0, 1):
                np.add.at(up[:, s], self.parent[level], message[level, s])
        belief = up.copy()  # with the message from above
        pair = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - message[level]
            both = above[:, :, None] + edge[level] + up[level, None, :]
            belief[level] = np.logaddexp(both[:, 0], both[:, 1])
            both -= both.max(axis=(1, 2), keepdims=True)
            pair[level] = np.exp(both) / np.exp(both).sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pair


def labels(nodes: list[Node]) -> list[int]:
    out = []
    for n in nodes:
        mark = n.attributes().get("data-y") if "data-y" in n.raw else None
        out.append(int(mark) if mark is not None else out[n.parent] if n.parent >= 0 else 0)
    return out


def train(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of greatest likelihood (with a small penalty): observed less expected features, by exact marginals."""
    trees = [parse(p)[0] for p in pages]
    batch = Batch(trees)
    y = np.array([v for t in trees for v in labels(t)], float)
    child = np.flatnonzero(batch.parent >= 0)
    seen = np.zeros((4, 2, 2))
    np.add.at(seen, (batch.kind[child], y[batch.parent[child]].astype(int), y[child].astype(int)), 1)
    nodes, edges = np.zeros(FEATURES), np.zeros((4, 2, 2))
    square_n, square_e = np.full(FEATURES, 1e-8), np.full((4, 2, 2), 1e-8)
    for _ in range(STEPS):
        p, pair = batch.marginals(nodes, edges)
        expected = np.zeros((4, 2, 2))
        np.add.at(expected, batch.kind[child], pair[child])
        slope_n = np.bincount(batch.feature, (y - p)[batch.row], FEATURES) / len(pages) - DECAY * nodes
        slope_e = (seen - expected) / len(pages) - DECAY * edges
        square_n += slope_n**2
        square_e += slope_e**2
        nodes += RATE * slope_n / np.sqrt(square_n)
        edges += RATE * slope_e / np.sqrt(square_e)
    return nodes, edges


@lru_cache(maxsize=1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages())


def extract_pages(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    batch = Batch([nodes for nodes, _ in parsed])
    kept = batch.marginals(*model)[0] > 0.5
    return [joined(pieces, kept[a:b]) for (_, pieces), a, b in zip(parsed, batch.begin[:-1], batch.begin[1:], strict=True)]


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    df = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("_html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_ = column(batch, "_html").to_pylist()
            text = [t for i in range(0, len(pages_), 200) for t in extract_pages(pages_[i : i + 200], sent.value)]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return df.mapInArrow(run, f"page_id {df.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
