"""Main text of web pages by a tree-structured graphical model.

Every element and run of text of a page is a node that is main text or not. A node's potential is
linear in its tag, its class and id words, and the lengths, links and sentences of the text it holds;
a potential for each parent and child connects nodes. Sum-product messages up and down the tree give
each node's marginal, exactly, since the graph is a tree. The weights maximise the likelihood of
labelled pages, whose gradient is the difference of counted and expected features.
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

from moundworks.llm import labelled, shared
from moundworks.llm.dom import INLINE, Page, parse

WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
SENTENCE_END = re.compile(r"[.!?。！？](?=\s|$)")
KINDS = 3  # of children: text, inline element, block
BUCKETS = (11, 6, 5, 11)  # text length, share in links, sentences, length of the mean run


def names_of(sign: tuple) -> list[str]:
    """What is said of a node by its tag and names alone."""
    if sign[0] == "#text":
        return [f"#text/{sign[1]}"]
    tag = sign[0]
    out = ["#element", f"<{tag}", f"<{tag}/{sign[2]}" if len(sign) > 2 else "<"]
    for part in (sign[1] if len(sign) > 1 else "").split():
        words = [w.lower() for w in WORD.findall(part)]
        whole = "-".join(words)
        out += dict.fromkeys([f"={whole}", *(f".{w}" for w in words)])
    return list(dict.fromkeys(out))


@dataclass
class Forest:
    """Nodes of many pages by depth, so that each level is one slice. ``at`` leads from a node's place
    here to its place in page order."""

    at: np.ndarray
    parent: np.ndarray
    levels: list[tuple[int, int]]
    kind: np.ndarray
    numbers: np.ndarray  # bucket of each numeric feature
    starts: list[int]

    @classmethod
    def of(cls, pages: list[Page]) -> Forest:
        sizes = [len(p.parent) for p in pages]
        starts = np.cumsum([0, *sizes])
        parent = np.concatenate([np.array(p.parent, np.int64) + s for p, s in zip(pages, starts, strict=False)])
        depth = np.concatenate([np.array(p.depth, np.int64) for p in pages])
        at = np.argsort(depth, kind="stable")
        place = np.empty_like(at)
        place[at] = np.arange(len(at))
        counts = np.bincount(depth)
        cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
        levels = list(zip(cut, cut[1:], strict=False))
        parent = np.where(depth[at] > 0, place[np.maximum(parent[at], 0)], -1)
        tag = [s for p in pages for s in p.sign]
        kind = np.array([0 if s[0] == "#text" else 1 if s[0] in INLINE else 2 for s in tag])[at]
        size = np.array([len(t) for p in pages for t in p.text], np.float64)[at]
        linked = np.array([s[0] == "#text" and s[1] for s in tag])[at]
        ends = np.array([len(SENTENCE_END.findall(t)) if t else 0 for p in pages for t in p.text], np.float64)[at]
        held = np.stack([size, size * linked, ends, (kind == 0).astype(np.float64)])
        for (lo, hi), (up, _) in zip(levels[:0:-1], levels[-2::-1], strict=True):
            n = lo - up
            for row in held:
                row[up:lo] += np.bincount(parent[lo:hi] - up, row[lo:hi], n)
        log = lambda x: np.minimum(np.log2(x + 1).astype(np.int64), 10)
        share = held[1] / np.maximum(held[0], 1)
        numbers = np.stack([log(held[0]), np.searchsorted([1e-9, 0.1, 0.3, 0.6, 0.9], share, side="right"), np.searchsorted([1, 2, 4, 8], held[2], side="right"), log(held[0] / np.maximum(held[3], 1))])
        return cls(at, parent, levels, kind, numbers + np.where(kind == 0, 0, 1) * np.array(BUCKETS)[:, None], starts.tolist())

    def messages(self, score: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum-product up and down. ``score``: log potential of label 1 over 0; ``edge``: log potential
        by child's kind, parent's and child's label. Gives marginals of nodes, of pairs of a node and its
        parent, and the log of the partition function."""
        n = len(score)
        own = np.stack([np.zeros(n), score], axis=1)
        up, sent = np.zeros((n, 2)), np.zeros((n, 2))
        t = edge[self.kind]
        for (lo, hi), (above, _) in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            b = own[lo:hi] + up[lo:hi]
            sent[lo:hi] = np.logaddexp(b[:, None, 0] + t[lo:hi, :, 0], b[:, None, 1] + t[lo:hi, :, 1])
            at = self.parent[lo:hi] - above
            for y in (0, 1):
                up[above:lo, y] += np.bincount(at, sent[lo:hi, y], lo - above)
        down = np.zeros((n, 2))
        pair = np.zeros((n, 2, 2))
        for lo, hi in self.levels[1:]:
            at = self.parent[lo:hi]
            rest = own[at] + up[at] + down[at] - sent[lo:hi]
            joint = rest[:, :, None] + t[lo:hi]
            down[lo:hi] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint = joint + (own[lo:hi] + up[lo:hi])[:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pair[lo:hi] = joint / joint.sum(axis=(1, 2), keepdims=True)
        whole = own + up + down
        top = whole[: self.levels[0][1]]
        return np.exp(whole[:, 1] - np.logaddexp(whole[:, 0], whole[:, 1])), pair, np.logaddexp(top[:, 0], top[:, 1])


@dataclass
class Model:
    """Bounded by the words of the labelled pages: ``names`` and one weight for each, a weight for each
    numeric bucket, and the potentials of parent and child."""

    names: dict[str, float]
    numeric: np.ndarray
    edge: np.ndarray

    def sign_score(self, sign: tuple) -> float:
        return sum(self.names.get(x, 0.0) for x in names_of(sign))

    def marginals(self, pages: list[Page], known: dict[tuple, float]) -> list[np.ndarray]:
        """``known`` keeps the scores of tags and names met before."""
        f = Forest.of(pages)
        first = np.array([known[s] if s in known else known.setdefault(s, self.sign_score(s)) for p in pages for s in p.sign])
        p, _, _ = f.messages(first[f.at] + numeric_score(self.numeric, f.numbers), self.edge)
        out = np.empty_like(p)
        out[f.at] = p
        return [out[a:b] for a, b in zip(f.starts, f.starts[1:], strict=False)]

    def text_of(self, pages: list[Page], known: dict[tuple, float], least: float = 0.5) -> list[str]:
        return [page.joined((m >= least).tolist()) for page, m in zip(pages, self.marginals(pages, known), strict=True)]


def numeric_score(weights: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return sum(weights[k, row] for k, row in enumerate(numbers))


def fit(sources: list[str], rounds: int = 150, penalty: float = 0.03, rate: float = 0.5, least_pages: int = 3) -> Model:
    """Maximum likelihood with a squared penalty, by shrinking steps sized by each weight's own gradients. Names on
    fewer than ``least_pages`` labelled pages have no weight."""
    pages = [parse(s) for s in sources]
    f = Forest.of(pages)
    label = np.array([m for p in pages for m in p.mark], np.float64)[f.at]
    label[: f.levels[0][1]] = 0
    signs: dict[tuple, int] = {}
    sign = np.array([signs.setdefault(s, len(signs)) for p in pages for s in p.sign])[f.at]
    on: dict[str, set[int]] = {}
    for k, p in enumerate(pages):
        for s in set(p.sign):
            for x in names_of(s):
                on.setdefault(x, set()).add(k)
    index = {x: k for k, x in enumerate(sorted(x for x, some in on.items() if len(some) >= least_pages))}
    cells = [(i, index[x]) for s, i in signs.items() for x in names_of(s) if x in index]
    of_sign, of_name = np.array(cells, np.int64).reshape(-1, 2).T
    shape = (len(BUCKETS), 2 * max(BUCKETS))
    w = [np.zeros(len(index)), np.zeros(shape), np.zeros((KINDS, 2, 2))]
    moved = [np.zeros_like(x) for x in w]
    squared = [np.zeros_like(x) for x in w]
    parent_label = np.where(f.parent >= 0, label[np.maximum(f.parent, 0)], 0).astype(np.int64)
    seen = np.zeros((KINDS, 2, 2))
    inner = f.parent >= 0
    np.add.at(seen, (f.kind[inner], parent_label[inner], label[inner].astype(np.int64)), 1)
    for k in range(1, rounds + 1):
        by_sign = np.bincount(of_sign, w[0][of_name], len(signs))
        p, pair, _ = f.messages(by_sign[sign] + numeric_score(w[1], f.numbers), w[2])
        off = label - p
        g_sign = np.bincount(sign, off, len(signs))
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, f.kind[inner], pair[inner])
        gradients = [np.bincount(of_name, g_sign[of_sign], len(index)), np.stack([np.bincount(row, off, shape[1]) for row in f.numbers]), seen - expected]
        for x, g, m, v in zip(w, gradients, moved, squared, strict=True):
            g = g - penalty * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (1 - (k - 1) / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model({x: float(w[0][k]) for x, k in index.items()}, w[1], w[2])


@lru_cache
def trained(n: int = 1000, seed: int = 0) -> Model:
    """The model of ``n`` labelled pages; the same wherever it is fitted."""
    return fit(labelled.pages(n, seed))


def extract(pages: DataFrame, model: Model | None = None, train_pages: int = 1000) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars, all of the page's main text.

    Text nodes whose marginal is at least a half are kept; character references are decoded, blocks and
    line breaks part words, white space (no-break spaces too) becomes one space. A null or empty page,
    and one without main text, has an empty text. Repeated rows and rows without ids have their own
    output. The model, unless given, is fitted on ``train_pages`` labelled pages, which bounds it; it goes
    to the tasks with their code. A page is one node list in memory, however long.
    """
    shared.ship(pages.sparkSession)
    model = model or trained(train_pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}
        for batch in batches:
            source = batch.column(2)
            sizes = np.cumsum([0, *(len(s) if s else 0 for s in source.to_pylist())])
            at = 0
            while at < batch.num_rows:  # about a megabyte of pages at a time
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + (1 << 20))) - 1)
                some = [parse(s or "") for s in source.slice(at, end - at).to_pylist()]
                if len(known) > 100_000:
                    known.clear()
                text = model.text_of(some, known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(text, pa.string())], names=["page_id", "url", "text"])
                at = end

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(read, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
