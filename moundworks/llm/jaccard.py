"""Similarity join on word shingles: every link between different texts, by Bayesian pruning.

Equal texts are one class from the start. Classes that agree on a band of MinHash values are
candidates; their values are compared a stretch at a time, and a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold (uniform prior) falls below the
tolerance. What is left in a group of candidates links its members to a forest, so a group of any
size gives fewer links than members; the connected parts are then compared pair by pair inside
blocks, pruned the same way, and the rest verified on their whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.llm import shared
from moundworks.llm.components import components
from moundworks.llm.repeats import gram_hashes, mixed, word_hashes

VALUES, ROWS = 128, 4  # MinHash values and how many make a band: 0.8 is missed once in 2e7 pairs
STRETCH = 32  # values compared at a time
SPREAD = np.random.default_rng(20_240_229).integers(1, 1 << 32, (2, VALUES), np.uint64).astype(np.uint32)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts and where each text's begin (with the end of the last). A
    text of fewer words than a shingle is one shingle; a text without words has none."""
    clean = [b" ".join(t.split()) for t in texts]
    sizes = np.array([len(t) + 1 for t in clean])
    raw = np.frombuffer(b" ".join(clean) + b" ", np.uint8)
    edge = np.flatnonzero(raw == 32)
    begin = np.concatenate([[0], edge[:-1] + 1])
    good = edge > begin
    begin, end = begin[good], edge[good]
    at = np.concatenate([[0], np.searchsorted(begin, np.cumsum(sizes))])
    codes = word_hashes(raw, begin, end)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    cut = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(cut[-1]) + np.repeat(at[:-1] - cut[:-1], count)
    padded = np.concatenate([codes, np.zeros(words - 1, np.uint64)]) if words > 1 else codes
    out = mixed(gram_hashes(padded, words)[place]) if len(place) else np.zeros(0, np.uint64)
    for k in np.flatnonzero((n > 0) & (n < words)).tolist():
        x = np.full(1, n[k], np.uint64)
        for c in codes[at[k] : at[k + 1]]:
            x = mixed(x * np.uint64(31) + c)
        out[cut[k]] = x[0]
    return out, cut


def signatures(hashes: np.ndarray, cut: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
    """MinHash values of each text, 32 bits each; texts without shingles have the largest."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(cut) - 1, VALUES), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), piece):
        part = short[a : a + piece]
        d0, d1 = np.searchsorted(cut, a, side="right") - 1, np.searchsorted(cut, a + len(part), side="left")
        own = np.arange(d0, d1)[np.diff(cut[d0 : d1 + 1]) > 0]
        first = np.maximum(cut[own], a) - a
        for k in range(VALUES):
            out[own, k] = np.minimum(out[own, k], np.minimum.reduceat(part * (SPREAD[0, k] | np.uint32(1)) + SPREAD[1, k], first))
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """Of 32, 64, ... values compared, how many must agree for the posterior to be large enough.
    With a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STRETCH, VALUES + 1, STRETCH):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def likely(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two aligned tables of values survive."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        s = slice(k * STRETCH, (k + 1) * STRETCH)
        matches[alive] += (a[alive, s] == b[alive, s]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= m]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups, some at a time, of rows sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
            if held:
                change[0] |= held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py()
        where = np.flatnonzero(change)
        if len(where):
            held.append(batch.slice(0, where[-1]))
            yield pa.Table.from_batches(held)
            held = [batch.slice(where[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_cuts(t: pa.Table, keys: list[str]) -> list[int]:
    change = np.ones(t.num_rows, bool)
    change[1:] = False
    for k in keys:
        x = t[k].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return [*np.flatnonzero(change).tolist(), t.num_rows]


def roots(ok: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A member of each member's connected part, by sweeps over the table of links."""
    root = np.arange(int(max(a.max(initial=-1), b.max(initial=-1))) + 1)
    seen = np.zeros(len(root), bool)
    linked_a, linked_b = ok.any(axis=1), ok.any(axis=0)
    for start in a[linked_a].tolist():
        if seen[start]:
            continue
        new = np.zeros(len(root), bool)
        new[start] = True
        while new.any():
            seen |= new
            root[new] = start
            found = np.zeros(len(root), bool)
            rows, columns = new[a] & linked_a, new[b] & linked_b
            found[b[ok[rows].any(axis=0)]] = True
            found[a[ok[:, columns].any(axis=1)]] = True
            new = found & ~seen
    return root


def connect(values: np.ndarray, side: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """Links of a forest that joins whatever likely pairs join. Members already joined are not
    compared, so a tight group takes one sweep. Two sides: all pairs, inside a side too."""
    n = len(values)
    label = np.arange(n)
    out = []
    for i in range(n):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(other):
            continue
        hit = other[likely(np.broadcast_to(values[i], (len(other), VALUES)), values[other], least)]
        for j in hit.tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def blocks_of(n: Column, name: str, block: int) -> tuple[Column, Column]:
    """Deals a group's members to blocks of about ``block`` rows; a member goes to each pair of
    blocks that has its own."""
    parts = F.ceil(n / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(name), parts).cast("int")
    return own, F.explode(F.sequence(F.lit(0), parts - 1))


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the common parts of each set of ``a`` with each of ``b``, by products of 0/1 tables
    over the elements that several sets have, some columns at a time."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, counts = np.unique(every, return_inverse=True, return_counts=True)
    keep = counts[number] > 1
    slot = np.cumsum(counts > 1) - 1
    number, owner = slot[number[keep]], owner[keep]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        i, j = np.searchsorted(number, [c, c + columns])
        table = np.zeros((len(sets), columns), np.float32)
        table[owner[i:j], number[i:j] - c] = 1
        out += table[a] @ table[b].T
    return out.astype(np.int64)


def links(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 1024) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, copy_id, n_links, which ``joined`` says more of. An empty
    table gives no rows; repeated rows are each a row; other columns, whatever their names, are not
    looked at."""
    signed, of_class = joined(docs, words, threshold, tolerance, block)
    lowest = of_class.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    return signed.join(of_class.join(lowest, "component"), "name").select("doc_id", "class_id", "copy_id", "n_links")


def one_of_each(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with one row of each class: the least doc_id's (of its texts the least digest; null
    last). Rows of one doc_id and text are one row. Columns may have any names; an empty table stays empty."""
    _, of_class = joined(docs, **options)
    first = of_class.groupBy("component").agg(F.min(F.struct(F.col("copy_id").isNull(), "copy_id", "name")).alias("first"))
    first = shared.staged(first.select(F.col("first.copy_id").alias("_id"), F.col("first.name").alias("_name")), "kept")
    # the row is one column, whatever names are inside
    named = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_own"), F.col("doc_id").cast("long").alias("_own_id"))
    kept = named.join(first, (named._own == first._name) & named._own_id.eqNullSafe(first._id), "left_semi")
    return kept.dropDuplicates(["_own", "_own_id"]).select("row.*")


def joined(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as (doc_id, name), and its texts as (name, copy_id, n_links, component).

    ``copy_id`` is the least doc_id with the same text; ``n_links`` how many other texts have a
    Jaccard similarity of at least ``threshold`` with this one on sets of ``words``-word shingles
    (words stand between ASCII white space); ``class_id`` the least doc_id that a chain of links
    reaches. Null texts are empty; empty texts are copies of each other and link to nothing. Rows
    with one doc_id are each a row; a null doc_id counts as the least of its class only if alone.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    least = least_matches(threshold, tolerance)
    parts = shared.parts(spark, shared.input_bytes(docs), 8 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                texts = some.column(1).to_pylist()
                hashes, cut = shingles(texts, words)
                values = signatures(hashes, cut)
                band = mixed(gram_hashes(values.reshape(-1).astype(np.uint64), ROWS)[:: ROWS].reshape(len(texts), -1)) if len(texts) else np.zeros((0, VALUES // ROWS), np.uint64)
                keys = (band >> np.uint64(6) << np.uint64(5) | np.arange(VALUES // ROWS, dtype=np.uint64)).astype("<i8")
                has = np.diff(cut) > 0
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts], pa.binary()), pa.array([k if h else [] for k, h in zip(keys, has, strict=True)], pa.list_(pa.int64())), pa.array([v.tobytes() for v in values.astype(np.uint8)], pa.binary())],
                    names=["doc_id", "name", "bands", "sig"],
                )

    signed = shared.staged(rows.mapInArrow(sign, "doc_id long, name binary, bands array<long>, sig binary"), "signatures")
    classes = signed.groupBy("name", "sig", "bands").agg(F.min("doc_id").alias("copy_id"))
    classes = shared.staged(classes, "classes")
    bands = classes.select("name", F.explode("bands").alias("band"))
    several = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = bands.join(several, "band")
    own, other = blocks_of(F.col("n"), "name", block)
    members = members.select("band", "name", own.alias("own"), other.alias("other")).select("band", "name", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    members = members.join(classes.select("name", "sig"), "name").repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["band", "i", "j"]
        for t in runs(batches, keys):
            values = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, VALUES)
            cuts = np.array(group_cuts(t, keys))
            size = np.diff(cuts)
            first, second = [], []
            for n in np.unique(size).tolist():
                if 2 <= n <= 12:  # all pairs of all groups of this size at once
                    p, q = np.triu_indices(n, 1)
                    begin = cuts[:-1][size == n][:, None]
                    first.append((begin + p).ravel())
                    second.append((begin + q).ravel())
            if first:
                a, b = np.concatenate(first), np.concatenate(second)
                good = likely(values[a], values[b], least)
                first, second = [a[good]], [b[good]]
            for a, b in zip(cuts[:-1][size > 12].tolist(), cuts[1:][size > 12].tolist(), strict=True):
                found = np.array(connect(values[a:b], None, least), np.int64).reshape(-1, 2) + a
                first.append(found[:, 0])
                second.append(found[:, 1])
            if first:
                name = t["name"].combine_chunks()
                yield pa.RecordBatch.from_arrays([name.take(pa.array(np.concatenate(first))), name.take(pa.array(np.concatenate(second)))], names=["a", "b"])

    maybe = members.select("band", "i", "j", "name", "sig").mapInArrow(candidates, "a binary, b binary").distinct()
    near = shared.staged(components(maybe), "near")

    nodes = near.join(classes.select("name", "copy_id"), near.node == classes.name).select("name", "component", "copy_id")
    sized = near.groupBy("component").agg(F.count("*").alias("n"))
    nodes = nodes.join(sized, "component")
    # by id and text, so that rows without an id, or with one they share, meet their own text only
    named = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("_own"))
    texts = nodes.join(named, nodes.copy_id.eqNullSafe(named.doc_id) & (nodes.name == named._own)).select("component", "n", "name", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                t = some.column("text").to_pylist()
                hashes, cut = shingles(t, words)
                sets = pa.array([np.unique(hashes[i:j]).tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("component"), some.column("n"), some.column("name"), sets], names=["component", "n", "name", "shingles"])

    sets = texts.mapInArrow(spread, "component binary, n long, name binary, shingles binary").dropDuplicates(["name"])
    own, other = blocks_of(F.col("n"), "name", block)
    sets = sets.select("component", "name", "shingles", own.alias("own"), other.alias("other")).select("component", "name", "shingles", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = sets.join(classes.select("name", "sig"), "name").repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "own")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["component", "i", "j"]
        for t in runs(batches, keys):
            values = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, VALUES)
            cuts = group_cuts(t, keys)
            name, blob, side = t["name"].to_pylist(), t["shingles"].to_pylist(), t["own"].to_numpy()
            out: list[tuple[bytes, int, bytes | None]] = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                held = [np.frombuffer(x, np.uint64) for x in blob[lo:hi]]
                size = np.array([len(x) for x in held])
                one_side = side[lo] == side[hi - 1]
                if not one_side or t["i"][lo].as_py() == t["j"][lo].as_py():
                    a = np.arange(hi - lo) if one_side else np.flatnonzero(side[lo:hi] == side[lo])
                    b = a if one_side else np.flatnonzero(side[lo:hi] != side[lo])
                    ok = linked(values[lo:hi], held, size, a, b, least, threshold)
                    if one_side:
                        ok = np.triu(ok, 1)
                    n = np.zeros(hi - lo, np.int64)
                    n[a] += ok.sum(axis=1)
                    n[b] += ok.sum(axis=0)
                    root = roots(ok, a, b)
                    out += [(name[lo + k], int(n[k]), name[lo + int(root[k])]) for k in np.flatnonzero(n).tolist()]
            if out:
                x = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.binary()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.binary())], names=["name", "n", "root"])

    found = shared.staged(sets.select("component", "i", "j", "own", "name", "sig", "shingles").mapInArrow(verify, "name binary, n long, root binary"), "links")
    counts = found.groupBy("name").agg(F.sum("n").alias("n_links"))
    group = components(found, "name", "root").select(F.col("node").alias("name"), "component")
    of_class = classes.select("name", "copy_id").join(counts, "name", "left").join(group, "name", "left").select("name", "copy_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "name").alias("component"))
    return signed.select("doc_id", "name"), shared.staged(of_class, "of-class")


def linked(values: np.ndarray, sets: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int], threshold: float) -> np.ndarray:
    """Which pairs of ``a`` and ``b`` reach the threshold: the likely ones, verified."""
    if len(a) * len(b) <= 64:
        out = np.zeros((len(a), len(b)), bool)
        p, q = np.divmod(np.arange(len(a) * len(b)), len(b))
        keep = a[p] != b[q]
        p, q = p[keep], q[keep]
        good = likely(values[a[p]], values[b[q]], least)
        for x, y in zip(p[good].tolist(), q[good].tolist(), strict=True):
            if a is b and x > y:
                continue
            common = len(np.intersect1d(sets[a[x]], sets[b[y]], assume_unique=True))
            out[x, y] = common >= threshold * (size[a[x]] + size[b[y]] - common)
        return out
    common = np.zeros((len(a), len(b)), np.int64)
    alive = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(a), 64):  # prune first; only rows and columns that have a likely pair are verified
        rows = np.repeat(np.arange(k, min(k + 64, len(a))), len(b))
        columns = np.tile(np.arange(len(b)), min(64, len(a) - k))
        alive[rows, columns] = likely(values[a[rows]], values[b[columns]], least)
    r, c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    if len(r) and len(c):
        both = np.unique(np.concatenate([a[r], b[c]]))
        common[np.ix_(r, c)] = intersections([sets[i] for i in both.tolist()], np.searchsorted(both, a[r]), np.searchsorted(both, b[c]))
    union = size[a][:, None] + size[b][None, :] - common
    return alive & (common >= threshold * union) & (a[:, None] != b[None, :])
