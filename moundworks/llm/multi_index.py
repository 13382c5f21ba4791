"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into halves, each half is quantised by its own centroids, and a vector's cell is
its pair of centroids. A query goes through the pairs by ascending summed distance, taken from a
heap, until the cells hold the wanted share of all entries; entries there are ranked by their exact
cosine. The share is measured when the index is fitted, so that it finds the wanted part of true
neighbours on a sample; a query that then has too few neighbours goes on.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundworks.llm import shared
from moundworks.llm.repeats import dump, load


@dataclass
class Index:
    """Two tables of centroids and the share of entries to look at; bounded by ``centroids``."""

    first: np.ndarray
    second: np.ndarray
    share: float

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return nearest(unit[:, : self.half], self.first) * len(self.second) + nearest(unit[:, self.half :], self.second)

    def order(self, unit: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
        """Cells of one query's walk until ``wanted`` entries are in them."""
        a = ((self.first - unit[: self.half]) ** 2).sum(axis=1)
        b = ((self.second - unit[self.half :]) ** 2).sum(axis=1)
        i_of, j_of = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b = a[i_of].tolist(), b[j_of].tolist()
        heap, out, have = [(a[0] + b[0], 0, 0)], [], 0
        while heap and have < wanted:
            _, i, j = heapq.heappop(heap)
            cell = i_of[i] * len(b) + j_of[j]
            if counts[cell]:
                out.append(cell)
                have += int(counts[cell])
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def centroids_of(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    if not x.shape[1]:  # the second half of vectors of one component
        return np.zeros((1, 0))
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, d], len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, centroids: int, k: int, recall: float, seed: int = 0) -> Index:
    """``sample``: unit vectors, as many rows as the caller's bound lets be."""
    half = max(1, sample.shape[1] // 2)
    index = Index(centroids_of(sample[:, :half], centroids, 12, seed), centroids_of(sample[:, half:], centroids, 12, seed + 1), 1.0)
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    queries = np.random.default_rng(seed).permutation(len(sample))[:400]
    depth = []
    for q in queries.tolist():
        s = sample @ sample[q]
        s[q] = -2
        true = np.argpartition(-s, min(k, len(s) - 1))[:k] if len(s) > 1 else np.zeros(0, int)
        walk = index.order(sample[q], counts, np.inf)
        reached = np.zeros(len(counts))
        reached[walk] = np.cumsum(counts[walk]) - counts[walk] + 1  # asked for so much, a walk enters the cell
        depth += reached[cells[true]].tolist()
    if depth:
        index.share = min(1.0, float(np.quantile(depth, recall, method="higher")) / len(sample))
    return index


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, centroids: int | None = None, recall: float = 0.96, sample_rows: int = 20_000, shard: int = 4096, query_block: int = 512, cell_rows: int = 2048, most_centroids: int = 128
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``k``
    nearest found by cosine, nearest first, ties to the smaller vec_id; all candidates, if fewer.

    Vectors of each length have an index of their own, as a cosine needs equal lengths. Centroids and
    the share of entries to visit are fitted on at most ``sample_rows`` vectors of the smallest hash;
    every vector is indexed. ``centroids`` of each half are 16 or more, so that cells keep about
    ``cell_rows`` rows as the table grows, up to ``most_centroids``. A length that the sample lacks is
    one cell. A query that finds fewer than ``k`` goes on through its cells, twice as far each time.

    Vectors that are null, empty or zero or that hold null or non-finite components, and rows with a
    null vec_id, take no part. A query never finds rows with its own vec_id. Rows of one vec_id are one
    query and one entry, whose score is the best of theirs; repeated rows are one row. No vectors give
    no rows, and other columns, whatever their names, are not looked at.
    """
    spark = vectors.sparkSession
    shared.ship(spark)
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = raw.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0))
    good = shared.staged(good.dropDuplicates(["vec_id", "v"]).select("vec_id", "v", F.size("v").alias("size"), F.xxhash64("vec_id", "v").alias("h")), "vectors")
    n_of = {r["size"]: r["count"] for r in good.groupBy("size").count().collect()}  # one row a length
    total = sum(n_of.values())
    # the hash bound leaves about a fifth more rows than are wanted, so that no task gets them from all partitions
    bound = min(1.0, 1.2 * sample_rows / max(total, 1) + 1e-9)
    near_bound = good.where(F.shiftrightunsigned("h", 11).cast("double") < bound * (1 << 53))
    head = near_bound.orderBy("h", "vec_id", "v").limit(sample_rows).select("v").toArrow()["v"].to_pylist() if total else []
    by_size: dict[int, list] = {}
    for v in head:
        by_size.setdefault(len(v), []).append(v)

    def fitted(size: int, rows: list) -> Index:
        wanted = min(most_centroids, max(16, math.isqrt(n_of[size] // cell_rows)))
        return fit(unit(np.array(rows)), centroids or wanted, k, recall)

    indexes = {size: fitted(size, rows) for size, rows in by_size.items()}
    for size in n_of.keys() - indexes.keys():
        half = max(1, size // 2)
        indexes[size] = Index(np.zeros((1, half)), np.zeros((1, size - half)), 1.0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            cells = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                cells[own] = indexes[size].cells(unit(matrix(batch.column(1).take(pa.array(own)), size)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], names=["vec_id", "v", "size", "h", "cell"])

    entries = shared.staged(good.mapInArrow(place, "vec_id long, v array<double>, size int, h long, cell long"), "entries")
    counts = {size: np.zeros(len(x.first) * len(x.second), np.int64) for size, x in indexes.items()}
    for r in entries.groupBy("size", "cell").count().collect():  # one row a cell
        counts[r["size"]][r["cell"]] = r["count"]
    shards = {size: np.maximum(1, -(-c // shard)) for size, c in counts.items()}
    table = [(size, int(c), int(shards[size][c])) for size, n in counts.items() for c in np.flatnonzero(n)]
    # bounded by the number of cells, most_centroids squared a length
    of_cell = F.broadcast(spark.createDataFrame(table, "size int, cell long, shards long"))

    def bundle(t: pa.Table) -> pa.Table:
        x = matrix(t["v"].combine_chunks(), t["size"][0].as_py())
        return pa.table({"size": t["size"][:1], "cell": t["cell"][:1], "shard": t["shard"][:1], "entries": pa.array([dump((t["vec_id"].to_numpy(), x))], pa.binary())})

    packed = entries.join(of_cell, ["size", "cell"]).select("vec_id", "v", "size", "cell", F.pmod("h", "shards").alias("shard"))
    packed = shared.staged(packed.groupBy("size", "cell", "shard").applyInArrow(bundle, "size int, cell long, shard long, entries binary"), "shards", "lz4")

    def ask_for(times: float) -> Callable:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column(2).to_numpy()
                for size in np.unique(sizes).tolist():
                    own = batch.filter(pa.array(sizes == size))
                    wanted = times * max(indexes[size].share * n_of[size], k + 1.0)
                    for a in range(0, own.num_rows, query_block):
                        some = own.slice(a, query_block)
                        ids, x = some.column(0).to_numpy(), matrix(some.column(1), size)
                        by_cell: dict[int, list[int]] = {}
                        for q, u in enumerate(unit(x)):
                            for cell in indexes[size].order(u, counts[size], wanted):
                                by_cell.setdefault(cell, []).append(q)
                        for c, q in by_cell.items():
                            m = int(shards[size][c])
                            yield pa.RecordBatch.from_arrays([pa.array([size] * m, pa.int32()), pa.array([c] * m, pa.int64()), pa.array(range(m), pa.int64()), pa.array([dump((ids[q], x[q]))] * m, pa.binary())], names=["size", "cell", "shard", "queries"])

        return ask

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e, q in zip(batch.column(0), batch.column(1), strict=True):
                ids, x = load(e.as_py())
                query_ids, y = load(q.as_py())
                out = top(query_ids, y, ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = entries.where(F.col("vec_id") % every == 0).select("vec_id", "v", "size")
    out, times = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 1.0
    while total:
        asked = queries.mapInArrow(ask_for(times), "size int, cell long, shard long, queries binary")
        pairs = asked.join(packed, ["size", "cell", "shard"]).select("entries", "queries").mapInArrow(rank, "query_id long, vec_id long, score double")
        pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = shared.staged(pairs.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k), "found")
        whole = found.where(F.col("rank") == k).select("query_id")
        if all(times * max(indexes[size].share * n, k + 1.0) >= n for size, n in n_of.items()):
            return out.unionByName(found)  # these have seen every entry
        queries = shared.staged(queries.join(whole, queries.vec_id == whole.query_id, "left_anti"), "short")
        out = out.unionByName(found.join(whole, "query_id", "left_semi"))
        if queries.isEmpty():
            return out
        times *= 2
    return out


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of one vector with each row, always summed alike, so that equal vectors score alike."""
    scale_a, scale_x = np.abs(a).max(), np.abs(x).max(axis=1, keepdims=True)
    a, x = a / scale_a, x / scale_x
    return (x * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((x * x).sum(axis=1)))


def top(query_ids: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best vec_ids of each query; the product only says which can be among them."""
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    rough = unit(y) @ unit(x).T
    out_q, out_i, out_s = [], [], []
    for q, (query, row) in enumerate(zip(query_ids.tolist(), rough, strict=True)):
        row[ids == query] = -2
        each = np.maximum.reduceat(row, first)  # the best of an id's rows
        bound = np.partition(each, len(each) - k)[len(each) - k] if len(each) > k else -1.5
        near = np.flatnonzero((row >= bound - 1e-9) & (row > -1.5))
        score = cosines(y[q], x[near])
        order = np.lexsort((ids[near], -score))
        order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])][:k]
        out_q.append(np.full(len(order), query))
        out_i.append(ids[near][order])
        out_s.append(score[order])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)
