"""Whitening of embeddings with exact second moments.

Components become integers. Each task centres its vectors on an integer point near their mean and cuts
the differences into limbs of 18 bits, so that float64 matrix products of limbs are exact; products of
limbs are put together as big integers and taken to one common origin. Tasks' moments are summed as
40-bit parts by a grouped aggregation. The covariance's entries are then quotients of exact integers,
each rounded once, and its eigenvectors whiten the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm import shared
from moundworks.llm.vectors import floored, matrices

LIMB = 18  # digits lie in [-2^17, 2^17), so a product of two summed over 2^16 rows is below 2^51
MOST_ROWS = 1 << 16
PART, PARTS = 40, 5  # of a sum on its way: a million tasks' parts fit a long
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Integers as digits of base 2^18, low ones first, each about zero."""
    out, half, mask = [], 1 << (LIMB - 1), (1 << LIMB) - 1
    while not out or y.any():
        low = ((y + half) & mask) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return out


def gram(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and products of columns over at most ``MOST_ROWS`` rows of integers, as big integers."""
    digits = limbs(y)
    sums = sum(d.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i) for i, d in enumerate(digits))
    products = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits[: i + 1]):
            p = (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
            products += p if i == j else p + p.T
    return sums, products


@dataclass
class Moments:
    """Of integer vectors about ``origin``: how many, their sums and products."""

    size: int
    origin: int
    n: int = 0

    def __post_init__(self) -> None:
        self.sums = np.zeros(self.size, object)
        self.products = np.zeros((self.size, self.size), object)

    def add(self, x: np.ndarray) -> None:
        for a in range(0, len(x), MOST_ROWS):
            some = x[a : a + MOST_ROWS]
            centre = np.floor(some.mean(axis=0)).astype(np.int64)
            sums, products = gram(some - centre)
            far, n = centre.astype(object) - self.origin, len(some)
            self.products += products + np.outer(far, sums) + np.outer(sums, far) + n * np.outer(far, far)
            self.sums += sums + n * far
            self.n += n

    def entries(self) -> pa.RecordBatch:
        """(size, i, j, p0 ...): the count at (-1, -1), sums at (-1, j), products at i <= j."""
        i, j = np.triu_indices(self.size)
        v = np.concatenate([np.array([self.n], object), self.sums, self.products[i, j]])
        i = np.concatenate([np.full(self.size + 1, -1), i])
        j = np.concatenate([[-1], np.arange(self.size), j])
        parts = [((v >> (PART * k)) & ((1 << PART) - 1) if k < PARTS - 1 else v >> (PART * k)).astype(np.int64) for k in range(PARTS)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), self.size)), pa.array(i), pa.array(j), *map(pa.array, parts)], names=["size", "i", "j", *(f"p{k}" for k in range(PARTS))])


@dataclass
class Model:
    """``axes``: unit eigenvectors by falling eigenvalue; a scale of 0 stands for no variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    scale: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray, origin: int) -> tuple[np.ndarray, list[int]]:
        """Whitened rows (NaN where there is no variance) and their exact sums of (n * x - sum)^2."""
        base = np.array([s // self.n + origin for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        y = x - base
        with np.errstate(divide="ignore", invalid="ignore"):
            white = np.where(self.scale > 0, (y - rest / self.n) @ (self.axes.T / self.scale), np.nan)
        far = int(np.abs(y).max(initial=0)) + 1
        if x.shape[1] * (self.n * far) ** 2 < 1 << 63:
            return white, ((self.n * y - rest) ** 2).sum(axis=1).tolist()
        return white, ((self.n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()


def decompose(size: int, n: int, sums: list[int], products: np.ndarray, components: int) -> Model:
    """``products``: about the same origin as ``sums``. An eigenvalue below 1e-12 of the largest is none."""
    s = np.array(sums, object)
    exact = n * products - np.outer(s, s)
    cov = (exact / n**2).astype(np.float64)  # a quotient of integers is rounded once
    trace = int(np.trace(exact)) / n**2
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components].T
    axes = axes / np.linalg.norm(axes, axis=1, keepdims=True)
    real = values > 1e-12 * max(values[0], 0.0)
    return Model(n, sums, axes, np.where(real, np.sqrt(np.where(real, values, 1.0)), 0.0), np.where(real, values, 0.0) / trace if trace else np.full(len(values), np.nan))


def fit(distinct: DataFrame, origin: int, components: int, most_sizes: int) -> dict[int, Model]:
    """A model for each length of vectors in ``distinct`` (x). What comes to the driver is one row a
    length: ``components`` times its size numbers."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for size, _, x in matrices(batch.column(0)):
                held.setdefault(size, Moments(size, origin)).add(x)
        for m in held.values():
            yield m.entries()

    parts = [f"p{k}" for k in range(PARTS)]
    entries = distinct.mapInArrow(moments, "size long, i long, j long, " + ", ".join(f"{p} long" for p in parts))
    summed = entries.groupBy("size", "i", "j").agg(*[F.sum(p).alias(p) for p in parts])

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(key[0])
        v = sum(pdf[p].to_numpy().astype(object) << (PART * k) for k, p in enumerate(parts))
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        sums, products = np.zeros(size, object), np.zeros((size, size), object)
        own = i < 0
        sums[j[own & (j >= 0)]] = v[own & (j >= 0)]
        products[i[~own], j[~own]] = v[~own]
        products[j[~own], i[~own]] = v[~own]
        m = decompose(size, int(v[own & (j < 0)][0]), sums.tolist(), products, components)
        return pd.DataFrame({"size": [size], "n": [m.n], "sums": [[str(s) for s in m.sums]], "axes": [m.axes.ravel().tolist()], "scale": [m.scale.tolist()], "explained": [m.explained.tolist()]})

    rows = summed.groupBy("size").applyInPandas(solve, "size long, n long, sums array<string>, axes array<double>, scale array<double>, explained array<double>").limit(most_sizes + 1).collect()
    if len(rows) > most_sizes:
        raise ValueError(f"more than {most_sizes} lengths of vectors")
    return {r["size"]: Model(r["n"], [int(s) for s in r["sums"]], np.array(r["axes"]).reshape(-1, r["size"]), np.array(r["scale"]), np.array(r["explained"], float)) for r in rows}


def whiten(vectors: DataFrame, scale: float = 64, offset: int = 1_000_000, components: int = 16, most_sizes: int = 256) -> DataFrame:
    """Per row with a finite vector and component (from 1, by falling eigenvalue, up to ``components``):
    vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits.

    Vectors that are null or hold null or non-finite entries, or have no entry, give no rows. The model
    is fitted on each distinct integer vector once (``n`` of them), so copies do not weigh; every row,
    copies and rows without a vec_id too, has its own output. Vectors of each length have a model of
    their own; more than ``most_sizes`` lengths are refused. A component without variance (an eigenvalue
    below 1e-12 of the largest) has a null ``whitened``, and a null ``explained`` where nothing varies.
    ``deviation`` is exact, and null where it is no long: ``deviation_digits`` has it always.
    ``identity_error`` is measured on the whitened fit list of that length.
    """
    shared.ship(vectors.sparkSession)
    rows, x = floored(vectors, scale, offset)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") > 0)
    distinct = shared.staged(rows.select("x").distinct(), "distinct-vectors")
    models = fit(distinct, offset, components, most_sizes)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, m in matrices(batch.column(0)):
                white, _ = models[size].whiten(m, offset)
                white = np.concatenate([np.ones((len(white), 1)), np.nan_to_num(white)], axis=1)
                held[size] = held.get(size, 0.0) + white.T @ white
        for size, p in held.items():
            i, j = np.divmod(np.arange(p.size), len(p))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(p.size, size)), pa.array(i), pa.array(j), pa.array(p.ravel())], names=["size", "i", "j", "p"])

    # (components + 1)^2 numbers a length
    measured: dict[int, dict[tuple[int, int], float]] = {}
    for r in distinct.mapInArrow(products, "size long, i long, j long, p double").groupBy("size", "i", "j").agg(F.sum("p").alias("p")).collect():
        measured.setdefault(r["size"], {})[r["i"], r["j"]] = r["p"]
    errors = {}
    for size, p in measured.items():
        real = [k + 1 for k, s in enumerate(models[size].scale.tolist()) if s > 0]
        n = p[0, 0]
        errors[size] = max((abs(p[i, j] / n - p[0, i] * p[0, j] / n**2 - (i == j)) for i in real for j in real), default=0.0)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                some = batch.slice(a, 2048)
                for size, at, m in matrices(some.column(1)):
                    model = models[size]
                    white, deviation = model.whiten(m, offset)
                    k, n = white.shape[1], len(at)
                    fits = [d if d < 1 << 63 else None for d in deviation]
                    white, explained = white.ravel(), np.tile(model.explained, n)
                    every = np.repeat(np.arange(n), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, model.n)), pa.array(fits, pa.int64()).take(pa.array(every)),
                            pa.array(white, mask=np.isnan(white)), pa.array(explained, mask=np.isnan(explained)), pa.array(np.full(n * k, errors[size])), pa.array([str(d) for d in deviation]).take(pa.array(every)),
                        ],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
                    )

    return rows.mapInArrow(give, OUT)
