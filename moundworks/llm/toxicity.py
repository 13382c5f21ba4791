"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams (lower case, white space as one character),
hashed to ``2 ** bits`` slots. On the training rows a slot's ratio is the log of its smoothed share in
toxic texts over that in the others; slots with the most telling ratios are kept, and a logistic
regression is fitted over the kept slots' presence times their ratio. A score needs the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm import shared

ORDERS = (3, 4, 5, 6, 7)
GROUP = 1 << 18  # characters of text whose n-grams are hashed at a time
ROWS = 500  # texts that are Python strings at a time


@dataclass
class Model:
    """``weight`` by slot (0: not kept) and ``bias``; bounded by the number of slots."""

    bits: int
    weight: np.ndarray
    bias: float


def groups(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, end of each text) for runs of texts, each between spaces."""
    held, ends, size = [], [], 0
    for t in texts:
        held.append(" " + t + " ")
        size += len(held[-1])
        ends.append(size)
        if size >= GROUP:
            yield codes(held), np.array(ends)
            held, ends, size = [], [], 0
    if held:
        yield codes(held), np.array(ends)


def codes(texts: list[str]) -> np.ndarray:
    """Code points in lower case where that keeps the length, white space as a space."""
    lower = [x if len(x := t.lower()) == len(t) else t for t in texts]
    out = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    out[out < 33] = 32
    return out


def slots(c: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each order n with the slot of the n-gram at each place."""
    h = c * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :]
        if n in ORDERS:
            yield n, (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def present(c: np.ndarray, ends: np.ndarray, bits: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, slot), ascending; with ``wanted`` only of slots it is true for."""
    found = []
    for n, s in slots(c, bits):
        at = np.flatnonzero(wanted[s]) if wanted is not None else np.arange(len(s))
        text = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[text]
        found.append(text[inside].astype(np.int64) << bits | s[at[inside]])
    both = np.unique(np.concatenate(found))
    return both >> bits, both & ((1 << bits) - 1)


def train(labelled: DataFrame, bits: int = 18, kept: int = 1500, penalty: float = 3.0, steps: int = 150) -> Model:
    """Fit on rows (text, label 0 or 1); their number is bounded by the caller. Counts of all slots
    are summed on the executors; to the driver come two counts a slot and, of each row, its kept slots."""
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    n_slots = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n_slots), np.int64)
        for batch in batches:
            label = np.array(batch.column(1).to_pylist())
            done = 0
            for c, ends in groups(batch.column(0).to_pylist()):
                text, slot = present(c, ends, bits, None)
                y = label[done : done + len(ends)][text]
                for k in (0, 1):
                    total[k] += np.bincount(slot[y == k], minlength=n_slots)
                done += len(ends)
        some = np.flatnonzero(total.any(axis=0))
        for a in range(0, n_slots, n_slots >> 4):
            own = some[(some >= a) & (some < a + (n_slots >> 4))]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[0, own]), pa.array(total[1, own])], names=["slot", "clean", "toxic"])

    sums = rows.mapInArrow(count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    total = np.zeros((2, n_slots))
    slot = sums["slot"].to_numpy()
    total[0, slot], total[1, slot] = sums["clean"].to_numpy(), sums["toxic"].to_numpy()
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):  # one class or none: its share is all there is to know
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1.0)
        return Model(bits, np.zeros(n_slots, np.float32), float(np.log(share / (1 - share))))
    p, q = (total[1] + 1) / (n[1] + 2), (total[0] + 1) / (n[0] + 2)
    ratio = np.log(p / q)
    # how far the toxic share of the rows that hold a slot is from chance, in standard deviations
    both, base = total.sum(axis=0), n[1] / (n[0] + n[1])
    telling = np.abs(total[1] - both * base) / np.sqrt(both * base * (1 - base) + 1)
    top = np.sort(np.argsort(-telling, kind="stable")[:kept])
    wanted = np.zeros(n_slots, bool)
    wanted[top] = True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, done = batch.column(1).to_pylist(), 0
            for c, ends in groups(batch.column(0).to_pylist()):
                text, slot = present(c, ends, bits, wanted)
                cut = np.searchsorted(text, np.arange(len(ends) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(label[done : done + len(ends)], pa.int32()), pa.array([slot[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())], names=["label", "slots"])
                done += len(ends)

    sparse = rows.mapInArrow(pick, "label int, slots binary").toArrow()
    parts = [np.frombuffer(x.as_py(), "<u4") for x in sparse["slots"]]
    y = sparse["label"].to_numpy().astype(float)
    sizes = np.array([len(x) for x in parts])
    column = np.searchsorted(top, np.concatenate(parts)) if sizes.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(y)), sizes)
    scale = ratio[top]
    fitted, bias = logistic(row, column, scale, y, penalty, steps)
    weight = np.zeros(n_slots, np.float32)
    weight[top] = fitted * scale
    return Model(bits, weight, bias)


def logistic(row: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Both classes weigh the same. Gradient descent with momentum and steps scaled by column."""
    weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    x = scale[column]
    for t in range(1, steps + 1):
        z = np.bincount(row, x * w[column], len(y)) + b
        err = weigh * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.append(np.bincount(column, x * err[row], len(scale)) + penalty * w / len(y), err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9) * min(1.0, 2 * (1 - t / (steps + 1)))
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    wanted, out = model.weight != 0, [np.zeros(0)]
    for c, ends in groups([t or "" for t in texts]):
        text, slot = present(c, ends, model.bits, wanted)
        z = np.bincount(text, model.weight[slot], len(ends)) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
    return np.concatenate(out)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, whole, whose score is below the threshold. Columns may have any names;
    repeated rows stay or go together; a null text is empty; an empty table stays empty."""
    shared.ship(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                yield some.filter(pa.array(scores(some.column("text").to_pylist(), model) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every whole text; a null text is empty
    and an empty one gets what the bias alone says."""
    shared.ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores(some.column(1).to_pylist(), model))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def labelled_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``train_rows`` labelled doc_ids outside the held-out third, those of
    smallest hash, so they do not depend on how the table is dealt; dealt out over all tasks."""
    shared.ship(docs.sparkSession)
    some = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
    some = some.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")
    # so few rows lie in few files: they are dealt out, as counting their n-grams takes longest
    return shared.staged(rows.repartition(shared.parts(docs.sparkSession, 0, 1)), "labelled")


def cross_validated(docs: DataFrame, labels: DataFrame, settings: list[dict], folds: int = 3, threshold: float = 0.7, train_rows: int = 20_000) -> list[dict]:
    """Each setting with its balanced log loss, recall and share of false positives, over folds inside the
    training rows: rows of the held-out third are neither trained on nor looked at, so a choice made here
    leaves its measurement independent. Folds go by the quotient of the same checksum."""
    rows = labelled_rows(docs, labels, train_rows).withColumn("fold", F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3) % folds)
    out = []
    for options in settings:
        parts = []
        for k in range(folds):
            model = train(rows.where(F.col("fold") != k).select("text", "label"), **options)
            test = rows.where(F.col("fold") == k)
            parts.append(score(test.withColumn("doc_id", F.struct("doc_id", "label")), model))
        scored = reduce(DataFrame.unionByName, parts).select("doc_id.label", F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p"))
        y = F.col("label") == 1
        r = scored.agg(
            (F.avg(F.when(y, -F.ln("p"))) / 2 + F.avg(F.when(~y, -F.ln(1 - F.col("p")))) / 2).alias("loss"), F.avg(F.when(y, (F.col("p") >= threshold).cast("int"))).alias("recall"), F.avg(F.when(~y, (F.col("p") >= threshold).cast("int"))).alias("false_positives")
        ).first()
        out.append({**options, **r.asDict()})
    return out


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, **options: float) -> Model:
    """Train on labelled rows outside the held-out third (crc32 of doc_id as text, mod 3, is 1).

    ``train_rows`` bounds the sample: the labelled doc_ids of smallest hash, so it does not depend on
    how the table is dealt. Being bounded it is broadcast, and texts are not moved. Labels null or
    other than 0 and 1, and rows with a null doc_id, take no part.
    """
    return train(labelled_rows(docs, labels, train_rows).select("text", "label"), **options)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. A null doc_id isn't held out, null and empty
    texts get what the bias alone says, repeated rows are each a row with one score, an empty table
    gives no rows, and other columns, whatever their names, are not looked at."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
