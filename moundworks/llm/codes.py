"""Product quantisation of embeddings by Lloyd's rounds that are kept up by deltas.

Vectors become integers and are packed once into blocks, a table bucketed by block. Each round reads
the blocks beside the codes of the round before, writes the new codes as such a table (so the two meet
without a shuffle), and with them what entered and left each codebook entry because a part changed
its entry. Only these plus and minus contributions are summed over blocks and shuffled; running sums
and counts turn them into the next codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundworks.llm import shared
from moundworks.llm.vectors import floored, matrices

Books = dict[int, list[np.ndarray]]  # for each length of vectors, a table of entries for each part
MOST = 1 << 49  # components of 1e11 and more are held there, so that a block's sums are longs
DELTA = "struct<size: long, part: int, entry: int, n: long, sums: array<long>>"


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower one, and its squared distance; exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 8 * x.shape[1] * most**2 < 1 << 53:  # all of it stays whole in float64
        a, c = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    else:
        a, c = x.astype(object), book.astype(object)
        d = np.stack([((a - e) ** 2).sum(axis=1) for e in c], axis=1)
    at = np.argmin(d, axis=1)
    least = np.take_along_axis(d, at[:, None], axis=1)[:, 0]
    return at.astype(np.uint8), least.astype(np.int64) if least.dtype != object else least


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of codes for each vector, and its squared distances summed over parts."""
    step = x.shape[1] // len(books)
    found = [nearest(x[:, p * step : (p + 1) * step], b) for p, b in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), sum(d.astype(object) for _, d in found)


def changes(size: int, x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> list[dict]:
    """What parts that changed their entry add to the new one's sums and take from the old one's."""
    parts = new.shape[1]
    step, out = size // parts, []
    for p in range(parts):
        moved = np.ones(len(x), bool) if old is None else old[:, p] != new[:, p]
        rows = x[moved, p * step : (p + 1) * step]
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for sign, codes in ((1, new), (-1, old)):
            if codes is None:
                continue
            own = codes[moved, p]
            for e in np.unique(own).tolist():
                n[e] = n.get(e, 0) + sign * int((own == e).sum())
                sums[e] = sums.get(e, 0) + sign * rows[own == e].sum(axis=0)
        out += [{"size": size, "part": p, "entry": e, "n": n[e], "sums": sums[e].tolist()} for e in n]
    return out


def starts(rows: DataFrame, entries: int, parts: int, most_sizes: int) -> Books:
    """The first codebooks: the vectors of the smallest vec_ids, of one id the least vector. What comes
    to the driver is ``entries`` vectors of each length."""
    known = rows.where("vec_id IS NOT NULL").select(F.size("x").alias("size"), "vec_id", "x")
    order = Window.partitionBy("size").orderBy("vec_id")
    ids = known.select("size", "vec_id").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= entries)
    first = known.join(F.broadcast(ids.drop("k")), ["size", "vec_id"]).groupBy("size", "vec_id").agg(F.min("x").alias("x"))  # bounded: ``entries`` a length
    out: dict[int, list] = {}
    for r in first.orderBy("size", "vec_id").limit(most_sizes * entries + 1).collect():
        out.setdefault(r["size"], []).append(r["x"])
    if len(out) > most_sizes:
        raise ValueError(f"more than {most_sizes} lengths of vectors")
    return {size: np.split(np.array(x, np.int64), parts, axis=1) for size, x in out.items()}


def packed(rows: DataFrame, tasks: int, block_rows: int) -> DataFrame:
    """Blocks of rows as Arrow bytes, in a table bucketed by block: a file for each of ``tasks``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, block_rows):
                some = batch.slice(a, block_rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(some)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])
                block += 1

    return bucketed(rows.mapInArrow(pack, "block long, payload binary").repartition(tasks, "block"), tasks, "vector_blocks")


def bucketed(df: DataFrame, tasks: int, name: str) -> DataFrame:
    table = shared.fresh_table(name)
    df.write.bucketBy(tasks, "block").option("compression", "none").option("path", shared.fresh_dir(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)


def unpacked(payload: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload.as_buffer()).read_next_batch()


def lloyd(blocks: DataFrame, books: Books, tasks: int, rounds: int) -> Books:
    """The codebooks after so many rounds. A round without a change ends them: the rest would be alike."""
    sums = {size: [np.zeros(b.shape, object) for b in own] for size, own in books.items()}
    counts = {size: [np.zeros(len(b), object) for b in own] for size, own in books.items()}
    before = None
    for _ in range(rounds):

        def assign(batches: Iterator[pa.RecordBatch], books: Books = books) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, payload, old in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    codes, deltas, at = [], [], 0
                    for size, _, x in matrices(unpacked(payload).column("x")):
                        new, _ = encode(x, books[size])
                        had = None if old is None else np.frombuffer(old, np.uint8)[at : at + new.size].reshape(new.shape)
                        deltas += changes(size, x, had, new)
                        codes.append(new.tobytes())
                        at += new.size
                    kind = pa.struct([("size", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([b"".join(codes)], pa.binary()), pa.array([deltas], pa.list_(kind))], names=["block", "codes", "deltas"])

        known = blocks.withColumn("codes", F.lit(None).cast("binary")) if before is None else blocks.join(before.select("block", "codes"), "block", "left")
        before = bucketed(known.select("block", "payload", "codes").mapInArrow(assign, f"block long, codes binary, deltas array<{DELTA}>"), tasks, "vector_codes")
        each = before.select(F.inline("deltas")).select("size", "part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("k", "v"))
        # a number for each component of each entry, whatever the table holds
        moved = each.groupBy("size", "part", "entry", "k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()
        if not moved:
            break
        for r in moved:
            if r["k"]:
                sums[r["size"]][r["part"]][r["entry"], r["k"] - 1] += int(r["v"])
            else:
                counts[r["size"]][r["part"]][r["entry"]] += int(r["v"])
        books = {size: [np.array([s // n if n else b for s, n, b in zip(sums[size][p], counts[size][p], own[p], strict=True)], np.int64).reshape(own[p].shape) for p in range(len(own))] for size, own in books.items()}
    return books


def digest(own: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in own for v in b.ravel().tolist()).encode()).hexdigest()


def quantise(vectors: DataFrame, scale: float = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, most_sizes: int = 256, block_rows: int = 4096, task_bytes: int = 32 << 20) -> DataFrame:
    """Per row with a finite vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components give no rows. Every other row has its
    own, copies and rows without a vec_id too; such rows give no start of a codebook, and rows of one
    vec_id give one, the least vector. A table with fewer vec_ids has shorter codebooks. Vectors of each
    length have codebooks of their own, more than ``most_sizes`` lengths are refused, and a length that
    can't be cut into ``parts`` equal parts (none at all included), or has no vec_id to start from, has
    a null code, error and digest. Errors and sums of them that are no longs are null. Null labels are one label; a
    table without a label column has one too. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    shared.ship(spark)
    rows, x = floored(vectors, scale, most=MOST)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x"))
    fits = (F.size("x") > 0) & (F.size("x") % parts == 0)
    books = starts(rows.where(fits), entries, parts, most_sizes)
    has = fits & F.size("x").isin(*books) if books else F.lit(False)
    tasks = shared.parts(spark, shared.input_bytes(vectors, F.size("embedding") * 8), task_bytes)
    blocks = packed(rows.where(has), tasks, block_rows)
    books = lloyd(blocks, books, tasks, rounds)
    digests = {size: digest(own) for size, own in books.items()}

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                some = unpacked(payload)
                for size, at, m in matrices(some.column("x")):
                    codes, error = encode(m, books[size])
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("vec_id").take(at), some.column("label").take(at), pa.array([c.tobytes().hex() for c in codes]), pa.array([e if e < 1 << 63 else None for e in error], pa.int64()), pa.array([digests[size]] * len(at))],
                        names=["vec_id", "label", "code", "error", "codebooks_sha256"],
                    )

    kind = rows.schema["label"].dataType.simpleString()
    coded = blocks.select("payload").mapInArrow(give, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")
    none = rows.where(~has).select("vec_id", "label", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("codebooks_sha256", "string"))])
    coded = shared.staged(coded.unionByName(none), "coded")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.when(F.count_if(F.col("code").isNotNull() & F.col("error").isNull()) == 0, F.try_sum("error")).alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
