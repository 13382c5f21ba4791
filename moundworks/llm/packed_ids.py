"""Token ids as fixed-width packed binary files, with random access.

Each id takes the fewest bits that hold the vocabulary's largest id. A file (a shard) is, all little-endian::

    magic "MWID"  u16 version  u16 bits  u32 ids per block  u64 documents  u64 ids
    i64 doc_id    per document (and a byte each that is 1 where doc_id is null)
    u64 ids       per document (its end id counts)
    u64 offset    per block: byte offset of the block in the payload
    payload       blocks, each packed on its own, most significant bit first, padded to a whole byte

So block ``i // ids_per_block`` is unpacked alone by numpy to reach id ``i``.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundworks.llm import shared
from moundworks.llm.tokens import END_ID, encoded
from moundworks.llm.tokens import encoder as shared_encoder

MAGIC, VERSION = b"MWID", 1
HEADER = struct.Struct("<4sHHIQQ")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    return np.packbits((ids.astype("<u4")[:, None] >> np.arange(bits - 1, -1, -1, dtype="<u4") & 1).astype(np.uint8)).tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return each @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = 4096) -> bytes:
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1] if blocks else np.zeros(0)
    return b"".join([
        HEADER.pack(MAGIC, VERSION, bits, block, len(doc_ids), len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        bytes(d is None for d in doc_ids),
        np.array(lengths, "<u8").tobytes(),
        offsets.astype("<u8").tobytes(),
        *blocks,
    ])


class IdFile:
    """Reads one file's bytes: whole, by document, or any range of ids."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.bits, self.block, docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of packed ids")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.is_null = np.frombuffer(data, np.uint8, docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks, at + 17 * docs).astype(np.int64)
        self.payload = memoryview(data)[at + 17 * docs + 8 * n_blocks :]

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (not included); only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        got = [unpack(self.payload[self.offsets[b] :], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k] + self.lengths[k]))


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file so that it is there whole or not at all: a task that is run again, or twice at
    once, writes the same bytes under the same name."""
    own = f".{name}.{uuid.uuid4().hex}"
    where = urlparse(folder)
    if where.scheme in ("", "file"):
        os.makedirs(where.path, exist_ok=True)
        with open(f"{where.path}/{own}", "wb") as f:
            f.write(data)
        os.replace(f"{where.path}/{own}", f"{where.path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{own}") as f:
        f.write(data)
    store.move(f"{path}/{own}", f"{path}/{name}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, vocabulary: int | None = None, shard_ids: int = 1 << 22, task_bytes: int = 16 << 20) -> DataFrame:
    """Encode every text (null: empty) and write the shards to ``folder`` in ascending doc_id order.

    Returns a row per shard: file, task and number (their order is that of the documents), n_docs,
    n_ids. Documents are dealt to tasks by ranges of (doc_id, hash of text), so a task holds one
    shard of about ``shard_ids`` ids at a time whatever the ranges hold. Null doc_ids come first;
    rows of one doc_id follow each other by the hash of their text. An empty table writes no shard.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    n = shared.parts(spark, shared.input_bytes(docs), task_bytes)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, shard = TaskContext.get().partitionId(), 0
        encoder = shared_encoder(tokenizer)
        bits = bits_for(max(vocabulary or encoder.tokenizer.get_vocab_size(), end_id + 1))
        end = struct.pack("<I", end_id)
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        n_ids = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, n_ids
            name = f"{task:08d}-{shard:08d}.ids"
            ids = np.frombuffer(b"".join(held), "<u4")
            held.clear()  # before they are packed, so that they are held once
            put(folder, name, to_file(doc_ids, lengths, ids, bits))
            row = pa.RecordBatch.from_pylist([{"file": name, "task": task, "number": shard, "n_docs": len(doc_ids), "n_ids": n_ids}])
            shard, n_ids = shard + 1, 0
            for x in (doc_ids, lengths):
                x.clear()
            return row

        for batch in batches:
            for d, ids in encoded(encoder, batch):
                ids += end
                doc_ids.append(d)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n_ids += lengths[-1]
                if n_ids >= shard_ids:
                    yield close()
        if doc_ids:
            yield close()

    return shared.staged(dealt.mapInArrow(encode, "file string, task long, number long, n_docs long, n_ids long"), "ids-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32. ``manifest`` has a row per shard and no more; only those are summed in one task."""
    spark = manifest.sparkSession
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("file_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = IdFile(content.as_py())
                ids = f.range(0, f.n_ids)
                crc = [zlib.crc32(ids[s : s + n]) for s, n in zip(f.starts.tolist(), f.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(crc)), pa.array(f.doc_ids, mask=f.is_null), pa.array(f.starts), pa.array(f.lengths), pa.array(crc, pa.int64())], names=["file", "doc_id", "local", "n_tokens", "ids_crc32"]
                )

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").load(f"{folder}/*.ids").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.mapInArrow(decode, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    folder = shared.fresh_dir(docs.sparkSession, "ids")
    return read(write(docs, folder, tokenizer, end_id), folder)
