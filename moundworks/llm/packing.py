"""Best-fit packing of token sequences into rows of fixed capacity, in bounded space.

A document longer than the capacity is cut into full pieces behind a first piece that may be
shorter; a full piece is a sequence by itself. The other pieces are packed online by best fit: of a
fixed number of open bins, held in a bitset keyed by free space, the fullest that has room takes the
piece, and when a new bin is needed beyond that number the fullest closes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm import shared
from moundworks.llm.tokens import END_ID, encoded
from moundworks.llm.tokens import encoder as shared_encoder

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """``place(length)`` gives (bin, offset). ``open_bins`` bounds what is held."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f: some open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def place(self, length: int) -> tuple[int, int]:
        room = self.bits >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            bins = self.by_free[free]
            k = bins.pop()
            if not bins:
                self.bits ^= 1 << free
        else:
            if self.n_open >= self.open_bins:
                self.close_fullest()
            free, k = self.capacity, self.n_bins
            self.n_bins += 1
            self.n_open += 1
        left = free - length
        if left:
            self.by_free[left].append(k)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        return k, self.capacity - free

    def close_fullest(self) -> None:
        least = (self.bits & -self.bits).bit_length() - 1
        self.by_free[least].pop()
        if not self.by_free[least]:
            self.bits ^= 1 << least
        self.n_open -= 1


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, row (tells rows of one doc_id apart), piece, start, length, ids_crc32."""
    shared.ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        encoder, end = shared_encoder(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            out: list[tuple] = []
            for d, ids in encoded(encoder, batch):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                at, k = 0, 0
                while at < n:
                    size = first if not k else capacity
                    out.append((d, row, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
                row += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID, open_bins: int = 4096, group_pieces: int = 1_000_000) -> DataFrame:
    """Pack every document: a row per piece with sequence_id and offset (gapless from 0).

    A null text is empty and still has its end id, so each row has one piece at least; rows of one
    doc_id are packed each for itself; an empty table gives no rows. Pieces are dealt by a hash to
    groups of about ``group_pieces``, one task each, that share no sequence. Within a group, runs of
    as many pieces as there are open bins come longest first: the long ones open bins that the short
    ones fill, and what stays open serves the next run.
    """
    cut = shared.staged(pieces(docs, tokenizer, capacity, end_id), "pieces")
    groups = max(1, -(-cut.where(F.col("length") < capacity).count() // group_pieces))
    single = cut.where(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("n"))
    full = single.select("doc_id", "row", "piece", "start", "length", "ids_crc32", (-1 - F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    key = F.xxhash64("doc_id", "row", "piece")
    columns = full.columns
    short = cut.where(F.col("length") < capacity).withColumns({"h": key, "group": F.pmod(key, F.lit(groups))})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "row", "piece"], ignore_index=True)
        run = np.arange(len(pdf)) // open_bins
        pdf = pdf.iloc[np.lexsort((-pdf["length"].to_numpy(), run))]
        bins = BestFit(capacity, open_bins)
        placed = np.array([bins.place(x) for x in pdf["length"].tolist()], np.int64).reshape(-1, 2)
        return pdf.assign(sequence_id=pdf["group"] * (1 << 40) + placed[:, 0], offset=placed[:, 1])[columns]

    return full.unionByName(short.groupBy("group").applyInPandas(fill, full.schema))
