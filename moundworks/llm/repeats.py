"""Repeated windows of a corpus, found exactly without moving the corpus.

A window is ``width`` consecutive units (bytes or words) of one document. Its minimiser is the
smallest hash of the ``gram``-unit strings inside it, so equal windows have equal minimisers, and
consecutive windows that share one form a super-k-mer, which travels as one string.

Documents are packed into blocks of a few MB, kept in a table bucketed by block, so that what comes
back to a block joins it in place. Minimisers are dealt by their hash to buckets, each of which is one
group in memory; a task goes through its buckets one after another. Then:

1. each block sends its distinct minimisers, four bytes each, to their buckets; a bucket answers
   which of them the corpus has more than once (others can't belong to a repeated window) and which
   are in so many blocks that their super-k-mers are to be sent window by window, by the windows' own hash;
2. each block sends each distinct super-k-mer of a repeated minimiser once, with its first place in
   the block, to its bucket, which finds the first place of each window in the corpus;
3. each block gets those first places back and marks the windows that have an earlier one.

A hot passage is one string a block however often it occurs; all else is spread by hash.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm import shared

NO_ID = -(1 << 63)  # stands for a null doc_id, before all others
BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 17  # units hashed at a time, so that the work stays in the processor's cache
MOST_TASKS = shared.MOST_PARTS  # table buckets too; beyond it tasks get more buckets, which stay small


def dump(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def load(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each ``n`` consecutive codes, by doubling."""
    whole, size, out, have = codes, 1, None, 0
    while True:
        if n & size:
            out, have = (whole, size) if out is None else (out[: len(out) - size] * power(size) + whole[have : have + len(out) - size], have + size)
        size *= 2
        if size > n:
            return out
        half = size // 2
        whole = whole[: len(whole) - half] * power(half) + whole[half:]


def sliding(f: Callable, x: np.ndarray, n: int) -> np.ndarray:
    """``f`` (minimum or maximum) over each ``n`` consecutive values."""
    size = 1
    while size * 2 <= n:
        x = f(x[: len(x) - size], x[size:])
        size *= 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each non-empty word raw[begin:end], of its bytes and length."""
    size = end - begin
    if not len(size):
        return np.zeros(0, np.uint64)
    powers = np.full(int(size.max()), BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    out = np.empty(len(size), np.uint64)
    for a in range(0, len(size), PIECE):
        s, b = size[a : a + PIECE], begin[a : a + PIECE]
        first = np.cumsum(s) - s
        place = np.arange(int(s.sum())) - np.repeat(first, s)
        out[a : a + PIECE] = np.add.reduceat((raw[place + np.repeat(b, s)] + np.uint64(1)) * powers[place], first)
    return mixed(out + size.astype(np.uint64) * np.uint64(0x94D049BB133111EB))


@dataclass
class Plan:
    """How a corpus is cut: ``units`` is "bytes" or "words"."""

    units: str
    width: int
    gram: int
    same_document: bool  # an earlier window of the same document counts too
    hot_blocks: int = 4096


class Block:
    """The documents of a block: ids ascending, their bytes, and the hashes of their units."""

    def __init__(self, payload: bytes, plan: Plan) -> None:
        self.plan = plan
        self.doc_ids, sizes, self.data = load(payload)
        raw = np.frombuffer(self.data, np.uint8)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        if plan.units == "bytes":
            self.unit_begin = self.unit_end = None
            self.doc_at = np.concatenate([[0], self.ends])
            codes_of = self._byte_codes(raw)
        else:
            codes = self._words(raw)
            codes_of = lambda a, b: codes[a:b]
        self.n_units = int(self.doc_at[-1])
        self._minimise(codes_of)

    @staticmethod
    def _byte_codes(raw: np.ndarray) -> Callable:
        of = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
        return lambda a, b: of[raw[a:b]]

    def _words(self, raw: np.ndarray) -> np.ndarray:
        """Texts are words joined by one space; a document's last word ends at its end."""
        edge = raw == 32
        last = self.ends[self.ends > self.begins] - 1
        inside_end = np.flatnonzero(edge)
        self.unit_end = np.sort(np.concatenate([inside_end, last + 1]))
        self.unit_begin = np.sort(np.concatenate([inside_end + 1, self.begins[self.ends > self.begins]]))
        self.doc_at = np.concatenate([[0], np.searchsorted(self.unit_begin, self.ends)])
        if not len(self.unit_begin):
            return np.zeros(0, np.uint64)
        return word_hashes(raw, self.unit_begin, self.unit_end)

    def _minimise(self, codes_of: Callable) -> None:
        """Runs of windows with one minimiser: ``run_at`` (first window), ``run_n``, ``run_key``;
        also ``occurs``: the hash at each place that is the minimiser of some window."""
        w, g = self.plan.width, self.plan.gram
        n_windows = max(0, self.n_units - w + 1)
        sizes = np.diff(self.doc_at)
        doc_end = self.doc_at[1:]
        at, key, occurs = [], [], []
        self.hash_first = np.empty(n_windows, np.uint64)  # of whole windows
        for a in range(0, n_windows, PIECE):
            b = min(n_windows, a + PIECE)
            codes = codes_of(a, b + w - 1)
            grams = mixed(gram_hashes(codes, g))
            low = sliding(np.minimum, grams, w - g + 1)
            self.hash_first[a:b] = gram_hashes(codes, w)
            # windows that end in another document are none
            d0, d1 = np.searchsorted(doc_end, [a, b], side="right")
            d1 = min(d1 + 1, len(sizes))
            over_from = np.clip(np.maximum(doc_end[d0:d1] - w + 1, self.doc_at[d0:d1]), a, b) - a
            over_to = np.clip(doc_end[d0:d1], a, b) - a
            step = np.zeros(b - a + 1, np.int32)
            np.add.at(step, over_from, 1)
            np.add.at(step, over_to, -1)
            good = np.cumsum(step[:-1]) == 0
            start = good.copy()
            start[1:] &= (low[1:] != low[:-1]) | ~good[:-1]
            firsts = np.unique(np.concatenate([np.flatnonzero(start), (self.doc_at[d0:d1] - a)[(self.doc_at[d0:d1] >= a) & (self.doc_at[d0:d1] < b)]]))
            firsts = firsts[(firsts < len(good))]
            firsts = firsts[good[firsts]]
            stop = np.flatnonzero(np.concatenate([good[:-1] & ~good[1:], [bool(good[-1])]]))
            bound = np.concatenate([firsts, [b - a]])
            last = np.minimum(bound[1:], stop[np.searchsorted(stop, firsts)] + 1)
            at.append(np.stack([firsts + a, last - firsts]))
            key.append(low[firsts])
            if self.plan.same_document:
                masked = np.where(good, low, np.uint64(0))
                padded = np.concatenate([np.zeros(w - g, np.uint64), masked, np.zeros(w - g, np.uint64)])
                top = sliding(np.maximum, padded, w - g + 1)
                occurs.append(grams[(grams == top[: len(grams)]) & (top[: len(grams)] > 0)])
        both = np.concatenate(at, axis=1) if at else np.zeros((2, 0), np.int64)
        self.run_at, self.run_n = both
        self.run_key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        self.occurs = np.concatenate(occurs) if occurs else np.zeros(0, np.uint64)
        self.run_doc = np.searchsorted(doc_end, self.run_at, side="right")

    def bytes_of(self, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and one past the last of ``n`` units from ``a``."""
        if self.unit_begin is None:
            return a, a + n
        return self.unit_begin[a], self.unit_end[a + n - 1]

    def minimisers(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (bucket << 32 | hash) ascending, and whether this block alone repeats them."""
        if self.plan.same_document:
            keys, counts = np.unique(address(self.occurs, buckets), return_counts=True)
            return keys, counts > 1
        keys, inverse = np.unique(address(self.run_key, buckets), return_inverse=True)
        low, high = np.full(len(keys), 1 << 60), np.full(len(keys), -1)
        np.minimum.at(low, inverse, self.run_doc)
        np.maximum.at(high, inverse, self.run_doc)
        return keys, low != high

    def candidates(self, buckets: int, repeated: np.ndarray, hot: np.ndarray) -> dict:
        """Super-k-mers of repeated minimisers: those of hot ones window by window, and none of more
        windows than ``width``, so that the hashes of its first and last window tell strings apart.
        ``repeated`` and ``hot`` go with ``minimisers()``'s order."""
        keys, _ = self.minimisers(buckets)
        own = address(self.run_key, buckets)
        place = np.searchsorted(keys, own)
        keep = repeated[place]
        at, n, key, is_hot = self.run_at[keep], self.run_n[keep], own[keep], hot[place[keep]]
        most = np.where(is_hot, 1, self.plan.width)
        times = -(-n // most)
        which = np.repeat(np.arange(len(at)), times)
        k = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        at, n = at[which] + k * most[which], np.minimum(most[which], n[which] - k * most[which])
        key = np.where(is_hot[which], address(mixed(self.hash_first[at]), buckets), key[which])
        h1, h2 = self.hash_first[at], self.hash_first[at + n - 1]
        name = mixed(h1 * np.uint64(3) + mixed(h2 + n.astype(np.uint64)))
        order = np.lexsort((name, key >> np.uint64(32)))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (name[a] != name[b]) | (key[a] != key[b]) | (h1[a] != h1[b]) | (h2[a] != h2[b]) | (n[a] != n[b])
        group = np.cumsum(new) - 1
        string = np.empty(len(order), np.int64)
        string[order] = group
        first = order[new]  # lexsort is stable: the first place in the block
        first = self._tell_apart(at, n, string, first)
        return {"at": at, "n": n, "string": string, "first": first, "bucket": (key[first] >> np.uint64(32)).astype(np.int64), "key": key[first].astype(np.uint32)}


    def _tell_apart(self, at: np.ndarray, n: np.ndarray, string: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Strings of equal hashes but other bytes get a number of their own (changes ``string``).
        Returns where each string is first."""
        rest = np.setdiff1d(np.arange(len(at)), first, assume_unique=True)
        if not len(rest):
            return first
        begin, end = (x.tolist() for x in self.bytes_of(at, n + self.plan.width - 1))
        data, more = memoryview(self.data), []
        for i, j in zip(rest.tolist(), first[string[rest]].tolist(), strict=True):
            if data[begin[i] : end[i]] != data[begin[j] : end[j]]:
                string[i] = len(first) + len(more)
                more.append(i)
        return np.concatenate([first, np.array(more, np.int64)]) if more else first


def address(h: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 bits of the hash."""
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32)) | (h >> np.uint64(32))


def pack_blocks(docs: DataFrame, plan: Plan, tasks: int, block_bytes: int, whole_rows: bool) -> DataFrame:
    """The documents as a table of blocks, bucketed by block. Null texts are empty. With
    ``whole_rows`` the rows as they came are kept beside, in the block's order."""
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple[int, bytes]] = []
        rows: list[pa.Array] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal block, size
            order = sorted(range(len(held)), key=lambda i: held[i][0])
            x = (np.array([held[i][0] for i in order], np.int64), np.array([len(held[i][1]) for i in order], np.int64), b"".join(held[i][1] for i in order))
            whole = pa.concat_arrays(rows).take(pa.array(order)) if whole_rows else None
            row = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([dump(x)], pa.binary()), pa.array([dump(whole)], pa.binary())], names=["block", "payload", "whole"])
            held.clear()
            rows.clear()
            block, size = block + 1, 0
            return row

        for batch in batches:
            begin = 0
            for k, (d, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                t = t.as_py() or b""
                if plan.units == "words":
                    t = b" ".join(t.split())
                held.append((NO_ID if d is None else d, t))
                size += len(t) + 16
                if size >= block_bytes:
                    if whole_rows:
                        rows.append(batch.column(2).slice(begin, k + 1 - begin))
                    begin = k + 1
                    yield close()
            if whole_rows and begin < batch.num_rows:
                rows.append(batch.column(2).slice(begin))
        if held:
            yield close()

    row = [F.struct("*")] if whole_rows else []  # one column, whatever names are inside
    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *row).mapInArrow(pack, "block long, payload binary, whole binary")
    name = shared.fresh_table("blocks")
    packed.write.bucketBy(tasks, "block").option("compression", "none").option("path", shared.fresh_dir(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def repeated_windows(docs: DataFrame, plan: Plan, first_places: Callable, digest: Callable, schema: object, block_bytes: int = 2 << 20, bucket_bytes: int = 4 << 20, buckets: int | None = None, most_tasks: int = MOST_TASKS, whole_rows: bool = False) -> DataFrame:
    """Rows that ``digest(block, removed)`` gives for each block, where ``removed`` marks the units
    that a repeated window covers; with ``whole_rows`` it also gets the block's rows as they came.

    ``first_places(strings, keys, docs, starts, plan)`` gets a bucket's strings with their first
    places and returns, a window after another, the doc_id and start of each window's first place.

    There is a bucket for each ``bucket_bytes`` of input unless ``buckets`` says how many, so a bucket's
    memory doesn't grow with it, and a task for each bucket up to ``most_tasks``.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    buckets = buckets or shared.parts(spark, shared.input_bytes(docs), bucket_bytes, most=None)
    tasks = min(buckets, most_tasks)
    blocks = pack_blocks(docs, plan, tasks, block_bytes, whole_rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, twice = Block(payload.as_py(), plan).minimisers(buckets)
                bucket, begin = np.unique((keys >> np.uint64(32)).astype(np.int64), return_index=True)
                cut = [*begin.tolist(), len(keys)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array([b] * len(bucket), pa.int64()), pa.array([keys[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([np.packbits(twice[i:j]).tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())],
                    names=["bucket", "block", "keys", "twice"],
                )

    hot_blocks = plan.hot_blocks

    def answer(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u4") for x in group["keys"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(group["twice"].to_pylist(), keys, strict=True)]
        _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        more = counts > 1
        more[inverse[np.concatenate(twice)]] = True
        bits = np.stack([more, counts > hot_blocks])[:, inverse]
        cut = np.cumsum([0, *map(len, keys)])
        out = [np.packbits(bits[:, i:j], axis=1).tobytes() for i, j in zip(cut, cut[1:], strict=False)]
        return pa.table({"block": group["block"], "bucket": group["bucket"], "n": pa.array(np.diff(cut)), "bits": pa.array(out, pa.binary())})

    answers = shared.staged(blocks.select("block", "payload").mapInArrow(ask, "bucket long, block long, keys binary, twice binary").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(answer, "block long, bucket long, n long, bits binary"), "answers")
    known = blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers")), "block", "left")

    def read_bits(rows: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for r in sorted(rows or (), key=lambda r: r["bucket"]):
            half = -(-r["n"] // 8)
            parts.append(np.unpackbits(np.frombuffer(r["bits"], np.uint8).reshape(2, half), axis=1, count=r["n"]))
        both = np.concatenate(parts, axis=1).astype(bool) if parts else np.zeros((2, 0), bool)
        return both[0], both[1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload, rows in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("answers"), strict=True):
                block = Block(payload.as_py(), plan)
                c = block.candidates(buckets, *read_bits(rows.as_py()))
                at, n = c["at"][c["first"]], c["n"][c["first"]]
                begin, end = block.bytes_of(at, n + plan.width - 1)
                doc = np.searchsorted(block.doc_at[1:], at, side="right")
                ids, starts = block.doc_ids[doc], at - block.doc_at[doc]
                bucket, first = np.unique(c["bucket"], return_index=True)
                out, key = [], [k.tobytes() for k in c["key"].astype("<u4")]
                for i, j in zip(first.tolist(), [*first.tolist()[1:], len(at)], strict=False):
                    text = [y for k, a, b in zip(key[i:j], begin[i:j].tolist(), end[i:j].tolist(), strict=True) for y in (k, block.data[a:b])]
                    out.append(dump((b"".join(text), (end - begin + 4)[i:j].astype(np.int32), n[i:j].astype(np.int32), ids[i:j], starts[i:j])))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([number] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "block", "strings"])

    def settle(group: pa.Table) -> pa.Table:
        """One bucket: equal strings of its blocks are one string with the first place of them all."""
        index: dict[bytes, int] = {}  # of minimiser and string
        ids, starts, windows, blobs = [], [], [], []
        for blob in group["strings"]:
            data, sizes, n, doc, start = load(blob.as_py())
            cut = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            new = len(index)
            own = np.array([index.setdefault(data[i:j], len(index)) for i, j in zip(cut, cut[1:], strict=False)], np.int64)
            del data
            first = own >= new  # in a block a string comes once
            ids.append(doc[first])
            starts.append(start[first])
            windows.append(n[first].astype(np.int64))
            blobs.append((own, first, doc, start))
        ids, starts, count = np.concatenate(ids), np.concatenate(starts), np.concatenate(windows)
        for own, first, doc, start in blobs:
            own, doc, start = own[~first], doc[~first], start[~first]
            less = (doc < ids[own]) | ((doc == ids[own]) & (start < starts[own]))
            ids[own[less]], starts[own[less]] = doc[less], start[less]
        blobs = [x[0] for x in blobs]
        strings = list(index)
        del index
        keys = np.frombuffer(b"".join(x[:4] for x in strings), "<u4").astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(count)])
        doc, start = first_places([x[4:] for x in strings], keys, ids, starts, count, plan)
        out = []
        for own in blobs:
            m = count[own]
            take = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(cut[own], m)
            out.append(dump((doc[take], start[take] if plan.same_document else None)))
        return pa.table({"block": group["block"], "bucket": group["bucket"], "places": pa.array(out, pa.binary())})

    places = known.select("block", "payload", "answers").mapInArrow(send, "bucket long, block long, strings binary").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(settle, "block long, bucket long, places binary")
    back = known.join(places.groupBy("block").agg(F.collect_list(F.struct("bucket", "places")).alias("places")), "block", "left")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, whole, rows, got in zip(batch.column("payload"), batch.column("whole"), batch.column("answers"), batch.column("places"), strict=True):
                block = Block(payload.as_py(), plan)
                c = block.candidates(buckets, *read_bits(rows.as_py()))
                found = [load(r["places"]) for r in sorted(got.as_py() or (), key=lambda r: r["bucket"])]
                covered = np.zeros(block.n_units + 1, np.int32)
                if found:
                    doc = np.concatenate([x for x, _ in found])
                    m = c["n"][c["first"]]
                    begin = np.cumsum(m) - m
                    n = c["n"]
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    take = np.repeat(begin[c["string"]], n) + step
                    window = np.repeat(c["at"], n) + step
                    own = np.searchsorted(block.doc_at[1:], window, side="right")
                    earlier = doc[take] < block.doc_ids[own]
                    if plan.same_document:
                        start = np.concatenate([x for _, x in found])
                        earlier |= (doc[take] == block.doc_ids[own]) & (start[take] < window - block.doc_at[own])
                    np.add.at(covered, window[earlier], 1)
                    np.add.at(covered, window[earlier] + plan.width, -1)
                removed = np.cumsum(covered[:-1]) > 0
                yield digest(block, removed, load(whole.as_py())) if whole_rows else digest(block, removed)

    return back.select("payload", "whole" if whole_rows else F.lit(None).cast("binary").alias("whole"), "answers", "places").mapInArrow(mark, schema)
