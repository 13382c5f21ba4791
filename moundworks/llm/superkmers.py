"""Removal of word windows that occur earlier in the corpus, by super-k-mers and sorting.

Consecutive windows that share a minimiser travel as one string to its bucket, where all windows
are sorted as rows of word numbers; equal neighbours are one window, whose first place is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm.repeats import NO_ID, Block, Plan, repeated_windows

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SLICE = 1 << 17  # windows made into rows at a time


def first_places(strings: list[bytes], keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, windows: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each window. Windows with one minimiser are in strings with one key, so
    strings are sorted by key and their windows sorted a slice of whole keys at a time."""
    number: dict[bytes, int] = {}
    words, sizes = [], []
    for s in strings:
        w = s.split(b" ")
        sizes.append(len(w))
        words += [number.setdefault(x, len(number)) for x in w]
    words, sizes = np.array(words, np.int32), np.array(sizes)
    begin = np.cumsum(sizes) - sizes
    target = np.cumsum(windows) - windows
    out_doc, out_start = np.empty(int(windows.sum()), np.int64), np.empty(int(windows.sum()), np.int64)
    by_key = np.argsort(keys, kind="stable")
    total = np.cumsum(windows[by_key])
    new_key = np.concatenate([[True], keys[by_key][1:] != keys[by_key][:-1], [True]])
    cuts = np.flatnonzero(new_key)
    a = 0
    while a < len(by_key):
        b = int(cuts[min(np.searchsorted(cuts, np.searchsorted(total, (total[a - 1] if a else 0) + SLICE, side="right")), len(cuts) - 1)])
        b = b if b > a else int(cuts[np.searchsorted(cuts, a, side="right")])
        part = by_key[a:b]
        a = b
        m = windows[part]
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        rows = np.lib.stride_tricks.sliding_window_view(words, plan.width)[np.repeat(begin[part], m) + step]
        doc, start = np.repeat(docs[part], m), np.repeat(starts[part], m) + step
        key = rows.astype(">i4").view(f"V{4 * plan.width}").ravel()
        order = np.lexsort((start, doc))
        order = order[np.argsort(key[order], kind="stable")]
        ordered = rows[order]
        head = np.ones(len(order), bool)
        head[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        group = np.cumsum(head) - 1
        place = (np.repeat(target[part], m) + step)[order]
        out_doc[place], out_start[place] = doc[order][head][group], start[order][head][group]
    return out_doc, out_start


def kept_texts(block: Block, removed: np.ndarray) -> tuple[list[bytes], list[int], list[int]]:
    out, n_words, n_removed = [], [], []
    for k, (a, b) in enumerate(zip(block.doc_at[:-1].tolist(), block.doc_at[1:].tolist(), strict=True)):
        gone = removed[a:b]
        text = block.data[int(block.begins[k]) : int(block.ends[k])]
        n_words.append(b - a)
        n_removed.append(int(gone.sum()))
        if n_removed[-1]:
            edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
            runs = zip((edge[::2] + a).tolist(), (edge[1::2] + a - 1).tolist(), strict=True)
            text = b" ".join(block.data[int(block.unit_begin[i]) : int(block.unit_end[j])] for i, j in runs)
        out.append(text)
    return out, n_words, n_removed


def digest(block: Block, removed: np.ndarray) -> pa.RecordBatch:
    texts, n_words, n_removed = kept_texts(block, removed)
    sha = [hashlib.sha256(t).hexdigest() for t in texts]
    return pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=block.doc_ids == NO_ID), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, width: int = 20, gram: int = 8, **sizes: int) -> DataFrame:
    """What stays of each document when every word is removed that a window of ``width`` words covers
    whose words also start earlier: in a document with a smaller doc_id, or before it in the same
    document. Windows are judged on the texts as they are.

    A row per row of ``docs``. Words are what stands between ASCII white space. Null texts have none
    and lose none. Rows with one doc_id count as one document in which the smaller start is earlier;
    a null doc_id comes before all others.
    """
    hot = sizes.pop("hot_blocks", 4096)
    return repeated_windows(docs, Plan("words", width, gram, True, hot), first_places, digest, SCHEMA, **sizes)


def rewrite(docs: DataFrame, width: int = 20, gram: int = 8, **sizes: int) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` (what is left is joined by one space) and
    ``n_chars``, where there is such a column, counted anew. Rows that lose nothing stay as they were,
    and rows that lose all stay with an empty text. Cases are those of ``dedup``."""
    hot = sizes.pop("hot_blocks", 4096)

    def put(block: Block, removed: np.ndarray, rows: pa.StructArray) -> pa.RecordBatch:
        texts, _, lost = kept_texts(block, removed)
        new = [t.decode("utf-8", "replace") if k else None for t, k in zip(texts, lost, strict=True)]
        columns = {f.name: c for f, c in zip(rows.type, rows.flatten(), strict=True)}
        changed = pa.array([bool(k) for k in lost])
        columns["text"] = pc.if_else(changed, pa.array(new, pa.string()).cast(columns["text"].type), columns["text"])
        if "n_chars" in columns:
            columns["n_chars"] = pc.if_else(changed, pc.utf8_length(pa.array(new, pa.string())).cast(columns["n_chars"].type), columns["n_chars"])
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return repeated_windows(docs, Plan("words", width, gram, True, hot), first_places, put, docs.schema, whole_rows=True, **sizes)
