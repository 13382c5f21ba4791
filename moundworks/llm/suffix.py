"""Removal of long byte strings that an earlier document has, by suffix arrays.

``suffix_array`` sorts suffixes by linear grouping. Its first phase takes groups of suffixes in
descending order: each suffix points to the previous one that is smaller (the nearest before it that
is not yet taken), and what gets pointed to moves behind its group, further the more pointers it
got; in the end a group holds the suffixes with one longest Lyndon prefix. The second phase walks the
array from the smallest suffix and places the suffix before it, and what that points to, at the front
of its group, which orders each group without sorting it again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm.repeats import BASE, NO_ID, Block, Plan, gram_hashes, repeated_windows

ARRAY = 1 << 13  # bytes of a suffix array, unless one key has more: its lists stay in the processor's cache
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``codes`` (small non-negative integers) in ascending order."""
    n = len(codes)
    if n < 2:
        return np.arange(n)
    order = np.argsort(codes, kind="stable")
    member = order.tolist()  # groups are ranges of this list
    places = np.empty(n, np.int64)
    places[order] = np.arange(n)
    place = places.tolist()
    sorted_codes = codes[order]
    begins = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
    sizes = np.diff(np.append(begins, n))
    stops = np.zeros(n, np.int64)
    stops[begins] = begins + sizes
    stop = stops.tolist()  # a group is known by where it begins
    groups = np.empty(n, np.int64)
    groups[order] = np.repeat(begins, sizes)
    group = groups.tolist()  # of each suffix: where its group begins
    left = list(range(-1, n))  # the untaken places as a linked list; its ends are -1 and n
    right = [*range(1, n + 1), 0]
    smaller = [-1] * (n + 1)

    def to_end(p: int) -> int:
        """Moves ``p`` behind its group, which gets shorter. Returns the new end."""
        g = group[p]
        at = stop[g] - 1
        stop[g] = at
        mine = place[p]
        if at != mine:
            there = member[at]
            member[at], member[mine] = p, there
            place[p], place[there] = at, mine
        return at

    end = n
    while end > 0:
        last = member[end - 1]
        begin = group[last]
        if begin == end - 1:  # most groups have one member
            p, q = left[last], right[last]
            right[p], left[q] = q, p
            smaller[last] = p
            if p >= 0 and stop[group[p]] - group[p] > 1:
                at = to_end(p)
                group[p], stop[at] = at, at + 1
            end = begin
            continue
        pointed: dict[int, int] = {}
        for i in sorted(member[begin:end]):
            p, q = left[i], right[i]
            right[p], left[q] = q, p
            smaller[i] = p  # those of the group before it are out of the list by now
            pointed[p] = pointed.get(p, 0) + 1
        end = begin
        pointed.pop(-1, None)
        by_times: dict[int, list[int]] = {}
        for p, times in pointed.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            new: dict[int, int] = {}
            ends: dict[int, int] = {}
            for p in by_times[times]:
                ends.setdefault(group[p], stop[group[p]])
                new[group[p]] = to_end(p)
            for p in by_times[times]:
                group[p] = new[group[p]]
            for g, at in new.items():
                stop[at] = ends[g]
    out = [-1] * n
    heads = list(range(n))  # where a group's next suffix goes
    done = bytearray(n + 1)
    done[n] = 1  # also place -1: nothing is before the first
    j, i = n - 1, 0  # before the empty suffix
    while True:
        while not done[j]:
            done[j] = 1
            g = group[j]
            out[heads[g]] = j
            heads[g] += 1
            j = smaller[j]
        if i == n:
            return np.array(out)
        j, i = out[i] - 1, i + 1


def layout(strings: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings' bytes as codes from 1, each string with a 0 behind, and where the windows begin."""
    sizes = np.array([len(s) + 1 for s in strings])
    codes = np.frombuffer(b"\n".join(strings) + b"\n", np.uint8).astype(np.uint16) + np.uint16(1)
    codes[np.cumsum(sizes) - 1] = 0
    return codes, np.repeat(np.cumsum(sizes) - sizes, windows) + steps(windows)


def steps(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ... n[1] - 1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def several(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Which windows another one has the hash of: all that are equal to another, and hardly more."""
    _, inverse, counts = np.unique(gram_hashes(codes.astype(np.uint64) * BASE, width)[at], return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def first_places(strings: list[bytes], keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, windows: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The smallest doc_id of each window.

    Windows of a string that alone holds its minimiser are in no other, and neither are windows whose
    hash is alone. The runs of all others are sorted in suffix arrays, where equal windows are
    neighbours. Equal windows have one key, so an array takes whole keys, about ``ARRAY`` bytes.
    """
    out = np.repeat(docs, windows)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[inverse] > 1)
    some = some[np.argsort(keys[some], kind="stable")]
    if not len(some):
        return out, out
    m = windows[some]
    codes, at = layout([strings[i] for i in some.tolist()], m)
    target = np.repeat((np.cumsum(windows) - windows)[some], m) + steps(m)
    shared = several(codes, at, plan.width)
    begins = shared.copy()
    begins[1:] &= ~shared[:-1] | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(begins)
    if not len(begin):
        return out, out
    n = np.diff(np.append(np.cumsum(shared)[begin] - 1, shared.sum()))
    key = np.repeat(keys[some], m)[begin]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
    size = np.concatenate([[0], np.cumsum(n + plan.width)])
    a = 0
    while a < len(key):
        b = int(cuts[np.searchsorted(cuts, a, side="right")])  # one key at least
        b = max(b, int(cuts[np.searchsorted(cuts, np.searchsorted(size, size[a] + ARRAY, side="right") - 1, side="right") - 1]))
        length = n[a:b] + plan.width  # a run's bytes and a 0
        runs = codes[np.minimum(np.repeat(at[begin[a:b]], length) + steps(length), len(codes) - 1)].astype(np.int64)
        first = np.cumsum(length) - length
        runs[first + length - 1] = 0
        where = target[np.repeat(begin[a:b], n[a:b]) + steps(n[a:b])]
        out[where] = least_by_window(runs, np.repeat(first, n[a:b]) + steps(n[a:b]), out[where], plan.width)
        a = b
    return out, out


def least_by_window(codes: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``values`` (one a window) over the equal ones of the windows that begin at ``at``,
    by the suffix array of ``codes``."""
    window_of = np.full(len(codes), -1)
    window_of[at] = np.arange(len(at))
    order = suffix_array(codes)
    order = order[window_of[order] >= 0]
    same = np.ones(len(order), bool)
    for k in range(width):
        unit = codes[order + k]
        same[1:] &= unit[1:] == unit[:-1]
    same[0] = False
    window = window_of[order]
    least = np.minimum.reduceat(values[window], np.flatnonzero(~same))
    out = np.empty_like(values)
    out[window] = least[np.cumsum(~same) - 1]
    return out


def digest(block: Block, removed: np.ndarray) -> pa.RecordBatch:
    raw = np.frombuffer(block.data, np.uint8)
    n_removed, n_spans, sha = [], [], []
    for a, b in zip(block.begins.tolist(), block.ends.tolist(), strict=True):
        gone = removed[a:b]
        n_removed.append(int(gone.sum()))
        n_spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if b > a else 0)
        sha.append(hashlib.sha256(raw[a:b][~gone] if n_removed[-1] else raw[a:b]).hexdigest())
    return pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=block.doc_ids == NO_ID), pa.array(block.ends - block.begins), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, width: int = 50, gram: int = 24, **sizes: int) -> DataFrame:
    """What stays of each document when every byte is removed that a ``width``-byte string covers
    which also starts in a document with a smaller doc_id, judged on the texts as they are.

    A row per row of ``docs``. Null texts are empty and lose nothing; of rows with one doc_id none
    comes before another; a null doc_id comes before all others. Matches never cross documents.
    """
    hot = sizes.pop("hot_blocks", 4096)
    return repeated_windows(docs, Plan("bytes", width, gram, False, hot), first_places, digest, SCHEMA, **sizes)


def spans(docs: DataFrame, **options: int) -> DataFrame:
    """Only the documents that lose something."""
    return dedup(docs, **options).where(F.col("n_removed") > 0)
