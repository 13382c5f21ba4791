"""Substring operators against plain loops over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from moundworks.llm import shared, suffix, superkmers
from moundworks.llm.repeats import Plan, gram_hashes, sliding

LEAST = -(1 << 63)


def by_bytes(rows, width):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def by_words(rows, width):
    first, cut = {}, []
    for d, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cut.append((d, w))
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (d, i))
    out = []
    for d, w in cut:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (d, i):
                gone[i : i + width] = b"\1" * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def made(seed, n=40):
    r = random.Random(seed)
    base = "".join(r.choice("abc d") for _ in range(400))
    rows = []
    for d in range(n):
        parts = [r.choice([base[r.randint(0, 300) :][: r.randint(1, 160)], "é" * r.randint(0, 80), "ab " * r.randint(1, 40), "".join(r.choice("xyz\n ") for _ in range(30))]) for _ in range(r.randint(0, 4))]
        rows.append((d * 7 % (n + 1 if n % 7 else n + 2), "".join(parts) if d else None))
    return rows


@pytest.mark.parametrize("hot", [4096, 0])
@pytest.mark.parametrize(("width", "gram"), [(50, 24), (9, 3)])
def test_bytes(docs, width, gram, hot):
    rows = made(width)
    got = suffix.dedup(docs(rows).repartition(3), width=width, gram=gram, block_bytes=400, hot_blocks=hot)
    assert sorted(map(tuple, got.collect())) == by_bytes(rows, width)


@pytest.mark.parametrize("hot", [4096, 0])
@pytest.mark.parametrize(("width", "gram"), [(20, 8), (4, 2)])
def test_words(docs, width, gram, hot):
    rows = made(width + 1)
    got = superkmers.dedup(docs(rows).repartition(3), width=width, gram=gram, block_bytes=400, hot_blocks=hot)
    assert sorted(map(tuple, got.collect())) == by_words(rows, width)


def test_more_buckets_than_a_table_may_have(docs):
    """Spark allows a table 100,000 buckets; the hash buckets may be more."""
    text = " ".join(f"word{i * i % 37}" for i in range(60))
    rows = [(1, text), (2, "before " + text[:300]), (3, text[200:] + " after"), (4, None), (5, "ab " * 100)]
    for dedup, truth, width in ((suffix.dedup, by_bytes, 50), (superkmers.dedup, by_words, 20)):
        got = dedup(docs(rows), width=width, buckets=150_000, most_tasks=6)
        assert sorted(map(tuple, got.collect())) == truth(rows, width)


def test_tables_leave_the_catalog(spark, docs, monkeypatch):
    monkeypatch.setattr(shared, "_made", [])
    monkeypatch.setattr(shared, "_tables", [])
    suffix.dedup(docs([(1, "a"), (2, "b")])).collect()
    name = shared._tables[0]
    assert spark.catalog.tableExists(name)
    shared.clean()
    assert not spark.catalog.tableExists(name)


def test_cleaning_ends_without_a_session(monkeypatch):
    monkeypatch.setattr(shared, "_made", [])
    monkeypatch.setattr(shared, "_tables", ["a", "b"])
    monkeypatch.setattr(shared.SparkSession, "getActiveSession", lambda: None)
    shared.clean()
    assert shared._tables == []


def test_suffix_arrays_decide_all_that_repeats(monkeypatch):
    """Of the windows of a bucket, all that occur in two strings go through a suffix array."""
    sorted_windows = []
    real = suffix.least_by_window
    monkeypatch.setattr(suffix, "least_by_window", lambda codes, at, values, width: sorted_windows.append(len(at)) or real(codes, at, values, width))
    r = random.Random(4)

    def drawn(letters, n):
        return "".join(r.choice(letters) for _ in range(n))

    flanks, passages = ["uvwxyz", "UVWXYZ", "123456"], [drawn("abcdef", 70) for _ in range(3)]  # equal windows have one key
    strings = [(drawn(flanks[k % 3], 20) + passages[k % 3] + drawn(flanks[k % 3], 20)).encode() for k in range(30)]
    cut = [[s[i : i + 50] for i in range(len(s) - 49)] for s in strings]
    times = Counter(w for own in cut for w in own)
    least = {}
    for k, own in enumerate(cut):
        for w in own:
            least.setdefault(w, 100 + k)
    windows = np.array([len(own) for own in cut])
    keys = np.array([k % 3 for k in range(30)])
    for size in (100, 1 << 13):
        monkeypatch.setattr(suffix, "ARRAY", size)
        sorted_windows.clear()
        found, _ = suffix.first_places(strings, keys, np.arange(30) + 100, np.zeros(30, int), windows, Plan("bytes", 50, 24, False))
        assert sum(sorted_windows) == sum(n for n in times.values() if n > 1) > 30 * 21  # flanks of a byte or two repeat too
        assert len(sorted_windows) == (3 if size == 100 else 1)
        assert found.tolist() == [least[w] for own in cut for w in own]


def test_one_long_text(docs):
    rows = [(1, "ab " * 40_000), (2, "x" * 100_000), (3, "ab " * 40_000 + "end")]
    assert sorted(map(tuple, superkmers.dedup(docs(rows)).collect())) == by_words(rows, 20)
    got = {r.doc_id: r.n_removed for r in suffix.dedup(docs(rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 120_000}


def test_null_and_repeated_ids(docs):
    text = " ".join(f"w{i}" for i in range(60))
    got = sorted(map(tuple, suffix.dedup(docs([(None, text), (1, text), (1, text), (2, text + "!")])).select("doc_id", "n_removed").collect()), key=repr)
    n = len(text)
    assert got == sorted([(None, 0), (1, n), (1, n), (2, n)], key=repr)
    twice = docs([(5, text), (5, text)])
    assert [r.n_removed for r in suffix.dedup(twice).collect()] == [0, 0]
    assert [r.n_removed for r in superkmers.dedup(twice).collect()] == [0, 0]


def test_empty_table(docs):
    assert suffix.dedup(docs([])).count() == superkmers.dedup(docs([])).count() == superkmers.rewrite(docs([])).count() == 0


def test_rewrite_keeps_rows_and_columns(docs):
    text = "\n".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 1), (2, "start " + text + " end", None, 2), (3, "free  of\nrepeats", "c", None), (4, None, "d", 4)]
    got = {r.doc_id: r for r in superkmers.rewrite(docs(rows, ", block string, n_chars long")).collect()}
    assert {k: tuple(r) for k, r in got.items() if k != 2} == {r[0]: r for r in rows if r[0] != 2}
    assert tuple(got[2]) == (2, "start end", None, 9)


def test_suffix_array():
    r = random.Random(0)
    for _ in range(400):
        s = [r.randint(0, r.choice([1, 2, 9])) for _ in range(r.randint(0, 60))]
        assert suffix.suffix_array(np.array(s, int)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_hashes_and_minima():
    r = np.random.default_rng(0)
    x = r.integers(0, 5, 300).astype(np.uint64)
    for n in (1, 2, 3, 7, 8, 24, 50):
        h = gram_hashes(x, n)
        assert len(h) == len(x) - n + 1
        seen = {}
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(v, tuple(x[i : i + n])) == tuple(x[i : i + n])
        assert sliding(np.minimum, x, n).tolist() == [min(x[i : i + n]) for i in range(len(x) - n + 1)]
