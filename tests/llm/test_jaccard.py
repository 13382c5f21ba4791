"""The similarity join against all pairs."""

import random

import numpy as np
import pytest

from moundworks.llm import jaccard


def shingled(text, words=5):
    w = (text or "").split()
    return frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[i : i + words]) for i in range(len(w) - words + 1)])


def every_pair(rows, threshold=0.8):
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    names = list(texts)
    sets = [shingled(t) for t in names]
    up, n = list(range(len(names))), [0] * len(names)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b):
                n[i] += 1
                n[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    low = {}
    for i, t in enumerate(names):
        low[root(i)] = min(low.get(root(i), 1 << 60), *texts[t])
    return sorted((d, low[root(i)], min(texts[t]), n[i]) for i, t in enumerate(names) for d in texts[t])


def made(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(60):
        base = [r.choice(["ab", "cd", "ef", "gh"]) + str(r.randint(0, 30)) for _ in range(r.choice([1, 3, 6, 40, 200]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            x = list(base)
            for _ in range(r.randint(0, 2)):
                x[r.randrange(len(x))] = f"z{r.randint(0, 3)}"
            rows.append((len(rows), r.choice([" ", "\n"]).join(x)))
    base = [f"w{i}" for i in range(300)]
    for k in range(60):
        x = list(base)
        for _ in range(r.randint(0, 5)):
            x[r.randrange(300)] = f"y{k}"
        rows.append((len(rows), " ".join(x)))
    return [*rows, (len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n"), (len(rows) + 3, "word " * 20_000), (len(rows) + 4, "word " * 20_001)]


@pytest.mark.parametrize("block", [2048, 16])
def test_all_links(docs, block):
    rows = made(1)
    assert sorted(map(tuple, jaccard.links(docs(rows).repartition(5), block=block).collect())) == every_pair(rows)


def test_one_of_each_class_stays_whole(docs):
    rows = [(i, t, f"x{i}", i) for i, t in made(2)]
    want = {c for _, c, _, _ in every_pair([r[:2] for r in rows])}
    got = jaccard.one_of_each(docs(rows, ", name string, band long").repartition(3))
    assert got.columns == ["doc_id", "text", "name", "band"]
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in want)


def test_repeated_rows_and_null_ids(docs):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (3, text), (3, "another text of some words here"), (None, text), (9, text + " more")]
    got = sorted(map(tuple, jaccard.links(docs(rows)).collect()), key=repr)
    assert got == sorted([(3, 3, 3, 1), (3, 3, 3, 1), (3, 3, 3, 0), (None, 3, 3, 1), (9, 3, 9, 1)], key=repr)
    assert sorted(map(tuple, jaccard.one_of_each(docs(rows)).collect()), key=repr) == sorted([rows[0], rows[2]], key=repr)


def test_any_names(docs):
    text = "one two three four five six seven"
    rows = [(1, text, "own1", 11, "n", "r"), (2, text, "own2", 22, "n", "r"), (3, "alone", "own3", 33, "n", "r")]
    df = docs(rows, ", _own string, _own_id int, name string, row string")
    assert sorted(map(tuple, jaccard.one_of_each(df).collect())) == [rows[0], rows[2]]


def test_many_rows_without_an_id(docs):
    """Each meets its own text only: texts that are near are linked, and no others."""
    base = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join([*base, f"end{k // 2}", f"x{k}"]) if k < 40 else f"other{k} " * 8) for k in range(3000)]
    got = jaccard.links(docs(rows))
    assert got.count() == 3000
    assert got.where("n_links = 39").count() == 40
    assert got.where("n_links > 0").count() == 40


def test_empty_table(docs):
    assert jaccard.links(docs([])).count() == jaccard.one_of_each(docs([])).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    least = jaccard.least_matches(0.8, 1e-6)
    assert least == sorted(least)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (20_000, 128), np.uint64).astype(np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype(np.uint8)
    assert jaccard.likely(a, b, least).all()
    b = np.where(rng.random(a.shape) < 0.4, a, a + 1).astype(np.uint8)
    assert not jaccard.likely(a, b, least).any()


def test_minhash_estimates_similarity():
    a = [f"w{i}" for i in range(400)]
    b = a[:300] + [f"v{i}" for i in range(100)]
    hashes, cut = jaccard.shingles([" ".join(x).encode() for x in (a, b)], 5)
    v = jaccard.signatures(hashes, cut)
    x, y = shingled(" ".join(a)), shingled(" ".join(b))
    assert len(set(hashes[: cut[1]].tolist())) == len(x)
    assert (v[0] == v[1]).mean() == pytest.approx(len(x & y) / len(x | y), abs=0.15)
