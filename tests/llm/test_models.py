"""Toxicity, language, mixing, neighbours and fingerprints: accuracy, round trips, brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundworks.llm import langid, mixing, multi_index, toxicity, weighted_fingerprints

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def labelled(n, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(5, 120))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["nastyword", "vileterm"]))
        rows.append((i, " ".join(w), f"s{i}", 0.5))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels = labelled(400)
    df = docs(rows + [(1000, "", None, None), (1001, None, None, 1.0), (1002, "vileterm " + "dolor " * 30_000, "s", 2.0), (None, "x", "s", 0.0)], ", source string, score double")
    lab = spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.classify(df, lab).collect()
    assert len(got) == 404
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 90
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    odd = {r.doc_id: r.score for r in got if r.doc_id in (1000, 1001)}
    assert odd[1000] == odd[1001] < 0.7
    assert all(0 <= r.score <= 1 for r in got)
    model = toxicity.fit(df, lab)
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_toxicity_without_two_classes(spark, docs):
    df = docs([(2, "a"), (3, "b")])
    for labels in ([], [(2, 0), (3, 0)]):
        lab = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert [r.predicted for r in toxicity.classify(df, lab).collect()] == [0, 0]
    assert toxicity.classify(docs([]), lab).count() == 0


def test_exponent_meets_entropy_and_limit():
    size = [1000.0, 100.0, 10.0]
    x = mixing.bisect_exponent(size, target_entropy=0.9)
    assert mixing.entropy(mixing.weights(size, x)) == pytest.approx(0.9, abs=1e-9)
    x = mixing.bisect_exponent(size, repetition_limit=4)
    assert max(mixing.passes(size, mixing.weights(size, x), None)) == pytest.approx(4)
    assert mixing.bisect_exponent(size, target_entropy=9) == 0.0
    assert mixing.bisect_exponent(size, repetition_limit=0.1) == 1.0
    x = mixing.bisect_exponent(size, repetition_limit=3, budget=1110)
    assert max(mixing.passes(size, mixing.weights(size, x), 1110)) == pytest.approx(3)


def test_mixture_has_its_weights(docs):
    r = random.Random(0)
    rows = [(i, "w " * r.randint(1, 20), "big" if i % 10 else r.choice(["small", None]), i) for i in range(3000)]
    got = mixing.mix(docs(rows, ", source string, blocks long"), repetition_limit=4.0, block_rows=16).collect()
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += len(t.split())
    names = list(tokens)
    size = [float(tokens[s]) for s in names]
    want = dict(zip(names, mixing.passes(size, mixing.weights(size, mixing.bisect_exponent(size, repetition_limit=4.0)), None), strict=True))
    had = Counter()
    for x in got:
        had[x.source] += x.mix_tokens
        assert x.mix_tokens == len(x.text.split())
        assert x.blocks == x.doc_id
    for s in names:
        assert abs(had[s] - want[s] * tokens[s]) <= 21
    assert max(want.values()) == pytest.approx(4)
    assert {x.doc_id for x in got} == {x[0] for x in rows}
    assert max(Counter((x.doc_id, x.mix_pass) for x in got).values()) == 1


def test_mixture_of_little(docs):
    assert mixing.mix(docs([], ", source string")).count() == 0
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None)]
    assert mixing.mix(docs(rows, ", source string")).count() == 3
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs([(1, "a", "x"), (2, "b", "y")], ", source string"), max_sources=1)


def test_mixture_chooses_whole_rows_within_its_budget(docs):
    """Copies go together, the budget is kept to within one text, and columns may have any names."""
    rows = [(i % 90, f"w{i % 90} " * (i % 7 + 1), "a" if i % 3 else None, i, 1, 2, 3, 4, 5, 6) for i in range(270)]
    df = docs(rows, ", source string, _tokens int, _key int, _source int, _pass int, _s int, _whole int, row int")
    got = mixing.mix(df, repetition_limit=None, budget=700, block_rows=16)
    assert got.columns == [*df.columns, "mix_tokens", "mix_pass", "mix_block", "mix_order", "mix_row"]
    got = got.collect()
    assert {(r._key, r._source, r._pass, r._s, r._whole, r.row) for r in got} == {(1, 2, 3, 4, 5, 6)}
    hashed = df.select("doc_id", "source", "_tokens", F.xxhash64("doc_id", "text").alias("key"), mixing.word_count().alias("n")).collect()
    size = {s: sum(r.n for r in hashed if r.source == s) for s in (None, "a")}
    names = sorted(size, key=lambda s: (s is not None, s))
    each = mixing.passes([float(size[s]) for s in names], mixing.weights([float(size[s]) for s in names], 0.0), 700)
    for s, x in zip(names, each, strict=True):
        whole, rest = int(x + 1e-9), max(0, round((x - int(x + 1e-9)) * size[s]))
        mine = [r for r in got if r.source == s]
        taken = Counter((r.doc_id, r._tokens) for r in mine)
        assert all(c in (whole, whole + 1) for c in taken.values())
        extra = [r for r in mine if r.mix_pass == whole]
        assert sum(r.mix_tokens for r in extra) <= rest
        texts = Counter((r.doc_id, r.mix_tokens) for r in hashed_rows(hashed, s))
        assert all(n == texts[k] for k, n in Counter((r.doc_id, r.mix_tokens) for r in extra).items())  # copies go together
        largest = max(n * k[1] for k, n in texts.items())
        assert sum(r.mix_tokens for r in extra) > rest - largest


def test_passes_follow_their_permutation(spark, docs):
    """Blocks, their order and the last pass's blocks and rows, again from the hashes alone."""
    rows = [(i, f"w{i} " * (i % 7 + 1), "ab"[i % 3 > 0]) for i in range(600)]
    df, seed, block_rows, budget = docs(rows, ", source string"), 7, 16, 3000
    got = mixing.mix(df, repetition_limit=None, budget=budget, seed=seed, block_rows=block_rows).collect()
    size = {s: sum(i % 7 + 1 for i, _, x in rows if x == s) for s in "ab"}
    each = dict(zip("ab", mixing.passes([float(size[s]) for s in "ab"], mixing.weights([float(size[s]) for s in "ab"], 0.0), budget), strict=True))
    for s in "ab":
        whole = int(each[s] + 1e-9)
        rest = round((each[s] - whole) * size[s])
        n_blocks = -(-sum(x == s for _, _, x in rows) // block_rows)
        key = F.xxhash64("doc_id", "text")
        x = df.where(F.col("source") == s).withColumn("key", key).withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n_blocks).cast("long")))
        turn = F.lit(whole).cast("long")
        x = x.select("doc_id", "block", mixing.word_count().alias("n"), F.xxhash64(F.lit(seed), turn, "source", "block").alias("order"), F.xxhash64(F.lit(seed), turn, "key").alias("row")).collect()
        want, left = [], rest
        for _, b in sorted({(r.order, r.block) for r in x}):
            mine = sorted((r.row, r.doc_id, r.n) for r in x if r.block == b)
            if sum(n for *_, n in mine) <= left:
                want += [d for _, d, _ in mine]
                left -= sum(n for *_, n in mine)
                continue
            for _, d, n in mine:
                if n > left:
                    break
                want.append(d)
                left -= n
            break
        last = sorted((r for r in got if r.source == s and r.mix_pass == whole), key=lambda r: (r.mix_order, r.mix_block, r.mix_row))
        assert [r.doc_id for r in last] == want
        assert want


def hashed_rows(rows, source):
    return [type("R", (), {"doc_id": r.doc_id, "mix_tokens": r.n}) for r in rows if r.source == source]


def test_language(spark):
    r = random.Random(0)
    vocabulary = {"en": "the and with from this that which".split(), "de": "der und mit von diese welche nicht".split()}
    docs = spark.createDataFrame([(i, " ".join(r.choice(vocabulary[k]) for _ in range(40)), k) for i in range(60) for k in vocabulary], "doc_id long, text string, lang string")
    pages, want = [], {}
    for i in range(120):
        k = r.choice(["en", "de"])
        body = " ".join(r.choice(vocabulary[k]) for _ in range(30 if i % 4 else 0))
        tag = k if i % 3 else ""
        pages.append((i, f"https://{k}{i % 3}.example.{'de' if k == 'de' else 'com'}/x", f"<html lang='{tag}'><head><script>the and der</script></head><body><nav>der und</nav><p>{body}</p></body></html>"))
        want[i] = k
    pages += [(900, None, None), (901, "", ""), (902, "http://en0.example.com/", "<p>" + "the and with " * 50_000)]
    got = {x.page_id: x for x in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(pages)
    assert sum(got[i].lang == k for i, k in want.items()) >= 0.98 * len(want)
    assert all(x.lang in vocabulary and 0.5 <= x.probability <= 1 for x in got.values())
    assert got[900].host == got[901].host == ""
    assert got[902].lang == "en"
    assert [x.lang for x in langid.identify(spark.createDataFrame(pages[:2], "page_id long, url string, html string"), docs.where("false")).collect()] == [None, None]
    assert langid.identify(spark.createDataFrame([], "page_id long, url string, html string"), docs).count() == 0


def brute(vectors, every, k):
    good = {i: np.array(v, float) for i, v in vectors}
    out = {}
    for q, a in good.items():
        if q % every == 0:
            s = sorted((-float(a @ b / np.sqrt((a @ a) * (b @ b))), i) for i, b in good.items() if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=17).tolist()) for i in range(1500)]
    same = rng.normal(size=17)
    vectors += [(i, same.tolist()) for i in range(1500, 1700)]
    bad = [(5000, None), (5050, [0.0] * 17), (5100, [float("nan")] * 17), (5150, [1.0] * 16 + [None]), (5200, [float("inf")] * 17), (5250, [1.0] * 3), (5300, []), (None, [1.0] * 17)]
    df = spark.createDataFrame([(*v, 1) for v in vectors + bad], "vec_id long, embedding array<float>, label int").repartition(3)
    exact = [(i, np.float32(v).tolist()) for i, v in vectors]
    want = brute(exact, 50, 5)
    got = {}
    for r in multi_index.search(df, centroids=6, shard=64, query_block=8).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    assert all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values())
    found = sum(len({v for v, _ in got[q].values()} & set(w)) for q, w in want.items())
    assert found >= 0.9 * 5 * len(want)
    assert [got[1600][n][0] for n in range(1, 6)] == [1500, 1501, 1502, 1503, 1504]  # ties to the smaller id
    by_id = dict(exact)
    for q, x in got.items():
        a = np.array(by_id[q])
        for v, s in x.values():
            b = np.array(by_id[v])
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_few_neighbours(spark):
    kind = "vec_id long, embedding array<float>"
    assert multi_index.search(spark.createDataFrame([], kind)).count() == 0
    assert multi_index.search(spark.createDataFrame([(50, [1.0, 2.0])], kind)).count() == 0
    got = multi_index.search(spark.createDataFrame([(50, [1.0, 2.0]), (50, [1.0, 2.0]), (7, [1.0, 0.0]), (8, [-1.0, 0.0])], kind))
    assert sorted({(r.query_id, r.rank, r.vec_id) for r in got.collect()})[:2] == [(50, 1, 7), (50, 2, 8)]


def exact_neighbours(rows, k=5):
    """query_id -> [(vec_id, score)] by brute force: the best score of each other vec_id."""
    out = {}
    for q in {v for v, _ in rows if v % 50 == 0}:
        best = {}
        for a in (np.array(x) for v, x in rows if v == q):
            for v, x in rows:
                if v != q and len(x) == len(a):
                    s = float(a @ np.array(x) / np.sqrt((a @ a) * (np.array(x) @ np.array(x))))
                    best[v] = max(s, best.get(v, -2.0))
        out[q] = sorted(best.items(), key=lambda t: (-round(t[1], 9), t[0]))[:k]
    return out


def neighbours_of(spark, rows, more=None, **options):
    df = spark.createDataFrame([(*x, *(more or ())) for x in rows], "vec_id long, embedding array<double>" + (", v int, h int, cell int, size int, query_id int" if more else ""))
    got = {}
    for r in multi_index.search(df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert all([n for _, _, n in x] == list(range(1, len(x) + 1)) for x in got.values())
    return got


def test_repeated_ids_leave_no_query_short(spark):
    r = np.random.default_rng(3)
    # a query's own rows, or those of one entry, are more than a walk of its share looks at
    own = [(50, (np.array([1.0, 0, 0, 0]) + 0.001 * r.normal(size=4)).tolist()) for _ in range(12)]
    entry = [(7, (np.array([0, 1.0, 0, 0]) + 0.001 * r.normal(size=4)).tolist()) for _ in range(30)]
    rest = [(n + 1000, r.normal(size=4).tolist()) for n in range(1, 11)]
    for rows in (own + rest, [(100, [0.0, 1.0, 0.0, 0.0])] + entry + rest, own + entry + rest):
        want = exact_neighbours(rows)
        got = neighbours_of(spark, rows, centroids=3, recall=0.1)
        assert got.keys() == want.keys()
        assert all(len(got[q]) == len(want[q]) == 5 and len({v for v, _, _ in got[q]}) == 5 for q in want)
        all_cells = neighbours_of(spark, rows, centroids=1, more=(1, 2, 3, 4, 5))
        assert {q: [v for v, _, _ in x] for q, x in all_cells.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_lengths_are_apart(spark):
    r = np.random.default_rng(4)
    rows = [(n, r.normal(size=3).tolist()) for n in range(1, 60)] + [(100, [1.0, 2.0]), (61, [2.0, 1.0]), (62, [-1.0, 0.5]), (150, [3.0])]
    want = exact_neighbours(rows)
    for sample_rows in (20_000, 4):  # lengths that the sample lacks are looked at whole
        got = neighbours_of(spark, rows, centroids=2, recall=1.0, sample_rows=sample_rows)
        assert [v for v, _, _ in got[100]] == [v for v, _ in want[100]] == [61, 62]
        assert 150 not in got
        assert len(got[50]) == 5


def bag(text):
    w = text.split() or [""]
    return Counter(zip(w, [*w[1:], None], strict=True))


def likeness(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_declaration_far_into_the_page(spark):
    docs = spark.createDataFrame([(1, "the and with from", "en"), (2, "der und mit von", "de")], "doc_id long, text string, lang string")
    far = "<!-- " + "licence " * 1_000 + "-->"
    pages = [(1, None, far + "<html lang='de'><p>der und</p></html>"), (2, None, far + "<html><p>der und</p></html>"), (3, None, "<html lang='en'><p>the and</p></html>" + far)]
    got = {x.page_id: x.declared for x in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert got == {1: "de", 2: "", 3: "en"}


def test_fingerprints(docs):
    r = random.Random(0)
    rows = []
    for i in range(150):
        w = [r.choice(["a", "the", "x1", "é"]) if r.random() < 0.3 else f"w{r.randint(0, 400)}" for _ in range(r.choice([0, 1, 5, 80, 300]))]
        rows.append((i * 31 % 151 - 20, r.choice([" ", "  ", "\n"]).join(w), i))
    rows += [(500, rows[-1][1], 1), (501, rows[-1][1], 1), (600, None, 1)]
    got = {x.doc_id: x for x in weighted_fingerprints.fingerprints(docs(rows, ", rn int").repartition(3)).collect()}
    assert got.keys() == {x[0] for x in rows}
    ordered = sorted((d, t or "") for d, t, _ in rows)
    edited, nxt = [], []
    for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        x, c = got[d], len(t) // 4
        e = t[: len(t) - c] + n[:c]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        edited.append(x.near_edited - likeness(bag(t), bag(e)))
        nxt.append(x.near_next - likeness(bag(t), bag(n)))
    for errors in (edited, nxt):
        assert abs(np.mean(errors)) < 0.02
        assert max(map(abs, errors)) < 5 * math.sqrt(0.25 / 48)
    assert len({x.fingerprint for x in got.values() if x.doc_id in (rows[149][0], 500, 501)}) == 1
    assert got[500].near_next == 1.0


def test_fingerprints_of_little(docs):
    assert weighted_fingerprints.fingerprints(docs([])).count() == 0
    (x,) = weighted_fingerprints.fingerprints(docs([(5, "just one text here")])).collect()
    assert (x.near_edited, x.near_next) == (pytest.approx(0.5, abs=0.5), 1.0)
    got = weighted_fingerprints.fingerprints(docs([(1, "a b c"), (1, "a b c"), (None, "z " * 30_000)])).collect()
    assert sorted(x.n_chars for x in got) == [5, 5, 60_000]
    assert len({x.fingerprint for x in got}) == 2


def test_fingerprints_have_all_samples(docs):
    text = " ".join(f"w{i}" for i in range(200))
    got = weighted_fingerprints.fingerprints(docs([(1, text), (2, text[:400] + " x y z")])).collect()
    assert all(len(bytes.fromhex(x[c])) == 4 * 64 for x in got for c in ("fingerprint", "edited_fingerprint"))
    assert all((64 * x[c]).is_integer() and 0 < x[c] < 1 for x in got for c in ("near_edited", "near_next"))


def test_gamma_tables():
    r, c = weighted_fingerprints.tables()
    assert r.mean() == pytest.approx(2, abs=0.02)
    assert (r**2).mean() - r.mean() ** 2 == pytest.approx(2, abs=0.1)
    for k, t in enumerate(c.reshape(weighted_fingerprints.LEVELS, -1)):
        assert (np.diff(t) > 0).all()
        x = math.exp(t[128])
        assert 1 - math.exp(-x) * (1 + x) == pytest.approx(128.5 / 256 / 16**k, rel=1e-3)


def test_ranges_follow_the_input(spark):
    """Far more than 512 of them; each row's range is what a search in the sorted first ids says."""
    from pyspark.sql import functions as F

    df = spark.range(0, 30_000, 3).select((F.col("id") * 7919 % 30_011).alias("doc_id"))
    number, firsts = weighted_fingerprints.ranges(df, F.col("doc_id"), 2_000)
    got = np.array([tuple(r) for r in df.select("doc_id", number).collect()])
    first = np.array(sorted(r["first"] for r in firsts.collect()))
    assert 1_900 <= len(first) <= 2_000
    want = np.searchsorted(first, got[:, 0], side="right")
    assert len(set(zip(want.tolist(), got[:, 1].tolist(), strict=True))) == len(first)
    assert np.bincount(got[:, 1]).max() <= 50


def test_language_is_trained_on_a_bound_of_distinct_rows(spark):
    rows = [(n, f"text number {n}", "en" if n % 2 else "de") for n in range(50)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for bound, most in ((1, 1), (10, 10), (1000, 50)):
        langs, table = langid.train(docs, bound)
        assert len(langs) <= 2 and (table.shape[0] == len(langs))
        n = sum(len(langid.trigrams(t)) for t in {t for _, t, _ in rows})
        weights = [1 / np.exp(x.min()) * 0.5 - 0.5 * (1 << langid.BITS) for x in table]
        assert sum(weights) <= n * most / 50 * 1.2 + 1
    assert langid.train(docs.limit(0))[0] == []
    with pytest.raises(ValueError, match="2 languages"):
        langid.train(docs, most_langs=1)


def test_toxicity_settings_are_chosen_without_held_out_rows(spark, docs):
    """Texts and labels of the held-out third don't change what cross-validation says."""
    import zlib

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = {i: " ".join([word() for _ in range(20)] + ["vileword"] * (i % 3 == 0)) for i in range(240)}
    out = {i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1}
    settings = [{"kept": 200, "penalty": 1.0}, {"kept": 50, "penalty": 30.0}]

    def run(other):
        rows = [(i, other if i in out and other else t) for i, t in texts.items()]
        labels = spark.createDataFrame([(i, int(i % 3 == 0) if i not in out or not other else 1) for i in texts], "doc_id long, toxic int")
        return toxicity.cross_validated(docs(rows), labels, settings, folds=2)

    plain = run(None)
    assert [x["kept"] for x in plain] == [200, 50] and plain[0]["recall"] > 0.9 and plain[0]["loss"] < plain[1]["loss"]
    for a, b in zip(plain, run("nothing to see"), strict=True):
        assert a == pytest.approx(b)


def test_a_score_follows_from_slots_and_weights():
    """Again from n-grams hashed one by one with plain integers."""
    bits, text = 12, "Aé b\tvile  words"
    model = toxicity.Model(bits, np.random.default_rng(0).normal(size=1 << bits).astype(np.float32), -0.3)
    cs = [32, *[32 if ord(x) < 33 else ord(x) for x in text.lower()], 32]
    mask, found = (1 << 32) - 1, set()
    for a in range(len(cs)):
        h = cs[a] * 0x9E3779B1 & mask
        for n in range(2, max(toxicity.ORDERS) + 1):
            if a + n > len(cs):
                break
            h = (h ^ (h >> 15)) * 0x85EBCA6B + cs[a + n - 1] & mask
            if n in toxicity.ORDERS:
                found.add((h * 0xC2B2AE35 & mask) >> (32 - bits))
    z = sum(float(model.weight[s]) for s in found) - 0.3
    assert toxicity.scores([text], model)[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


def test_language_is_the_posterior_of_its_parts(spark):
    """Each page's posterior again, by loops over the texts' verdicts of all other pages."""
    r = random.Random(8)
    speech = {"en": "the and with house water".split(), "de": "der und mit haus wasser".split(), "fr": "le et avec maison eau".split()}
    say = lambda lang, n: " ".join(r.choice(speech[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(lang, 40), lang) for i, lang in enumerate(list(speech) * 12)], "doc_id long, text string, lang string")
    rows = []
    for i in range(40):
        lang = r.choice(list(speech))
        declared = r.choice(["", f' lang="{lang}"', ' lang="de"'])
        host = r.choice(["a.example.de", "b.example.fr", "a.example.com"])
        rows.append((i, f"http://{host}/x", f"<html{declared}><body><p>{say(lang, r.choice([0, 1, 2, 8]))}</p></body></html>"))
    rows += [(90, None, None), (91, "no address", "<p>the und"), (None, "http://a.example.de", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    trust, most = 5.0, 30.0
    got = langid.identify(pages, docs, trust=trust, most_trigrams=most).collect()
    langs, table = langid.train(docs)
    seen = []
    for i, url, page in rows:
        t = langid.trigrams(langid.plain(page or ""))
        log = table[:, t].sum(axis=1) if len(t) > 1 else np.zeros(3)
        said = (log - log.max()) * min(1.0, most / max(len(t), 1))
        host = url.split("/")[2] if url and "://" in url else ""
        found = page and page.split('lang="')[1].split('"')[0] if page and 'lang="' in page else ""
        seen.append((i, said, langs[int(said.argmax())] if said.any() else None, host, host.rsplit(".", 1)[-1], found))
    want = {}
    for row, (i, said, own, host, suffix, declared) in enumerate(seen):
        rest = seen[:row] + seen[row + 1 :]
        n = lambda keep, rest=rest: np.array([sum(1.0 for s in rest if s[2] == lang and keep(s)) for lang in langs])
        total = n(lambda s: True)
        every = (total + 1) / (total.sum() + 3)
        of_suffix, of_host, of_declared = n(lambda s, x=suffix: s[4] == x), n(lambda s, x=host: s[3] == x), n(lambda s, x=declared: s[5] == x)
        prior = (of_host + trust * (of_suffix + trust * every) / (of_suffix.sum() + trust)) / (of_host.sum() + trust)
        told = np.ones(3) if not declared else (of_declared + 1) / (total + 6)
        log = said + np.log(prior) + np.log(told)
        p = np.exp(log - log.max())
        want[i] = (langs[int(log.argmax())], p.max() / p.sum(), own)
    assert len(got) == len(rows)
    for x in got:
        assert (x.lang, x.text_lang) == (want[x.page_id][0], want[x.page_id][2])
        assert x.probability == pytest.approx(want[x.page_id][1])


def test_a_page_does_not_vote_for_itself(spark):
    """Where there is no other page, the text alone decides."""
    docs = spark.createDataFrame([(1, "aaa bbb ccc", "en"), (2, "ddd eee fff", "de")], "doc_id long, text string, lang string")
    page = lambda i, text, host: (i, f"http://{host}/{i}", f'<html lang="xx"><body>{text}</body></html>')
    pages = spark.createDataFrame([page(0, "ddd", "lone.example")], "page_id long, url string, html string")
    (x,) = langid.identify(pages, docs).collect()
    langs, table = langid.train(docs)
    said = table[:, langid.trigrams("ddd ")].sum(axis=1)
    p = np.exp(said - said.max())
    assert (x.lang, x.text_lang) == ("de", "de") and x.probability == pytest.approx(p.max() / p.sum())
