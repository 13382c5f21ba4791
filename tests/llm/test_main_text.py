"""Trees of pages, exact marginals against all labellings, and main text on labelled pages held out."""

import itertools
import math

import numpy as np
import pytest

from moundworks.llm import labelled, main_text
from moundworks.llm.dom import parse


@pytest.fixture(scope="module")
def model():
    return main_text.fit(labelled.pages(300, 5), rounds=80)


def shown(source):
    page = parse(source)
    return page.joined([True] * len(page.parent))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<p>b<b>c</b>d<br>e", "a bcd e"),
        ("<ul><li>a<li>b</ul>c", "a b c"),
        ("<script>var t='</p>';</script>a<style>p{}</style><textarea>x</textarea>b", "a b"),
        ("a<!-- <p>no --> b<!-- open", "a b"),
        ("x &amp; y&nbsp;&#233;&lt;p&gt;", "x & y é<p>"),
        ('<a title="1 > 0">a</a><p title=\'"\'>b', "a b"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<div></span></p>a</div></div>b", "a b"),
        ("1 < 2 <3 <p", "1 < 2 <3"),
        ("<title>t</title><p>  a \n b\t</p>", "a b"),
        ("<script>never ends <p>a", ""),
        ("", ""),
    ],
)
def test_trees(source, want):
    assert shown(source) == want


def test_unclosed_and_deep_pages():
    p = parse("<div><p>a<p>b</div>c")
    depth = {p.text[n]: p.depth[n] for n in p.flow if n >= 0}
    assert depth["a"] == depth["b"] > depth["c"]
    assert shown("<div>" * 20_000 + "a") == "a"
    assert shown("<p>a " * 20_000) == " ".join("a" * 20_000)


def test_marginals_are_sums_over_all_labellings(model):
    page = parse("<nav><a>x y</a></nav><div class='post'>One. <b>Two.</b></div>")
    f = main_text.Forest.of([page])
    r = np.random.default_rng(0)
    score, edge = r.normal(size=len(page.parent)), r.normal(size=(main_text.KINDS, 2, 2))
    p, pair, log_z = f.messages(score, edge)
    total, ones, both = 0.0, np.zeros(len(score)), np.zeros((len(score), 2, 2))
    for y in itertools.product((0, 1), repeat=len(score)):
        w = math.exp(sum(s for s, k in zip(score, y, strict=True) if k) + sum(edge[f.kind[i], y[f.parent[i]], y[i]] for i in range(len(y)) if f.parent[i] >= 0))
        total += w
        ones += w * np.array(y)
        for i in range(1, len(y)):
            both[i, y[f.parent[i]], y[i]] += w
    assert p == pytest.approx(ones / total)
    assert pair[1:] == pytest.approx(both[1:] / total)
    assert float(log_z[0]) == pytest.approx(math.log(total))
    # pages of one batch don't touch each other
    many = [page, parse("<p>Else."), page, parse("")]
    alone = [model.marginals([x], {})[0] for x in many]
    for a, b in zip(alone, model.marginals(many, {}), strict=True):
        assert a == pytest.approx(b)


def test_main_text_of_held_out_pages(model):
    """By characters, on layouts drawn anew."""
    pages = [parse(s) for s in labelled.pages(150, 777)]
    hit = kept = main = 0
    for page, p in zip(pages, model.marginals(pages, {}), strict=True):
        for n in page.flow:
            if n >= 0:
                size, y, k = len(page.text[n]), page.mark[n] == 1, p[n] >= 0.5
                hit, kept, main = hit + size * (y and k), kept + size * k, main + size * y
    assert hit / kept > 0.97 and hit / main > 0.97


def test_rows_and_spoilt_pages(spark, model):
    article = "<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy it now. It is cheap.</div><article><h1>Ti&amp;tle</h1><p>One <b>two</b>\n three.<p>Four.</article><footer>&copy; us</footer>"
    long = "<article>" + "<p>Some words here, and more.</p>" * 3000 + "</article>"
    rows = [(1, "u", article, 1), (1, "u", article, 2), (None, None, None, 3), (2, "v", "", 4), (3, "w", long, 5), (4, None, "<nav>a</nav>", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = main_text.extract(df, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = "Ti&tle One two three. Four."
    want = [(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", " ".join(["Some words here, and more."] * 3000), 3000 * 27 - 1), (4, None, "", 0)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert main_text.extract(df.limit(0), model).count() == 0


def test_labelled_pages_are_the_same_everywhere():
    assert labelled.pages(5, 3) == labelled.pages(5, 3)
    assert labelled.pages(5, 3) != labelled.pages(5, 4)
