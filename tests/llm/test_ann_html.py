from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.ann import PROJECTIONS, SEED, Block, nearest, search_block
from lodestone.llm.htmltext import blocks, classify, extract, labelled_rows, main_text, train, used


def exact(ids, x, q, k):
    s = x @ x[q]
    keep = np.flatnonzero(ids != ids[q])
    by = np.lexsort((ids[keep], -s[keep]))[:k]
    return ids[keep[by]].tolist()


@pytest.mark.parametrize("kind", ["random", "clusters", "lengths", "copies"])
def test_recall(kind):
    rng = np.random.default_rng(7)
    n, dim = 3000, 32
    x = rng.standard_normal((n, dim))
    if kind == "clusters":
        x = x * 0.3 + rng.standard_normal((12, dim))[rng.integers(0, 12, n)]
    if kind == "lengths":
        x *= rng.uniform(0.2, 3, (n, 1))
    if kind == "copies":
        x[: n // 3] = x[0]
    ids = np.arange(n)
    asked = ids[::60]
    q, v, s, share = search_block(Block(x, PROJECTIONS, SEED), ids, asked, x[asked], 20)
    assert np.allclose(s, np.einsum("ij,ij->i", x[q], x[v]))
    hits = sum(len({*exact(ids, x, a, 20)} & {*v[q == a].tolist()}) for a in asked)
    assert hits / (20 * len(asked)) >= 0.95
    assert kind in ("copies", "lengths") or share.mean() < 0.25
    if kind == "copies":
        assert v[q == 0].tolist() == [*range(1, 21)]  # ties go to the smaller id


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)]
    odd = [(1000, None, 0.0), (1020, [0.0] * 8, 0.0), (1040, [float("nan")] + [1.0] * 7, 0.0), (1060, [float("inf")] * 8, 0.0), (1080, [None] + [1.0] * 7, 0.0), (1100, [], 0.0), (1120, [1.0, 2.0], 0.0), (1140, [2.0, 1.0], 0.0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score double")
    for blocks in ({}, {"block_bytes": 90 * 64, "query_rows": 7}):
        got = {}
        for r in nearest(table, F.col("vec_id") % 20 == 0, k=5, **blocks).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == {*range(0, 400, 20), 1120, 1140}
        assert [(r, v) for r, v, _ in sorted(got[1120])] == [(1, 1140)] and got[1120][0][2] == 4.0
        ids = np.arange(400)
        hits = sum(len({v for _, v, _ in got[q]} & {*exact(ids, x, q, 5)}) for q in range(0, 400, 20))
        assert hits / (5 * 20) >= 0.9 and all([r for r, *_ in sorted(got[q])] == [1, 2, 3, 4, 5] for q in range(0, 400, 20))
    assert nearest(table.limit(0), F.lit(True)).count() == 0


def test_recall_on_the_table_over_several_blocks(spark):
    """All of the embeddings table, dealt over some eight blocks, against an exact search."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in nearest(table, F.col("vec_id") % 20 == 0, block_bytes=128 << 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist())
    assert sum(len(got[int(ids[a])] & {*exact(ids, x, a, 20)}) for a in asked) >= 0.95 * 20 * len(asked)
    *_, share = search_block(Block(x, PROJECTIONS, SEED), ids, ids[asked], x[asked], 20)
    assert share.mean() < 0.25


TREE = train(labelled_rows())


def test_the_tree_fits_its_table_and_asks_the_neighbours():
    rows = labelled_rows()
    assert all(classify(TREE, r[:-1]) == bool(r[-1]) for r in rows)
    assert {"words", "density", "density before", "density after", "words before", "words after"} <= used(TREE)
    # beside words and links: what stands in an article stays, the rest of its page goes, furniture goes
    grid = [(w, d, *around) for w in (1.0, 4.0, 9.0, 60.0, 300.0) for d in (0.0, 0.4, 1.0) for around in itertools.product((0.0, 2.0, 30.0, 90.0), (0.0, 0.5, 1.0), (0.0, 2.0, 30.0, 90.0), (0.0, 1.0))]
    for row in grid:
        for heading in (0.0, 1.0):
            assert classify(TREE, (*row, 1.0, heading, 0.0, 0.0, 1.0))
            for mark in (0.0, 1.0):
                assert not classify(TREE, (*row, 0.0, heading, 0.0, mark, 1.0))
                assert not classify(TREE, (*row, 0.0, heading, 1.0, mark, 0.0))


def words(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


def held_out():
    """Pages that the table doesn't hold, of blocks (html, text, whether it is main text)."""
    nav = lambda k: [(f'<li><a href="/{i}">Topic {i}</a></li>', f"Topic {i}", 0) for i in range(k)]
    p = lambda n, i=0: (f"<p>{words(n, i)}</p>", words(n, i), 1)
    out = []
    for k in (3, 6, 9):
        for sizes in ((40, 25, 60), (120, 9, 33, 70), (15, 18, 22, 50, 11), (200, 6, 90)):
            body = [("<h1>A headline of some words</h1>", "A headline of some words", 1)] + [p(n, 100 * i) for i, n in enumerate(sizes)]
            out.append([*nav(k), *body, *[(f'<div><a href="/n{i}">Another story number {i} here</a></div>', f"Another story number {i} here", 0) for i in range(k)]])
            out.append([("<div>Site</div>", "Site", 0), *nav(k), *body, ("<div>Sections</div>", "Sections", 0), *nav(k), ("<div>(c) us</div>", "(c) us", 0)])
            with_link = [*body, ('<p><a href="/full">Read the full report on it</a></p>', "Read the full report on it", 1), p(80, 900), p(45, 990)]
            out.append([*nav(k), *with_link, *nav(k)])
            out.append([("<header>Name</header>", "Name", 0), *nav(k), *((f"<article>{h}</article>" if i == 0 else h.replace("<p", "<article><p").replace("</p>", "</p></article>"), t, y) for i, (h, t, y) in enumerate(body)), ("<div>Beside it all</div>", "Beside it all", 0), (f'<div class="comments"><p>{words(30, 700)}</p></div>', words(30, 700), 0), ("<footer>f</footer>", "f", 0)])
    return out


def test_precision_and_recall_on_pages_held_out():
    right = kept = wanted = 0
    for page in held_out():
        got = main_text("".join(h for h, _, _ in page), TREE).split("\n")
        want = [t for _, t, y in page if y]
        kept, wanted = kept + len(got), wanted + len(want)
        right += sum(min(got.count(t), want.count(t)) for t in set(want))
    assert right / kept >= 0.95 and right / wanted >= 0.95, (right / kept, right / wanted)


def test_links_end_where_they_should():
    assert main_text("<article><p>One <a href=https://x.com/>two</a> three.</p></article>", TREE) == "One two three."
    page = "<p>" + words(30) + "</p><div><a href=https://x.com/>One</a> <a href=https://y.com/>two</a></div><div><a href=/z>z</a></div>"
    assert main_text(page, TREE) == words(30)
    assert blocks("<p><a name=x>one <a href=y>two</p><p>three")[0].linked == 1
    assert main_text("<p>a<br/>b<img src=x/>c<i/>d</p>", TREE) == "a bcd"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- note --><div class="ad">Buy now</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b> words,
and&nbsp;more.<br>Line two</p><p>Short.</p><ul><li>one</li><li>two</li></ul><aside>beside</aside><form><label>Name</label><input></form>
<section class="comments"><h2>Comments</h2><p>I liked this article very much indeed and will read on.</p></section></article></main>
<div id="cookie-notice">We use cookies</div><div class="sidebar"><p>Other things to read when you have read this.</p></div><footer>&copy; us</footer></body></html>"""


def test_article():
    assert main_text(PAGE, TREE) == "Title & more\nFirst bold words, and more. Line two\nShort.\none\ntwo"


def test_page_without_an_article():
    page = '<div id="nav"><a href=1>Home</a> <a href=2>News</a></div><div id="content"><h2>Head</h2><p>A long paragraph with many words in it, enough of them to be text.</p><p>Short.</p></div><div class=footer>x y z</div>'
    assert main_text(page, TREE) == "Head\nA long paragraph with many words in it, enough of them to be text.\nShort."


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<nav><a>x</a></nav>", ""), ("<article><p>cut sho", "cut sho"), ("<article><p><b>one<p>two</article><footer>f", "one\ntwo"), ("<article><p>1 &lt; 2 &am</p>", "1 < 2 &am"), ("<article><p>a<script>x", "a"), ("<article><p>a < b</p><p>c<!-- d", "a < b\nc")])
def test_odd_pages(page, want):
    assert main_text(page, TREE) == want


LONG = " ".join(f"word{i}" for i in range(80))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="layout has-sidebar"><article><p>Short.</p></article></div>', "Short."),
        ('<div class="sidebar"><main><p>Short.</p></main></div>', "Short."),
        ('<article><section id="legal-history"><h2 id="related-work">Head</h2><p>Short.</p></section></article>', "Head\nShort."),
        ('<article><div class="social-science"><p>One.</p></div><section id="discussion"><h2>Discussion</h2><p>Two.</p></section></article>', "One.\nDiscussion\nTwo."),
        ('<article><p title="the hidden door">One.</p><p data-x=\'a class="ad"\'>Two.</p><p hidden>Three.</p></article>', "One.\nTwo."),
        (f'<article><p>One.</p><div class="notice"><p>{LONG}</p><p>Two.</p></div></article>', f"One.\n{LONG}"),
        (f'<div class="widget"><p>{LONG}</p><p>Two.</p></div>', LONG),
        (f'<article><p>One.</p></article><div class="site-footer"><p>{LONG}</p></div>', "One."),
        ('<article><p>One.</p><div class="comments"><article class="comment"><p>Two.</p></article></div></article>', "One."),
    ],
)
def test_marks_are_whole_tokens_weighed_with_the_rest(page, want):
    assert main_text(page, TREE) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>Some text <span class="share">Share</span></p></article>', "Some text"),
        ('<article><p>Some text<sup class="legal">1</sup></p></article>', "Some text"),
        ('<article><p>Some <b>bold <i class="ad">Buy now</i> text</b> here.</p></article>', "Some bold text here."),
        ('<article><p><span class="ad">Buy now</span> Some text.</p></article>', "Some text."),
        ('<article><p>Some <span hidden>secret</span>text.</p></article>', "Some text."),
        ('<article><span class="ad">Buy now</span><p>Some text.</p></article>', "Some text."),
        (f'<article><p>Some <span class="notice">{LONG}</span>, here.</p></article>', f"Some {LONG}, here."),
        ('<article><a class="promo"><div>Buy now</div></a><p>Some text.</p></article>', "Some text."),
        ('<article><div class="ad">Buy <b>now</b></div>Some text.</article>', "Some text."),
    ],
)
def test_marked_inline_elements_stand_alone(page, want):
    assert main_text(page, TREE) == want


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><meta charset=utf-8><title>T</title><script>x</script><body><article><p>Some text.</p></article></body></html>",
        "<head><title>T</title><link rel=x><article><p>Some text.</p></article>",
        "<head><style>p{}</style></head><body><article><p>Some text.</p></article>",
        "<html><head><title>T</title>\n<meta name=a><p>Some text.",
        "<head><title>T</title>Some text.",
        "<head><title>T</title><noscript><p>no</p></noscript><template><p>no</p></template><p>Some text.</p>",
        "<head><title>T</title><img src=x>Some text.",
    ],
)
def test_a_head_ends_without_its_end_tag(page):
    assert main_text(page, TREE) == "Some text."


def test_long_pages_take_linear_time():
    import time

    began = time.time()
    assert main_text("<article>" + "<p>word &amp; word</p>" * 50_000, TREE).count("\n") == 49_999
    assert time.time() - began < 20


def test_extract(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "old"), (2, "u", None, None), (2, "u", None, None)], "page_id long, url string, html string, text string")
    got = extract(rows)
    assert got.columns == ["page_id", "url", "html", "text"]
    assert [r.text for r in got.orderBy("page_id").collect()] == [main_text(PAGE, TREE), "", ""]
    assert extract(rows.limit(0)).count() == 0
