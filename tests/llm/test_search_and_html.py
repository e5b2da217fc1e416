"""Vantage-point search against brute force; page extraction on small pages and on the pages table."""

import html
import re

import numpy as np
import pytest

from sparkwarden.llm import html_extract, vp_search
from sparkwarden.llm.html_extract import Weights, main_text


def brute(x, ids, q, own, k):
    d = np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1])
    other = ids != own
    first = np.lexsort((ids[other], d[other]))[:k]
    return list(zip(ids[other][first].tolist(), d[other][first].tolist(), strict=True))


@pytest.mark.parametrize("shard, block", [(8192, 1024), (70, 4)])
def test_search_is_exact_at_factor_one(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vp_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(vp_search, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    x[200:260] = x[:60]
    x[260:] = x[0] + 0.01 * rng.standard_normal((40, 6))
    rows = [(k, v.tolist(), "q", 3) for k, v in enumerate(x)]
    odd = [(900, None), (910, [0.0] * 6), (920, [float("inf")] + [1.0] * 5), (930, [None] * 6), (940, [1.0, 2.0]), (None, [1.0] * 6), (950, [])]
    df = spark.createDataFrame([*rows, *rows[:3], *[(*o, "q", 3) for o in odd]], "vec_id long, embedding array<float>, dim string, shard int")
    got = {}
    for r in vp_search.search(df, df.where("vec_id % 10 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 10))
    ids = np.arange(300)
    for q, found in got.items():
        want = brute(x.astype(float), ids, x[q].astype(float), q, 7)
        assert sorted(found) == [(n + 1, *w) for n, w in enumerate(want)]


def test_relaxed_factor_keeps_most_neighbours():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 4))
    ids, own = np.arange(4000), np.full(50, -1)
    q = rng.standard_normal((50, 4))
    tree = vp_search.Tree.build(x)
    exact = tree.search(q, 10, ids, own)[1]
    for k in range(50):
        assert exact[k].tolist() == [i for i, _ in brute(x, ids, q[k], -1, 10)]
    loose = tree.search(q, 10, ids, own, factor=1.5)[1]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, loose, strict=True)]) >= 0.9
    with pytest.raises(ValueError):
        vp_search.search(None, None, factor=0.5)


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = vp_search.search(df, df, k=10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(0, 1, 100), (100, 1, 0)]
    assert vp_search.search(df, df.limit(0)).count() == 0 and vp_search.search(df.limit(0), df).count() == 0


PAGES = [
    (None, ""),
    ("", ""),
    ("  \n ", ""),
    ("plain text", "plain text"),
    ("<p>a &amp;\n b&nbsp;c<p>foo<b>bar</b><br>x", "a & b c foobar x"),
    ("<nav><a>Home</a></nav><p>one two</p><footer>&copy; x</footer>", "one two"),
    ("<p>a b c</p><form>name <input></form><div id='comments'><p>so true</p></div>", "a b c"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- no --><p>yes it is", "yes it is"),
    ("<nav><a>never closed", "never closed"),
    ("<script>open", ""),
    ("<<<p>>a</p>", "<< >a"),
    ('<p title="a > b">x y</p>', "x y"),
    ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()),
]


@pytest.mark.parametrize("source, want", PAGES)
def test_small_pages(source, want):
    assert main_text(source, Weights()) == want


ARTICLE = " ".join(f"word{k}" for k in range(120))
HALF = " ".join(f"more{k}" for k in range(120))
BODY = f"<article><p>{ARTICLE}</p></article>"


@pytest.mark.parametrize(
    "source",
    [
        f'<div class="content has-sidebar">{BODY}</div>',
        f'<body class="layout no-sidebar">{BODY}</body>',
        f'<div class="layout no-sidebar">{BODY}</div>',
        f'<div class="page search-results">{BODY}</div>',
        f'<div data-id="search">{BODY}</div>',
        f'<div class="search">{BODY}</div>',
        f"<html><body><form action=x>{BODY}</form></body></html>",
        f"<form><div><p>{ARTICLE}</p></div></form>",
        f"<html><head><title>t t</title><body>{BODY}</body></html>",
        f"<html><head><title>t t</title><script>var a = '<div>';</script><div>{BODY}</div></html>",
        f"<html><head><title>t t</title></head><body>{BODY}</body></html>",
        f'<svg width="3" />{BODY}',
        f"<svg/>{BODY}",
        f"<svg><title>chart</title><text>label</text></svg>{BODY}",
        f"<head-line>{BODY}</head-line>",
        f"<style-guide></style-guide>{BODY}",
        f"<div>{'menu ' * 150}</div><ul><li>a</li></ul><div><h2>x</h2></div>{BODY}",
        f"{BODY}<div class='comment-list'>{'so true ' * 200}</div>",
        f"<nav><ul><li>Home</li></ul></nav>{BODY}<footer class='site-footer'>{'legal ' * 90}</footer>",
    ],
)
def test_ordinary_pages_keep_their_text(source):
    assert main_text(source, Weights()) == ARTICLE


@pytest.mark.parametrize("between", ['<section id="related-work"><p>{}</p></section>', '<p id="social-history">{}</p>', "<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>" * 60 + "<p>{}</p>"])
def test_parts_of_an_article_stay(between):
    text = main_text(f"<article><p>{ARTICLE}</p>{between.format(HALF)}</article>", Weights())
    assert text.startswith(ARTICLE) and text.endswith(HALF)


def test_names_of_side_matter():
    assert all(map(html_extract._is_side, ("ad", "site-footer", "ad-banner", "comments", "social_share", "sidebar-left")))
    assert not any(map(html_extract._is_side, ("has-sidebar", "related-work", "search-results", "content", "page", "", "-", "header")))


def test_scan_finds_the_best_run():
    """Against all contiguous runs of the page's items."""
    source = "<div>a b</div><ul><li>x</li><li>y</li></ul><div><p>one two three four five six seven</p><h2>t</h2><p>eight nine</p></div><div>z</div>"
    weights = Weights({"div": (0, 50), "/div": (0, 50)})
    page = html_extract.Page(source)
    value = [len(t.split()) if t is not None else -weights.cost(tag, names) for _, tag, names, t in page.items]
    n = len(value)
    best = max(((sum(value[i:j]), i, j) for i in range(n) for j in range(i + 1, n + 1)), key=lambda x: x[0])
    words = " ".join(page.items[k][3] for k in range(best[1], best[2]) if page.items[k][3]).split()
    assert main_text(source, weights).split() == words == "one two three four five six seven t eight nine".split()


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    extra = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (None, None, "<p>no id</p>")], pages.schema)
    pages = pages.unionByName(extra).withColumn("text", pages.html)
    rows = html_extract.extract(pages, html_extract.fit(pages)).collect()
    assert len(rows) == pages.count()
    for r in rows:
        if r.page_id is None or r.page_id < 0:
            assert r.text == ("no id" if r.page_id is None else "")
            continue
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", body))).split())
    assert html_extract.extract(pages.limit(0), html_extract.fit(pages.limit(0))).count() == 0
