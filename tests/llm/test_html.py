"""Parts that are no article by their names are left out wherever they stand; article parts with like names stay."""

import random

import pytest
import pyarrow.parquet as pq

from lectern.llm import html

LONG = "A paragraph of running text with enough words in it to count as content on any page, and then some more of it."
NOISE = ["comments", "comment-list", "sidebar", "sidebar-left", "cookie-notice", "cookie-consent", "newsletter", "ad", "ad-box", "sponsored",
         "replies", "gdpr", "disqus"]
KEPT = ["discussion", "related-work", "results", "advice", "commentary-on-law", "long-form", "address-book"]


def article(rng, name, where, container):
    """A page and its article's lines: a long noisy part before, inside or behind the text."""
    own = [f"{LONG} Own {i} {rng.random()}" for i in range(rng.randint(2, 6))]
    noise = f'<div class="{name}">' + "".join(f"<p>{LONG} Noise {i} {rng.random()}</p>" for i in range(rng.randint(1, 4))) + "</div>"
    body = [f"<p>{x}</p>" for x in own]
    if where == "inside":
        body.insert(rng.randint(1, len(body)), noise)
    inner = "<" + container + ">" + "".join(body) + "</" + container.split()[0] + ">"
    return "<html><body>" + {"before": noise + inner, "inside": inner, "behind": inner + noise}[where] + "</body></html>", own


@pytest.mark.parametrize("where", ["before", "inside", "behind"])
@pytest.mark.parametrize("container", ["article", 'div id="content"', "div", "main"])
def test_noise_goes(where, container):
    rng = random.Random(1)
    for name in NOISE:
        page, own = article(rng, name, where, container)
        assert html.main_text(page).split("\n") == own, (name, page)


@pytest.mark.parametrize("name", KEPT)
def test_article_parts_stay(name):
    page = f'<article><p>{LONG}</p><section class="{name}"><p>{LONG} Two.</p></section><p>{LONG} Three.</p></article>'
    assert html.main_text(page).split("\n") == [LONG, f"{LONG} Two.", f"{LONG} Three."]


def test_misnamed_article_stays():
    page = f'<body><div class="sidebar"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><p>Hi.</p></body>'
    assert html.main_text(page).split("\n")[:3] == [LONG] * 3
    page = f'<body><div class="popup"><p>{LONG}</p></div><div class="comments"><p>{LONG}</p></div></body>'  # nothing else
    assert html.main_text(page)


def test_very_long_and_odd_pages(spark):
    long_page = "<article>" + f"<p>{LONG}</p>" * 20_000 + '<div class="comments"><p>no</p></div></article>'
    rows = [(1, "u", long_page, "x", "y"), (2, None, None, "x", "y"), (None, "u", "", "x", "y"), (1, "u", "<p>a", "x", "y"), (1, "u", "<p>a", "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html.extract(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 20_000 * (len(LONG) + 1) - 1), (2, 0)]


def test_sample_pages_have_text():
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    assert sum(bool(html.main_text(p or "")) for p in pages) > 0.9 * len(pages)
