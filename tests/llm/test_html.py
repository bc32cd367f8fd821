"""Operator 3: block reading, held-out labelled pages and the given pages' articles."""

import html
import re

import pytest

from parcela.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.learn()


def test_leaf_blocks():
    page = ("<!DOCTYPE html><title>no</title><script>var t='</p>';</script><!-- x --><p>a&nbsp;&amp;\n b<br>c<p><b>d</b> < e"
            "<ul><li>one<li>two<a href='>'>three</a></ul>tail<table><tr><td>x<td>y</table><p title=\"a>b\">q</p><style>p{}")
    assert [t for t, _ in H.leaf_blocks(page)] == ["a & b c", "d < e", "one", "twothree", "tail", "x", "y", "q"]
    for odd in ("", "<", "<p", "</", "</p></div>", "<!--", "<a href=\"", "<script>", "&#xD800;&bad;", "<p>" * 3000, "<div " + "a'\"" * 2000):
        H.leaf_blocks(odd)


def test_held_out_labelled_pages(model):
    right = total = 0
    for page in H.labelled_pages(200, seed=77):
        blocks = H.leaf_blocks(page)
        kept = H.content_blocks(blocks, model)
        total += 1
        right += kept == [t for t, _ in blocks if H.MARK[1] in t]
    assert right / total > 0.93


def test_copyright_anywhere_in_a_block():
    bit = H.BIT["copyright"]
    assert all(H._text_bits("word " * n + "Copyright by us") & bit for n in (0, 10, 39, 40, 500))
    assert not H._text_bits("word " * 500 + "copy right") & bit


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {p.page_id: article(p.html) for p in pages.collect()}
    got = H.extract_pages(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_other_layouts(model):
    page = ("<html><body><div id='cookie-banner'>We use cookies. Accept all of them please.</div><header><nav><ul><li><a href=/>Home</a></li>"
            "</ul></nav></header><main><h1>A title of some words</h1><p>First paragraph, with several words in it.</p><div class='advert'>Buy this "
            "now, it is cheap.</div><p>Second paragraph &amp; its words go on for a while.</p></main><section class=\"comments\"><p>I liked this "
            "piece a lot, thank you.</p></section><form><label>Name</label><button>Send</button></form><footer>&copy; 2024 Some Site</footer>")
    assert H.extract(page, model) == ("A title of some words\n\nFirst paragraph, with several words in it.\n\n"
                                      "Second paragraph & its words go on for a while.")


def test_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p>only one paragraph here, no more than that.</p>", 3), (3, "u", "<br><hr><p> </p>", 4)]
    rows += [rows[2], (9, "u", "<article><p>" + "very long text " * 100_000 + "</p></article>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0), r.url, r.text[:40], r.n_chars) for r in H.extract_pages(pages).collect() if r.url)
    p = "only one paragraph here, no more than that."
    assert got == [(0, "u", p[:40], len(p))] * 2 + [(1, "u", "", 0), (3, "u", "", 0), (9, "u", ("very long text " * 3)[:40], 1_499_999)]
    assert H.extract_pages(pages.limit(0)).count() == 0
