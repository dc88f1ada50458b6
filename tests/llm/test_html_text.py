import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import html_text as M

from compare import SMALL


def article(page):
    """The article element's blocks, for the pages of the test tables, which have exactly one."""
    inner = page.split("<article>", 1)[1].split("</article>")[0]
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_tables(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").toPandas()
    got = {r.page_id: r for r in M.op10_html_text(spark, SMALL).collect()}
    for p in pages.itertuples():
        assert got[p.page_id].text == article(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_unmarked_pages_by_words_alone():
    """Held out: the same pages with the article element's tags taken away."""
    import duckdb

    pages = [r[0] for r in duckdb.sql(f"select html from '{SMALL}/pages.parquet' order by page_id").fetchall()]
    half = len(pages) // 2
    counts = sum((M.count_labels(p) for p in pages[:half]), start=type(M.count_labels(""))())
    weights = M.fit(counts)
    good = sum(M.main_text(re.sub(r"</?article>", "", p), weights) == article(p) for p in pages[half:])
    assert good >= 0.9 * (len(pages) - half)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5), max_size=25))
def test_best_region(scores):
    low, high = M.best_region(scores)
    every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert abs(sum(scores[low:high]) - max([0, *every])) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.text("<>/&;\"'= abp!-", max_size=60))
def test_any_markup(page):
    M.main_text(page, {})
    M.count_labels(page)


def test_boxes_within_the_article():
    page = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><main><h1>Title &amp; x</h1><p>Para one with   words<br>line two <a href="x">link</a> more.</p>
    <aside>side bar words</aside><form>name <input></form><p>Last para 1 &lt; 2 here</p><div id="comments"><p>great post! really great</p></div></main><footer>f</footer><script>if (a<b) {"</p>"}</script></body></html>"""
    assert M.main_text(page, {}) == "Title & x\nPara one with words\nline two link more.\nLast para 1 < 2 here"


@pytest.mark.parametrize("page, want", [("", ""), ("just plain text", "just plain text"), ('<p>unclosed <b>x "y <a href="', 'unclosed x "y'), ("<!-- never closed <p>a</p>", ""), ("<script>x", ""), ("<p>a&nbsp;&#98;&am</p>", "a b&am")])
def test_broken_pages(page, want):
    assert M.main_text(page, {}) == want


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "<p>some words here</p>", "t"), (2, "<p>some words here</p>", "t")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in M.extract_text(df).collect()) == [(1, "", 0), (2, "some words here", 15), (2, "some words here", 15)]
    assert M.extract_text(df.limit(0)).count() == 0


LONG = "The paragraph goes on at some length about its matter, one clause after another, with words enough that nobody takes it for a button or a notice at the edge of a page."


@pytest.fixture(scope="module")
def learned(spark):
    return M.learn(spark.read.parquet(f"{SMALL}/pages.parquet"))


@pytest.mark.parametrize("opened", ['section class="legal"', 'div class="tags-of-war"', 'div id="related-work"', 'div class="search algorithms"', "dialog open", "footer", 'div class="share"'])
def test_long_prose_stays_in_doubtful_boxes(learned, opened):
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>Head line</h1><p>{LONG}</p><{opened}><p>{LONG}</p></{opened.split()[0]}><p>Last words here.</p></article><footer>imprint</footer></body></html>"
    for weights in ({}, learned):
        assert M.main_text(page, weights) == f"Head line\n{LONG}\n{LONG}\nLast words here."


@pytest.mark.parametrize("opened", ['div class="comments"', 'div id="comment-list"', 'aside class="x"', 'div class="ad"', "nav", 'div class="cookie-notice"', "form", "div hidden", "dialog", 'div role="navigation"', 'div class="share"'])
def test_other_matter_goes(learned, opened):
    other = "A word on this" if "share" in opened else LONG
    page = f"<html><body><article><h1>Head line</h1><p>{LONG}</p><{opened}><p>{other}</p></{opened.split()[0]}><p>Last words here.</p></article></body></html>"
    for weights in ({}, learned):
        assert M.main_text(page, weights) == f"Head line\n{LONG}\nLast words here."


def test_main_elements_in_comments_and_scripts_do_not_count():
    page = f"<html><body><!-- <main> --><script>'<article>'</script><article><h1>Head line</h1><p>{LONG}</p></article><p>after</p></body></html>"
    assert M.main_text(page, {}) == f"Head line\n{LONG}"


def test_weights_of_classes_come_from_the_labelled_pages(spark):
    """A class that no list names: out of the article on labelled pages, and so on pages without a label."""
    page = lambda i: f"<body><div class='zork'><p>{LONG} {i}</p></div><article>{3 * f'<p>{LONG}</p>'}<div class='legal'><p>short but in</p></div></article></body>"
    weights = M.learn(spark.createDataFrame([(i, page(i)) for i in range(30)], "page_id long, html string"))
    assert weights["class:zork"] < -1 and weights["class:legal"] > 1
    assert M.main_text(f"<body><p>{LONG}</p><div class='zork'><p>{LONG}</p></div><div class='legal'><p>short but in</p></div><p>{LONG}</p></body>", weights) == f"{LONG}\nshort but in\n{LONG}"
