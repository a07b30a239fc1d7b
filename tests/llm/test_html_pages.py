"""Broken markup, repeated rows and wrapped pages."""

import time

import pytest

from detlake.llm import html_templates as H


@pytest.mark.parametrize(
    "page",
    ['<a "' * 250_000, "<script " * 130_000, "<a x=\"'" * 150_000 + ">", "<" * 1_000_000, "<!--" * 250_000, "<a " * 300_000 + ">", "<form>" * 150_000,
     "<p class='" * 100_000, "<div>" * 200_000 + "x" + "</div>" * 200_000, "</section>" * 100_000 + "<div>" * 100_000, '<article title="' + "y > " * 200_000],
)
def test_a_megabyte_of_broken_markup_takes_no_time(page):
    began = time.process_time()
    H.occurrences(page[:1_000_000])
    assert time.process_time() - began < 3


def test_what_never_ends():
    assert H.main_text("a <b", None) == "a <b"
    assert H.main_text('<p>one</p><a title="two>three</a><p>four</p>', None) == "one\nthree\nfour"
    assert H.main_text("x < y and <3 <p>z", None) == "x < y and <3\nz"
    assert H.main_text("one<script>two", None) == "one"
    assert H.main_text("one<!-- two --><style>p {}</STYLE >three", None) == "onethree"


def test_a_form_round_the_article_is_no_form_of_the_page():
    page = "<body><form><div>menu</div><article><p>One.</p></article></form><form><p>Search</p></form></body>"
    assert H.main_text(page, None) == "One."
    assert H.main_text("<body><p>Text.</p><form><p>Search</p></form></body>", None) == "Text."


def site(times):
    pages = [("http://h/%d" % i, "<body><div class=wrap><div class=lead><p>Lead number %d of all.</p></div>%s</div></body>" % (i, "".join(f"<div class=row><p>Row {j} of page {i} with words.</p></div>" for j in range(1 + i % 3)))) for i in range(6)]
    return [(i, *p) for i, p in enumerate(pages * times)]


@pytest.mark.parametrize("times", [1, 2, 3, 4])
def test_repeated_rows_keep_their_text(spark, times):
    rows = site(times)
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    want = {u: "\n".join([f"Lead number {i} of all.", *(f"Row {j} of page {i} with words." for j in range(1 + i % 3))]) for i, u, _ in rows[:6]}
    assert all(r.text == want[r.url] for r in out)
