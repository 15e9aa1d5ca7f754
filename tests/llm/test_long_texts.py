"""Long texts that once took time in the square of their length."""

import time

import pytest

from tidemark.llm import html_text as H, personal_data as P

LENGTH = 300_000


def seconds(work, *given):
    start = time.process_time()
    work(*given)
    return time.process_time() - start


def lines(html):
    page = H.Lines()
    page.feed(html)
    page.close()
    return page.lines


@pytest.mark.parametrize("part", ["http://", "http://a/", "mailto:", "+1 ", "1.", "4-", "a@", "account "])
def test_personal_data(part):
    assert seconds(P.spans, part * (LENGTH // len(part))) < 20


def test_every_scheme_of_a_run_is_tried():
    assert P.spans("http://http://a.b)") == [("url", 7, 17)]
    assert P.spans("http://x,http://a.b/c.") == [("url", 9, 21)]


@pytest.mark.parametrize(("opened", "closed"), [("<b>", "<i>x</u>"), ("<b>", "<br>line\n"), ("<a>", "x</b>"), ("<div><b>", "x</u>")])
def test_unclosed_tags(opened, closed):
    n = LENGTH // len(opened + closed)
    assert seconds(lines, opened * n + closed * n) < 20


def test_inline_end_tags_stay_in_their_block():
    found = lines("<div><a href=x>link text<p>inside</a> too</p></div><p>after</p>")
    assert [(x.text, x.linked) for x in found] == [("link text", 9), ("inside too", 9), ("after", 0)]
