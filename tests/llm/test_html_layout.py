"""Layout around the article that bears the name of what it lays out."""

import pytest

from tidemark.llm.html_text import main_text

LONG = "A sentence of the article that is long enough to be taken for prose by its ratio of characters to tags."
MENU = '<div class="sidebar"><a href="x">menu</a></div>'


@pytest.mark.parametrize(
    "html",
    [
        f'<div class="page no-sidebar"><article><p>{LONG}</p></article></div>',
        f'<div class="with-sidebar"><p>{LONG}</p></div>',
        f'<div class="share-enabled">{MENU}<article><p>{LONG}</p></article></div>',
        f'<form><nav>menu</nav><main><p>{LONG}</p></main></form>',
        f'<form><article><p>{LONG}</p></article><div class="related"><article>{LONG * 2}</article></div></form>',
        f'<article><p>{LONG}</p></article><div class="comments"><article>{LONG * 2}</article></div>',
        f'<div><p>{LONG}</p></div><div class="related"><article><p>Teaser</p></article></div>',
        f'<article><p>{LONG}</p><form>Your name</form><div class="share">Share</div></article>',
        f'<div hidden class="share-enabled"><article>{LONG * 2}</article></div><p>{LONG}</p>',
    ],
)
def test_layout(html):
    assert main_text(f"<html><body>{html}</body></html>") == LONG
