"""Missing end tags and self-closed elements cost no text."""

from __future__ import annotations

import pytest
from tallyfield.llm import html_text

BODY = "<body><p>The article stands here.</p><div>And here.</div></body>"
WANT = ["The article stands here.", "And here."]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=utf-8><script>var a = '<div>x</div>';</script>" + BODY,
        "<head><link rel=x href=y>" + BODY.replace("<body>", "").replace("</body>", ""),
        "<head><title>T</title>\n<style>p {}</style></head>" + BODY,
        "<head><script>var a = '<body>';</script><div>odd</div></head>" + BODY,
        "<head><script src=x /><title>T</title></head>" + BODY,
        "<svg viewBox='0 0 1 1'/>" + BODY,
        "<iframe src='x' />" + BODY,
        "<svg><path/></svg><iframe src=x>no frames</iframe>" + BODY,
    ],
)
def test_article_is_kept(page):
    assert [b.text for b in html_text.blocks(page)] == WANT
