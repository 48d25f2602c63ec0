"""Attributes that only look like hidden or unwanted parts of a page."""

import pytest

from tidemark.llm import html_extract


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article class='overflow-hidden'><p>Seen.</p></article>", "Seen."), ("<article><p aria-hidden='false'>Seen.</p></article>", "Seen."),
        ("<article><h2 id='hidden-costs'>Costs</h2><p>Seen.</p></article>", "Costs\nSeen."), ("<article><p title='a hidden gem'>Seen.</p></article>", "Seen."),
        ("<article><p>a</p><h2 id='related-work'>Work</h2><p>b</p></article>", "a\nWork\nb"), ("<article><p>a</p><section id='social-history'><p>b</p></section></article>", "a\nb"),
        ("<article><p>a</p><p hidden>No.</p><p hidden=''>No.</p><p HIDDEN=until-found>No.</p></article>", "a"), ("<article><p>a</p><p aria-hidden='true'>No.</p></article>", "a"),
        ("<article><p>a</p><p style='color:red; display : none'>No.</p><p style='visibility:hidden'>No.</p></article>", "a"),
        ("<article><p>a</p><section id='comments'><p>A comment.</p></section><section id=related-posts><p>More to read.</p></section></article>", "a"),
    ],
)
def test_attributes(body, text):
    assert html_extract.extract(f"<html><body>{body}</body></html>") == text
