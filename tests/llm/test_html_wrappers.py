"""Class names that hint at furniture do not hide what wraps the main text."""

from __future__ import annotations

import pytest

from claimloom.llm.html_text import main_text

TEXT = "A long paragraph of the article, which tells what happened, where, and why it matters to those who read it."


@pytest.mark.parametrize("page", ["<div class='content-sidebar-wrap'><article><p>{}</p></article></div>", "<div class='has-sidebar'><main><p>{}</p></main></div>", "<div class='post comments-open'><p>{}</p></div>"])
def test_wrappers_stay(page):
    assert TEXT in main_text("<html><body>" + page.format(TEXT) + "<div class='sidebar'><p>links</p></div></body></html>")


def test_furniture_goes_and_formulas_stay():
    text = main_text(f"<body><div class='has-sidebar'><article><p>{TEXT}</p><p>{TEXT} <math><mi>xyz</mi></math></p></article><div class='sidebar'><p>links and more</p></div></div></body>")
    assert "links" not in text and "xyz" in text
