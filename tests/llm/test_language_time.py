"""Parses of long texts take time in proportion to their length, whether blocks' parses meet or not."""

from __future__ import annotations

import time

import pytest

from claimloom.llm import language

from .fixtures import prose


@pytest.mark.parametrize("unit", [prose("en", 400, 11) + " ", "ab", "abb ", "Ω"])
def test_long_texts_take_linear_time(unit):
    model = language.LanguageModel({"en": [prose("en", 3000, 1)], "zz": ["ab" * 333 + " " + "abb " * 55]})
    took = []
    for n in (2_000_000, 4_000_000, 8_000_000):
        text = (unit * (n // len(unit) + 1))[:n]
        began = time.process_time()
        model.predict([text])
        took.append(time.process_time() - began)
    assert took[2] < 2.5 * took[1] + 0.5 and took[2] < 60, took


def test_carried_parses_that_meet_late(monkeypatch):
    """The same counts whatever the blocks."""
    model = language.LanguageModel({"zz": ["ab" * 333 + " " + "abb " * 55], "yy": ["a" * 50 + "b" * 70]})
    texts = [language.letters_only(t) for t in ("ab" * 5000, "ab" * 700 + "b" + "abb " * 900, "a" * 3000 + "b" * 3000, "abb " * 2000 + "xyz" + "ab" * 1000)]
    whole = []
    for block in (1 << 20, 2048, 100, 37):
        monkeypatch.setattr(language, "BLOCK", block)
        whole.append(model.phrases(texts).tolist())
    assert all(w == whole[0] for w in whole)
