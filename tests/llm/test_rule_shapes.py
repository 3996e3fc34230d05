"""Further statistics of texts against a plain version, and the threshold's calibration."""

from __future__ import annotations

import math
import statistics as plain
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from claimloom.llm import rules

from .fixtures import prose


def slow_shape(text: str) -> list[float]:
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    if not words:
        return [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    n, closing = len(words), b".!?,;:"
    spread = lambda x: plain.pstdev(x) / plain.mean(x)
    letters = lambda w: all(c > 126 or c < 33 or chr(c).isalpha() or chr(c) == "'" for c in w)
    pure = sum(letters(w[:-1] if w[-1] in closing else w) for w in words)
    return [len(zlib.compress(raw, 1)) / len(raw), pure / n, math.log(1 + len(set(words))) / math.log(1 + n), spread([len(x) for x in lines]), spread([len(w) for w in words]), sum(w[-1] in closing for w in words) / n, sum(len(w) == 1 for w in words) / n]


@given(st.lists(st.sampled_from(["a", "word", "it's", "x1", "%%%", "|", "end.", "é", "ça,", "\n", "\n\n", "\t", "\x0b", "\r", ".", "!?", "\x7f", "\x00"]), max_size=40).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_shapes(text):
    assert rules.statistics(text)[1][10:] == pytest.approx(slow_shape(text))


def test_nothing_and_spaces():
    for text in (None, "", " \n\t ", "a"):
        assert len(rules.statistics(text)[1]) == len(rules.FEATURES) and np.isfinite(rules.statistics(text)[1]).all()


def test_rows_that_fail_a_rule_do_not_raise_the_threshold(spark):
    good = [(i, prose("en", 80, i), 1) for i in range(300)] + [(300 + i, "!!! ### " + prose("en", 3, i), 1) for i in range(40)]  # too short: they fail anyway
    bad = [(400 + i, " ".join(w + "%%%" for w in prose("en", 80, i).split()), 0) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rules.with_rules(docs, rules.fit_rules(docs, labels), ["doc_id"]).collect()}
    assert sum(got[i]["kept"] for i, *_ in bad) <= 15  # with the short rows in the calibration nothing is rejected
    assert sum(got[i]["kept"] for i in range(300)) >= 298 and all(got[i]["base_failed"] for i in range(300, 340))
