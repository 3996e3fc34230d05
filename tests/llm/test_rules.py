"""Shares of capitals in every script."""

from __future__ import annotations

import pytest

from claimloom.llm import rules


@pytest.mark.parametrize("text", ["КУПИТЕ СЕЙЧАС", "ΑΓΟΡΑΣΤΕ ΤΩΡΑ", "Été ÉTÉ à l'ombre", "plain Text", "A" * 19 + "É" + "a" * 80, "\ud800X", ""])
def test_capitals_of_every_script(text):
    letters = [x for x in text if not x.isspace()]
    assert rules.statistics(text)[1][0] == pytest.approx(sum(x.isupper() for x in letters) / max(1, len(letters)))


def test_every_labelled_row_counts_for_the_threshold(spark):
    """Rows beyond the sample decide: with them, the least threshold that keeps enough good rows is another."""
    import numpy as np

    from claimloom.llm import rules

    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), size=5))
    text = lambda junk: " ".join((word() + ("#|!9" * 3 if junk else "")) for _ in range(80))
    docs = spark.createDataFrame([(n, text(n % 10 == 0)) for n in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n % 10 > 0)) for n in range(120)], "doc_id long, quality int")
    model = rules.fit_rules(docs, labels, 40)
    judged = {r["doc_id"]: r for r in rules.with_rules(docs, model, ["doc_id"]).collect()}
    good = [r["anomaly"] for n, r in judged.items() if n % 10 and not r["base_failed"]]
    assert len(good) == 108 and model.threshold >= np.sort(good)[-1] - 1 / rules.STEPS and model.threshold < 1
    assert all(r["kept"] for n, r in judged.items() if n % 10)


def test_best_threshold_keeps_the_good():
    import numpy as np

    from claimloom.llm import rules

    scores = np.array([0.1, 0.2, 0.3, 0.4])
    assert rules.best_threshold(scores, np.array([100, 100, 0, 0]), np.array([0, 1, 5, 5])) == 0.2
    assert rules.best_threshold(scores, np.array([100, 100, 2, 0]), np.array([0, 1, 5, 5])) == 0.3
    assert rules.best_threshold(scores, np.array([1, 0, 0, 0]), np.zeros(4)) == float("inf")
