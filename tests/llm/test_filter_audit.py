"""The filter audit against a plain walk through all orders, document by document."""

from __future__ import annotations

import itertools
import re
from collections import Counter

from claimloom.llm import filter_audit

from .fixtures import prose, rows, table

LABELS = "doc_id long, quality int, toxic int, n int, good boolean, part string"


def failures(docs: list[tuple]) -> list[set]:
    least: dict[str, int] = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, *_ in docs:
        text, found = text or "", set()
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found |= {"A"} if len(words) < 100 else set()
        found |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        found |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        found |= {"D"} if re.search("[#$%&*|]", text) else set()
        out.append(found | ({"E"} if doc_id is not None and doc_id > least[text] else set()))
    return out


def audited(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out, failed = [], failures(docs)
    for part in {d[2] or "" for d in docs}:
        mine = [(d[0], f) for d, f in zip(docs, failed, strict=True) if (d[2] or "") == part]
        shapley, steps = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in alive if letter in f]
                alive = [(i, f) for i, f in alive if letter not in f]
                shapley[letter] += len(gone)
                before = sum(letter in f and bool(f & set(order[: step - 1])) for _, f in mine)
                steps.append((order, step, letter, len(alive), len(gone), before, sum(f == {letter} for _, f in mine), sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None)))
        out += [(part, o, s, *rest, shapley[letter]) for o, s, letter, *rest in steps]
    return set(out)


def audit(spark, docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    marked = spark.createDataFrame([(*x, 7, True, "x") for x in labels], LABELS)
    return [tuple(r) for r in filter_audit.orders(filter_audit.cells(table(spark, [(*d, 0.5, "clash") for d in docs]), marked)).collect()]


def test_against_all_orders(spark):
    docs = [r[:5] for r in rows()]
    docs += [(1000 + i, docs[i % 7][1], docs[i][2], "s", 0) for i in range(30)]  # copies in other parts
    docs += [(2000, "ABC DEF GHI", "en", "s", 11), (2001, "a $ b", "en", "s", 5), (2002, prose("en", 150, 3) + " #", "", "s", 0), (2003, " ".join(f"w{i}" for i in range(120)), "en", "s", 0), (None, "a $ b", "en", "s", 5)]
    docs += [(2004, " word word É", "de", "s", 3), (-5, "a $ b", "fr", "s", 5), (-5, "a $ b", "fr", "s", 5)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 2005, 3)] + [(3, None, 1), (3, 1, 0), (None, 1, 1), (9, 0, 0), (-5, 1, 1)]
    got = audit(spark, docs, labels)
    assert len(got) == len(set(got)) == 600 * len({d[2] or "" for d in docs})
    assert set(got) == audited(docs, labels)


def test_one_text_in_a_third_of_all_rows(spark):
    docs = [(i, "" if i % 3 == 0 else f"text {i}", ("en", "fr", None)[i % 2], "s", 0) for i in range(900)]
    assert set(audit(spark, docs, [])) == audited(docs, [])


def test_empty_tables(spark):
    assert audit(spark, [], [(1, 1, 1)]) == []
    assert len(audit(spark, [(1, None, None, None, 0)], [])) == 600
