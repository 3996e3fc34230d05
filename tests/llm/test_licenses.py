"""The license rules: what each can match, the gates before it, and long texts."""

from __future__ import annotations

import itertools
import re
import time
from re import _parser as parser

import pytest

from claimloom.llm import license_rules, licenses

from .fixtures import table

RULES = license_rules.rules()
NAMES = ("expat", "freebsd", *(f"{a} attribution{b}" for a, b in itertools.product(("cc", "creative commons"), ("", "-noncommercial", " Non-Commercial 4.0", " share-alike", " sharealike", " no derivatives", " NonCommercial ShareAlike 4.0", " non commercial noderivs"))))
TEXTS = [form.format(name) for form in ("Licensed under {}", "released under the terms of the {} license", "{} license", "a work by me: {}", "SPDX-License-Identifier: {}", "plain {} here") for name in NAMES]


def spelled(parsed) -> list[str]:
    """Every text that a pattern of literals, classes, options and groups matches."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            some = [chr(value)]
        elif name == "IN":
            some = [chr(c) for k, v in value for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])]
        elif name == "SUBPATTERN":
            some = spelled(value[3])
        elif name == "BRANCH":
            some = [x for branch in value[1] for x in spelled(branch)]
        elif name == "MAX_REPEAT":
            assert value[:2] == (0, 1)
            some = ["", *spelled(value[2])]
        else:
            assert name in ("ASSERT", "AT"), name
            some = [""]
        out = [a + b for a in out for b in some]
    return out


EXAMPLES = [(r, text) for r in RULES for text in spelled(parser.parse(r["pattern"]))]


def brute(text: str) -> list:
    joined = " " + " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) + " "
    found = [(m.start(), m.end(), r) for r, p in PATTERNS for m in p.finditer(joined)]
    rank = lambda f: (f[2]["priority"], f[1] - f[0], -f[2]["nth"])
    return [f for f in found if not any(o[0] <= f[0] and o[1] >= f[1] and rank(o) > rank(f) for o in found)]


PATTERNS = [(r, re.compile(r["pattern"])) for r in RULES]


def test_rules_are_written_out_and_differ():
    assert 250 < len(RULES) < 600 and len({r["pattern"] for r in RULES}) == len(RULES)
    assert [r["priority"] for r in RULES] == sorted((r["priority"] for r in RULES), reverse=True)


def test_gates_are_necessary():
    """All that a rule can match holds its keyword and passes the prefilter; so do the base phrases."""
    low = [text for _, text in EXAMPLES] + [phrase for phrase, _ in licenses.BASE]
    for r, text in EXAMPLES:
        assert r["keyword"] in text, (r["keyword"], text)
    for text in low:
        assert any(s in text for s in license_rules.STEMS) or any(w.startswith(license_rules.BEGINNINGS) for w in text.split()), text


def test_every_rule_names_its_label(spark):
    texts = [f"x {text[0].upper()}{text[1:].replace(' ', '-')}; Y" for _, text in EXAMPLES if len(EXAMPLES) < 9000 or hash(text) % 3]
    by_rule: dict[int, str] = {}
    for (r, _), text in zip(EXAMPLES, texts, strict=True):
        by_rule.setdefault(r["nth"], text)
    some = list(by_rule.values()) + texts[:: max(1, len(texts) // 1500)]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, [(i, t, None, None, 0, 0.0, "") for i, t in enumerate(some)]), ["doc_id"]).collect()}
    base = dict(licenses.BASE)
    for i, text in enumerate(some):
        kept = brute(text)
        joined = " " + " ".join(re.findall("[a-z0-9]+", text.lower())) + " "
        always = {label for phrase, label in base.items() if f" {phrase} " in joined}
        assert got[i]["labels"] == ",".join(sorted({f[2]["label"] for f in kept} | always)), text
        assert got[i]["score"] == max([f[2]["confidence"] for f in kept] + [0.95] * bool(always))
        assert got[i]["labels"]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "gpl-2"),
        ("licensed under GPLv3", "gpl-3"),
        ("GPL-3.0-or-later", "gpl-3"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2-classpath"),
        ("It is MIT licensed.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
        ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa,cc-by-nc"),
        ("a limit on public access to success", ""),
    ],
)
def test_known_sentences(spark, text, labels):
    got = licenses.scan(table(spark, [(1, text, None, None, 0, 0.0, "")]), ["doc_id", "labels"]).collect()[0]
    assert got["labels"] == ",".join(sorted(labels.split(",")))


def test_spelled_out_names(spark):
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, [(i, t, None, None, 0, 0.0, "") for i, t in enumerate(TEXTS)]), ["doc_id"]).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i]["labels"] == ",".join(sorted({f[2]["label"] for f in brute(text)})), text
    assert got[TEXTS.index("Licensed under creative commons attribution-noncommercial")]["labels"] == "cc-by-nc"


def test_a_list_of_licenses_takes_linear_time(spark):
    frame = lambda n: table(spark, [(1, "GPLv3, MIT license; under the Apache License version 2.0! " * n, None, None, 0, 0.0, "")])
    took = []
    for n in (100, 30_000):
        began = time.time()
        got = licenses.scan(frame(n), ["doc_id"]).collect()[0]
        took.append(time.time() - began)
        assert got["labels"] == "apache-2,gpl-3,mit" and got["n_base"] == n and got["last_word"] == 10 * n - 6 + 1
    assert took[1] < 60
