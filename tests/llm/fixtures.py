"""A small table with the cases that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, fp string, root int, kept boolean, lang_pred string"
WORDS = {"en": "the and that with have this from they would there their what about which when make like time just know".split(), "fr": "les des une que dans pour pas sur avec tout plus par mais nous comme fait être après très où".split(), "de": "und die der nicht sich auch auf für eine sind wird über schön größe müssen können haben wir ihr groß".split()}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang}{n}{seed}")
    return "".join(rng.choice(WORDS[lang]) + (".\n" if rng.random() < 0.08 else " ") for _ in range(n)).strip()


def rows() -> list[tuple]:
    out = []
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        out.append((i, prose(lang, 60 + i, i), lang, f"src{i % 4}"))
    out += [(100, None, None, None), (101, "", "en", "src0"), (102, "!!! ### 123", "fr", "src1"), (103, "one", None, "src2"), (None, prose("en", 80, 900), "en", "src3"), (None, None, None, "src3")]
    out += [(104, prose("en", 30000, 5), "en", "src0"), (105, "x" * 50000, None, "src0"), (106, "  two\t\twords \r\n", None, "src9")]
    out += [out[3], out[3], (200, out[5][1], "de", "src2"), (201, out[5][1], "de", "src1")]  # repeated rows; copies
    out += [(300, "Released under the MIT License. " * 3 + out[1][1], "en", "src1"), (301, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "en", None)]
    return [(a, t, lang, s, len(t or ""), 0.5, "clash", "f", 1, False, "x") for a, t, lang, s in out]


def table(spark, data: list[tuple] | None = None):
    extra = ("f", 1, False, "x")
    return spark.createDataFrame(rows() if data is None else [(*r, *extra)[:11] for r in data], DOCS)
