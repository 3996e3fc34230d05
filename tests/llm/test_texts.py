"""License scans, quality rules, language ID and the classifier on the fixture table."""

from __future__ import annotations

import re

import numpy as np
import pytest

from claimloom.llm import html_text, language, license_rules, licenses, quality, rules

from .fixtures import prose, rows, table


def test_license_scan_agrees_with_brute_force(spark):
    signatures = [(r, re.compile(r["pattern"])) for r in license_rules.rules()]
    assert 200 < len(signatures) < 600
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [r[1] for r in rows()] + ["see cc by-nc, CC BY NC 4.0; under the MIT license", "gnu general public license v3 under the terms of the GNU Lesser General Public License version 2.1", "under the mit license under the mit license", "écc by nc"]
    data = [(i, t, None, None, 0, 0.0, "") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, data), ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        w = word.findall((text or "").translate(low))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        joined = " " + " ".join(w) + " "
        found = [(m.start(), m.end(), r) for r, p in signatures for m in p.finditer(joined)]
        rank = lambda f: (f[2]["priority"], f[1] - f[0], -f[2]["nth"])
        kept = [f for f in found if not any(o[0] <= f[0] and o[1] >= f[1] and rank(o) > rank(f) for o in found)]
        base = {label for _, label in places}
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | {f[2]["label"] for f in kept}))
        assert 0 <= r["score"] <= 1


def test_empty_tables(spark):
    empty = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert licenses.scan(empty, ["doc_id"]).collect() == []
    assert rules.with_rules(empty, rules.fit_rules(empty, labels), ["doc_id"]).collect() == []
    from pyspark.sql import functions as F

    assert language.with_language(empty, language.fit_languages(empty, F.lit(True)), ["doc_id"]).collect() == []
    assert quality.with_quality(empty, quality.fit_quality(empty, labels, F.lit(True)), ["doc_id"]).collect() == []


def brute_repeats(words: list[str]) -> int:
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_rule_statistics_agree_with_brute_force():
    texts = [None, "", "a", "a b c a b c", "a b c d a b c e\na b c", "x x x x x", "# * $ % & | < >\n\n \t\n# *", "é é é é"] + [prose("en", n, n)[:400] for n in (5, 40, 90)]
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), brute_repeats(words))
        assert rules.statistics(text)[0] == want, text


def test_isolation_forest_matches_path_by_path():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(size=(300, 4)), rng.normal(6, 1, size=(6, 4))])
    forest = rules.IsolationForest(data, trees=20, tree_rows=64)

    def path(row, root):
        at = root
        while forest.feature[at] >= 0:
            at = forest.left[at] + (row[forest.feature[at]] >= forest.cut[at])
        return forest.path[at]

    slow = [2 ** (-np.mean([path(r, root) for root in forest.roots]) / rules._expected(64)) for r in data]
    assert np.allclose(forest.score(data), slow)
    assert forest.score(data)[300:].mean() > forest.score(data)[:300].mean() + 0.1


def test_quality_rules_query_rows(spark):
    data = [*rows(), *[(500 + i, prose("en", 70, i).upper().replace(" ", "!! "), "en", "s", 0, 0.0, "") for i in range(12)]]
    docs = table(spark, data)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(500, 512)]], "doc_id long, quality int, toxic int")
    got = rules.with_rules(docs, rules.fit_rules(docs, labels), ["doc_id", "score"]).collect()
    assert len(got) == len(data)
    assert got[0].__fields__.count("score") == 1
    model = rules.fit_rules(docs, labels)
    assert model.threshold < 1
    texts = {(r[0], r[1]) for r in data}
    plain = {}
    for doc_id, text in texts:
        base, features = rules.statistics(text)
        paths = []
        for root in model.forest.roots:
            at = root
            while model.forest.feature[at] >= 0:
                at = model.forest.left[at] + (features[model.forest.feature[at]] >= model.forest.cut[at])
            paths.append(model.forest.path[at])
        anomaly = 2 ** (-np.mean(paths) / rules._expected(model.forest.rows))
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        plain.setdefault(doc_id, set()).add((*base, failed, not failed and not anomaly > model.threshold + 1e-12))
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) in plain[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_suffix_automaton_finds_all_substrings():
    text = [1, 2, 1, 1, 3, 2, 1]
    a = language.SuffixAutomaton(text, 5)
    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for n in range(1, 4):
        for code in range(5**n):
            word = tuple(code // 5**k % 5 for k in range(n))
            state = 0
            for s in word:
                to, new = a.step(np.array([state]), np.array([s]))
                state = int(to[0]) if state >= 0 and not (new[0] and state) and to[0] else -1
            assert (state >= 0) == (word in inside)


def slow_phrases(sample: str, text: str) -> int:
    n = at = 0
    while at < len(text):
        length = 1
        while at + length < len(text) and text[at : at + length + 1] in sample:
            length += 1
        at, n = at + length, n + 1
    return n


def test_phrases_are_the_longest_matches():
    samples = {k: [prose(k, 200, 1)] for k in ("en", "fr")}
    model = language.LanguageModel(samples)
    clean = lambda t: "".join(map(chr, language.letters_only(t)))
    for text in ("the and that", prose("fr", 40, 7), "zzz qqq", "a", "Ωmega the"):
        got = model.phrases([language.letters_only(text)])[0]
        assert got.tolist() == [slow_phrases(clean(samples[k][0]) + " ", clean(text)) for k in model.languages], text


def test_texts_longer_than_a_block_are_parsed_whole(monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 64)
    samples = {"en": [prose("en", 60, 1)], "zz": ["abab" * 30]}
    model = language.LanguageModel(samples)
    clean = lambda t: "".join(map(chr, language.letters_only(t)))
    texts = [prose("en", 90, 2), "ab" * 200, "abc" * 70 + "ba" * 90, clean(samples["en"][0])[:300] * 2, "Ω" * 150, prose("fr", 100, 3), "b", clean(samples["zz"][0]) * 3]
    got = model.phrases([language.letters_only(t) for t in texts])
    for text, row in zip(texts, got.tolist(), strict=True):
        assert row == [slow_phrases(clean(samples[k][0]) + " ", clean(text)) for k in model.languages], text


def test_large_alphabets_keep_every_letter():
    rng = np.random.default_rng(4)
    spans = {"ja": (0x3041, 0x3096), "ko": (0xAC00, 0xD7A3), "zh": (0x4E00, 0x9FFF), "ru": (0x430, 0x44F), "el": (0x3B1, 0x3C9)}
    words = {k: ["".join(map(chr, rng.integers(*span, 3))) for _ in range(1500)] for k, span in spans.items()}
    words["yue"] = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3))) for _ in range(1500)]
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    model = language.LanguageModel({k: [text(k, 4000)] for k in words})
    assert len(model.points) > 8000
    labels, scores = model.predict([text(k, 60) for k in model.languages])
    assert labels == model.languages and min(scores) > 0.5


def test_results_replace_kept_columns_of_their_name(spark):
    from pyspark.sql import functions as F

    docs = table(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert language.with_language(docs, language.fit_languages(docs, F.lit(True)), ["doc_id", "score", "lang_pred"]).columns == ["doc_id", "lang_pred", "score"]
    assert quality.with_quality(docs, quality.fit_quality(docs, labels, F.lit(True)), ["score", "doc_id"]).columns == ["doc_id", "score", "predicted"]
    assert rules.with_rules(docs, rules.fit_rules(docs, labels), ["doc_id", "kept"]).columns.count("kept") == 1


def test_an_id_that_repeats_costs_one_row(spark):
    from pyspark.sql import functions as F

    from claimloom.llm.common import smallest_hashes, taken_whole

    ids = spark.range(500).selectExpr("id AS doc_id", "cast(id % 2 AS string) AS lang").unionAll(spark.range(10000).selectExpr("cast(7 AS bigint)", "'1'"))
    got = smallest_hashes(ids, 50, "lang")
    assert len(got) == 100 and len({g[:2] for g in got}) == 100
    order = [r[0] for r in spark.range(500).orderBy(F.xxhash64("id"), "id").collect()]
    assert [g[0] for g in sorted(smallest_hashes(ids.select("doc_id"), 80), key=lambda g: g[1])] == order[:80]
    docs = table(spark, [(7, prose("en", 60, i % 3), "en", "s", 0, 0.0, "") for i in range(10000)])
    model = language.fit_languages(docs, F.lit(True))
    assert model.bits == [np.log2(len(language.letters_only(min(prose("en", 60, i) for i in range(3)))) + 1)]
    assert taken_whole([(0, 5, "a"), (1, 50, "b"), (2, 4, "c"), (3, 2, "d")], 10) == ["a", "c"]
    assert taken_whole([(0, 50, "a"), (1, 40, "b")], 10) == ["a"]


def test_language_id_rows(spark):
    from pyspark.sql import functions as F

    docs = table(spark)
    model = language.fit_languages(docs, F.lit(True))
    got = language.with_language(docs, model, ["doc_id", "lang"]).collect()
    assert len(got) == len(rows())
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == by_id[i]["lang"] for i in range(60))
    assert by_id[100]["lang_pred"] == by_id[101]["lang_pred"] == by_id[102]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_attention_gradients_match_differences():
    rng = np.random.default_rng(3)
    model = quality.AttentionModel()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, first, y = rng.random((9, quality.FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.where(y == 1, np.log(p := model._forward(x, first)["p"]), np.log(1 - p)))
    grads = model.gradients(x, first, y)
    for name in model.w:
        flat = model.w[name].reshape(-1)
        for at in {0, len(flat) // 2, len(flat) - 1}:
            keep, step = flat[at], 1e-6
            flat[at] = keep + step
            up = loss()
            flat[at] = keep - step
            down = loss()
            flat[at] = keep
            assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-8), (name, at)


def plain_score(model: quality.AttentionModel, text: str | None) -> float:
    """One document at a time, passage by passage, from the definition."""
    w = model.w
    lines, seen, words = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.split()], set(), []
    for line in lines:
        words += [(x, line in seen) for x in line.split()]
        seen.add(line)
    vectors, weights = [], []
    for at in range(0, max(1, len(words)), quality.PASSAGE):
        part = words[at : at + quality.PASSAGE]
        x = np.zeros(quality.FEATURES)
        if part:
            joined = b"".join(p for p, _ in part)
            for byte in joined:
                x[byte] += 1 / len(joined)
            x[:256] **= 0.5
            x[256:] = min(2.0, len(joined) / len(part) / 10), len({p for p, _ in part}) / len(part), sum(r for _, r in part) / len(part), len(part) / quality.PASSAGE
        h = np.tanh(x @ w["encode"] + w["encode_b"])
        vectors.append(h)
        weights.append(np.exp((np.tanh(h @ w["attend"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["weigh"]))
    z = sum(a * h for a, h in zip(weights, vectors, strict=True)) / sum(weights)
    return 1 / (1 + np.exp(-(z @ w["score"] + w["bias"][0])))


def test_classifier_scores_like_a_plain_version():
    model = quality.AttentionModel(seed=9)
    texts = [None, "", "one", prose("fr", 64, 1), prose("en", 65, 2), (prose("de", 9, 1) + "\n") * 40, prose("en", 3000, 3), "é " * 100, prose("en", 65, 2)]
    assert np.allclose(model.score(texts), [plain_score(model, t) for t in texts], atol=1e-5)


def test_classifier_fits_all_passages_of_few_whole_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    fitted = []
    monkeypatch.setattr(quality.AttentionModel, "fit", lambda self, bags, y, seed=0: fitted.append((bags, y)) or self)
    long = prose("en", 64 * 100, 4)
    data = [(i, long if i == 5 else prose("en", 70, i), "en", "s", 0, 0.0, "") for i in range(20)] + [(3, prose("en", 70, 3), "en", "s", 0, 0.0, "")] * 5000
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, 1, 0)] * 5000, "doc_id long, quality int, toxic int")
    quality.fit_quality(table(spark, data), labels, F.lit(True), most=1000)
    bags, y = fitted[0]
    assert sorted(map(len, bags)) == [2] * 19 + [100] and sum(y) == 10  # id 3 once, all passages of 5
    quality.fit_quality(table(spark, data), labels, F.lit(True), most=50)
    assert sorted(map(len, fitted[1][0])) == [2] * 19  # a row is taken whole or not at all


def test_classifier_learns_and_scores_every_row(spark):
    from pyspark.sql import functions as F

    data = [(i, prose("en", 80, i) if i % 4 else prose("en", 80, i).upper().replace(" ", "!! "), "en", "s", 0, 0.0, "") for i in range(200)] + [r for r in rows() if r[0] is None or r[0] >= 100]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = table(spark, data)
    got = quality.with_quality(docs, quality.fit_quality(docs, labels, F.col("doc_id") % 5 != 0), ["doc_id"]).collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] % 5 == 0]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.95


def test_html_cases(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class="sidebar">Side</div>
<article><h1>Head &amp; line</h1><p>First <b>para</b>graph, long enough to be text.<p>Second<br>one &copy; here.<script>x("</p>")</script><div id="comments">I disagree</div></article>
<form>Mail <input></form><footer>Foot</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\nFirst paragraph, long enough to be text.\nSecond one © here."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    parts = '<title>T</title><div style="display: none">no</div><div class="c"><div><p>' + "long words here " * 40 + "</p></div><div><p>" + "short part " * 9 + "</p></div></div><div id='cookie-notice'>We use</div>"
    assert html_text.main_text(parts) == ("long words here " * 40).strip() + "\n" + ("short part " * 9).strip()
    assert html_text.main_text("plain  text &lt;b&gt;") == "plain text <b>"
    data = [(1, "u", page, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<p>" + "word " * 50000, "x"), (1, "u", page, "x")]
    got = html_text.with_main_text(spark.createDataFrame(data, "page_id long, url string, html string, text string"), ["page_id", "url"]).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(r["n_chars"] for r in got) == 249999
