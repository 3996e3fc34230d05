"""Quotes of every length are found."""

from __future__ import annotations

from claimloom import catalog

from .compare import difference, duck


def test_short_and_partial_quotes(spark, tmp_path):
    d = str(tmp_path)
    quotes = ["lanterns", "amber lanterns", "amber lanterns glow", "old amber lanterns glow", "the old amber lanterns glow here", "glow", ""]
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    docs = ["see the old amber lanterns glow here at night", "bold amber lanterns glowing", "lanterns", "", "camber lanternsmith"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    found = catalog.queries()["quote_found"](spark, d)
    assert sorted(map(tuple, found.collect())) == sorted((n, m) for n, t in enumerate(docs) for m, q in enumerate(quotes) if len(q) >= 6 and q in t)
    assert difference(found, duck(d), catalog.oracle_sql()["quote_found"]) == ""


def test_quotes_are_found_with_and_without_first_words(spark, tmp_path, monkeypatch):
    from claimloom import catalog
    from claimloom.operators import ingest

    d = str(tmp_path)
    quotes = [(0, "amber lanterns glow over quiet harbours"), (1, "velvet curtain falls"), (2, "copper turbine"), (3, "no such words stand here")]
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = [(0, "All amber lanterns glow over quiet harbours now. Velvet curtain falls."), (1, "a copper turbine, velvet curtain"), (2, None), (3, "curtain")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    found = lambda: {tuple(r) for r in catalog.queries()["quote_found"](spark, d).collect()}
    want = {(0, 0), (0, 1), (1, 2)}
    assert found() == want
    monkeypatch.setattr(ingest, "FIRST_WORDS", 0)
    assert found() == want


def _common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _partial(quote: str, text: str) -> bool:
    """A partial ratio of 90 percent at least, window by window."""

    def one(a: str, b: str) -> bool:
        windows = [b[i : i + len(a)] for i in range(len(b) - len(a) + 1)] + [w for i in range(1, len(a)) for w in (b[:i], b[len(b) - i :])]
        return any(20 * _common(a, w) >= 9 * (len(a) + len(w)) for w in windows)

    return len(quote) <= len(text) and (one(quote, text) or (len(quote) == len(text) and one(text, quote)))


def test_altered_quotes_are_found_as_a_partial_ratio_finds_them(spark, tmp_path):
    quote = "amber lanterns glow over quiet harbours while old ferries cross the bay"
    altered = [quote.replace("glow", "glew"), quote.replace(" quiet", ""), quote.replace("old", "cold grey"), quote.replace("e", "o"), quote.replace("o", ""), quote[6:], quote[:-6], quote[20:]]
    docs = [pad.format(t) for t in altered for pad in ("{}", "they say {} every night of the long winter", "{} and nothing else was seen that night at all")] + [None, ""]
    quotes = [quote, "old ferry", "no such words stand here at all", "glew", altered[0]]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    found = catalog.queries()["quote_found"](spark, d)
    want = sorted((n, m) for n, t in enumerate(docs) for m, q in enumerate(quotes) if len(q) >= 6 and _partial(q, t or ""))
    assert sorted(map(tuple, found.collect())) == want
    assert any(quotes[m] not in docs[n] for n, m in want)
    assert difference(found, duck(d), catalog.oracle_sql()["quote_found"]) == ""


def test_no_window_is_lost_however_a_text_is_cut(monkeypatch):
    import random

    import pyarrow as pa

    from claimloom.operators import quotes as Q

    r = random.Random(7)
    for _ in range(400):
        letters = r.choice(["ab", "abcdefgh "])
        made = ["".join(r.choice(letters) for _ in range(r.choice([6, 7, 10, 11, 15, 20, 31]))) for _ in range(3)]
        body = list(r.choice(made))
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(body))
            body[at : at + r.randint(0, 1)] = r.choice(["", r.choice(letters)])
        text = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 9]))) + "".join(body) + "".join(r.choice(letters) for _ in range(r.choice([0, 1, 9])))
        monkeypatch.setattr(Q, "CHARACTERS", r.choice([7, 1 << 16]))
        monkeypatch.setattr(Q, "HITS", r.choice([3, 1 << 20]))
        got = Q.Quotes(pa.table({"item_id": [0, 1, 2], "q": made})).found(text)
        assert got == [i for i, q in enumerate(made) if q not in text and _partial(q, text)]
