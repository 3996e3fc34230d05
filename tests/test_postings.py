"""Cover density, block products and prefix matches against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from claimloom import catalog
from claimloom.operators import blocks, postings, search


def slow_density(places: list[list[int]]) -> float:
    """All intervals, those that hold every word, and of these the ones that hold no other."""
    every = sorted({p for own in places for p in own})
    held = [(a, b) for a in every for b in every if a <= b and all(any(a <= p <= b for p in own) for own in places)]
    minimal = [(a, b) for a, b in held if not any((c, e) != (a, b) and a <= c and e <= b for c, e in held)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p in every) - 1)) for a, b in minimal)


@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=6), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_density_is_that_of_all_minimal_intervals(places):
    lists = [sorted(own) for own in places]
    assert postings.density([np.array(own) for own in lists]) == pytest.approx(slow_density(lists))


def test_density_of_one_word_counts_its_places():
    assert postings.density([np.array([3, 9, 12])]) == pytest.approx(0.3)
    assert postings.density([np.array([3]), np.array([4])]) == pytest.approx(0.1)
    assert postings.density([np.array([3]), np.array([7])]) == pytest.approx(0.1 / 4)


@pytest.fixture
def tables(spark, tmp_path):
    def make(questions: list[str], claims: list[str | None]) -> str:
        d = str(tmp_path)
        spark.createDataFrame([(20 * (n + 1), 0, "user", q) for n, q in enumerate(questions)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
        spark.createDataFrame(list(enumerate(claims)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        return d

    return make


def test_near_words_lead(spark, tables):
    d = tables(["copper turbine", "the of and"], ["copper x x x x turbines", "copper turbines", "turbine", None, "", "copper the of turbine. copper"])
    got = [(r["claim_id"], r["matched"], r["density"]) for r in catalog.queries()["fts_cover_density"](spark, d).orderBy("rank").collect()]
    # stop words are places too; a question of nothing but them finds nothing
    assert got == [(5, 2, 0.133333), (1, 2, 0.1), (0, 2, 0.02), (2, 1, 0.1)]


def test_ties_beyond_the_last_place_are_ranked_by_density(spark, tables):
    far = ["copper y y y turbine"] * 25
    d = tables(["copper turbine"], [*far, "copper turbine copper"])
    got = [r["claim_id"] for r in catalog.queries()["fts_cover_density"](spark, d).orderBy("rank").collect()]
    assert got == [25, *range(19)]


def test_no_questions_and_no_claims(spark, tables, tmp_path):
    d = tables([], ["copper"])
    assert [catalog.queries()[n](spark, d).count() for n in ("fts_topk", "fts_cover_density", "trigram_topk")] == [0] * 3
    spark.createDataFrame([(20, 0, "user", None), (40, 0, "user", "copper")], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{d}/benchmark.parquet")
    assert [catalog.queries()[n](spark, d).count() for n in ("fts_topk", "fts_cover_density", "trigram_topk")] == [0] * 3


def test_prefixes_meet_whole_vocabularies(spark):
    words = spark.createDataFrame([("inte",), ("a",), ("zz",), ("interest",)], "q string")
    tokens = spark.createDataFrame([("interest",), ("interested",), ("int",), ("a",), ("abc",), ("inte",)] * 2, "token string")
    got = {tuple(r) for r in postings.prefix_matches(words, tokens).select("q", "token").collect()}
    assert got == {("inte", "interest"), ("inte", "interested"), ("inte", "inte"), ("a", "a"), ("a", "abc"), ("interest", "interest"), ("interest", "interested")}


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_every_block_meets_every_block(spark, broadcast):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(300, [0.0] * 6), (301, [1.0] * 6), (302, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        many = lambda df, label, n: blocks.packed(df, label, n)
        found = blocks.meet(many(vectors, "v", 32), many(vectors.where("vec_id % 7 = 0"), "q", 5), search.Vectors, search.Vectors, _dots, "question_id long, claim_id long, cosine double", "question_id", ["-cosine", "claim_id"], 4)
        got = [(r["question_id"], r["claim_id"]) for r in search._top(found, [F.desc("cosine"), "claim_id"], 4).orderBy("question_id", "rank").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = []
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if any(v)}
    for q in sorted(i for i in unit if i % 7 == 0):
        want += [(q, i) for i in sorted(unit, key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:4]]
    assert got == want


def _dots(c, q):
    s = np.round(c.v @ q.v.T, 12)
    return search._found(search._nearest(s, 4), c.ids, q.ids, cosine=s)


def test_best_of_keeps_ties():
    table = {"g": np.array([1, 1, 1, 1, 2]), "n": np.array([5, 5, 7, 4, 1]), "i": np.array([3, 2, 1, 0, 9])}
    assert blocks.best_of(table, "g", ["-n", "i"], 2)["i"].tolist() == [1, 2, 9]
    assert blocks.best_of(table, "g", ["-n", "i"], 2, "n")["i"].tolist() == [1, 2, 3, 9]


def test_pruning_in_a_task_loses_nothing(spark, monkeypatch, tables):
    d = tables(["copper turbine lantern"], [f"copper {'turbine' if n % 3 else ''} {'lantern' if n % 5 else ''}" for n in range(60)])
    want = [tuple(r) for r in catalog.queries()["fts_topk"](spark, d).orderBy("rank").collect()]
    assert [r[3] for r in want] == [n for n in range(60) if n % 3 and n % 5][:20]


@given(st.lists(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=6), min_size=1, max_size=4), max_size=6), st.sampled_from([3, 1 << 20]))
@settings(max_examples=200, deadline=None)
def test_densities_of_many_pairs_are_those_of_each(pairs, places):
    lists = [sorted(own) for p in pairs for own in p]
    size = np.array([len(own) for own in lists], dtype=np.int64)
    pair = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    at = np.array([x for own in lists for x in own], dtype=np.int64)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(postings, "PLACES", places)
        got = postings.densities(len(pairs), pair, np.cumsum(size) - size, size, at)
    assert got.tolist() == pytest.approx([postings.density([np.array(sorted(own)) for own in p]) for p in pairs], abs=1e-6)


@pytest.mark.parametrize("name", ["fts_topk", "fts_cover_density", "trigram_topk"])
def test_floors_of_the_longest_claims_lose_nothing(spark, tables, monkeypatch, name):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abc"), size=n)) for n in rng.integers(2, 6, size=60)]
    some = lambda n: " ".join(rng.choice(words, size=n))
    d = tables([some(n) for n in (1, 2, 5, 9, 20)], [some(int(n)) for n in rng.integers(1, 60, size=160)])
    rows = lambda: sorted(tuple(r) for r in catalog.queries()[name](spark, d).collect())
    want = rows()
    monkeypatch.setattr(search, "LONGEST", 8)
    assert len(want) and rows() == want


def test_beginnings_of_tokens_by_their_chains():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("ab"), size=rng.integers(2, 7)))
    table = lambda lists: pa.table({"id": pa.array(range(len(lists))), "t": pa.array(lists, pa.list_(pa.string()))})
    claims, asked = search.Words(table([[word() for _ in range(9)] for _ in range(20)])), search.AskedWords(table([[word() for _ in range(3)] for _ in range(9)]))
    codes, columns = asked.pairs(claims)
    token = {c: t for t, c in asked.place.items()}
    got = sorted((claims.vocabulary[c], token[n]) for c, n in zip(codes.tolist(), columns.tolist(), strict=True))
    assert got == sorted((t, q) for t in claims.vocabulary for q in asked.place if t.startswith(q) and claims.content[claims.vocabulary.index(t)])
