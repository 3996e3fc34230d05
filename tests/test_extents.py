"""Word similarity against all stretches, in Python and in SQL."""

from __future__ import annotations

import random

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from claimloom import catalog
from claimloom.operators import extents


def slow(wanted: list[str], held: list[str]) -> float:
    q = set(wanted)
    stretches = (set(held[a:b]) for a in range(len(held)) for b in range(a + 1, len(held) + 1))
    return max((len(q & s) / len(q | s) for s in stretches), default=0.0)


@given(st.sets(st.sampled_from("abcdefgh"), min_size=1), st.lists(st.sampled_from("abcdefghijkl"), max_size=30), st.sampled_from([0.0, 0.3, 0.45, 0.8]))
@settings(max_examples=500, deadline=None)
def test_best_stretch(wanted, held, least):
    want = slow(list(wanted), held)
    assert extents.best_extent(sorted(wanted), held, least) == pytest.approx(want if want >= least else 0.0)


def test_stretches_in_long_repeating_texts():
    assert extents.best_extent(["a", "b", "c"], ["a", "x"] * 5000 + ["a", "b", "y", "c"] + ["x", "y"] * 5000) == pytest.approx(3 / 4)
    assert extents.best_extent(["a"], []) == extents.best_extent([], ["a"]) == 0.0


WORDS = "copper turbine turbines lantern lanterns harbour harbor velvet rust rusting slowly amber ambers glow".split()


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "'s"]) for _ in range(n))


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    questions = [(n, text(rng, rng.randrange(1, 5))) for n in range(25)] + [(100, None), (101, ""), (102, "the of"), (103, "é!")]
    claims = [(n, text(rng, rng.randrange(1, 12))) for n in range(60)] + [(100, None), (101, "..."), (102, "copper"), (103, "copper")]
    return questions, claims


def test_prefix_filter_loses_nothing(spark, small):
    questions, claims = small
    q = extents.asked_trigrams(spark.createDataFrame(questions, "question_id long, text string"))
    c = spark.createDataFrame(claims, "claim_id long, text string")
    gs = {r["question_id"]: r["gs"] for r in q.collect()}
    held = {r["claim_id"]: r["h"] for r in c.select("claim_id", extents._ordered(extents.X.tokens(F.col("text"))).alias("h")).collect() if r["h"]}
    want = {}
    for i, g in gs.items():
        scores = sorted(((-slow(g, h), j) for j, h in held.items()))
        want |= {(i, j): (-s, n + 1) for n, (s, j) in enumerate([x for x in scores if -x[0] >= 0.45][:5])}
    for hits in (1, 4, 100):
        got = {(r["question_id"], r["claim_id"]): (r["similarity"], r["rank"]) for r in extents.word_similarity(q, c, k=5, hits=hits).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    assert 100 not in gs and 101 not in gs and 102 in gs  # a question of nothing but stop words asks for all its tokens


def test_same_as_sql_over_all_stretches(spark, small, tmp_path):
    questions, claims = small
    spark.createDataFrame([(20 * i, 0, "user", t) for i, t in questions], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(claims, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["question_id"], r["item_id"], r["similarity"], r["rank"]) for r in catalog.queries()["word_similarity_topk"](spark, str(tmp_path)).collect()}
    grams = lambda c: f"flatten(list_transform(list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
    con = duckdb.connect()
    sql = f"""WITH q AS (SELECT conv_id AS question_id, list_distinct({grams('text')}) AS gs FROM '{tmp_path}/conversations.parquet/*.parquet'), c AS (SELECT item_id, {grams('text')} AS h FROM '{tmp_path}/benchmark.parquet/*.parquet'),
    e AS (SELECT item_id, list_distinct(h[a:b]) AS s FROM (SELECT item_id, h, a, unnest(range(a, len(h) + 1)) AS b FROM (SELECT item_id, h, unnest(range(1, len(h) + 1)) AS a FROM c))),
    m AS (SELECT question_id, item_id, max(len(list_intersect(gs, s))::DOUBLE / (len(gs) + len(s) - len(list_intersect(gs, s)))) AS similarity FROM q, e WHERE len(gs) > 0 GROUP BY ALL HAVING similarity >= 0.45::DOUBLE)
    SELECT question_id, item_id, round(similarity, 6), row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, item_id) AS rank FROM m QUALIFY rank <= 20"""
    assert got == set(con.execute(sql).fetchall())
