"""Claim derivation on literal evidence, and its invariants."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from claimloom.operators.evidence import ScoringPolicy, asof_join, derive, states_differ

NOW = "2026-10-01 00:00:00"
POLICY = ScoringPolicy(half_life_days=30.0)
EVIDENCE = "claim_id long, stance string, tier int, grp string, evidence_at timestamp_ntz, quote_verified boolean, endorser_tier int, version_match boolean, audience int, active boolean"
CLAIMS = "claim_id long, human_verified boolean, open_conflict boolean"


def row(claim, tier, grp, days=5, stance="supports", endorser=None, audience=None, active=True, quoted=True, version=None):
    return (claim, stance, tier, grp, dt.datetime(2026, 10, 1) - dt.timedelta(days=days), quoted, endorser, version, audience, active)


def run(spark, evidence, claims=None):
    ids = sorted({e[0] for e in evidence})
    c = spark.createDataFrame([(i, *(claims or {}).get(i, (False, False))) for i in ids], CLAIMS)
    return {r["claim_id"]: r for r in derive(c, spark.createDataFrame(evidence, EVIDENCE), POLICY, NOW).collect()}


def test_verification_ladder(spark):
    evidence = [
        row(1, 2, "a"), row(2, 2, "a"), row(2, 2, "b"), row(3, 2, "a"), row(3, 3, "a"), row(4, 4, "a"),
        row(5, 4, "a"), row(5, 4, "b", days=1, stance="contradicts"), row(6, 2, "a", endorser=3), row(7, 2, "a", endorser=2), row(8, 4, "a"), row(9, 4, "a"),
        *[row(10, 2, f"g{i}", days=0) for i in range(50)], row(11, 2, "a", audience=5), row(12, 2, "a", audience=5, active=False), row(12, 1, "b"),
    ]
    got = run(spark, evidence, {8: (False, True), 9: (True, True)})
    want = {1: "unverified", 2: "corroborated", 3: "unverified", 4: "verified", 5: "unverified", 6: "verified", 7: "unverified", 8: "disputed", 9: "verified"}
    assert {k: got[k]["verification"] for k in want} == want
    assert got[4]["basis"] == "official_source" and got[6]["basis"] == got[9]["basis"] == "human"
    assert got[10]["support_score"] <= 1.2 and not got[11]["is_public"] and got[12]["is_public"]


def test_claims_without_evidence_stay_and_are_retracted(spark):
    c = spark.createDataFrame([(1, False, False, "active"), (2, True, False, "active"), (3, False, True, "active"), (4, False, False, "outdated"), (5, False, False, "active"), (6, False, False, "active")], CLAIMS + ", lifecycle string")
    e = spark.createDataFrame([row(5, 4, "a", stance="contradicts"), row(6, 1, "a"), row(1, 4, "a", active=False)], EVIDENCE)
    got = {r["claim_id"]: r for r in derive(c, e, POLICY, NOW).collect()}
    assert {k: (r["lifecycle"], r["lifecycle_reason"]) for k, r in got.items()} == {1: ("retracted", "no_evidence"), 2: ("active", None), 3: ("retracted", "no_evidence"), 4: ("outdated", None), 5: ("retracted", "no_evidence"), 6: ("active", None)}
    assert [got[i]["verification"] for i in range(1, 7)] == ["unverified", "verified", "disputed", "unverified", "unverified", "unverified"]
    assert got[1]["support_score"] == 0 and got[2]["is_public"] and not got[1]["is_public"] and got[1]["audiences"] == []


def test_categories_age_by_their_own_half_life(spark):
    c = spark.createDataFrame([(i, False, False, k) for i, k in enumerate(("fast", "never", "other", None))], CLAIMS + ", category string")
    e = spark.createDataFrame([row(i, 4, "a", days=30) for i in range(4)], EVIDENCE)
    got = derive(c, e, POLICY, NOW, {"fast": 15.0, "never": None}).orderBy("claim_id").collect()
    assert [r["support_score"] for r in got] == pytest.approx([0.25, 1.0, 0.5, 0.5])


def test_human_evidence_needs_no_quote(spark):
    e = spark.createDataFrame([(*row(i, 4, "a", days=0, quoted=False), h) for i, h in enumerate((True, False, None))], EVIDENCE + ", human boolean")
    c = spark.createDataFrame([(i, False, False) for i in range(3)], CLAIMS)
    assert [r["support_score"] for r in derive(c, e, POLICY, NOW).orderBy("claim_id").collect()] == [1.0, 0.5, 0.5]


def test_stored_states_differ_in_any_part(spark):
    kind = "claim_id long, verification string, basis string, is_public boolean, audiences array<int>, lifecycle string, support_score double"
    base = ("verified", "human", True, [5, 6], "active", 1.0)
    new = spark.createDataFrame([(i, *base) for i in range(8)], kind)
    other = [base, ("disputed", *base[1:]), ("verified", None, *base[2:]), (*base[:2], False, *base[3:]), (*base[:3], [5], *base[4:]), (*base[:4], "retracted", 1.0), (*base[:5], 1.1), (*base[:3], [6, 5], "active", 1.0 + 1e-9)]
    stored = spark.createDataFrame([(i, *o) for i, o in enumerate(other)], kind)
    assert sorted(r["claim_id"] for r in states_differ(new, stored).collect()) == [1, 2, 3, 4, 5, 6]


def test_weights(spark):
    got = run(spark, [row(1, 4, "a", days=0), row(2, 4, "a", days=30), row(3, 4, "a", days=0, quoted=False), row(4, 4, "a", days=0, version=False), row(5, 4, "a", days=5000)])
    assert [got[i]["support_score"] for i in range(1, 6)] == pytest.approx([1.0, 0.5, 0.5, 0.4, 0.2])


facts = st.lists(st.tuples(st.integers(0, 4), st.sampled_from("abcd"), st.integers(0, 2000), st.sampled_from(["supports", "contradicts"]), st.sampled_from([None, 2, 3]), st.sampled_from([None, 5])), min_size=1, max_size=12)


@given(st.lists(st.tuples(facts, st.booleans(), st.booleans()), min_size=1, max_size=15))
@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
def test_invariants(spark, cases):
    evidence = [row(i, t, g, d, s, e, a) for i, (rows, _, _) in enumerate(cases) for t, g, d, s, e, a in rows]
    for i, r in run(spark, evidence, {i: (h, c) for i, (_, h, c) in enumerate(cases)}).items():
        rows, human, conflict = cases[i]
        assert (r["verification"] == "verified") == (r["basis"] is not None)
        assert not human or r["verification"] == "verified"
        assert human or not conflict or r["verification"] == "disputed"
        assert human or r["n_sup"] or r["verification"] != "verified"
        assert r["support_score"] <= len({x[1] for x in rows}) + 1e-9


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 7, 70)], "k string, t int, v int")
    assert sorted((r["k"], r["t"], r["v"]) for r in asof_join(left, right, "k", "t", "t", "v").collect()) == [("a", 1, None), ("a", 5, 50), ("b", 9, None)]


def test_sources_that_tie_in_tier_date_and_line_come_in_their_own_order(spark, tmp_path):
    from claimloom import catalog
    from claimloom.operators import routing

    at = dt.datetime(2001, 1, 1)
    for turn in (1, -1):  # whichever row is read first
        d = f"{tmp_path}/{turn}"
        lines = [(7, 1, 1, supplier, "N", 0.04, "O", 0.01, at, 100.0, 30.0) for supplier in range(9)][::turn]
        spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_tax double, l_linestatus string, l_discount double, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
        spark.createDataFrame([(n, f"S{n}") for n in range(9)], "s_suppkey long, s_name string").write.parquet(f"{d}/supplier.parquet")
        got = catalog.queries()["top_sources_per_claim"](spark, d).orderBy("rn").collect()
        assert [r["source"] for r in got] == ["S0", "S1", "S2"]
        keys = spark.createDataFrame([(7,)], "key long")
        assert [r["sources"] for r in routing.sources_of(spark, d, keys).collect()] == ["S0,S1,S2"]
