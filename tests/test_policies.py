"""Scopes, thresholds, the breaker, and the cache."""

from __future__ import annotations

import datetime

import pytest

from claimloom.operators import policies
from claimloom.operators.evidence import POLICY, derive, states_differ
from claimloom.operators.policies import Breaker, Scope, in_scope

NOW = "2001-01-01 00:00:00"
AT = datetime.datetime(2000, 12, 1)
EVIDENCE = "claim_id long, stance string, tier int, grp int, evidence_at timestamp_ntz, quote_verified boolean, human boolean, version_match boolean, audience int, active boolean"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(1, "supports", 2, 1, AT, True, False, None, None, True), (1, "supports", 2, 2, AT, True, False, None, None, True), (2, "supports", 4, 1, AT, True, False, None, 5, True), (3, "supports", 2, 1, AT, True, True, None, None, True), (4, "supports", 2, 1, AT, True, False, None, 6, False)]
    claims = spark.createDataFrame([(1, "a", False, False), (2, "a", False, False), (3, "b", False, False), (4, "b", False, False)], "claim_id long, category string, human_verified boolean, open_conflict boolean")
    return claims, spark.createDataFrame(rows, EVIDENCE)


def test_thresholds_by_category(tables):
    of = lambda groups: {r["claim_id"]: r["verification"] for r in derive(*tables, POLICY, NOW, None, groups).collect()}
    assert of(None)[1] == "corroborated" and of({"a": 3})[1] == "unverified" and of({"a": None})[1] == "unverified"
    assert of({"b": 1}) == of(None) | {3: "corroborated"}  # an official source verifies whatever the groups


def test_scopes(tables):
    derived = derive(*tables, POLICY, NOW)
    ids = lambda **scope: {r["claim_id"] for r in in_scope(derived, tables[1], Scope(**scope)).collect()}
    assert ids() == {1, 2, 3}  # without active evidence a claim is retracted
    assert ids(states=("verified",)) == {2} and ids(categories=("b",)) == {3} and ids(channels=(6,)) == {1, 3} and ids(channels=(5,)) == {1, 2, 3}
    assert ids(origins=("manual",)) == {3} and ids(origins=("web", "chat")) == {1, 2} and ids(origins=()) == set()
    assert ids(states=("verified", "corroborated"), categories=("a",), origins=("web",), channels=(5,)) == {2}


def test_stored_states(tables):
    new = derive(*tables, POLICY, NOW)
    assert states_differ(new, new).count() == 0
    without = derive(tables[0], tables[1].where("claim_id <> 1 OR grp = 1"), POLICY, NOW)
    assert [r["claim_id"] for r in states_differ(new, without).collect()] == [1]


def test_breaker():
    b = Breaker(3, 60)
    steps = [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (6, False), (64, True), (65, True), (130, True), (200, False), (201, True)]
    assert [b.step(*s)[0] for s in steps] == ["failed", "failed", "ok", "failed", "failed", "opened", "refused", "refused", "opened", "opened", "ok", "failed"]


def test_answers_come_back_from_json_whole(spark, tmp_path):
    at = datetime.datetime(2024, 1, 30, 1, 2, 3, 456789)
    day = lambda n: at + datetime.timedelta(hours=n)
    rows = [
        (1, day(-2), 7, "signup", 10.0, '{"k": 1}'), (2, at, 7, "view", 33.0, '{"k": 4}'), (3, day(1), 7, "view", 33.0, '{"k": 4}'),  # the second of a key wins
        (4, day(0), 8, "view", 30.0, '{"k": 1}'), (5, day(1), 8, "purchase", 30.0, '{"k": 1}'),  # another epoch
        (6, day(-500), 9, "view", 30.0, '{"k": 1}'), (7, day(1), 10, "view", 0.5, '{"k": 1}'), (8, day(0), 11, "view", 30.0, '{"k": 1}'), (9, day(1), 11, "click", 90.0, '{"k": 1}'),
    ]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r for r in policies.cached_answers(spark, str(tmp_path)).collect()}
    assert got.keys() == {3, 9}  # 2 was replaced, 4 is of an older epoch, 6 too old, 7 degraded, 8 of an older configuration
    assert got[3]["at"] == day(1) and got[3]["score"] == 0.33 and got[3]["claim_id"] == 4 and got[3]["mode"] == "list"
