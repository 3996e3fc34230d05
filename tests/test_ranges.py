"""Walks over ranges against one walk over all rows, with hot keys that no state settles."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from claimloom.operators import ranges
from claimloom.operators.ranges import Latest, Limits, Ring, Rule, Sliding


class Running(Rule):
    """A sum that depends on every row before."""

    def __init__(self):
        self.n = 0

    def step(self, t):
        self.n += t
        return (self.n,)


def events(n: int, hot: float, step: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += rng.randrange(step)
        out.append(("hot" if rng.random() < hot else rng.choice(["a", "b", None]), t, i))
    return out


def plain(rows: list[tuple], make) -> dict[int, tuple]:
    rules, out = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        out[i] = rules.setdefault(k, make()).step(t)
    return out


@pytest.mark.parametrize("make", [Running, lambda: Sliding(3, 40), lambda: Sliding(1, 5), lambda: Limits(2, 9, 60), lambda: Limits(5, 5, 5)])
@pytest.mark.parametrize("parts", [1, 13])
def test_same_as_one_walk(spark, make, parts):
    for step in (6, 4000):
        rows = events(1500, 0.6, step)
        df = spark.createDataFrame(rows, "k string, t long, i long").repartition(3)
        kind = "n long" if make is Running else "n string" if isinstance(make(), Limits) else "n boolean"
        got = {r["i"]: (r["n"],) for r in ranges.fold(df, ["k"], ["t", "i"], ["t"], make, kind, parts).collect()}
        assert got == plain(rows, make)


def test_one_key_alone_and_no_rows(spark):
    rows = [("x", i, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = ranges.fold(df, ["k"], ["t", "i"], ["t"], Running, "n long", 9)
    assert got.rdd.getNumPartitions() >= 1 and {r["i"]: r["n"] for r in got.collect()} == {i: i * (i + 1) // 2 for i in range(500)}
    assert ranges.fold(df.limit(0), ["k"], ["t", "i"], ["t"], Running, "n long").collect() == []


def test_day_gives_back_the_hour_but_not_the_minute():
    rule = Limits(2, 3, 3)
    steps = [rule.step(t)[0] for t in (0, 1, 2, 61, 125, 3600, 3601, 3662, 86400, 86401, 86402)]
    # the third of the minute is refused before any counter; the day's refusals leave the next hour's three places free,
    # yet each takes a slot of its minute
    assert steps == ["ok", "ok", "minute", "ok", "hour", "day", "day", "day", "ok", "ok", "minute"]


def test_context_and_replies():
    rule = Ring(size=3, n=2, within=100)
    got = [rule.step(*row) for row in ((0, 1, None), (50, 2, 1), (60, 3, 1), (150, 4, 1), (155, 5, 1), (1000, 6, 5), (1001, 7, 6))]
    assert got == [([], False), ([1], True), ([1, 2], True), ([1, 2, 3], True), ([3, 4], False), ([5], True), ([6], True)]


def test_context_spans_ranges(spark, monkeypatch):
    rows = [("hot" if i % 3 else "b", 10 * i, i, i - 1 - i % 60) for i in range(900)]
    df = spark.createDataFrame(rows, "channel string, t long, message_id long, reply long")
    got = {r["message_id"]: (r["context"], r["reply_found"]) for r in ranges.fold(df, ["channel"], ["t", "message_id"], ["t", "message_id", "reply"], Ring, "context array<long>, reply_found boolean", 12).collect()}
    held: dict = {}
    for channel, t, m, reply in rows:
        before = held.setdefault(channel, deque(maxlen=50))
        recent = [x for x, at in list(before)[-5:] if t - at <= 1800]
        found = reply in [x for x, _ in before]
        assert got[m] == (([reply] if found and reply not in recent else []) + recent, found)
        before.append((m, t))


def test_versions_of_a_region_and_of_all(spark):
    given = spark.createDataFrame([("eu", 10, 0, "1"), ("eu", 20, 1, "2"), (None, 15, 2, "g"), ("eu", 20, 3, "2b"), ("us", 5, 4, "u"), (None, 20, 0, "h"), ("eu", None, 9, "never")], "scope string, valid_from int, idx long, value string")
    asking = spark.createDataFrame([(1, "eu", 9), (2, "eu", 10), (3, "eu", 19), (4, "eu", 20), (5, "us", 16), (6, "xx", 14), (7, "xx", 30), (8, None, 30), (9, "us", None), (10, "eu", 20)], "id long, scope string, at int")
    got = {r["id"]: r["value"] for r in ranges.asof_by_scope(asking, given).collect()}
    # ties on the day go to the larger place in the list, of the region's and the general entries alike
    assert got == {1: None, 2: "1", 3: "g", 4: "2b", 5: "g", 6: None, 7: "h", 8: "h", 9: None, 10: "2b"}


def test_one_scope_with_half_of_the_rows(spark):
    rng = random.Random(4)
    given = [("big" if i % 2 else f"s{i % 9}", rng.randrange(1000), i, f"v{i}") for i in range(400)]
    asking = [(i, "big" if i % 2 else f"s{i % 11}", rng.randrange(1000)) for i in range(800)]
    got = {r["id"]: r["value"] for r in ranges.asof_by_scope(spark.createDataFrame(asking, "id long, scope string, at int"), spark.createDataFrame(given, "scope string, valid_from int, idx long, value string")).collect()}
    want = {i: max(((f, n, v) for s, f, n, v in given if s == scope and f <= at), default=(None,) * 3)[2] for i, scope, at in asking}
    assert got == want


def test_latest_without_a_value():
    rule = Latest()
    assert rule.step(1, None, None) == (None, None) and rule.step(0, 3, "x") == (3, "x") and rule.step(1, None, None) == (3, "x") and rule.settled


def test_greedy_limit_of_a_table(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.col("id") * 3000).cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["accepted"] for r in ranges.rate_limit_sliding_greedy(spark, str(tmp_path)).collect()}
    want = {}
    for user in (0, 1):
        taken: list[int] = []
        for i in range(user, 40, 2):
            want[i] = sum(x > i * 3000 - 21600 for x in taken) < 2
            taken += [i * 3000] * want[i]
    assert got == want
