"""Configuration versions, purges and spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import text as X
from claimloom.operators import delta
from claimloom.operators.evidence import POLICY, derive
from claimloom.plans.tables import EVIDENCE_NOW, HALF_LIVES, claims, evidence

SMALL = "/root/testdata/sf0.001"
CHANGES = "profile string, at int, seq long, op string, content string, target int"


def outcomes(spark, *changes):
    rows = [(c[0], n, n, c[1], c[2] if c[1] == "apply" else None, c[2] if c[1] == "rollback" else None) for n, c in enumerate(changes)]
    got = delta.versions(spark.createDataFrame(rows, CHANGES)).orderBy("seq").collect()
    return [(r["version"], r["outcome"]) for r in got]


def test_apply_no_op_and_rollback(spark):
    assert outcomes(spark, ("g", "apply", "one"), ("g", "apply", "one"), ("g", "apply", "two"), ("g", "rollback", 1), ("g", "apply", "one"), ("g", "rollback", 2), ("g", "rollback", 9), ("g", "rollback", 4)) == [
        (1, "applied"), (1, "unchanged"), (2, "applied"), (3, "rolled_back"), (3, "unchanged"), (4, "rolled_back"), (4, "no_version"), (4, "unchanged"),
    ]


def test_profiles_are_apart_and_nulls_are_contents(spark):
    assert outcomes(spark, ("a", "rollback", 1), ("a", "apply", None), ("b", "apply", "x"), ("a", "apply", None), ("b", "rollback", 0), (None, "apply", "x"), ("a", "rollback", None)) == [
        (0, "no_version"), (1, "applied"), (1, "applied"), (1, "unchanged"), (1, "no_version"), (1, "applied"), (1, "no_version"),
    ]


def test_a_purge_is_a_full_recompute_of_the_touched(spark, monkeypatch):
    c, e = claims(spark, SMALL), evidence(spark, SMALL)
    gone = e.where("observation_id % 5 = 0").select("observation_id")
    options = {"policy": POLICY, "now": EVIDENCE_NOW, "half_lives": HALF_LIVES}
    ids = {r["observation_id"] for r in gone.collect()}
    whole = {r["claim_id"]: r for r in derive(c, e.where(~F.col("observation_id").isin(list(ids))), **options).collect()}
    was = {r["claim_id"]: r for r in derive(c, e, **options).collect()}
    touched = {r["claim_id"] for r in e.where("active").where(F.col("observation_id").isin(list(ids))).collect()}
    for most in (500_000, 0):  # by broadcast, and by a shuffle
        monkeypatch.setattr(delta, "MAX_TOUCHED", most)
        got = {r["claim_id"]: r for r in delta.purged(c, e, gone, **options).collect()}
        assert got.keys() == touched & whole.keys()
        for i, r in got.items():
            assert (r["verification"], r["support_score"], r["lifecycle"], r["n_sup"], r["was_verification"], r["was_score"]) == (*(whole[i][k] for k in ("verification", "support_score", "lifecycle", "n_sup")), was[i]["verification"], was[i]["support_score"])
    keys = ("verification", "support_score", "lifecycle", "n_sup", "n_con")
    assert all([whole[i][k] for k in keys] == [was[i][k] for k in keys] for i in whole.keys() - touched)


def test_evidence_of_other_claims_is_not_shuffled(spark):
    c, e = claims(spark, SMALL), evidence(spark, SMALL)
    plan = delta.purged(c, e, e.where("observation_id < 20").select("observation_id"), policy=POLICY, now=EVIDENCE_NOW)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "lineitem" in line]
    assert scans and "BroadcastHashJoin" in plan


def test_spellings_as_a_table_function(spark):
    spark.udtf.register("claimloom_spellings", delta.Spellings)
    spark.createDataFrame([("ψυχή",), ("ου",), (None,), ("latin",), ("ωωωωωωω",)], "word string").createOrReplaceTempView("w")
    rows = spark.sql("SELECT word, spelling, nth FROM w, LATERAL claimloom_spellings(word, 24)").collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["nth"]):
        got.setdefault(r["word"], []).append(r["spelling"])
    assert got == {w: X.spellings(w, 24) for w in ("ψυχή", "ου", "ωωωωωωω")} and len(got["ωωωωωωω"]) == 24 and got["ου"] == ["ou", "u"]
    assert "psyxi" in got["ψυχή"]
