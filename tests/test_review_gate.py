"""The gate on claim features: the embedding, the decision, and what becomes of claims."""

from __future__ import annotations

import datetime
import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from claimloom.operators import gate, ingest

EVIDENCE = "claim_id long, stance string, tier int, quote_verified boolean, active boolean"


def test_embedding_of_stems(spark):
    texts = [(1, "Copper turbines and copper lanterns"), (2, "the of and"), (3, None), (4, "ÉÀx élan")]
    got = {r["id"]: r["e"] for r in gate.stem_embedding(spark.createDataFrame(texts, "id long, text string")).collect()}
    counts = Counter(int(hashlib.sha256(w[:5].encode()).hexdigest()[:8], 16) % 64 for w in ("copper", "turbines", "copper", "lanterns"))
    norm = math.sqrt(sum(n * n for n in counts.values()))
    assert got[1] == pytest.approx([counts.get(b, 0) / norm for b in range(64)])
    assert got[2] == got[3] == [0.0] * 64 and sum(x > 0 for x in got[4]) == 2


def test_scalars(spark):
    e = [(1, "supports", 3, True, True), (1, "supports", 1, True, True), (1, "contradicts", 4, True, True), (1, "supports", 4, True, False), *[(2, "supports", 1, True, True)] * 6]
    texts = [(1, "The Fire Temple boss respawns every 4 hours"), (2, "x" * 1000), (3, None)]
    got = {r["id"]: r for r in gate.claim_features(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(e, EVIDENCE)).collect()}
    assert (got[1]["x_tier"], got[1]["x_quotes"], got[1]["x_len"]) == (0.75, 0.5, 43 / 400) and got[1]["x_score"] == pytest.approx(3 / 6)
    assert (got[2]["x_tier"], got[2]["x_quotes"], got[2]["x_len"]) == (0.25, 1.0, 1.0)
    assert (got[3]["x_tier"], got[3]["x_quotes"], got[3]["x_len"]) == (0.5, 0.0, 0.0) and all(len(r["x"]) == 68 for r in got.values())


def test_decision_is_that_of_the_model(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.5).astype(float)
    x = np.column_stack([y + rng.normal(0, 0.2, 400), rng.normal(size=400)])
    model = ingest.gate_model(x, y)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {r["id"]: r for r in gate.decided(rows, model).collect()}
    z = (x - np.array(model["mean"])) / np.array(model["std"]) @ np.array(model["weights"]) + model["bias"]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for i in range(400):
        assert got[i]["probability"] == pytest.approx(p[i], abs=1e-6)
        assert got[i]["decision"] == ("keep" if p[i] >= model["keep"] else "reject" if p[i] <= model["reject"] else "ask")
    assert {r["decision"] for r in gate.decided(rows, None).collect()} == {"ask"}


def test_claims_are_kept_rejected_or_asked_about(spark, tmp_path):
    d, at = str(tmp_path), datetime.datetime(2001, 1, 1)
    good, bad = "copper turbines hum in the quiet harbour", "%%% buy velvet now %%%"
    texts = [(i, (good if i % 2 else bad) + f" w{i % 13}" * (i % 7)) for i in range(700)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, 1, "O", at, "3-MEDIUM") for i in range(700)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    lines = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_tax double, l_linestatus string, l_discount double, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double"
    spark.createDataFrame([], lines).write.parquet(f"{d}/lineitem.parquet")
    got = {r["doc_id"]: r["outcome"] for r in gate.review_gate(spark, d).collect()}
    assert all(got[i] == "judged" for i in range(500))
    wrong = [got[i] for i in range(500, 700) if got[i] != ("keep" if i % 2 else "reject")]
    assert len(wrong) < 60 and not {"keep", "reject"} & set(wrong)  # what it is not sure of it leaves to people
    # too few labels: people are asked, but not twice about claims in a conflict (multiples of 23)
    asked = {r["doc_id"]: r["outcome"] for r in gate.review_gate(spark, d, fit_rows=100).collect()}
    assert all(asked[i] == ("already_open" if i % 23 == 0 else "task") for i in range(500, 700))
