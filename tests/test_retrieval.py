"""Retrieval asks every user turn of its query set, over passages and documents."""

from __future__ import annotations

import datetime

import pytest

from claimloom import catalog
from claimloom.operators import routing

DAY = datetime.datetime(2001, 12, 31)


def domain(spark, d: str, orders: list[tuple] = (), evidence: list[tuple] = ()) -> None:
    """The tables of claims: orders (key, customer), customers 0 to 9 of the nations of their number, which lie in regions 0
    (even) and 1 (odd); evidence (claim, supplier, tier, date)."""
    spark.createDataFrame([(k, c, "O", DAY, "3-MEDIUM") for k, c in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(n, n, "HOUSEHOLD") for n in range(10)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(n, n % 2) for n in range(10)], "n_nationkey int, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(0,), (1,)], "r_regionkey int").write.parquet(f"{d}/region.parquet")
    spark.createDataFrame([(n, f"Supplier {n}") for n in range(9)], "s_suppkey long, s_name string").write.parquet(f"{d}/supplier.parquet")
    lines = [(claim, 1, n % 3, supplier, "N", tier / 100, "O", 0.01, at, 100.0, 30.0) for n, (claim, supplier, tier, at) in enumerate(evidence)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_tax double, l_linestatus string, l_discount double, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double").write.parquet(f"{d}/lineitem.parquet")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("retrieval"))
    domain(spark, d)
    turns = [(20, 0, "system", "obey"), (20, 1, "user", "copper turbines rusting"), (40, 0, "user", "amber lanterns"), (40, 1, "assistant", "yes"), (40, 2, "user", "velvet harbour")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(0, "amber lanterns glow"), (1, "velvet curtains")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, "copper turbines rusting slowly"), (1, "velvet harbour lights")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["fts_topk", "trigram_topk", "rrf_fused_rank", "answers"])
def test_later_turns_and_documents_count(spark, small, name):
    rows = catalog.queries()[name](spark, small).collect()
    best = [r for r in (row.asDict() for row in rows) if r.get("rank", r.get("rn", 1)) == 1]
    first = {(r["question_id"], r["turn"]): (r["source"], r["claim_id"]) for r in best}
    assert first == {(20, 1): ("documents", 0), (40, 0): ("benchmark", 0), (40, 2): ("documents", 1)}


def test_published_entries_are_ranked_among_themselves(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(60, 0, "user", "amber lanterns")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    unpublished = [(n, "amber lanterns") for n in (1, 3, 5, 7, 9, 11)]
    spark.createDataFrame([*unpublished, (20, "amber lanterns glow over many quiet harbours")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "amber lanterns")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert [tuple(r) for r in catalog.queries()["faq_match"](spark, d).collect()] == [(60, 0, "benchmark", 20, 1.0, True)]


def texts(spark, d: str, questions: list[str], claims: list[tuple]) -> None:
    spark.createDataFrame([(20 * (n + 1), 0, "user", q) for n, q in enumerate(questions)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame(claims, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")


def ranks(spark, d: str) -> dict:
    return {(r["question_id"], r["rn"]): r for r in catalog.queries()["rrf_fused_rank"](spark, d).collect()}


def test_weak_questions_reach_claims_by_vectors_and_fresh_claims_lead(spark, tmp_path):
    d = str(tmp_path)
    # "turbinescencefulness" is no prefix of a claim's word, and holds too few of its trigrams; both share a stem of five letters
    texts(spark, d, ["turbinescencefulness", "lanterns"], [(0, "turbinology"), (4, "xx lanterns"), (364, "xx lanterns"), (365, "xx lanterns")])
    domain(spark, d, [(4, 1), (364, 1), (365, 1)], [(4, 0, 4, DAY), (364, 0, 4, datetime.datetime(2001, 6, 1)), (365, 0, 2, DAY)])
    rows = ranks(spark, d)
    assert rows[20, 1]["claim_id"] == 0
    # the same words: fresh official evidence, then fresh evidence of a member, then old official evidence
    assert [(rows[40, n]["claim_id"], rows[40, n]["state"]) for n in (1, 2, 3)] == [(4, "verified"), (365, "unverified"), (364, "verified")]
    assert rows[40, 1]["score"] > 2 * rows[40, 3]["score"]
    routes = {r["question_id"]: r["route"] for r in catalog.queries()["answers"](spark, d).collect()}
    assert routes == {20: "fts:0,vector:1", 40: "fts:3"}


def test_aliases_lead_to_categories_and_what_is_below_them(spark, tmp_path):
    d = str(tmp_path)
    # "velvet" opens passage 0, whose claim lies in region 0; "amber glass" passage 1, in nation 3
    texts(spark, d, ["velvet harbour", "amber glass harbour", "harbour"], [(0, "velvet"), (1, "amber glass"), *((n, "quiet harbour") for n in (2, 3, 4, 5))])
    domain(spark, d, [(0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 8)])
    rows = ranks(spark, d)
    best = lambda q: [rows[q, n]["claim_id"] for n in range(1, 7) if (q, n) in rows and rows[q, n]["claim_id"] > 1]
    assert best(20) == [3, 5, 2, 4]  # region 0 holds nations 4 and 8
    assert best(40)[0] == 2 and set(best(40)) == {2, 3, 4, 5}  # nation 3 alone
    assert best(60) == [2, 3, 4, 5]  # no alias: no category counts less
    assert rows[20, 1]["score"] > 0 and catalog.queries()["answers"](spark, d).count() == 3


def test_an_alias_counts_as_present_in_its_category(spark, tmp_path):
    from claimloom.operators import retrieval, search
    from claimloom.operators.postings import written

    d = str(tmp_path)
    texts(spark, d, ["velvet harbour"], [(0, "velvet"), (3, "quiet harbour"), (4, "quiet harbour")])
    domain(spark, d, [(0, 2), (3, 4), (4, 5)])
    index = search.Index(spark, d)
    found = written(search.fts(index), "found")
    share = lambda routes: {r["claim_id"]: r["coverage"] for r in retrieval.covered(index, found, routes).collect()}
    assert share(None) == {0: 0.5, 3: 0.5, 4: 0.5}
    assert share(routing.Routes(spark, d, index)) == {0: 0.5, 3: 1.0, 4: 0.5}


def test_a_disputed_top_claim_shows_all_sides(spark, tmp_path):
    d = str(tmp_path)
    # multiples of 23 are in conflict with those of the same customer
    texts(spark, d, ["lanterns", "turbines"], [(46, "xx lanterns"), (69, "xx turbines")])
    domain(spark, d, [(23, 1), (46, 1), (69, 2), (92, 1), (5, 1)], [(46, 3, 4, DAY), (46, 4, 2, DAY), (23, 5, 2, DAY), (69, 6, 3, DAY)])
    modes = {r["question_id"]: (r["mode"], r["n_items"]) for r in catalog.queries()["answers"](spark, d).collect()}
    assert modes == {20: ("conflict", 3), 40: ("extractive", 1)}  # a conflict with one side left is none
    items = {(r["question_id"], r["place"]): (r["claim_key"], r["sources"]) for r in catalog.queries()["answer_items"](spark, d).collect()}
    assert items == {(20, 1): (46, "Supplier 3,Supplier 4"), (20, 2): (23, "Supplier 5"), (20, 3): (92, ""), (40, 1): (69, "Supplier 6")}


def test_lists_are_cut_to_three(spark, tmp_path):
    d = str(tmp_path)
    texts(spark, d, ["lanterns"], [(n, "xx lanterns") for n in range(1, 9)])
    domain(spark, d)
    assert [(r["mode"], r["n_items"]) for r in catalog.queries()["answers"](spark, d).collect()] == [("list", 3)]
    assert catalog.queries()["answer_items"](spark, d).count() == 3


def test_numbers_of_a_tree(spark):
    nodes = [("a", None), ("b", "a"), ("c", "a"), ("b1", "b"), ("ab", None), ("b2", "b"), ("lost", "nowhere")]
    got = {r["id"]: (r["pre"], r["last"]) for r in routing.numbered_tree(spark.createDataFrame(nodes, "id string, parent string")).collect()}
    below = {x: {y for y in got if got[x][0] <= got[y][0] <= got[x][1]} for x in got}
    assert below == {"a": {"a", "b", "c", "b1", "b2"}, "b": {"b", "b1", "b2"}, "c": {"c"}, "b1": {"b1"}, "b2": {"b2"}, "ab": {"ab"}}


def test_coverage_by_sets_is_that_of_the_expression(spark):
    import random

    from pyspark.sql import functions as F

    from claimloom.functions import text as X
    from claimloom.operators.retrieval import share_covered

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 8)))
    rows = [(i, [word() for _ in range(rng.randrange(5))], [word() for _ in range(rng.randrange(6))], [word() for _ in range(rng.randrange(3))]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, q array<string>, d array<string>, s array<string>")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", X.coverage(F.col("q"), F.col("d")).alias("a"), X.coverage(F.col("q"), F.col("d"), F.col("s")).alias("b")).collect()}
    assert all(got[i] == pytest.approx((share_covered(q, d), share_covered(q, d, s))) for i, q, d, s in rows)
