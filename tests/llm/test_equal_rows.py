"""Rows that repeat each other, names that clash, and vectors of several lengths."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import mixing, neighbours, simhash

from .fixtures import prose, table


def test_equal_rows_come_out_as_often_as_the_mix_takes_them(spark):
    docs = table(spark, [(1, "one two three", "en", "a", 13, 0.5, "c")] * 1000)
    assert mixing.mixed_documents(docs).count() == 1500
    assert mixing.mixture(docs).agg(F.sum("taken")).first()[0] == 4500
    some = table(spark, [(1, "one two three", "en", "a", 13, 0.5, "c")] * 90 + [(i, f"w{i} x y", "en", "b", 0, 0.5, "c") for i in range(5)] + [(7, "u v", "en", None, 0, 0.5, "c")] * 30)
    plan = mixing.mixture(some).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    got = mixing.mixed_documents(some).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == pytest.approx({r["source"]: r["n"] for r in plan if r["n"]}, abs=3)


def test_copies_are_those_of_the_plan(spark):
    data = [(i, prose("en", 20 + i % 7, i), "en", f"s{i % 4}", 0, 0.5, "c") for i in range(150)] + [(i % 9, prose("en", 21, 3), "en", "s1", 0, 0.5, "c") for i in range(40)] + [(None, "a b c d", "en", None, 0, 0.5, "c")] * 12 + [(300, None, None, "s0", 0, 0.5, "c")]
    docs = table(spark, data)
    want = Counter()
    for r in mixing.mixture(docs).collect():
        if r["size"]:
            want[r["doc_id"], r["source"], r["size"]] += int(r["taken"] / r["size"] + 0.5)
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixing.mixed_documents(docs).collect())
    assert got == +want


@pytest.mark.parametrize("few", [10_000, -1])
def test_many_sources_and_one_hot(spark, monkeypatch, few):
    from claimloom.llm import common

    monkeypatch.setattr(common, "FEW", few)
    data = [(i, f"w{i} x", "en", "hot" if i % 3 else f"s{i}", 0, 0.5, "c") for i in range(200)] + [(i, "q", "en", None, 0, 0.5, "c") for i in range(300, 400)]
    docs = table(spark, data)
    taken = mixing.mixture(docs).agg(F.sum("taken")).first()[0]
    assert abs(taken - 1.5 * 500) <= len({d[3] for d in data})  # a source's words are its target rounded down
    marked = simhash.near_duplicates(docs, ["doc_id", "source"])
    assert marked.count() == 300 and marked.where("doc_id >= 300").select("component_id").distinct().count() == 1


NAMES = ("row_number", "row_fp", "Mix_Whole", "mix_row", "mix_source", "lang_found", "of_kept", "__row", "__fp", "__text", "__times", "__key", "n", "rest")


def test_columns_of_any_name_pass_through_the_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, [(i, prose("en", 60, i // 2), "en", f"s{i % 2}", 0, 0.5, "c") for i in range(30)] * 2)
    for n, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.lit(f"own {n}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"own {n}" for r in rows for n, c in enumerate(NAMES)), name


def test_each_length_of_vectors_is_searched(spark):
    data = [(i, [float(i % 7), float(i), 1.0]) for i in range(120)] + [(1000 + 10 * i, [float(i), 2.0]) for i in range(12)] + [(7000, [5.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, F.col("id") % 100 == 0).collect()
    near = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert len(near[0]) == len(near[100]) == 10 and near[1000] == [1000 + 10 * i for i in range(1, 11)]
    assert set(near[1100]) == {1000 + 10 * i for i in range(12)} - {1100, 1000} and 7000 not in near
