"""Stages of the pipeline on tables without rows, and on rows of nulls alone."""

from __future__ import annotations

import pytest

import corpus_pipeline

from .fixtures import table


@pytest.mark.parametrize("data", [[], [(None, None, None, None, None, None, None)] * 3], ids=["no-rows", "nulls"])
def test_stages_take_tables_without_texts(spark, tmp_path, data):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, data)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name == "best_fit_packing":
            assert [(r["doc_id"], r["length"]) for r in rows] == [(None, 1)] * len(data)
            continue
        assert out.columns == docs.columns
        # rejected by language and rules; one of a group of copies stays; no words, so the mix takes none
        assert len(rows) == (min(1, len(data)) if name == "simhash_near_dedup" else 0)
