"""The corpus queries on the smallest tables: SQL where there is any, else the contract's columns and rows."""

from __future__ import annotations

from pathlib import Path

import pytest

from claimloom.llm import catalog

from ..compare import difference, duck

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no input tables")
COLUMNS = {
    "op1_quality_classifier": "doc_id:bigint held_out:boolean score:double predicted:int", "op2_html_extraction": "page_id:bigint url:string text:string n_chars:bigint",
    "op3_nearest_neighbours": "query_id:bigint rank:int vec_id:bigint score:double", "op4_simhash_near_dedup": "doc_id:bigint fingerprint:string component_id:bigint",
    "op5_best_fit_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op8_token_codes": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint", "op10_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op11_secret_scan": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op9_quality_rules": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, SMALL), duck(SMALL), catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    frame = catalog.QUERIES[name](spark, SMALL)
    assert " ".join(f"{c}:{t}" for c, t in frame.dtypes).startswith(COLUMNS[name])
    rows = frame.count()
    per_row = {"op2_html_extraction": "pages", "op3_nearest_neighbours": None, "op5_best_fit_packing": None}
    table = per_row.get(name, "documents")
    assert rows > 0 and (table is None or rows == spark.read.parquet(f"{SMALL}/{table}.parquet").count())
