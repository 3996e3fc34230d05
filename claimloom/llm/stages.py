"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the
columns of documents.

Cases: rows with null ids are judged like others; of a near-duplicate group the row of the smallest id stays (of its
repeats one, null ids last); empty inputs give empty outputs; further columns of docs pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import language, mixing, packing, rules, simhash
from .common import id_hash_mod, load, unused


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found. The model learns from the labelled rows of docs."""
    model = language.fit_languages(docs, id_hash_mod("doc_id", 4) != 2)
    lang, score = unused(docs.columns, "lang_found", "lang_score")
    return language.with_language(docs, model, docs.columns, lang, score).where(F.col(lang) != language.UND).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules or that the isolation forest finds anomalous."""
    model = rules.fit_rules(docs, load(spark, sf_dir, "labels"))
    prefix = "of_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return rules.with_rules(docs, model, docs.columns, prefix=prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group.

    Rows are numbered and written with their fingerprints once; groups are decided on numbers alone, of each fingerprint's
    first row, and the rows that stay are picked by a hash join that neither sorts nor gathers texts."""
    number, mark = unused(docs.columns, "row_number", "row_fp")
    marked = simhash.fingerprinted(docs.withColumn(number, F.monotonically_increasing_id()), [*docs.columns, number], name=mark)
    rows = marked.select("doc_id", F.col(number).alias("row"), F.col(mark).alias("fp"))
    of = simhash.fingerprint_components(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
    chosen = rows.groupBy("fp").agg(first.alias("w")).join(of.select("fp", "root"), "fp").groupBy("root").agg(F.min("w").alias("w")).select(F.col("w.row").alias(number))
    return marked.join(chosen.hint("shuffle_hash"), number, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix of their sources does."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences."""
    return packing.pack_documents(docs)
