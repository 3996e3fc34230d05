"""The learned review gate on the features of a claim: an embedding of its text beside its author's tier, its prefilter
score, its length and its verified quotes; and what the gate does with claims that nobody has judged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..plans.tables import EVIDENCE_SQL, claims, evidence, read
from .ingest import GATE_ROWS, gate_model, prefilter
from .postings import written
from .texts import content_sql

DIMS = 64
#: Largest value of each scalar feature, which is its unit.
TIER, SCORE, CHARS, QUOTES = 4, 6, 400, 4


def stem_embedding(texts: DataFrame, dims: int = DIMS) -> DataFrame:
    """id, e: the counts of hashed stems (first five letters of content words) over their length; zeros without words."""
    t = texts.select("id", F.explode(X.content_tokens(F.col("text"))).alias("t"))
    bucket = (F.conv(F.substring(F.sha2(F.substring("t", 1, 5), 256), 1, 8), 16, 10).cast("long") % dims).cast("int")
    counts = t.groupBy("id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    e = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double"))
    spread = F.transform(e, lambda x: x / F.col("norm"))
    zeros = F.array(*[F.lit(0.0)] * dims)
    return texts.select("id").join(per, "id", "left").select("id", F.when(F.col("norm") > 0, spread).otherwise(zeros).alias("e"))


def claim_features(texts: DataFrame, evidence_df: DataFrame) -> DataFrame:
    """id, x: the features of each claim (id, its text): embedding, tier, score, length, quotes, all from 0 to 1. The tier is
    the best that supports it, 2 without support."""
    e = evidence_df.where("active AND stance = 'supports'").withColumnRenamed("claim_id", "id").join(texts.select("id"), "id", "left_semi")
    per = e.groupBy("id").agg(F.max("tier").alias("tier"), F.count(F.when(F.col("quote_verified"), 1)).alias("quotes"))
    c = texts.join(per, "id", "left").withColumns({"author_tier": F.coalesce("tier", F.lit(2)), "alias_hits": F.lit(0), "entity_hits": F.lit(0), "is_reply_to_question": F.lit(False)})
    share = lambda value, unit: F.least(value, F.lit(unit)).cast("double") / unit
    c = prefilter(c).select("id", F.col("author_tier").cast("double") / TIER, share(F.col("score"), SCORE), share(F.length(F.coalesce("text", F.lit(""))), CHARS), share(F.coalesce("quotes", F.lit(0)), QUOTES)).toDF("id", "x_tier", "x_score", "x_len", "x_quotes")
    return c.join(stem_embedding(texts), "id").withColumn("x", F.concat("e", F.array(F.coalesce("x_tier", F.lit(0.0)), F.coalesce("x_score", F.lit(0.0)), "x_len", "x_quotes")))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def claim_vectors(spark, d):
    """Each document's features as the gate sees them: the scalars, how many buckets of the embedding it fills, and their sum."""
    f = claim_features(_texts(spark, d), evidence(spark, d))
    return f.select(F.col("id").alias("doc_id"), "x_tier", "x_len", "x_quotes", F.size(F.filter("e", lambda v: v > 0)).cast("long").alias("n_stems"), F.round(F.aggregate("e", F.lit(0.0), lambda a, v: a + v), 6).alias("e_sum"))


def decided(rows: DataFrame, model: dict | None) -> DataFrame:
    """rows (with x) with probability and decision: keep, reject or ask; without a model all are asked."""
    if model is None:
        return rows.withColumns({"probability": F.lit(None).cast("double"), "decision": F.lit("ask")})
    scale = F.array(*[F.struct(F.lit(float(w / s)).alias("w"), F.lit(float(m)).alias("m")) for w, m, s in zip(model["weights"], model["mean"], model["std"], strict=True)])
    z = F.aggregate(F.zip_with("x", scale, lambda x, p: (x - p["m"]) * p["w"]), F.lit(float(model["bias"])), lambda a, v: a + v)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    keep, reject = F.lit(2.0 if model["keep"] is None else model["keep"]), F.lit(-1.0 if model["reject"] is None else model["reject"])
    return rows.withColumn("p", p).withColumns({"probability": F.round("p", 6), "decision": F.when(F.col("p") >= keep, "keep").when(F.col("p") <= reject, "reject").otherwise("ask")}).drop("p")


def review_gate(spark, d, fit_rows: int = GATE_ROWS):
    """What becomes of each claim with a text: judged already, kept or rejected by a gate learned from the newest fit_rows
    labels (a larger id is newer), or a task for people, unless one is open (the claim is in a conflict)."""
    f = written(claim_features(_texts(spark, d), evidence(spark, d)).select(F.col("id").alias("doc_id"), "x"), "claim-features")
    labels = read(spark, d, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    newest = written(f.join(labels, "doc_id").orderBy(F.desc("doc_id")).limit(fit_rows), "newest-labels")
    rows = sorted(newest.collect(), key=lambda r: r["doc_id"])
    model = gate_model(np.array([r["x"] for r in rows], dtype=float).reshape(-1, DIMS + 4), np.array([r["quality"] for r in rows], dtype=float))
    opened = claims(spark, d).where("open_conflict").select(F.col("claim_id").alias("doc_id"), F.lit(True).alias("opened"))
    j = decided(f, model).join(labels, "doc_id", "left").join(opened, "doc_id", "left")
    asked = F.when(F.col("opened"), "already_open").otherwise("task")
    return j.select("doc_id", "probability", F.when(F.col("quality").isNotNull(), "judged").when(F.col("decision") == "ask", asked).otherwise(F.col("decision")).alias("outcome"))


QUERIES = {f.__name__: f for f in (claim_vectors, review_gate)}
ORACLES = {
    "claim_vectors": f"""WITH e AS (SELECT claim_id, max(tier) AS tier, count(*) FILTER (quote_verified) AS quotes FROM ({EVIDENCE_SQL}) WHERE active AND stance = 'supports' GROUP BY 1),
b AS (SELECT doc_id, CAST(('0x' || substr(sha256(left(t, 5)), 1, 8))::BIGINT % {DIMS} AS INT) AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({content_sql('text')}) AS t FROM documents) GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n_stems, round(sum(n)::DOUBLE / sqrt(sum(n * n)::DOUBLE), 6) AS e_sum FROM b GROUP BY 1)
SELECT doc_id, coalesce(tier, 2)::DOUBLE / {TIER} AS x_tier, least(length(coalesce(text, '')), {CHARS})::DOUBLE / {CHARS} AS x_len, least(coalesce(quotes, 0), {QUOTES})::DOUBLE / {QUOTES} AS x_quotes, coalesce(n_stems, 0) AS n_stems, coalesce(e_sum, 0.0::DOUBLE) AS e_sum
FROM documents LEFT JOIN e ON claim_id = doc_id LEFT JOIN s USING (doc_id)""",
}
