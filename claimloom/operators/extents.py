"""Word similarity: the best continuous stretch of a claim's trigrams for a question's, behind a prefix filter on rare ones.

The similarity of a question (a set of trigrams Q) and a stretch of a claim (with the distinct trigrams D) is the size of
their intersection over that of their union; a claim counts by its best stretch. One that reaches the least similarity t
shares at least c = t * |Q| trigrams with Q, so it holds at least HITS of any |Q| - c + HITS of them (or c, if that is
less). The rarest are taken: only their postings are joined, and only claims that pass are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..plans.tables import read
from .blocks import small_batches
from .postings import STRIDE, asked, written

#: Least similarity, claims a question, and rare trigrams that a claim must share.
LEAST, BEST, HITS = 0.45, 20, 32


def _ordered(tokens: Column) -> Column:
    """Trigrams of the words in tokens, in order: two spaces before a word, one after."""
    words = F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, "[.']"))), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.flatten(each)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word of a text."""
    return F.array_distinct(_ordered(X.tokens(c)))


def asked_trigrams(texts: DataFrame) -> DataFrame:
    """question_id, gs: the distinct trigrams of each question's content tokens, or of all its tokens if it has no others."""
    t = texts.select("question_id", X.tokens(F.col("text")).alias("t")).withColumn("own", F.filter("t", X.is_content))
    return t.select("question_id", F.array_distinct(_ordered(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("t")))).alias("gs")).where(F.size("gs") > 0)


def best_extent(wanted: list[str], held: list[str], least: float = 0.0) -> float:
    """The largest similarity of wanted and a stretch of held; 0 if none reaches least.

    A best stretch begins and ends with a wanted trigram, and the one that it begins with does not come again in it (the
    stretch from there would be as good). So for each such beginning the stretch grows up to the next place of its
    trigram, or until it holds more trigrams than a better one could: more than |wanted| over the best so far."""
    code: dict[str, int] = {}
    at = np.array([code.setdefault(g, len(code)) for g in held], dtype=np.int64)
    size, found = len(wanted), frozenset(wanted)
    is_wanted = np.array([g in found for g in code], dtype=bool)
    if not size or not len(at) or is_wanted.sum() < least * size:
        return 0.0
    n = len(at)
    order = np.argsort(at, kind="stable")
    same = at[order[1:]] == at[order[:-1]]
    earlier, later = np.full(n, -1), np.full(n, n)
    earlier[order[1:][same]], later[order[:-1][same]] = order[:-1][same], order[1:][same]
    good = is_wanted[at]
    best = 0.0
    for start in np.flatnonzero(good).tolist():
        most = size / max(best, least, 1e-9)  # distinct trigrams of a stretch that can be better
        width, stop = int(min(2 * most, n)) + 2, int(later[start])
        while True:
            fresh = earlier[start : min(stop, start + width)] < start
            distinct = np.cumsum(fresh)
            if start + width >= stop or distinct[-1] > most:
                break
            width *= 2
        ends = fresh & good[start : start + len(fresh)] & (distinct <= most)
        shared = np.cumsum(ends)[ends]
        if len(shared):
            best = max(best, float((shared / (size + distinct[ends] - shared)).max()))
    return best if best >= least else 0.0


def rare_prefixes(questions: DataFrame, postings: DataFrame, least: float = LEAST, hits: int = HITS) -> DataFrame:
    """question_id, g, need: the rarest trigrams of each question, of which a claim must hold need at least.

    questions has question_id and gs; postings (g, claim_id) has distinct rows."""
    each = questions.select("question_id", F.size("gs").alias("n"), F.explode("gs").alias("g"))
    frequency = postings.join(each.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    shared = F.greatest(F.ceil(F.lit(least) * F.col("n") - 1e-9), F.lit(1))
    need = F.least(F.lit(hits), shared)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.coalesce("df", F.lit(0)), "g"))
    return each.join(frequency, "g", "left").withColumn("place", place).where(F.col("place") <= F.col("n") - shared + need).select("question_id", "g", need.alias("need"))


def word_similarity(questions: DataFrame, texts: DataFrame, k: int = BEST, least: float = LEAST, hits: int = HITS) -> DataFrame:
    """The k claims (claim_id, text) whose best stretches are most similar to each question (question_id, gs), with ranks.

    Claims and questions without trigrams take no part; ties go to the smaller id."""
    questions = written(questions, "asked-trigrams")
    claims = written(texts.select("claim_id", _ordered(X.tokens(F.col("text"))).alias("held")).where(F.size("held") > 0), "claim-trigrams")
    postings = claims.select("claim_id", F.explode(F.array_distinct("held")).alias("g"))
    rare = rare_prefixes(questions, postings, least, hits)
    near = rare.join(postings, "g").groupBy("question_id", "claim_id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need")
    pairs = near.select("question_id", "claim_id").join(questions, "question_id").join(claims, "claim_id").select("question_id", "claim_id", "gs", "held")
    small_batches(texts.sparkSession)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [best_extent(gs.as_py(), held.as_py(), least) for gs, held in zip(b.column("gs"), b.column("held"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("question_id"), b.column("claim_id"), pa.array(scores, pa.float64())], names=["question_id", "claim_id", "similarity"])

    found = pairs.mapInArrow(searched, "question_id long, claim_id long, similarity double").where(F.col("similarity") > 0)
    w = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "claim_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def passages(spark: SparkSession, d: str) -> DataFrame:
    """claim_id, text: the benchmark passages, which stand for short statements."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text")


def word_similarity_topk(spark, d):
    """The 20 passages whose best stretches are most similar to each question of the query set."""
    found = word_similarity(asked_trigrams(asked(spark, d)), passages(spark, d))
    q = F.col("question_id")
    return found.select((q % STRIDE).alias("question_id"), F.floor(q / STRIDE).cast("long").alias("turn"), F.col("claim_id").alias("item_id"), F.round("similarity", 6).alias("similarity"), "rank")


QUERIES = {"word_similarity_topk": word_similarity_topk}
ORACLES: dict[str, str] = {}
