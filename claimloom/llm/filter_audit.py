"""Audit of how five text filters interact: what each removes alone, after the others, and on average over all orders.

Native expressions turn each text into a mask of the filters that it fails; copies are found by a groupBy of the texts'
SHA-256 digests, which supplies the least doc_id of each text. Rows collapse to counts before every shuffle, so neither a
text that a third of all rows share nor a hot part meets one task. At most 32 cells a part remain (one for each mask);
all permutations of the filters are enumerated from these.

Filters (bit of the mask): A (1) under 100 words; B (2) few distinct words; C (4) many capitals; D (8) a symbol;
E (16) the same text under a smaller doc_id anywhere in the table.

Cases: a null text is empty, and equal to other empty ones; a null lang and an empty one are the part ''; a null doc_id
is no smaller and no larger than another, so such rows never fail E and have no labels; rows that repeat an id are
separate documents, of which none is a copy of another of the same id; a document counts as good (toxic) if one of its
label rows says so, and once; no rows give no rows; other columns are ignored."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import load, small_batches, word_count

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"
SEPARATORS = r"[\x20\x09-\x0D]+"
COPY = 16


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.split(text, SEPARATORS, -1)
    open_end = (F.get(words, F.lit(0)) == "") | (F.element_at(words, -1) == "")
    distinct = F.size(F.array_distinct(words)) - F.when(open_end, 1).otherwise(0)
    n_words = word_count(text, SEPARATORS)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = (n_words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n_words, 100 * capitals > MAX_CAPITAL_PERCENT * F.length(text), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << n).otherwise(0) for n, f in enumerate(failed)), F.lit(0))


def label_flags(labels: DataFrame) -> DataFrame:
    """good and toxic of every labelled doc_id."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(flag("quality")("good"), flag("toxic")("toxic"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cell (mask of the failed filters), n, good and toxic: at most 32 rows a part."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(text).alias("mask"))
    rows = facts.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # rows without an id have no labels: they are dealt out by their text
    rows = rows.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    rows = rows.join(label_flags(labels.withColumn("doc_id", F.col("doc_id").cast("long"))).withColumn("deal", F.lit(0).cast("long")), ["doc_id", "deal"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    kinds = ["digest", "part", "mask", "good", "toxic"]
    # of each text, one row a part, mask and label: all its rows, its rows without an id, and those of its least id
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = rows.select("doc_id", "digest", "part", "mask", *flags, "n").groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"), least.alias("least"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    by_text = by_text.withColumn("kept", F.col("free") + F.when(first, F.col("least.n")).otherwise(0))
    sums = by_text.groupBy("part", "mask", "good", "toxic").agg(F.sum("kept").alias("kept"), F.sum(F.col("n") - F.col("kept")).alias("copies"))
    both = F.explode(F.array(F.struct(F.col("mask").alias("cell"), F.col("kept").alias("n")), F.struct((F.col("mask") + COPY).alias("cell"), F.col("copies").alias("n"))))
    flat = sums.select("part", "good", "toxic", both.alias("c")).select("part", "good", "toxic", "c.cell", "c.n").where("n > 0")
    return flat.groupBy("part", "cell").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def orders(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every filter does at every place of every order, from the cells of each part."""
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))
    every = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = by_part.select("part", "cells", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), letter) - 1)
    letters = F.split("filter_order", "(?!^|$)")
    earlier = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, x: acc.bitwiseOR(bit_of(x)))
    steps = steps.withColumn("bit", bit_of(F.element_at(letters, F.col("step")))).withColumn("before", earlier)
    bit, before = F.col("bit"), F.col("before")

    def total(where, of: str = "n", times=None) -> Column:
        value = lambda c: c[of] if times is None else c[of] * times(c["cell"])
        return F.aggregate(F.filter("cells", lambda c: where(c["cell"])), F.lit(0).cast("long"), lambda acc, c: acc + value(c))

    fails = lambda cell: cell.bitwiseAND(bit) != 0
    gone = lambda cell: cell.bitwiseAND(before) != 0
    removed = lambda cell: fails(cell) & ~gone(cell)
    # a cell with k failed filters meets each of them first in 1/k of the orders
    n_orders = 1
    for k in range(2, len(filters) + 1):
        n_orders *= k
    turns = lambda cell: F.floor(F.lit(n_orders) / F.bit_count(cell)).cast("long")
    return steps.select(
        "part", "filter_order", "step", total(lambda c: ~fails(c) & ~gone(c)).alias("kept"), total(removed).alias("removed"), total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c == bit).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), total(fails, times=turns).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(cells(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


ORACLE_SQL = r"""
WITH lab AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fails AS (
  SELECT t.doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM t LEFT JOIN lab ON t.doc_id = lab.doc_id
), rows AS (
  SELECT part, list_concat(CASE WHEN a THEN ['A'] ELSE [] END, CASE WHEN b THEN ['B'] ELSE [] END, CASE WHEN c THEN ['C'] ELSE [] END, CASE WHEN d THEN ['D'] ELSE [] END, CASE WHEN e THEN ['E'] ELSE [] END) AS f,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL
), l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), judged AS (
  SELECT *, list_contains(f, letter) AS fail, len(list_filter(f, lambda x: contains(earlier, x))) > 0 AS gone FROM rows, steps
), summed AS (
  SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fail AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fail AND len(f) = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM summed
"""
