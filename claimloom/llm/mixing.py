"""Mixing sources to target weights by capped water-filling.

Targets rise in proportion to the sources' weights; a source that reaches max_epochs times its size is clamped there and
its excess goes to the others by weight, until none is above. Within a source, documents in a seeded hash order are
taken whole as often as the target allows and then once more until the rest is used up; the last one taken is taken in
part (a fractional repetition), so a source's words are its target rounded down.

Everything is DataFrame operations: sums by source, a loop that brings two scalars a round to the driver, and running
sums over ranges of the hash order, so that a source with a third of all rows is spread over many tasks.

Cases: a null or empty text has size 0 and takes 0; a source without words has target 0; null is a source of its own and
the last; without words at all every target is 0; no rows give no rows; rows that repeat an id are separate documents,
ordered by id, then size, then as they come (only the operator's own, as equal rows are alike); other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import load, materialize, spread_join, unused, word_count

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
SEPARATORS = r"[\x20\x09-\x0D]+"


def ranges(df: DataFrame, order: list, label: str) -> DataFrame:
    """df dealt into consecutive ranges of an order and written, with the range's number in column pid."""
    return materialize(df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), label)


def numbered(df: DataFrame, order: list, label: str) -> DataFrame:
    """df with its place in an order, from 0, in column place; one row per range reaches the driver."""
    dealt = ranges(df, order, label)
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy(*order)) - 1)
    before, offsets = 0, []
    for row in sorted(dealt.groupBy("pid").count().collect(), key=lambda r: r["pid"]):
        offsets.append((row["pid"], before))
        before += row["count"]
    starts = df.sparkSession.createDataFrame(offsets, "pid int, before long")
    return within.join(F.broadcast(starts), "pid").withColumn("place", F.col("place") + F.col("before")).drop("pid", "before")


def running_before(df: DataFrame, group: str, order: list[str], value: str, label: str) -> DataFrame:
    """df with the sum of value over its group's earlier rows, in column before_it; groups of any size are spread."""
    dealt = ranges(df, [F.col(group), *[F.col(c) for c in order]], label)
    parts = dealt.groupBy(F.col(group).alias("__g"), F.col("pid").alias("__p")).agg(F.sum(value).alias("n"))
    earlier = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__g", "__p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"))
    inside = Window.partitionBy(group, "pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(parts, (summed[group] == parts["__g"]) & (summed["pid"] == parts["__p"]))
    return joined.withColumn("before_it", F.col("__i") + F.col("__n")).drop("__g", "__p", "__n", "__i", "pid")


def water_fill(sources: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources (with source_size, weight) and their targets, which share total by weight under the cap."""
    cap = F.col("source_size").cast("double") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    row = sources.agg(F.sum("weight").alias("w")).first()
    weight, held = float(row["w"] or 0), 0.0
    while weight > 0:
        level = (total - held) / weight
        over = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum(F.when(over, 1).otherwise(0)).alias("n")).first()
        if row["n"] == clamped:
            break
        clamped, held, weight = row["n"], row["held"], row["weight"]
    # all clamped: the level is unbounded
    target = F.least(cap, F.col("weight") * F.lit(level)) if weight > 0 else cap
    return sources.withColumn("target", target)


def _order(doc_id, seed: str):
    """The seeded hash that orders a source's documents."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and how it comes about (place of the source, order, before_it, whole,
    rest), for every row of docs."""
    size = word_count(F.col("text"), SEPARATORS)
    # the row's number parts rows that repeat an id and a size, so that no range gets all of them
    sized = materialize(docs.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "sources")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", pick), "weights")
    total = sized.agg(F.sum("size").alias("n")).first()["n"] or 0
    counts = sized.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    targets = water_fill(sources, share * total, max_epochs)
    targets = targets.join(counts, targets["source"].eqNullSafe(counts["s"])).select("source", "place", "source_size", "target", "n")
    rows = spread_join(sized, targets, "source").withColumn("order", _order(F.col("doc_id"), seed))
    placed = running_before(rows, "place", ["order", "doc_id", "size", "row"], "size", "order")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("before_it"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).alias("taken"), "place", "order", "before_it", whole.alias("whole"), rest.alias("rest"))


def mixed_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, to the nearest whole; columns as they were.

    A source's documents before a cut in its hash order are taken once more than those after it, so a row tells by itself,
    from its source's cut, how often it is taken, and no text is shuffled. Only rows that equal the cut's own in id and size
    (one, unless ids repeat) are numbered to tell which of them still fit."""
    plan = materialize(mixture(docs, seed=seed, **options), "plan")
    at = plan.where((F.col("size") > 0) & (F.col("before_it") <= F.col("rest")) & (F.col("rest") < F.col("before_it") + F.col("size"))).select("place", F.col("order").alias("cut"), F.col("size").alias("cut_size"))
    tied = plan.join(at, "place").where((F.col("order") == F.col("cut")) & (F.col("size") == F.col("cut_size")))
    ties = tied.groupBy("place", "cut", "cut_size").agg(F.min("before_it").alias("from"), F.count(F.lit(1)).alias("equal"))
    sources = plan.groupBy("source", "place", "whole", "rest").agg(F.count(F.lit(1)).alias("n"))
    cuts = materialize(sources.join(ties, "place", "left").drop("place"), "cuts")
    own = {c: u for c, u in zip(("whole", "rest", "cut", "cut_size", "from", "equal", "size", "order", "number", "tied", "times", "copy"), unused(docs.columns, *[f"mix_{c}" for c in ("whole", "rest", "cut", "cut_size", "from", "equal", "size", "order", "number", "tied", "times", "copy")]), strict=True)}
    col = {c: F.col(u) for c, u in own.items()}
    key, = unused(docs.columns, "mix_source")
    facts = cuts.select(F.col("source").alias(key), *[F.col(c).alias(own[c]) for c in ("whole", "rest", "cut", "cut_size", "from", "equal")], "n")
    rows = docs.withColumn(own["size"], word_count(F.col("text"), SEPARATORS)).withColumn(own["order"], _order(F.col("doc_id"), seed)).withColumn(key, F.col("source"))
    rows = spread_join(rows, facts, key)
    rows = rows.withColumn(own["tied"], F.coalesce((col["order"] == col["cut"]) & (col["size"] == col["cut_size"]), F.lit(False)))
    before = F.coalesce((col["order"] < col["cut"]) | ((col["order"] == col["cut"]) & (col["size"] < col["cut_size"])), F.lit(False))
    part = F.least(F.greatest(col["rest"] - col["from"] - col["number"] * col["size"], F.lit(0)), col["size"])
    nearest = F.floor(part / col["size"] + F.lit(0.5))

    def copied(some: DataFrame) -> DataFrame:
        times = F.when(col["size"] == 0, 0).when(col["tied"], col["whole"] + nearest).otherwise(col["whole"] + before.cast("int"))
        some = some.withColumn(own["times"], times.cast("int")).where(col["times"] > 0)
        return some.withColumn(own["copy"], F.explode(F.sequence(F.lit(1), col["times"]))).select(*docs.columns)

    many = col["tied"] & (col["equal"] > 1)
    out = copied(rows.where(~many).withColumn(own["number"], F.lit(0)))
    if cuts.where("equal > 1").limit(1).count() == 0:
        return out
    name, = unused([*docs.columns, *own.values()], "mix_row")
    equal = materialize(rows.where(many).withColumn(name, F.monotonically_increasing_id()), "equal-rows")
    one = F.lit(1).cast("long")
    numbers = running_before(equal.select(F.struct(F.col("source").alias("s")).alias("s"), F.col(name).alias("row"), one.alias("one")), "s", ["row"], "one", "equal-numbers")
    numbers = numbers.select(F.col("row").alias(name), F.col("before_it").alias(own["number"]))
    return out.unionByName(copied(equal.join(numbers, name)))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM src
), sums AS (
  SELECT *, cap / weight AS ratio,
    sum(cap) OVER (ORDER BY cap / weight, place) AS caps_to, sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, place) AS weight_after,
    1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM weighed
), held AS (
  -- a source is clamped if the level that clamps all before it reaches its cap
  SELECT *, (total - (caps_to - cap)) / (weight_after + weight) >= ratio AS clamped FROM sums
), lvl AS (
  SELECT (any_value(total) - coalesce(sum(cap) FILTER (clamped), 0)) / sum(weight) FILTER (NOT clamped) AS level FROM held
), targets AS (
  SELECT source, place, source_size, CASE WHEN clamped THEN cap ELSE least(cap, weight * level) END AS target FROM held, lvl
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY t.place ORDER BY md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + least(greatest(CAST(floor(target) AS BIGINT) - whole * source_size - before_it, 0), size) AS BIGINT) AS taken
FROM placed
"""
