"""License scans by ordered signature rules, on native expressions alone.

Rules (license_rules.py) are hand-written regexes over a text's lower-cased words: what license texts, headers,
identifiers, links and sentences say. Most documents hold none of the parts of words that every rule needs, and go no
further; a rule runs only where its section's keyword stands, which each of its matches holds. Of the places that rules
match, one inside another's interval goes if the outer one has the higher priority, or the same and is longer (or is
earlier in the order of rules).

The rules are one constant. Documents that hold a keyword meet the rules of its section as rows, their places become rows
of numbers, and two windows over a document's places decide: running sums of gaps and lengths give where each place
begins, and the furthest stop so far at each priority tells whether another place holds it. Only places are shuffled.

Base phrases are counted apart from the rules, in all their places, and their labels always stay.

Cases: a null or empty text has no words, no labels and score 0; repeated rows get equal results; ties of interval and
priority go to the earlier rule; a text of nothing but matches takes time in proportion to them (and their sorting); other
columns pass through or are ignored, and result columns replace kept ones of the same name."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import load, materialize, word_count
from .license_rules import BEGINNINGS, STEMS, rules

#: Phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RULE = "struct<nth: int, label: string, priority: int, confidence: double, pattern: string>"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words_text(text: Column) -> Column:
    """The words, lower-cased in A-Z, each between single spaces."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, SEPARATORS, " ")), F.lit(" "))


def _count_spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _worth_reading(text: Column) -> Column:
    """A necessary condition, on the raw text, of every base phrase and rule."""
    low = F.lower(text)
    some = [F.contains(low, F.lit(stem)) for stem in STEMS]
    some += [F.contains(low, F.lit(word)) & low.rlike(f"(?:^|[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]){word}") for word in BEGINNINGS]
    return reduce(lambda a, b: a | b, some)


def _sections() -> dict[str, list[dict]]:
    """The rules by keyword."""
    out: dict[str, list[dict]] = {}
    for r in rules():
        out.setdefault(r["keyword"], []).append({k: r[k] for k in ("nth", "label", "priority", "confidence", "pattern")})
    return out


def _constant(value, schema: str) -> Column:
    """A nested constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _places(read: DataFrame) -> DataFrame:
    """row, begin, stop and the rule of every place that a rule matches; read has row, w and the numbers of its sections."""
    by_section = _constant(list(_sections().values()), f"array<array<{RULE}>>")
    met = read.select("row", "w", F.explode(F.flatten(F.transform("sections", lambda n: F.get(by_section, n)))).alias("rule"))
    gaps, lengths = F.transform(F.split("w", F.col("rule.pattern"), -1), F.length), F.transform(F.regexp_extract_all("w", F.col("rule.pattern"), F.lit(0)), F.length)
    places = met.select("row", "rule.nth", "rule.label", "rule.priority", "rule.confidence", gaps.alias("gaps"), lengths.alias("lengths")).where(F.size("lengths") > 0)
    places = places.select("row", "nth", "label", "priority", "confidence", F.posexplode(F.zip_with(F.slice("gaps", 1, F.size("lengths")), "lengths", lambda g, n: F.struct(g.alias("gap"), n.alias("n")))).alias("k", "at"))
    so_far = Window.partitionBy("row", "nth").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("at.gap") + F.col("at.n")).over(so_far)
    return places.repartition("row").withColumn("stop", stop).withColumn("begin", F.col("stop") - F.col("at.n"))


def _kept(places: DataFrame) -> DataFrame:
    """found (labels) and certainty of the rows with places that no other suppresses.

    Sorted, a place comes after all that hold it and outrank it, so it goes if one of its priority or a higher one, met
    before, stops no earlier."""
    before = Window.partitionBy("row").orderBy("begin", F.desc("stop"), F.desc("priority"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r["priority"] for r in rules()}, reverse=True)
    furthest = F.array(*[F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(before) for level in levels])
    level = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("priority")).cast("int")
    held = F.coalesce(F.element_at("furthest", level) >= F.col("stop"), F.lit(False))
    return places.withColumn("furthest", furthest).where(~held).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("confidence").alias("certainty"))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of every row with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    keep = [c for c in keep if c not in RESULTS]
    text = F.col(f"`{text_col}`")
    named = [f"k{n}" for n in range(len(keep))]  # names that clash with none of those below
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, named, strict=True)], word_count(text, SEPARATORS).alias("n_words"), F.when(_worth_reading(text), words_text(text)).alias("w"))
    # base phrases: what stands before, between and after their places
    df = df.select(*named, "n_words", "w", *[F.when(F.instr("w", f" {phrase} ") > 0, F.split("w", f"(?<= ){phrase}(?= )", -1)).alias(f"b{n}") for n, (phrase, _) in enumerate(BASE)])
    parts = [F.col(f"b{n}") for n in range(len(BASE))]
    sizes = [len(phrase.split()) for phrase, _ in BASE]
    n_base = sum((F.when(p.isNull(), F.lit(0)).otherwise(F.size(p) - 1) for p in parts), F.lit(0))
    # a piece before a place opens and closes with a space, so it holds one space more than words
    first = F.array_min(F.array(*[_count_spaces(F.get(p, F.lit(0))) - 1 for p in parts]))
    last = F.array_max(F.array(*[F.col("n_words") - (_count_spaces(F.element_at(p, -1)) - 1) - n for p, n in zip(parts, sizes, strict=True)]))
    base = F.filter(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(parts, BASE, strict=True)]), lambda x: x.isNotNull())
    keywords = _constant(list(_sections()), "array<string>")
    numbers = F.filter(F.transform(keywords, lambda word, n: F.when(F.contains("w", word), n)), lambda n: n.isNotNull())
    df = df.select(*named, "n_words", n_base.cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), base.alias("base"), "w", F.when(F.col("w").isNotNull(), numbers).alias("sections"))
    some = F.coalesce(F.size("sections") > 0, F.lit(False))
    df = materialize(df.withColumn("w", F.when(some, F.col("w"))).withColumn("row", F.monotonically_increasing_id()), "license-words")
    read = df.where(F.col("w").isNotNull())
    plain = df.where(F.col("w").isNull()).withColumn("found", F.lit(None).cast("array<string>")).withColumn("certainty", F.lit(None).cast("double"))
    df = plain.drop("w", "sections", "row").unionByName(read.drop("w", "sections").join(_kept(_places(read)), "row", "left").drop("row"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    certainty = F.greatest(F.coalesce("certainty", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.95)).otherwise(F.lit(0.0)))
    return df.select(*[F.col(k).alias(c) for c, k in zip(keep, named, strict=True)], "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), certainty.alias("score"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"), ["doc_id"])


def oracle_sql() -> str:
    """The same in DuckDB SQL, pair by pair. Its regexes cannot look around, so every word gets a space of its own on both sides."""

    def spaced(pattern: str) -> str:
        core = pattern.removeprefix("(?<= )").removesuffix("(?= )")
        return " " + core.replace(" ?", "\x01").replace(" ", "  ").replace("\x01", "(?:  )?") + " "

    listed = ",\n".join(f"({r['nth']}, '{r['label']}', '{r['keyword'].replace(' ', '  ')}', {r['priority']}, {r['confidence']}::DOUBLE, '{spaced(r['pattern'])}')" for r in rules())
    base = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in BASE)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid FROM documents
), n AS (
  SELECT *, coalesce(array_to_string(list_transform(w, lambda x: ' ' || x || ' '), ''), '') AS n FROM d
), base(phrase, label, k) AS (VALUES {base}), b AS (
  SELECT rid, label, unnest(list_filter(range(0, greatest(len(w) - k + 1, 0)), lambda i: array_to_string(w[i + 1:i + k], ' ') = phrase)) AS pos
  FROM n, base WHERE contains(n, ' ' || replace(phrase, ' ', '  ') || ' ')
), bb AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM b GROUP BY rid
), rules(nth, label, keyword, priority, confidence, rx) AS (VALUES
{listed}
), m AS (
  SELECT rid, rules.*, regexp_extract_all(n, rx) AS ms, regexp_split_to_array(n, rx) AS ps FROM n JOIN rules ON contains(n, keyword) AND regexp_matches(n, rx)
), f AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m), g AS (
  SELECT rid, nth, label, priority, confidence, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, length(ms[i]) AS size FROM f
), k AS (
  SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.rid = g.rid AND o.s <= g.s AND o.s + o.size >= g.s + g.size
    AND (o.priority > g.priority OR (o.priority = g.priority AND (o.size > g.size OR (o.size = g.size AND o.nth < g.nth)))))
), kk AS (SELECT rid, list(DISTINCT label) AS labels, max(confidence) AS confidence FROM k GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(bb.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.labels, []), coalesce(kk.labels, [])))), ','), '') AS labels,
  greatest(coalesce(kk.confidence, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM n LEFT JOIN bb USING (rid) LEFT JOIN kk USING (rid)
"""
