"""The question set, the claims, and positional postings: cover density, the density of the minimal intervals of a claim
that hold all of a question's words that the claim has."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.tables import read
from ..session import scratch_path
from .texts import content_sql, is_content_sql, tokens_sql

#: What an interval without other words between its matches adds to a claim's density.
COVER_WEIGHT = 0.1
#: Places that are swept at a time.
PLACES = 1 << 20
#: Conversations whose user turns are the query set: those of an id divisible by this.
ASKED = 20
#: question_id is conv_id + turn * STRIDE, claim_id of a document doc_id + STRIDE. Ids are taken to lie in 0 .. STRIDE - 1; a
#: multiple of 12 leaves their remainders by 2, 3 and 4.
STRIDE = 12 << 36


def asked(spark: SparkSession, d: str) -> DataFrame:
    """question_id, text: the user turns of the query set."""
    c = read(spark, d, "conversations").where(f"role = 'user' AND conv_id % {ASKED} = 0")
    return c.select((F.col("conv_id") + F.col("turn") * STRIDE).alias("question_id"), "text")


def claims(spark: SparkSession, d: str) -> DataFrame:
    """claim_id, text: the benchmark passages and all documents."""
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    return b.unionByName(read(spark, d, "documents").select((F.col("doc_id") + STRIDE).alias("claim_id"), "text"))


def written(df: DataFrame, label: str) -> DataFrame:
    """df in the shared folder: what several steps read is computed once."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parted(df: DataFrame) -> DataFrame:
    """question_id and claim_id as conversation, turn, table and id."""
    q, c = F.col("question_id"), F.col("claim_id")
    ids = {"question_id": [(q % STRIDE).alias("question_id"), F.floor(q / STRIDE).cast("long").alias("turn")], "claim_id": [F.when(c >= STRIDE, "documents").when(c >= 0, "benchmark").alias("source"), (c % STRIDE).alias("claim_id")]}
    return df.select(*[x for n in df.columns for x in ids.get(n, [F.col(n)])])


def prefix_matches(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(q, token): the distinct tokens that begin with each word q; written.

    Every distinct token goes out under each of its beginnings, so the join is one of equal words, and a word gets no
    other rows than its matches."""
    vocabulary = tokens.distinct()
    longest = words.agg(F.max(F.length("q")).alias("n")).first()["n"] or 0
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(longest))), lambda n: F.substring("token", F.lit(1), n))
    beginnings = vocabulary.where(F.length("token") > 0).select("token", F.explode(starts).alias("q")) if longest else vocabulary.select("token", F.col("token").alias("q")).limit(0)
    return written(beginnings.join(words.distinct(), "q"), "matches")


def density(places: list[np.ndarray], weight: float = COVER_WEIGHT) -> float:
    """The sum over all minimal intervals that hold each word of weight / (1 + other places between their first and last).

    places has the sorted places of each word. A sweep over all places takes the latest place of every word up to there:
    the least of them opens the tightest interval that closes there, which is minimal if no earlier one opens as late."""
    every = np.unique(np.concatenate(places))
    latest = []
    for own in places:
        at = np.searchsorted(own, every, side="right") - 1
        latest.append(np.where(at >= 0, own[np.maximum(at, 0)], -1))
    opens = np.min(latest, axis=0)
    minimal = opens > np.concatenate([[-1], opens[:-1]])
    opens, closes = opens[minimal], every[minimal]
    matched = np.searchsorted(every, closes) - np.searchsorted(every, opens)
    return float((weight / (1 + closes - opens - matched)).sum())


def densities(n: int, pair: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """density() of n pairs at once, to six places: posting number i holds the places at[first[i] : first[i] + size[i]] of
    one word of its pair; the pairs of postings ascend."""
    total, held = np.bincount(pair, size, minlength=n), np.bincount(pair, minlength=n)
    out, starts = np.zeros(n), np.cumsum(held) - held
    part = (np.cumsum(total) // PLACES).astype(np.int64)
    for some in np.split(np.arange(n), np.flatnonzero(np.diff(part)) + 1) if n else []:
        some = some[np.argsort(-held[some], kind="stable")]  # those with many words first, so a word's turn is a prefix
        posting = np.repeat(starts[some] - (np.cumsum(held[some]) - held[some]), held[some]) + np.arange(held[some].sum())
        local = np.repeat(np.arange(len(some)), held[some])
        word = np.arange(len(posting)) - np.repeat(np.cumsum(held[some]) - held[some], held[some])
        each = np.repeat(np.arange(len(posting)), size[posting])
        place = at[np.arange(len(each)) + np.repeat(first[posting] - (np.cumsum(size[posting]) - size[posting]), size[posting])]
        width = int(place.max(initial=0)) + 1
        every, where = np.unique(local[each] * width + place, return_inverse=True)
        owner, spot = np.divmod(every, width)
        begins = np.searchsorted(owner, np.arange(len(some)))
        opens = np.full(len(every), len(every))
        by_word = np.argsort(word[each], kind="stable")
        cuts = np.searchsorted(word[each][by_word], np.arange(held[some].max(initial=0) + 1))
        for w in range(len(cuts) - 1):
            end = np.searchsorted(owner, np.searchsorted(-held[some], -w, side="left"))
            latest = np.full(end, -1)
            mine = where[by_word[cuts[w] : cuts[w + 1]]]
            latest[mine] = mine
            np.minimum(opens[:end], np.maximum.accumulate(latest), out=opens[:end])
        opens[opens < begins[owner]] = -1
        minimal = np.flatnonzero((opens >= 0) & (opens > np.concatenate([[-1], opens[:-1]])))
        gaps = spot[minimal] - spot[opens[minimal]] - (minimal - opens[minimal])
        out[some] = np.bincount(owner[minimal], COVER_WEIGHT / (1 + gaps), minlength=len(some))
    return np.floor(out * 1e6 + 0.5) / 1e6


def whole_sql(columns: str, sql: str, among: str = "true") -> str:
    """A query's SQL over the query set's user turns and over passages and documents fit for among."""
    q, c = f"question_id % {STRIDE} AS question_id, question_id // {STRIDE} AS turn", f"CASE WHEN claim_id >= {STRIDE} THEN 'documents' WHEN claim_id >= 0 THEN 'benchmark' END AS source, claim_id % {STRIDE} AS claim_id"
    return f"""WITH conversations AS (SELECT conv_id + turn * {STRIDE} AS conv_id, 0 AS turn, role, text FROM main.conversations WHERE conv_id % {ASKED} = 0), benchmark AS (SELECT * FROM (SELECT item_id, text FROM main.benchmark UNION ALL SELECT doc_id + {STRIDE}, text FROM main.documents) WHERE {among})
SELECT {q}, {c}, {columns} FROM ({sql})"""


QUESTIONS_SQL = f"(SELECT conv_id AS question_id, list_distinct({content_sql('text')}) AS tokens FROM conversations WHERE role = 'user' AND turn = 0)"
FTS_SQL = f"""(WITH q AS (SELECT question_id, unnest(tokens) AS q FROM {QUESTIONS_SQL}), c AS (SELECT item_id AS claim_id, {content_sql('text')} AS t FROM benchmark),
p AS (SELECT claim_id, token, count(*) AS tf, any_value(n) AS n FROM (SELECT claim_id, len(t) AS n, unnest(t) AS token FROM c) GROUP BY claim_id, token),
h AS (SELECT question_id, claim_id, count(DISTINCT q) AS matched, round(sum(tf / (1.0::DOUBLE + ln(n::DOUBLE))), 6) AS weight FROM q JOIN p ON starts_with(token, q) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY matched DESC, weight DESC, claim_id) AS INT) AS rank FROM h QUALIFY rank <= 20)"""
#: Every interval that closes at a place and opens at the latest place of the rarest word, for all pairs of questions and claims.
COVER_SQL = f"""(WITH q AS (SELECT question_id, unnest(tokens) AS q FROM {QUESTIONS_SQL}), c AS (SELECT item_id AS claim_id, {tokens_sql('text')} AS t FROM benchmark),
p AS (SELECT claim_id, token, pos FROM (SELECT claim_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM c) WHERE {is_content_sql('token')}),
v AS (SELECT DISTINCT q, token FROM (SELECT DISTINCT q FROM q) JOIN (SELECT DISTINCT token FROM p) ON starts_with(token, q)),
e AS (SELECT DISTINCT question_id, claim_id, q, pos FROM q JOIN v USING (q) JOIN p USING (token)),
m AS (SELECT question_id, claim_id, q, count(*) OVER (PARTITION BY question_id, claim_id) AS matched FROM (SELECT DISTINCT question_id, claim_id, q FROM e)),
s AS (SELECT question_id, claim_id, pos, row_number() OVER (PARTITION BY question_id, claim_id ORDER BY pos) AS n FROM (SELECT DISTINCT question_id, claim_id, pos FROM e)),
l AS (SELECT s.question_id, s.claim_id, s.pos, s.n, m.matched, max(e.pos) OVER (PARTITION BY s.question_id, s.claim_id, m.q ORDER BY s.pos) AS latest
  FROM s JOIN m USING (question_id, claim_id) LEFT JOIN e ON e.question_id = s.question_id AND e.claim_id = s.claim_id AND e.q = m.q AND e.pos = s.pos),
i AS (SELECT question_id, claim_id, matched, pos AS closes, n, min(latest) AS opens FROM l GROUP BY ALL HAVING count(latest) = matched),
x AS (SELECT *, lag(opens) OVER (PARTITION BY question_id, claim_id ORDER BY closes) AS earlier FROM i),
y AS (SELECT x.*, s.n AS first FROM x JOIN s ON s.question_id = x.question_id AND s.claim_id = x.claim_id AND s.pos = x.opens WHERE earlier IS NULL OR opens > earlier),
h AS (SELECT question_id, claim_id, matched, round(sum(0.1::DOUBLE / (1 + (closes - opens) - (n - first))), 6) AS density FROM y GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY matched DESC, density DESC, claim_id) AS INT) AS rank FROM h QUALIFY rank <= 20)"""
