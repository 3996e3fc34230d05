"""Rules that a deployment sets: thresholds by category, scopes of retrieval, retention, the breaker and the answer cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.tables import EVENTS_NOW, EVIDENCE_NOW, EVIDENCE_SQL, HALF_LIVES, claims, evidence, read
from .delta import ORACLES as DELTA_SQL, config_versions
from .evidence import ORACLES as EVIDENCE_ORACLES, POLICY, STORED_AT, derive, derive_sql, faq_candidates, faq_popularity, states_differ
from .ranges import Rule, fold

#: Groups that corroborate a claim of a category, where not the policy's; None: corroboration is disabled there.
GROUPS: dict[str, int | None] = {"1-URGENT": 3, "2-HIGH": 1, "5-LOW": None}


def category_policy_states(spark, d):
    """Every claim's verification where categories have thresholds and half-lives of their own."""
    c = derive(claims(spark, d), evidence(spark, d), POLICY, EVIDENCE_NOW, HALF_LIVES, GROUPS)
    return c.select("claim_id", "category", "verification", "support_score")


def changed_states(spark, d):
    """Claims whose whole state (verification, basis, visibility, audiences, lifecycle, score) is no longer the one stored,
    which was derived when only the evidence of its time was there."""
    c, e = claims(spark, d), evidence(spark, d)
    stored = derive(c, e.where(F.col("evidence_at") <= F.lit(STORED_AT).cast("timestamp_ntz")), POLICY, STORED_AT, HALF_LIVES)
    return states_differ(derive(c, e, POLICY, EVIDENCE_NOW, HALF_LIVES), stored)


@dataclass(frozen=True)
class Scope:
    """What a search may return; None leaves a part open. channels are those that the asking principal is in."""

    states: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    origins: tuple[str, ...] | None = None
    channels: tuple[int, ...] | None = None


def origin_of(human, tier):
    """Where evidence comes from: a person's entry, an official page, or the chat."""
    return F.when(human, "manual").when(tier >= 4, "web").otherwise("chat")


def in_scope(derived: DataFrame, evidence_df: DataFrame, scope: Scope) -> DataFrame:
    """The active claims of derived that a scope admits; its open parts add nothing to the plan."""
    c = derived.where("lifecycle = 'active'")
    if scope.states is not None:
        c = c.where(F.col("verification").isin(*scope.states))
    if scope.categories is not None:
        c = c.where(F.col("category").isin(*scope.categories))
    if scope.channels is not None:
        own = F.array(*[F.lit(x) for x in scope.channels]).cast(dict(c.dtypes)["audiences"])
        c = c.where(F.col("is_public") | F.coalesce(F.arrays_overlap("audiences", own), F.lit(False)))
    if scope.origins is not None:
        e = evidence_df.where("active").where(origin_of(F.col("human"), F.col("tier")).isin(*scope.origins))
        c = c.join(e.select("claim_id"), "claim_id", "left_semi")
    return c


SCOPE = Scope(("verified", "corroborated"), ("2-HIGH", "3-MEDIUM"), ("web", "manual"), (6,))


def scoped_claims(spark, d):
    """Settled claims of two categories with evidence from pages or people, as a principal of channel 6 sees them."""
    e = evidence(spark, d)
    return in_scope(derive(claims(spark, d), e, POLICY, EVIDENCE_NOW, HALF_LIVES), e, SCOPE).select("claim_id", "category", "verification", "is_public")


def faq_candidates_all(spark, d):
    """Entries to write: the five most cited claims and the five best supported verified public ones that have none yet; a
    claim in both counts as popular."""
    popular = faq_popularity(spark, d).select("claim_id", F.lit("popular").alias("why"))
    supported = faq_candidates(spark, d).select("claim_id", F.lit("supported").alias("why"))
    return popular.unionByName(supported).groupBy("claim_id").agg(F.min("why").alias("why"))


#: Days that context rows, log rows and usage counters are kept, and hours that a cached answer is.
CONTEXT_DAYS, LOG_DAYS, COUNTER_DAYS, CACHE_DAYS = 14, 21, 2, 2


def retention_rules(spark, d):
    """What each of the five retention rules takes at the clock: context rows that expired without evidence, the text of
    deleted messages without active evidence, old log rows, stale cached answers, old usage counters.

    Events are the rows: views are context, errors are deleted messages, sign-ups are log rows, clicks are cached answers
    (stale once their user buys: another epoch), and props.k is the observation that evidence may name."""
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    now = F.lit(EVENTS_NOW).cast("timestamp_ntz")
    before = lambda days: F.col("ts") < now - F.expr(f"INTERVAL {days} DAYS")
    ev = evidence(spark, d).groupBy(F.col("observation_id").alias("k")).agg(F.bool_or("active").alias("held"))
    known = e.join(ev, "k", "left")
    epochs = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("moved"))
    of = lambda rows, rule, does: rows.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), F.lit(does).alias("action"), "n")
    counters = e.where(before(COUNTER_DAYS)).select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).distinct()
    parts = [
        of(known.where("event_type = 'view' AND held IS NULL").where(before(CONTEXT_DAYS)), "context", "delete"),
        of(known.where("event_type = 'error' AND NOT coalesce(held, false)"), "deleted", "nullify"),
        of(e.where("event_type = 'signup'").where(before(LOG_DAYS)), "log", "delete"),
        of(e.where("event_type = 'click'").join(epochs, "user_id", "left").where(before(CACHE_DAYS) | (F.col("moved") > F.col("ts"))), "cache", "delete"),
        of(counters, "counters", "delete"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


class Breaker(Rule):
    """Opens for a while when calls fail often enough in a row: refused calls do not count; a success resets the count, so
    a failure right after the pause opens it again."""

    def __init__(self, threshold: int = 3, cooldown: int = 60):
        self.threshold, self.cooldown, self.failures, self.until, self.first, self.settled = threshold, cooldown, 0, None, None, False

    def step(self, t: int, failed: bool) -> tuple[str]:
        self.first = t if self.first is None else self.first
        if self.until is not None and t < self.until:
            return ("refused",)
        if not failed:
            self.failures = 0
            self.settled |= t >= self.first + self.cooldown  # whatever was open before has closed
            return ("ok",)
        self.failures += 1
        if self.failures >= self.threshold:
            self.until = t + self.cooldown
            return ("opened",)
        return ("failed",)


#: Seconds that the breaker of the query stays open; its events are hours apart.
COOLDOWN = 86_400


def llm_breaker(spark, d):
    """What becomes of each call (an event; errors fail) of a profile under its breaker."""
    e = read(spark, d, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") == "error").alias("failed"))
    return fold(e, ["user_id"], ["t", "event_id"], ["t", "failed"], lambda: Breaker(2, COOLDOWN), "outcome string").select("event_id", "outcome")


ANSWER = "mode string, profile long, items array<struct<claim_id: long, score: double, at: timestamp_ntz>>, tokens array<int>"
#: How an answer is written as JSON, so that times come back whole.
AS_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
TTL_DAYS = 10


def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that the cache still gives: of the profile's knowledge epoch and configuration version, young enough, and not
    kept at all where the answer was degraded or empty. They are stored as JSON and read back whole.

    Views and clicks are answers of their user's profile, an error is a degraded one; a purchase starts an epoch."""
    e = read(spark, d, "events").join(config_versions(spark, d), "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("at_epoch", F.sum((F.col("event_type") == "purchase").cast("long")).over(w))
    now = e.groupBy("user_id").agg(F.max("at_epoch").alias("epoch"), F.max_by("version", F.struct("ts", "event_id")).alias("now_version"))
    put = e.where("event_type IN ('view', 'click') AND value >= 1")
    item = F.struct(F.get_json_object("props", "$.k").cast("long").alias("claim_id"), F.round(F.col("value") / 100, 4).alias("score"), F.col("ts").alias("at"))
    answer = F.struct(F.when(F.col("event_type") == "view", "list").otherwise("extractive").alias("mode"), F.col("user_id").alias("profile"), F.array(item).alias("items"), F.array(F.lit(0), F.lit(0)).alias("tokens"))
    put = put.withColumn("response", F.to_json(answer, AS_JSON))
    key = F.sha2(F.concat_ws("\x1f", "user_id", "version", "event_type", F.get_json_object("props", "$.k")), 256)
    put = put.withColumn("cache_key", key)
    last = F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("ts"), F.desc("event_id")))
    put = put.withColumn("rn", last).where("rn = 1").join(now, "user_id")
    fresh = F.col("ts") > F.lit(EVENTS_NOW).cast("timestamp_ntz") - F.expr(f"INTERVAL {TTL_DAYS} DAYS")
    held = put.where(fresh & (F.col("at_epoch") == F.col("epoch")) & (F.col("version") == F.col("now_version"))).withColumn("a", F.from_json("response", ANSWER, AS_JSON))
    first = F.get("a.items", F.lit(0))
    return held.select("event_id", "cache_key", F.col("a.mode").alias("mode"), first["claim_id"].alias("claim_id"), first["score"].alias("score"), first["at"].alias("at"))


QUERIES = {f.__name__: f for f in (category_policy_states, changed_states, scoped_claims, faq_candidates_all, retention_rules, llm_breaker, cached_answers)}

_NEEDED = "CASE category " + " ".join(f"WHEN '{k}' THEN {'NULL' if v is None else v}" for k, v in GROUPS.items()) + " ELSE 2 END"
_STATES = lambda sql: f"(SELECT claim_id, verification, coalesce(basis, '') AS basis, is_public, audiences, lifecycle, support_score FROM {sql})"
_OLD = derive_sql(STORED_AT).replace(EVIDENCE_SQL, f"SELECT * FROM ({EVIDENCE_SQL}) WHERE evidence_at <= TIMESTAMP '{STORED_AT}'")
_BEFORE = lambda days: f"ts < TIMESTAMP '{EVENTS_NOW}' - INTERVAL {days} DAY"
ORACLES = {
    "category_policy_states": f"SELECT claim_id, category, verification, support_score FROM {derive_sql().replace('coalesce(solid.n, 0) >= 2 AS shared', f'coalesce(coalesce(solid.n, 0) >= ({_NEEDED}), false) AS shared')}",
    "changed_states": f"SELECT claim_id FROM {_STATES(derive_sql())} n JOIN {_STATES(_OLD)} o USING (claim_id) WHERE (n.verification, n.basis, n.is_public, n.audiences, n.lifecycle) <> (o.verification, o.basis, o.is_public, o.audiences, o.lifecycle) OR abs(n.support_score - o.support_score) > 1e-6::DOUBLE",
    "scoped_claims": f"""SELECT claim_id, category, verification, is_public FROM {derive_sql()} WHERE lifecycle = 'active' AND verification IN ('verified', 'corroborated') AND category IN ('2-HIGH', '3-MEDIUM')
AND (is_public OR list_contains(string_split(audiences, ','), '6')) AND claim_id IN (SELECT claim_id FROM ({EVIDENCE_SQL}) WHERE active AND (human OR tier >= 4))""",
    "faq_candidates_all": f"SELECT claim_id, min(why) AS why FROM (SELECT claim_id, 'popular' AS why FROM ({EVIDENCE_ORACLES['faq_popularity']}) UNION ALL SELECT claim_id, 'supported' FROM ({EVIDENCE_ORACLES['faq_candidates']})) GROUP BY claim_id",
    "retention_rules": f"""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), o AS (SELECT observation_id AS k, bool_or(active) AS held FROM ({EVIDENCE_SQL}) GROUP BY 1)
SELECT 'context' AS rule, 'delete' AS action, count(*) AS n FROM e WHERE event_type = 'view' AND {_BEFORE(CONTEXT_DAYS)} AND k NOT IN (SELECT k FROM o)
UNION ALL SELECT 'deleted', 'nullify', count(*) FROM e WHERE event_type = 'error' AND k NOT IN (SELECT k FROM o WHERE held)
UNION ALL SELECT 'log', 'delete', count(*) FROM e WHERE event_type = 'signup' AND {_BEFORE(LOG_DAYS)}
UNION ALL SELECT 'cache', 'delete', count(*) FROM e WHERE event_type = 'click' AND ({_BEFORE(CACHE_DAYS)} OR EXISTS (SELECT 1 FROM e b WHERE b.user_id = e.user_id AND b.event_type = 'purchase' AND b.ts > e.ts))
UNION ALL SELECT 'counters', 'delete', count(*) FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) FROM e WHERE {_BEFORE(COUNTER_DAYS)})""",
    "llm_breaker": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, event_type = 'error' AS failed, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT), event_id) AS n FROM events),
w AS (SELECT event_id, user_id, n, CASE WHEN failed THEN 1 ELSE 0 END AS failures, CAST(0 AS BIGINT) AS until, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS outcome FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.t < until THEN failures WHEN NOT failed THEN 0 ELSE failures + 1 END, CASE WHEN e.t >= until AND failed AND failures + 1 >= 2 THEN e.t + {COOLDOWN} ELSE until END,
  CASE WHEN e.t < until THEN 'refused' WHEN NOT failed THEN 'ok' WHEN failures + 1 >= 2 THEN 'opened' ELSE 'failed' END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, outcome FROM w""",
    "cached_answers": f"""WITH v AS ({DELTA_SQL['config_versions']}), e AS (SELECT events.*, version, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS at_epoch FROM events JOIN v USING (event_id)),
now AS (SELECT user_id, max(at_epoch) AS epoch, arg_max(version, row(ts, event_id)) AS now_version FROM e GROUP BY 1),
p AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM e WHERE event_type IN ('view', 'click') AND value >= 1 QUALIFY row_number() OVER (PARTITION BY user_id, version, event_type, CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_id, sha256(concat_ws(chr(31), user_id, version, event_type, k)) AS cache_key, CASE event_type WHEN 'view' THEN 'list' ELSE 'extractive' END AS mode, k AS claim_id, round(value / 100, 4) AS score, ts AS at
FROM p JOIN now USING (user_id) WHERE ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL {TTL_DAYS} DAY AND at_epoch = epoch AND version = now_version""",
}
