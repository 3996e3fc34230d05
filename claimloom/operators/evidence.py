"""Evidence to derived claim state: weights, group-capped support, verification, visibility, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.tables import CLAIMS_SQL, EVENTS_NOW, EVIDENCE_NOW, EVIDENCE_SQL, HALF_LIVES, claims, evidence, read


@dataclass(frozen=True)
class ScoringPolicy:
    """Fixed values of the scoring policy."""

    tier_weights: tuple[float, ...] = (0.0, 0.25, 0.5, 0.8, 1.0)
    half_life_days: float | None = 900.0
    freshness_floor: float = 0.2
    version_penalty: float = 0.4
    quote_penalty: float = 0.5
    community_cap: float = 1.2
    corroborated_groups: int = 2
    trusted_groups: int = 3
    corroboration_verifies: bool = False
    endorsement_verifies: bool = True
    stance_factor: float = 0.5


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a double, from microseconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)).cast("double") / F.lit(86400000000.0)


def freshness(age_days: Column, half_life: float | None, floor: float) -> Column:
    """One half per half-life, no less than floor; 1 without a half-life."""
    if not half_life or half_life <= 0:
        return F.lit(1.0)
    return F.greatest(F.lit(floor), F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / F.lit(half_life)))


def weight(policy: ScoringPolicy, now: Column, human: Column | None = None, half_life: float | None | str = "policy") -> Column:
    """The weight of an evidence row; a quote need not be verified where a human gave the evidence."""
    tiers = F.array(*[F.lit(w) for w in policy.tier_weights])
    days = policy.half_life_days if half_life == "policy" else half_life
    w = F.get(tiers, F.col("tier")) * freshness(days_between(now, F.col("evidence_at")), days, policy.freshness_floor)
    w = w * F.when(F.col("version_match") == F.lit(False), F.lit(policy.version_penalty)).otherwise(F.lit(1.0))
    quoted = F.col("quote_verified") if human is None else F.col("quote_verified") | human
    return w * F.when(quoted, F.lit(1.0)).otherwise(F.lit(policy.quote_penalty))


def _supported(evidence_df: DataFrame, policy: ScoringPolicy, clocks: tuple[str, ...], half_lives: list[float | None]) -> DataFrame:
    """Per claim what its active evidence adds up to; s_sup and s_con hold a row of half-lives for each clock.

    Two levels of aggregation: the best row of each independence group, then the groups' sums. All clocks and half-lives
    are weighed in the one pass over evidence, and both levels combine before they shuffle, so that a claim with a large
    part of all rows arrives as one row per group and task."""
    e = evidence_df.where("active")
    for name, kind in (("endorser_tier", "int"), ("human", "boolean")):
        if name not in e.columns:
            e = e.withColumn(name, F.lit(None).cast(kind))
    human = F.coalesce(F.col("human"), F.lit(False))
    kinds = [(c, h) for c in range(len(clocks)) for h in range(len(half_lives))]
    best = [F.max(weight(policy, F.lit(clocks[c]).cast("timestamp_ntz"), human, half_lives[h])).alias(f"best_{c}_{h}") for c, h in kinds]
    groups = e.groupBy("claim_id", "stance", "grp").agg(
        *best,
        F.max("tier").alias("gtier"),
        F.max(F.when(F.col("tier") >= 4, F.col("evidence_at"))).alias("official_at"),
        F.max("evidence_at").alias("last_at"),
        F.max("endorser_tier").alias("endorser"),
        F.bool_or(F.col("audience").isNull()).alias("open"),
        F.collect_set("audience").alias("audiences"),
        F.count(F.lit(1)).alias("rows"),
    )
    sup, con = F.col("stance") == "supports", F.col("stance") == "contradicts"

    def total(stance: Column, c: int, h: int) -> Column:
        strong = F.sum(F.when(stance & (F.col("gtier") > 2), F.col(f"best_{c}_{h}")).otherwise(0.0))
        community = F.sum(F.when(stance & (F.col("gtier") <= 2), F.col(f"best_{c}_{h}")).otherwise(0.0))
        return strong + F.least(community, F.lit(policy.community_cap))

    rows = lambda stance: F.array(*[F.array(*[total(stance, c, h) for h in range(len(half_lives))]) for c in range(len(clocks))])
    return groups.groupBy("claim_id").agg(
        rows(sup).alias("s_sup"),
        rows(con).alias("s_con"),
        F.sum(F.when(sup & (F.col("gtier") >= 2), 1).otherwise(0)).alias("groups_2"),
        F.sum(F.when(sup & (F.col("gtier") >= 3), 1).otherwise(0)).alias("groups_3"),
        F.sum(F.when(con, F.col("rows")).otherwise(0)).alias("n_con"),
        F.sum(F.when(sup, F.col("rows")).otherwise(0)).alias("n_sup"),
        F.max(F.when(sup, F.col("official_at"))).alias("official_sup"),
        F.max(F.when(con, F.col("official_at"))).alias("official_con"),
        F.max(F.when(sup, F.col("endorser"))).alias("endorser"),
        F.max("last_at").alias("last_evidence_at"),
        F.coalesce(F.bool_or(F.when(sup, F.col("open"))), F.lit(False)).alias("open_support"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(sup, F.col("audiences")))))).alias("audiences"),
    )


def derive_at(claims_df: DataFrame, evidence_df: DataFrame, policy: ScoringPolicy, clocks: tuple[str, ...], half_lives: dict[str, float | None] | None = None, groups: dict[str, int | None] | None = None) -> DataFrame:
    """claims_df (claim_id, human_verified, open_conflict) with verification, basis, scores (one per clock), visibility,
    lifecycle and its reason. A claim without active evidence stays, and is retracted if it was active and no human
    verified it. half_lives and groups give categories their own half-life and number of groups that corroborate (None: none ever do);
    others have the policy's."""
    half_lives = half_lives or {}
    kinds = sorted({policy.half_life_days, *half_lives.values()}, key=lambda x: (x is None, x or 0))
    per = _supported(evidence_df, policy, clocks, kinds)
    d = claims_df.join(per, "claim_id", "left")
    for c in ("groups_2", "groups_3", "n_con", "n_sup"):
        d = d.withColumn(c, F.coalesce(c, F.lit(0)))
    d = d.withColumn("audiences", F.coalesce("audiences", F.array().cast(dict(per.dtypes)["audiences"])))
    kind = F.lit(kinds.index(policy.half_life_days))
    for category, days in half_lives.items():
        kind = F.when(F.col("category") == category, F.lit(kinds.index(days))).otherwise(kind)
    summed = lambda name, c: F.coalesce(F.get(F.get(F.col(name), F.lit(c)), kind), F.lit(0.0))
    scores = F.array(*[F.round(summed("s_sup", c) - F.lit(policy.stance_factor) * summed("s_con", c), 6) for c in range(len(clocks))])
    official = F.col("official_sup").isNotNull() & (F.col("official_con").isNull() | (F.col("official_sup") > F.col("official_con")))
    endorsed = F.coalesce(F.col("endorser") >= 3, F.lit(False)) & F.lit(policy.endorsement_verifies)
    trusted = F.lit(policy.corroboration_verifies) & (F.col("groups_3") >= policy.trusted_groups) & (F.col("n_con") == 0)
    needed = F.lit(policy.corroborated_groups)
    for category, n in (groups or {}).items():
        needed = F.when(F.col("category") == category, F.lit(n).cast("int")).otherwise(needed)
    verification = (
        F.when(F.col("human_verified"), "verified").when(F.col("open_conflict"), "disputed").when(endorsed, "verified").when(official, "verified").when(trusted, "verified")
        .when(F.col("groups_2") >= needed, "corroborated").otherwise("unverified")
    )
    basis = (
        F.when(F.col("human_verified"), "human").when(F.col("open_conflict"), F.lit(None)).when(endorsed, "human").when(official, "official_source").when(trusted, "corroboration")
    )
    was = F.col("lifecycle") if "lifecycle" in claims_df.columns else F.lit("active")
    retracted = (was == "active") & (F.col("n_sup") == 0) & ~F.col("human_verified")
    return d.select(
        *[c for c in claims_df.columns if c != "lifecycle"],
        was.alias("was_lifecycle"),
        F.when(retracted, "retracted").otherwise(was).alias("lifecycle"),
        F.when(retracted, "no_evidence").alias("lifecycle_reason"),
        verification.alias("verification"),
        basis.alias("basis"),
        scores.alias("scores"),
        (F.coalesce("open_support", F.lit(False)) | (F.col("human_verified") & (F.size("audiences") == 0))).alias("is_public"),
        F.col("audiences"),
        F.col("last_evidence_at"),
        F.col("n_sup").cast("long").alias("n_sup"),
        F.col("n_con").cast("long").alias("n_con"),
    )


def derive(claims_df: DataFrame, evidence_df: DataFrame, policy: ScoringPolicy, now: str, half_lives: dict[str, float | None] | None = None, groups: dict[str, int | None] | None = None) -> DataFrame:
    """derive_at one clock, with support_score."""
    return derive_at(claims_df, evidence_df, policy, (now,), half_lives, groups).withColumn("support_score", F.get("scores", F.lit(0))).drop("scores")


POLICY = ScoringPolicy()


def _derived(spark: SparkSession, d: str, now: str = EVIDENCE_NOW) -> DataFrame:
    return derive(claims(spark, d), evidence(spark, d), POLICY, now, HALF_LIVES)


#: Rows of evidence with their weight at a clock, row by row, from the definition of the weight.
def _weighed_sql(now: str) -> str:
    days = "CASE category " + " ".join(f"WHEN '{c}' THEN {'NULL' if h is None else f'{h}::DOUBLE'}" for c, h in HALF_LIVES.items()) + f" ELSE {POLICY.half_life_days}::DOUBLE END"
    return f"""SELECT e.*, [0.0, 0.25, 0.5, 0.8, 1.0][tier + 1]::DOUBLE
    * CASE WHEN ({days}) IS NULL THEN 1.0::DOUBLE ELSE greatest(0.2::DOUBLE, pow(0.5::DOUBLE, greatest((epoch_us(TIMESTAMP '{now}') - epoch_us(evidence_at))::DOUBLE / 86400000000.0::DOUBLE, 0.0::DOUBLE) / ({days}))) END
    * if(version_match IS NOT NULL AND NOT version_match, 0.4::DOUBLE, 1.0::DOUBLE) * if(quote_verified OR human, 1.0::DOUBLE, 0.5::DOUBLE) AS w
  FROM ({EVIDENCE_SQL}) e LEFT JOIN ({CLAIMS_SQL}) c USING (claim_id) WHERE active"""


def derive_sql(now: str = EVIDENCE_NOW) -> str:
    """A SELECT of the derived claims in DuckDB SQL, fact by fact: each a scalar subquery's join over all claims."""
    return f"""(WITH cl AS ({CLAIMS_SQL}), ev AS ({_weighed_sql(now)}),
score AS (SELECT claim_id, sum(CASE stance WHEN 'supports' THEN s ELSE -0.5::DOUBLE * s END) AS score FROM (
  SELECT claim_id, stance, sum(CASE WHEN top > 2 THEN best ELSE 0.0::DOUBLE END) + least(sum(CASE WHEN top > 2 THEN 0.0::DOUBLE ELSE best END), 1.2::DOUBLE) AS s FROM (
    SELECT claim_id, stance, grp, max(w) AS best, max(tier) AS top FROM ev GROUP BY ALL) GROUP BY ALL) GROUP BY claim_id),
official AS (SELECT claim_id, max(evidence_at) FILTER (stance = 'supports') AS yes, max(evidence_at) FILTER (stance = 'contradicts') AS no FROM ev WHERE tier >= 4 GROUP BY claim_id),
solid AS (SELECT claim_id, count(DISTINCT grp) AS n FROM ev WHERE stance = 'supports' AND tier >= 2 GROUP BY claim_id),
counts AS (SELECT claim_id, count(*) FILTER (stance = 'supports') AS n_sup, count(*) FILTER (stance = 'contradicts') AS n_con, max(evidence_at) AS last_evidence_at FROM ev GROUP BY claim_id),
seen AS (SELECT claim_id, bool_or(audience IS NULL) AS open, string_agg(DISTINCT CAST(audience AS VARCHAR), ',' ORDER BY CAST(audience AS VARCHAR)) FILTER (audience IS NOT NULL) AS audiences FROM ev WHERE stance = 'supports' GROUP BY claim_id),
state AS (SELECT cl.*, human_verified AS by_human, open_conflict AS fought, coalesce(yes > coalesce(no, TIMESTAMP '0001-01-01'), false) AS by_source, coalesce(solid.n, 0) >= 2 AS shared,
    coalesce(score, 0.0::DOUBLE) AS score, coalesce(n_sup, 0) AS n_sup, coalesce(n_con, 0) AS n_con, last_evidence_at, coalesce(open, false) AS open, coalesce(audiences, '') AS audiences
  FROM cl LEFT JOIN score USING (claim_id) LEFT JOIN official USING (claim_id) LEFT JOIN solid USING (claim_id) LEFT JOIN counts USING (claim_id) LEFT JOIN seen USING (claim_id))
SELECT claim_id, author_id, category, created_at, human_verified, open_conflict, lifecycle AS was_lifecycle,
  CASE WHEN lifecycle = 'active' AND n_sup = 0 AND NOT by_human THEN 'retracted' ELSE lifecycle END AS lifecycle, CASE WHEN lifecycle = 'active' AND n_sup = 0 AND NOT by_human THEN 'no_evidence' END AS lifecycle_reason,
  CASE WHEN by_human THEN 'verified' WHEN fought THEN 'disputed' WHEN by_source THEN 'verified' WHEN shared THEN 'corroborated' ELSE 'unverified' END AS verification,
  CASE WHEN by_human THEN 'human' WHEN NOT fought AND by_source THEN 'official_source' END AS basis, round(score, 6) AS support_score, open OR (by_human AND audiences = '') AS is_public,
  audiences, last_evidence_at, CAST(n_sup AS BIGINT) AS n_sup, CAST(n_con AS BIGINT) AS n_con FROM state)"""


def evidence_derive(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: every claim's state from its evidence."""
    out = _derived(spark, d)
    return out.select("claim_id", "lifecycle", "lifecycle_reason", "verification", "basis", "support_score", "is_public", F.array_join("audiences", ",").alias("audiences"), "last_evidence_at", "n_sup", "n_con")


def evidence_weight_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every active row's weight under its claim's category; without a claim, under the policy's half-life."""
    c = claims(spark, d).select("claim_id", "category")
    e = evidence(spark, d).where("active").join(c, "claim_id", "left")
    now = F.lit(EVIDENCE_NOW).cast("timestamp_ntz")
    w = weight(POLICY, now, F.col("human"))
    for category, days in HALF_LIVES.items():
        w = F.when(F.col("category") == category, weight(POLICY, now, F.col("human"), days)).otherwise(w)
    return e.select("claim_id", "line", F.round(w, 6).alias("weight"))


#: The clock of the stored state that a recompute compares with.
STORED_AT = "2001-01-01 00:00:00"


def recompute_changed_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that a recompute changes: their score since the stored clock, or their lifecycle, as unsupported ones are retracted.

    Verification, basis, visibility and audiences follow from the evidence alone, so the clock moves none of them here;
    states_differ compares all of them where a stored table is given."""
    c = derive_at(claims(spark, d), evidence(spark, d), POLICY, (STORED_AT, EVIDENCE_NOW), HALF_LIVES)
    old, new = F.get("scores", F.lit(0)), F.get("scores", F.lit(1))
    changed = (F.abs(new - old) > 1e-6) | (F.col("lifecycle") != F.col("was_lifecycle"))
    return c.where(changed).select("claim_id", "lifecycle", F.col("lifecycle_reason").alias("reason"), "verification", "basis", old.alias("was"), new.alias("support_score"))


def states_differ(new: DataFrame, stored: DataFrame) -> DataFrame:
    """claim_id of the rows of new (a derivation) whose verification, basis, visibility, audiences, lifecycle or score
    (beyond 1e-6) is not the stored one; audiences in any order."""
    s = stored.select("claim_id", *[F.col(c).alias(f"__{c}") for c in ("verification", "basis", "is_public", "audiences", "lifecycle", "support_score")])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("verification", "basis", "is_public", "lifecycle")]
    same += [F.array_sort("audiences").eqNullSafe(F.array_sort("__audiences")), F.abs(F.col("support_score") - F.col("__support_score")) <= 1e-6]
    all_same = same[0]
    for x in same[1:]:
        all_same = all_same & x
    return new.join(s, "claim_id").where(~all_same).select("claim_id")


def epoch_bumps(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge epoch of each profile (a claim's author's nation): how many of its claims a recompute changes."""
    profile = read(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_nationkey").alias("profile_id"))
    owned = claims(spark, d).select("claim_id", "author_id").join(profile, "author_id").select("claim_id", "profile_id")
    return recompute_changed_claims(spark, d).join(owned, "claim_id").groupBy("profile_id").agg(F.count(F.lit(1)).alias("epoch"))


#: Versions and the day from which each counts (fixed values of the example timeline).
TIMELINE = (("1.0", "1995-01-01"), ("1.1", "1996-06-01"), ("2.0", "1998-03-15"), ("2.1", "1999-11-01"), ("3.0", "2001-02-01"))


def version_asof(spark: SparkSession, d: str) -> DataFrame:
    """The version in force when each claim was made: union with the timeline, then the last version seen.

    One shuffle by nothing at all: the timeline is five rows, so it is a literal and the lookup an expression."""
    c = claims(spark, d)
    version = F.lit(None).cast("string")
    for name, start in TIMELINE:
        version = F.when(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"), F.lit(name)).otherwise(version)
    return c.select("claim_id", version.alias("version"))


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the latest value of right at or before its time, by key: a union, then the last value in time order."""
    marked = left.select(*left.columns, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"))
    given = right.select(*[F.col(on) if c == on else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.unionByName(given).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__t", "__side", "__v")


def asof_price(spark: SparkSession, d: str) -> DataFrame:
    """As-of join at scale: each event's last purchase value of the same user at or before it."""
    ev = read(spark, d, "events").select("event_id", "user_id", "ts")
    buys = read(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return asof_join(ev, buys, "user_id", "ts", "ts", "last_value").select("event_id", "last_value")


def stale_version_flag(spark: SparkSession, d: str) -> DataFrame:
    """Claims of volatile categories none of whose versioned support is of the current version."""
    volatile = claims(spark, d).where(F.col("category").isin("1-URGENT", "2-HIGH")).select("claim_id", "category")
    e = evidence(spark, d).where("active AND stance = 'supports' AND version_match IS NOT NULL")
    flags = e.groupBy("claim_id").agg((~F.bool_or("version_match")).alias("stale"))
    return volatile.join(flags, "claim_id", "left").select("claim_id", "category", F.coalesce("stale", F.lit(False)).alias("stale"))


def visibility_filter(spark: SparkSession, d: str) -> DataFrame:
    """Claims visible to a principal of two channels: public, or an audience that the principal is in."""
    allowed = F.array(F.lit(6), F.lit(7))
    c = _derived(spark, d)
    seen = F.col("is_public") | F.coalesce(F.arrays_overlap("audiences", allowed), F.lit(False))
    return c.where(F.col("lifecycle") == "active").where(seen).select("claim_id", "verification", "is_public")


def top_sources_per_claim(spark: SparkSession, d: str) -> DataFrame:
    """Three best sources a claim by tier, then date, line and source; the rank limit also prunes before the shuffle.

    Lines may repeat within a claim. The SQL leaves such ties open; by the source, reruns agree."""
    e = evidence(spark, d).where("active AND stance = 'supports'").where(F.col("audience").isNull() | F.col("audience").isin(6))
    w = Window.partitionBy("claim_id").orderBy(F.desc("tier"), F.desc("evidence_at"), "line", "grp")
    top = e.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("grp"), F.col("s_name").alias("source"))
    return top.join(s, "grp", "left").select("claim_id", "rn", "source", "tier", "evidence_at")


def conflict_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Everything in an open conflict with a claim, as membership: each member with its conflict, the conflict's size and
    least claim. The members of a conflict are each other's conflicting claims; pairs would grow with the square.

    Conflict: the orders of a customer that are in conflict."""
    m = claims(spark, d).where("open_conflict").select(F.col("author_id").alias("conflict_id"), "claim_id").distinct()
    per = m.groupBy("conflict_id").agg(F.count(F.lit(1)).alias("size"), F.min("claim_id").alias("first_claim"))
    return m.join(per, "conflict_id").where("size > 1").select("claim_id", "conflict_id", "size", "first_claim")


def has_open_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Semi-join: claims with a sibling in an open conflict."""
    c = claims(spark, d)
    return c.join(c.where("open_conflict").select("author_id"), "author_id", "left_semi").select("claim_id", "category")


def source_reputation(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed agreement of each source with settled claims, and the tier that follows."""
    c = _derived(spark, d).select("claim_id", "verification")
    e = evidence(spark, d).where("active").select("claim_id", "grp", "stance")
    j = e.join(c, "claim_id")
    agree = F.count_distinct(F.when((F.col("verification") == "verified") & (F.col("stance") == "supports"), F.col("claim_id")))
    oppose = F.count_distinct(F.when((F.col("verification") == "verified") & (F.col("stance") == "contradicts"), F.col("claim_id")))
    r = j.groupBy("grp").agg(agree.alias("agree"), oppose.alias("oppose"))
    n = F.col("agree") + F.col("oppose")
    ratio = (F.col("agree") + 1).cast("double") / (n + 2).cast("double")
    tier = F.when(n < 5, F.lit(None).cast("int")).when((ratio >= 0.85) & (n >= 10), 3).when(ratio >= 0.6, 2).when(ratio < 0.35, 1)
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("grp"), F.col("s_name").alias("source"))
    return r.join(s, "grp").select("source", "agree", "oppose", F.round(ratio, 6).alias("reputation"), tier.alias("new_tier"))


def faq_popularity(spark: SparkSession, d: str) -> DataFrame:
    """Claims cited first in at least five answers of the last fortnight: the five most cited."""
    ev = read(spark, d, "events").where(F.col("ts") > F.lit(EVENTS_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 14 DAYS"))
    cited = ev.select(F.get_json_object("props", "$.k").cast("long").alias("claim_id")).where("claim_id IS NOT NULL")
    return cited.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").orderBy(F.desc("n"), "claim_id").limit(5)


def knowledge_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Unanswered questions of the last week asked at least three times: the ten most asked."""
    ev = read(spark, d, "events").where(F.col("ts") > F.lit(EVENTS_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).where("event_type IN ('error', 'view')")
    q = ev.select(F.sha2(F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")), 256).alias("norm_hash"), F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")).alias("text"))
    return q.groupBy("norm_hash").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.desc("n"), "norm_hash").limit(10)


def faq_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Verified public claims not in a published entry yet: the five best supported (an anti-join, then top-k)."""
    c = _derived(spark, d).where("verification = 'verified' AND is_public AND lifecycle = 'active'")
    published = claims(spark, d).where(F.col("claim_id") % 7 == 0).select("claim_id")
    return c.join(published, "claim_id", "left_anti").orderBy(F.desc("support_score"), "claim_id").limit(5).select("claim_id", "category", "support_score")


def faq_change_check(spark: SparkSession, d: str) -> DataFrame:
    """Entries (of one customer's claims) whose claims went or are disputed now."""
    c = _derived(spark, d).select("claim_id", "author_id", "lifecycle", "verification")
    per = c.groupBy("author_id").agg(F.bool_or(F.col("lifecycle") != "active").alias("gone"), F.bool_or(F.col("verification") == "disputed").alias("disputed"))
    action = F.when(F.col("gone"), "needs_review").when(F.col("disputed"), "banner").otherwise("clear")
    return per.select(F.col("author_id").alias("faq_id"), "gone", "disputed", action.alias("action"))


def overall_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of an answer made of a customer's claims."""
    c = _derived(spark, d).groupBy("author_id").agg(F.bool_or(F.col("verification") == "disputed").alias("x"), F.bool_and(F.col("verification") == "verified").alias("v"), F.bool_or(F.col("verification").isin("corroborated", "verified")).alias("c"))
    return c.select("author_id", F.when(F.col("x"), "disputed").when(F.col("v"), "verified").when(F.col("c"), "corroborated").otherwise("unverified").alias("overall"))


_DERIVED = derive_sql()
QUERIES = {f.__name__: f for f in (evidence_derive, evidence_weight_rows, recompute_changed_claims, epoch_bumps, version_asof, asof_price, stale_version_flag, visibility_filter, top_sources_per_claim, conflict_two_hop, has_open_conflict, source_reputation, faq_popularity, knowledge_gaps, faq_candidates, faq_change_check, overall_state)}
_CHANGED = f"""SELECT n.claim_id, n.lifecycle, n.lifecycle_reason AS reason, n.verification, n.basis, o.support_score AS was, n.support_score
FROM {_DERIVED} n JOIN {derive_sql(STORED_AT)} o USING (claim_id)
WHERE n.verification <> o.verification OR n.basis IS DISTINCT FROM o.basis OR abs(n.support_score - o.support_score) > 1e-6 OR n.is_public <> o.is_public OR n.audiences <> o.audiences OR n.lifecycle <> n.was_lifecycle"""
ORACLES = {
    "evidence_derive": f"SELECT claim_id, lifecycle, lifecycle_reason, verification, basis, support_score, is_public, audiences, last_evidence_at, n_sup, n_con FROM {_DERIVED}",
    "evidence_weight_rows": f"SELECT claim_id, line, round(w, 6) AS weight FROM ({_weighed_sql(EVIDENCE_NOW)})",
    "recompute_changed_claims": _CHANGED,
    "epoch_bumps": f"SELECT c_nationkey AS profile_id, count(*) AS epoch FROM ({_CHANGED}) x JOIN ({CLAIMS_SQL}) c USING (claim_id) JOIN customer ON c_custkey = author_id GROUP BY 1",
    "version_asof": f"SELECT claim_id, v.version FROM ({CLAIMS_SQL}) c ASOF LEFT JOIN (VALUES {', '.join(f'({n!r}, TIMESTAMP {s!r})' for n, s in TIMELINE)}) v(version, since) ON c.created_at >= v.since",
    "asof_price": "SELECT e.event_id, b.last_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON e.user_id = b.user_id AND e.ts >= b.ts",
    "stale_version_flag": f"""SELECT c.claim_id, c.category, coalesce(s.stale, false) AS stale FROM ({CLAIMS_SQL}) c
LEFT JOIN (SELECT claim_id, NOT bool_or(version_match) AS stale FROM ({EVIDENCE_SQL}) WHERE active AND stance = 'supports' AND version_match IS NOT NULL GROUP BY claim_id) s USING (claim_id) WHERE c.category IN ('1-URGENT', '2-HIGH')""",
    "visibility_filter": f"SELECT claim_id, verification, is_public FROM {_DERIVED} WHERE lifecycle = 'active' AND (is_public OR list_has_any(string_split(audiences, ','), ['6', '7']))",
    "top_sources_per_claim": f"""SELECT claim_id, rn, s_name AS source, tier, evidence_at FROM (SELECT *, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY tier DESC, evidence_at DESC, line) AS INT) AS rn FROM ({EVIDENCE_SQL})
WHERE active AND stance = 'supports' AND (audience IS NULL OR audience = 6)) e LEFT JOIN supplier s ON s.s_suppkey = e.grp WHERE rn <= 3""",
    "conflict_two_hop": f"WITH m AS (SELECT DISTINCT author_id, claim_id FROM ({CLAIMS_SQL}) WHERE open_conflict) SELECT a.claim_id, a.author_id AS conflict_id, count(*) AS size, min(b.claim_id) AS first_claim FROM m a JOIN m b USING (author_id) GROUP BY ALL HAVING count(*) > 1",
    "has_open_conflict": f"WITH c AS ({CLAIMS_SQL}) SELECT claim_id, category FROM c WHERE EXISTS (SELECT 1 FROM c o WHERE o.open_conflict AND o.author_id = c.author_id)",
    "source_reputation": f"""WITH r AS (SELECT grp, count(DISTINCT e.claim_id) FILTER (verification = 'verified' AND stance = 'supports') AS agree, count(DISTINCT e.claim_id) FILTER (verification = 'verified' AND stance = 'contradicts') AS oppose
FROM ({EVIDENCE_SQL}) e JOIN (SELECT claim_id, verification FROM {_DERIVED}) c USING (claim_id) WHERE active GROUP BY grp), q AS (SELECT *, (agree + 1)::DOUBLE / (agree + oppose + 2)::DOUBLE AS ratio, agree + oppose AS n FROM r)
SELECT s_name AS source, agree, oppose, round(ratio, 6) AS reputation, CAST(CASE WHEN n < 5 THEN NULL WHEN ratio >= 0.85::DOUBLE AND n >= 10 THEN 3 WHEN ratio >= 0.6::DOUBLE THEN 2 WHEN ratio < 0.35::DOUBLE THEN 1 END AS INT) AS new_tier FROM q JOIN supplier ON s_suppkey = grp""",
    "faq_popularity": f"SELECT CAST(props->>'$.k' AS BIGINT) AS claim_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY AND props->>'$.k' IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, claim_id LIMIT 5",
    "knowledge_gaps": f"SELECT sha256(concat_ws('|', event_type, props->>'$.k')) AS norm_hash, min(concat_ws('|', event_type, props->>'$.k')) AS text, count(*) AS n FROM events WHERE ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY AND event_type IN ('error', 'view') GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, norm_hash LIMIT 10",
    "faq_candidates": f"SELECT claim_id, category, support_score FROM {_DERIVED} c WHERE verification = 'verified' AND is_public AND lifecycle = 'active' AND claim_id % 7 <> 0 ORDER BY support_score DESC, claim_id LIMIT 5",
    "faq_change_check": f"SELECT author_id AS faq_id, bool_or(lifecycle <> 'active') AS gone, bool_or(verification = 'disputed') AS disputed, CASE WHEN bool_or(lifecycle <> 'active') THEN 'needs_review' WHEN bool_or(verification = 'disputed') THEN 'banner' ELSE 'clear' END AS action FROM {_DERIVED} GROUP BY author_id",
    "overall_state": f"SELECT author_id, CASE WHEN bool_or(verification = 'disputed') THEN 'disputed' WHEN bool_and(verification = 'verified') THEN 'verified' WHEN bool_or(verification IN ('corroborated', 'verified')) THEN 'corroborated' ELSE 'unverified' END AS overall FROM {_DERIVED} GROUP BY author_id",
}
