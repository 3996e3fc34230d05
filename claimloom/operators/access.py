"""Who may do what: capabilities, trust tiers, routing, bindings, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.tables import EVENTS_NOW, read

#: Example grants: subject kind, subject, capability (fixed values).
GRANTS = (("everyone", "", "kb.query"), ("role", "BUILDING", "kb.add"), ("role", "MACHINERY", "faq.edit"), ("role", "MACHINERY", "perm.manage"), ("user", "7", "perm.manage"), ("user", "7", "audit.read"))
CAPABILITIES = ("kb.query", "kb.add", "faq.edit", "perm.manage", "audit.read")
ROLE_TIERS = (("BUILDING", 2), ("MACHINERY", 3), ("AUTOMOBILE", 1))


def principals(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.array("c_mktsegment").alias("roles"), (F.col("c_custkey") % 41 == 0).alias("is_bot"), (F.col("c_custkey") % 97 == 0).alias("superuser"), F.when(F.col("c_custkey") % 53 == 0, F.col("c_custkey")).alias("webhook_id"), (F.lit(EVENTS_NOW).cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("c_custkey") % 40).cast("int"))).alias("created_at"))


def capabilities(spark: SparkSession, d: str) -> DataFrame:
    """user_id, capability: the union of grants to everyone, the user and the roles; all for superusers, none for bots."""
    p = principals(spark, d).where(~(F.col("is_bot") & F.col("webhook_id").isNull()))
    grants = F.broadcast(spark.createDataFrame(list(GRANTS), "kind string, subject string, capability string"))
    subjects = F.concat(F.array(F.struct(F.lit("everyone").alias("kind"), F.lit("").alias("subject")), F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("subject"))), F.transform("roles", lambda r: F.struct(F.lit("role").alias("kind"), r.alias("subject"))))
    plain = p.where("NOT superuser").select("user_id", F.explode(subjects).alias("s")).select("user_id", "s.kind", "s.subject").join(grants, ["kind", "subject"]).select("user_id", "capability").distinct()
    every = p.where("superuser").select("user_id", F.explode(F.array(*[F.lit(c) for c in CAPABILITIES])).alias("capability"))
    return plain.unionByName(every)


def permission_resolution(spark, d):
    return capabilities(spark, d)


def trust(spark: SparkSession, d: str) -> DataFrame:
    """user_id, tier: webhook, then user, then best role, then the default, which a new account caps at 1."""
    role = F.array_max(F.transform("roles", lambda r: F.coalesce(*[F.when(r == n, F.lit(t)) for n, t in ROLE_TIERS])))
    age = F.date_diff(F.lit(EVENTS_NOW).cast("date"), F.col("created_at").cast("date"))
    default = F.when(age < 14, F.lit(1)).otherwise(F.lit(2))
    tier = F.when(F.col("webhook_id").isNotNull(), F.when(F.col("webhook_id") % 2 == 0, 3).otherwise(1)).when(F.col("user_id") % 101 == 0, 4).otherwise(F.when(F.col("superuser"), F.greatest(F.coalesce(role, default), F.lit(3))).otherwise(F.coalesce(role, default)))
    return principals(spark, d).select("user_id", tier.cast("int").alias("tier"))


def trust_tier(spark, d):
    return trust(spark, d)


def escalation_rules(spark, d):
    """What each principal may grant and the highest tier it may assign."""
    caps = capabilities(spark, d).groupBy("user_id").agg(F.bool_or(F.col("capability") == "perm.manage").alias("manages"), F.bool_or(F.col("capability") == "audit.read").alias("audits"))
    p = principals(spark, d).select("user_id", "superuser").join(trust(spark, d), "user_id").join(caps, "user_id", "left")
    manages = F.coalesce("manages", F.lit(False))
    return p.select("user_id", (manages & F.coalesce("audits", F.lit(False))).alias("may_grant_audit"), F.when(~manages, -1).when(F.col("superuser"), 4).otherwise(F.least(F.greatest("tier", F.lit(3)), F.lit(3))).cast("int").alias("max_tier"))


def _bindings(spark, d):
    """channel, profile, kind: explicit bindings by nation."""
    n = read(spark, d, "nation")
    return n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("channel_id"), (F.col("n_nationkey") % 4).alias("profile_id"))


def answering_profile(spark, d):
    """The profile that answers in each channel: its own binding, its parent's, or the guild's smallest profile."""
    b = _bindings(spark, d)
    c = read(spark, d, "nation").select(F.col("n_nationkey").alias("channel"), F.col("n_regionkey").alias("parent"), (F.col("n_nationkey") % 3).alias("guild"))
    guild = c.groupBy("guild").agg(F.min(F.when(F.col("guild") > 0, F.col("guild") + 10)).alias("default_profile"))
    options = c.select("channel", "guild", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.col("channel").alias("at")), F.struct(F.lit(2).alias("p"), F.col("parent").alias("at")))).alias("o")).select("channel", "guild", "o.p", "o.at")
    own = options.join(b, options["at"] == b["channel_id"]).groupBy("channel").agg(F.min_by("profile_id", "p").alias("bound"))
    return c.join(own, "channel", "left").join(guild, "guild").select("channel", F.coalesce("bound", "default_profile").alias("profile_id"))


def route_ladder(spark, d):
    """What happens to each message: the first rung that applies."""
    e = read(spark, d, "events")
    who = principals(spark, d).select("user_id", "is_bot", "webhook_id")
    can = capabilities(spark, d).where("capability = 'kb.query'").select("user_id").withColumn("can", F.lit(True))
    m = e.join(who, "user_id", "left").join(can, "user_id", "left").join(trust(spark, d), "user_id", "left")
    hour = Window.partitionBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp"))).orderBy("ts", "event_id")
    m = m.withColumn("n", F.row_number().over(hour))
    mention, home = F.col("event_type").isin("click", "purchase"), F.col("event_type") == "view"
    bot = F.coalesce(F.col("is_bot") & F.col("webhook_id").isNull(), F.lit(False))
    denied = F.col("webhook_id").isNull() & ~F.coalesce("can", F.lit(False))
    reason = (
        F.when(F.col("event_id") % 50 == 0, "dm_ignored").when(bot, "bot_ignored").when(F.col("event_id") % 37 == 0, "no_profile").when(~(mention | home), "not_addressed").when(denied, "denied")
        .when(~mention, "home_ingest").when(F.col("value") > 300, "teach").when(F.col("n") > 2, "limited:hour").otherwise("answered")
    )
    return m.select("event_id", reason.alias("reason"))


def model_registry(spark, d):
    """Embedding models after a switch: the newest of the right size is active, the others retired."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("profile"), F.col("p_partkey").alias("model_id"), F.when(F.col("p_size") % 2 == 0, 64).otherwise(128).alias("dims"))
    newest = F.max(F.when(F.col("dims") == 64, F.col("model_id"))).over(Window.partitionBy("profile"))
    return p.select("profile", "model_id", "dims", F.when(F.col("model_id") == newest, "active").otherwise("retired").alias("state"))


def embedding_backfill(spark, d):
    """Active claims without a vector, or whose vector is of another text."""
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    have = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label"))
    j = docs.join(have, "doc_id", "left")
    stale = F.col("label").isNotNull() & (F.col("label") == 3)
    return j.where(F.col("label").isNull() | stale).select("doc_id", F.when(stale, "changed").otherwise("missing").alias("why"))


def feedback_writeback(spark, d):
    """Ratings written back only by who asked, the latest wins."""
    q = read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("asked_by"))
    f = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 100).alias("by"), "l_linenumber", F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("rating"))
    mine = f.join(q, "query_id").where((F.col("asked_by") % 100) == F.col("by"))
    return mine.groupBy("query_id").agg(F.max_by("rating", F.struct("l_linenumber", "rating")).alias("rating"))


def settings_change(spark, d):
    """Role groups after a settings change: members added and removed by pure set operations."""
    c = read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("roles"))
    after = F.array_sort(F.array_except(F.array_union("roles", F.array(F.lit("MODERATOR"))), F.array(F.lit("AUTOMOBILE"))))
    return c.select("c_nationkey", F.array_join(after, ",").alias("roles"), F.size(F.array_intersect("roles", F.array(F.lit("BUILDING"), F.lit("MACHINERY")))).alias("n_trusted"))


def audit_query(spark, d, action_prefix: str | None = "p", user_id: int | None = None):
    """Audit rows under optional filters: what is not asked for is not in the plan."""
    e = read(spark, d, "events")
    if action_prefix is not None:
        e = e.where(F.startswith("event_type", F.lit(action_prefix)))
    if user_id is not None:
        e = e.where(F.col("user_id") == user_id)
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("actor"))
    return e.join(c, "user_id").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "actor", "event_type")


def answer_payload(spark, d):
    """One line per derived claim as an answer shows it: badge, number, clipped category, date."""
    from .evidence import evidence_derive

    badge = F.element_at(F.create_map(*[F.lit(x) for x in ("verified", "[v]", "corroborated", "[c]", "unverified", "[?]", "disputed", "[!]")]), F.col("verification"))
    return evidence_derive(spark, d).select("claim_id", F.concat_ws(" ", badge, F.concat(F.lit("K-"), "claim_id"), F.date_format("last_evidence_at", "yyyy-MM-dd"), F.when(~F.col("is_public"), "(restricted)")).alias("line"))


QUERIES = {f.__name__: f for f in (permission_resolution, trust_tier, escalation_rules, answering_profile, route_ladder, model_registry, embedding_backfill, feedback_writeback, settings_change, audit_query, answer_payload)}

_P = f"(SELECT c_custkey AS user_id, c_mktsegment AS role, c_custkey % 41 = 0 AS is_bot, c_custkey % 97 = 0 AS superuser, CASE WHEN c_custkey % 53 = 0 THEN c_custkey END AS webhook_id, c_custkey % 40 AS age FROM customer)"
_CAPS = f"""(WITH p AS (SELECT * FROM {_P} WHERE NOT (is_bot AND webhook_id IS NULL)), g(kind, subject, capability) AS (VALUES {', '.join(map(str, GRANTS))})
SELECT DISTINCT user_id, capability FROM p JOIN g ON kind = 'everyone' OR (kind = 'user' AND subject = CAST(user_id AS VARCHAR)) OR (kind = 'role' AND subject = role) WHERE NOT superuser
UNION ALL SELECT user_id, unnest({list(CAPABILITIES)}) FROM p WHERE superuser)"""
_TRUST = f"""(WITH p AS (SELECT *, CASE role WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 WHEN 'AUTOMOBILE' THEN 1 END AS rt, CASE WHEN age < 14 THEN 1 ELSE 2 END AS dt FROM {_P})
SELECT user_id, CAST(CASE WHEN webhook_id IS NOT NULL THEN CASE WHEN webhook_id % 2 = 0 THEN 3 ELSE 1 END WHEN user_id % 101 = 0 THEN 4 WHEN superuser THEN greatest(coalesce(rt, dt), 3) ELSE coalesce(rt, dt) END AS INT) AS tier FROM p)"""
ORACLES = {
    "permission_resolution": f"SELECT * FROM {_CAPS}",
    "trust_tier": f"SELECT * FROM {_TRUST}",
    "escalation_rules": f"""WITH c AS (SELECT user_id, bool_or(capability = 'perm.manage') AS m, bool_or(capability = 'audit.read') AS a FROM {_CAPS} GROUP BY 1)
SELECT user_id, coalesce(m, false) AND coalesce(a, false) AS may_grant_audit, CAST(CASE WHEN NOT coalesce(m, false) THEN -1 WHEN superuser THEN 4 ELSE 3 END AS INT) AS max_tier FROM {_P} p LEFT JOIN c USING (user_id)""",
    "answering_profile": """WITH c AS (SELECT n_nationkey AS channel, n_regionkey AS parent, n_nationkey % 3 AS guild FROM nation) SELECT channel, CASE WHEN channel % 2 = 0 THEN channel % 4 WHEN parent % 2 = 0 THEN parent % 4 WHEN guild > 0 THEN guild + 10 END AS profile_id FROM c""",
    "route_ladder": f"""WITH can AS (SELECT user_id FROM {_CAPS} WHERE capability = 'kb.query'), m AS (SELECT e.*, p.is_bot, p.webhook_id, e.user_id IN (FROM can) AS can, row_number() OVER (PARTITION BY e.user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events e LEFT JOIN {_P} p USING (user_id))
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'dm_ignored' WHEN coalesce(is_bot AND webhook_id IS NULL, false) THEN 'bot_ignored' WHEN event_id % 37 = 0 THEN 'no_profile' WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'not_addressed'
WHEN webhook_id IS NULL AND NOT can THEN 'denied' WHEN event_type = 'view' THEN 'home_ingest' WHEN value > 300 THEN 'teach' WHEN n > 2 THEN 'limited:hour' ELSE 'answered' END AS reason FROM m""",
    "model_registry": "WITH p AS (SELECT p_brand AS profile, p_partkey AS model_id, CASE WHEN p_size % 2 = 0 THEN 64 ELSE 128 END AS dims FROM part) SELECT profile, model_id, dims, CASE WHEN model_id = max(model_id) FILTER (dims = 64) OVER (PARTITION BY profile) THEN 'active' ELSE 'retired' END AS state FROM p",
    "embedding_backfill": "SELECT doc_id, CASE WHEN label = 3 THEN 'changed' ELSE 'missing' END AS why FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE label IS NULL OR label = 3",
    "feedback_writeback": "SELECT l_orderkey AS query_id, arg_max(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END, row(l_linenumber, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)) AS rating FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 100 = l_suppkey % 100 GROUP BY 1",
    "settings_change": "WITH c AS (SELECT c_nationkey, list_sort(list_distinct(list(c_mktsegment))) AS r FROM customer GROUP BY 1) SELECT c_nationkey, array_to_string(list_sort(list_filter(list_append(r, 'MODERATOR'), lambda x: x <> 'AUTOMOBILE')), ',') AS roles, CAST(len(list_filter(r, lambda x: x IN ('BUILDING', 'MACHINERY'))) AS INT) AS n_trusted FROM c",
    "audit_query": "SELECT event_id, ts, c_name AS actor, event_type FROM events JOIN customer ON c_custkey = user_id WHERE starts_with(event_type, 'p') ORDER BY ts DESC, event_id LIMIT 50",
}


def _payload_sql() -> str:
    from .evidence import derive_sql

    return f"SELECT claim_id, concat_ws(' ', CASE verification WHEN 'verified' THEN '[v]' WHEN 'corroborated' THEN '[c]' WHEN 'unverified' THEN '[?]' ELSE '[!]' END, concat('K-', claim_id), strftime(last_evidence_at, '%Y-%m-%d'), CASE WHEN NOT is_public THEN '(restricted)' END) AS line FROM {derive_sql()}"


ORACLES["answer_payload"] = _payload_sql()
