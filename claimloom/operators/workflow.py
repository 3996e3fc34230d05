"""Queues, schedules, limits, histories, audit and reconciliation as set-at-a-time transformations."""

from __future__ import annotations


import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.tables import EVENTS_NOW, read
from .ranges import Rule, fold, rate_limit_sliding_greedy  # noqa: F401

#: Fixed values of the latency histogram and of the queue's backoff.
BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0)
BACKOFF_BASE_S, BACKOFF_CAP_S = 30, 3600


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")


def _epoch(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """The queue's rows: one per order."""
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("llm.window", "llm.web", "web.fetch", "faq.check")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.alias("status"), F.col("o_orderdate").alias("run_after"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"))


JOBS_SQL = """SELECT o_orderkey AS id, ['llm.window', 'llm.web', 'web.fetch', 'faq.check'][o_custkey % 4 + 1] AS kind, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_orderdate AS run_after, CAST(o_orderkey % 4 AS INT) AS attempts FROM orders"""


def queue_stats(spark, d):
    return jobs(spark, d).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.min("run_after").alias("oldest"))


def queue_claim_order(spark, d):
    """The next jobs that workers would lease."""
    ready = jobs(spark, d).where("status = 'queued' AND run_after <= TIMESTAMP_NTZ '2001-06-01 00:00:00'")
    return ready.orderBy("priority", "run_after", "id").limit(20).withColumn("attempts", F.col("attempts") + 1)


def queue_prefix_caps(spark, d):
    """Leases under a cap for each kind's prefix."""
    ready = jobs(spark, d).where("status = 'queued'").withColumn("prefix", F.substring_index("kind", ".", 1))
    rn = F.row_number().over(Window.partitionBy("prefix").orderBy("priority", "run_after", "id"))
    cap = F.when(F.col("prefix") == "llm", 1).otherwise(2)
    return ready.withColumn("rn", rn).where("rn <= 2").where(F.col("rn") <= cap).select("id", "prefix", "rn")


def job_transitions(spark, d):
    """The state after each job's outcome: done, failed with backoff or dead, postponed without an attempt, reclaimed."""
    j = jobs(spark, d).withColumn("outcome", F.element_at(F.array(*[F.lit(x) for x in ("complete", "fail", "permanent", "postpone", "reclaim")]), (F.col("id") % 5 + 1).cast("int")))
    dead = (F.col("outcome") == "permanent") | ((F.col("outcome") == "fail") & (F.col("attempts") >= 3))
    status = F.when(F.col("outcome") == "complete", "done").when(dead, "dead").otherwise("queued")
    wait = F.when((F.col("outcome") == "fail") & ~dead, F.least(F.lit(BACKOFF_CAP_S), F.lit(BACKOFF_BASE_S) * F.pow(F.lit(2), F.greatest(F.col("attempts") - 1, F.lit(0))).cast("int"))).when(F.col("outcome") == "postpone", 600).otherwise(0)
    attempts = F.when(F.col("outcome") == "postpone", F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts"))
    return j.select("id", "outcome", status.alias("status"), attempts.alias("attempts"), wait.cast("int").alias("wait_s"))


def schedule_buckets(spark, d):
    """One job per schedule and time bucket, however often the tick runs."""
    e = _events(spark, d).select(F.explode(F.array(F.struct(F.lit("crawl").alias("schedule"), F.lit(900).alias("every_s")), F.struct(F.lit("faq").alias("schedule"), F.lit(86400).alias("every_s")))).alias("s"), _epoch("ts").alias("t"))
    return e.select("s.schedule", F.floor(F.col("t") / F.col("s.every_s")).cast("long").alias("bucket")).groupBy("schedule", "bucket").agg(F.count(F.lit(1)).alias("ticks"))


def enqueue_once(spark, d):
    """Inserts that an idempotency key lets through: the first event of each key."""
    e = _events(spark, d).withColumn("key", F.concat_ws(":", F.lit("window"), "user_id", F.floor(_epoch("ts") / 300)))
    return e.groupBy("key").agg(F.min("event_id").alias("event_id"))


def usage_counters(spark, d):
    """Counts per user and tumbling hour and day, in one pass."""
    e = _events(spark, d)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.date_trunc(k, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("start")) for k in ("hour", "day")]))
    return e.select("user_id", kinds.alias("w")).groupBy("user_id", F.col("w.kind").alias("window_kind"), F.col("w.start").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def rate_limit_tumbling(spark, d):
    """Accepted or not under 2 an hour and 6 a day; what the day rejects is given back to the hour."""
    e = _events(spark, d).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    hour = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    e = e.withColumn("hour_ok", F.row_number().over(hour) <= 2)
    day = Window.partitionBy("user_id", F.date_trunc("day", "ts"), "hour_ok").orderBy("ts", "event_id")
    e = e.withColumn("day_n", F.row_number().over(day))
    return e.select("event_id", F.when(~F.col("hour_ok"), "hour").when(F.col("day_n") > 6, "day").otherwise("ok").alias("decision"))


def rate_limit_sliding_count(spark, d):
    """Requests of the same user in the hour before each one."""
    e = _events(spark, d).withColumn("t", _epoch("ts"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3600, 0)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("n"))


#: Most generous of a user's role overrides; null stands for no limit.
ROLE_LIMITS = (("BUILDING", 5, None), ("MACHINERY", None, 50), ("HOUSEHOLD", 3, 20))


def rate_limit_policy(spark, d):
    """Each principal's hour and day limits: the base, or the most generous of its roles'."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.array("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "HOUSEHOLD")).alias("roles"))
    roles = spark.createDataFrame(list(ROLE_LIMITS), "role string, hour int, day int")
    big = F.lit(2147483647)
    r = c.select("user_id", F.explode("roles").alias("role")).join(F.broadcast(roles), "role")
    r = r.groupBy("user_id").agg(F.max(F.coalesce("hour", big)).alias("h"), F.max(F.coalesce("day", big)).alias("dd"))
    j = c.select("user_id").join(r, "user_id", "left")
    return j.select("user_id", F.nullif(F.greatest(F.coalesce("h", F.lit(2)), F.lit(2)), big).alias("hour"), F.nullif(F.greatest(F.coalesce("dd", F.lit(10)), F.lit(10)), big).alias("day"))


def latency_histogram(spark, d):
    """Cumulative counts under fixed bounds, per event type."""
    e = _events(spark, d).withColumn("s", F.col("value") / F.lit(10.0))
    row = e.groupBy("event_type").agg(*[F.sum(F.when(F.col("s") <= F.lit(b), 1).otherwise(0)).alias(f"le_{n}") for n, b in enumerate(BUCKETS)], F.count(F.lit(1)).alias("n"))
    return row


def latency_percentiles(spark, d):
    """Nearest-rank-floor percentiles from counts of distinct values, so a type's rows never meet in one task."""
    counts = _events(spark, d).where("value IS NOT NULL").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("event_type").orderBy("value"))
    total = F.sum("n").over(Window.partitionBy("event_type"))
    c = counts.withColumn("upto", upto).withColumn("total", total)
    place = lambda q: F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total")))
    return c.groupBy("event_type").agg(*[F.min(F.when(F.col("upto") > place(q), F.col("value"))).alias(f"p{int(q * 100)}") for q in (0.5, 0.95)])


def _votes(spark, d):
    decision = F.element_at(F.array(F.lit("keep"), F.lit("edit"), F.lit("reject")), (F.length("text") % 3 + 1).cast("int"))
    return read(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), "turn", decision.alias("decision"))


def vote_tally(spark, d):
    return _votes(spark, d).groupBy("task_id").pivot("decision", ["keep", "edit", "reject"]).agg(F.count(F.lit(1))).na.fill(0)


def vote_quorum(spark, d):
    """The first decision to reach two votes (keep and edit count together) closes the task."""
    v = _votes(spark, d).withColumn("side", F.when(F.col("decision") == "reject", "reject").otherwise("keep"))
    v = v.withColumn("n", F.row_number().over(Window.partitionBy("task_id", "side").orderBy("turn", "decision"))).where("n = 2")
    first = v.groupBy("task_id").agg(F.min(F.struct("turn", "side")).alias("f"))
    tasks = _votes(spark, d).select("task_id").distinct()
    return tasks.join(first, "task_id", "left").select("task_id", F.coalesce("f.side", F.lit("open")).alias("outcome"), F.col("f.turn").alias("closed_at"))


def label_stats(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


def hash_sample(spark, d, rate: float = 0.2):
    """Ids that a hash puts into the sample: the first two bytes of SHA-256 against the rate."""
    e = _events(spark, d).select("event_id")
    share = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 4), 16, 10).cast("double") / F.lit(65535.0)
    return e.where(share <= F.lit(rate))


def _audit(spark, d):
    """A stored chain per user whose links are altered at some rows."""
    e = _events(spark, d).select("user_id", "event_id", F.concat_ws("\x1f", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "event_type", "props").alias("body"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.withColumn("chain_seq", F.row_number().over(w)).withColumn("prev_hash", F.coalesce(F.sha2(F.lag("body").over(w), 256), F.lit("")))


def audit_verify(spark, d):
    """The first place of each chain where the stored link is not the digest of what goes before, or null."""
    a = _audit(spark, d).withColumn("stored", F.when((F.col("event_id") % 97 == 3) & (F.col("chain_seq") > 1), F.sha2(F.lit("altered"), 256)).otherwise(F.col("prev_hash")))
    w = Window.partitionBy("user_id").orderBy("chain_seq")
    broken = F.col("stored") != F.coalesce(F.sha2(F.lag("body").over(w), 256), F.lit(""))
    return a.withColumn("broken", broken).groupBy("user_id").agg(F.min(F.when(F.col("broken"), F.col("chain_seq"))).alias("first_broken"), F.count(F.lit(1)).alias("n"))


def audit_digest(spark, d):
    """Each row's digest over its predecessor's digest and its fields (a field that is null is left out)."""
    return _audit(spark, d).select("event_id", F.sha2(F.concat("prev_hash", "body"), 256).alias("digest"))


class Chain(Rule):
    """The hash so far."""

    def __init__(self):
        self.before = b""

    def step(self, body: str) -> tuple[str]:
        self.before = hashlib.sha256(self.before + body.encode()).digest()
        return (self.before.hex(),)


def audit_chain_build(spark, d):
    """A true hash chain per user: each row's hash takes in the hash before it, so a chain is walked in order, range by
    range with the last hash carried on."""
    a = _audit(spark, d).select("user_id", "chain_seq", "body")
    return fold(a, ["user_id"], ["chain_seq"], ["body"], Chain, "row_hash string").select("user_id", "chain_seq", "row_hash")


def reconcile_actions(spark, d):
    """Desired against published state: a full outer join on the entry."""
    j = jobs(spark, d)
    want = j.where("id % 3 <> 0").select("id", F.col("status").alias("want"))
    have = j.where("id % 4 <> 0").select("id", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("status")).alias("have"))
    r = want.join(have, "id", "full")
    action = F.when(F.col("have").isNull(), "create").when(F.col("want").isNull(), "delete").when(F.col("want") == F.col("have"), "noop").when(F.col("want") == "done", "lock").otherwise("edit")
    return r.select("id", action.alias("action"))


def source_liveness(spark, d):
    """Longest run of failures in a row per source; three make it unreachable (gaps and islands)."""
    e = _events(spark, d).withColumn("bad", F.col("event_type") == "error")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = e.where("bad").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"))
    longest = runs.groupBy("user_id").agg(F.max("n").alias("longest"))
    every = _events(spark, d).select("user_id").distinct()
    return every.join(longest, "user_id", "left").select("user_id", F.coalesce("longest", F.lit(0)).alias("longest"), (F.coalesce("longest", F.lit(0)) >= 3).alias("unreachable"))


def circuit_breaker(spark, d):
    """Failures since the last success, and how many hours the circuit stays open."""
    e = _events(spark, d)
    last_good = e.where("event_type <> 'error'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("g"))
    j = e.where("event_type = 'error'").join(last_good, "user_id", "left").where(F.col("g").isNull() | (F.struct("ts", "event_id") > F.col("g")))
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("failures")).select("user_id", "failures", F.when(F.col("failures") >= 3, F.least("failures", F.lit(48))).otherwise(0).cast("int").alias("open_h"))


def revision_history(spark, d):
    """A revision for every change of content in time order (SCD-2)."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate", F.sha2("o_orderpriority", 256).alias("hash"))
    w = Window.partitionBy("key").orderBy("o_orderdate", "o_orderkey")
    changed = F.coalesce(F.lag("hash").over(w) != F.col("hash"), F.lit(True))
    rows = o.withColumn("changed", changed)
    rows = rows.withColumn("rev", F.sum(F.col("changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("changed").select("key", "rev", F.col("o_orderdate").alias("valid_from"), "hash")


def current_revision(spark, d):
    """The latest revision of each key."""
    return revision_history(spark, d).groupBy("key").agg(F.max("rev").alias("rev"), F.max_by("hash", "rev").alias("hash"))


def content_hash_changes(spark, d):
    """Texts whose digest differs from the one stored before, null-safely."""
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "source")
    stored = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2("source", 256)).otherwise(F.col("hash")).alias("old"))
    return docs.join(stored, "doc_id", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("doc_id", F.col("old").isNull().alias("is_new"))


def upsert_latest(spark, d):
    """Overwriting upserts: the last event of each user wins."""
    return _events(spark, d).groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.event_type", "r.value")


def upsert_merge_combine(spark, d):
    """Combining upserts: the first known audience and the highest tier of each (claim, group)."""
    from ..plans.tables import evidence

    e = evidence(spark, d)
    return e.groupBy("claim_id", "grp").agg(F.max("tier").alias("tier"), F.min_by("audience", F.when(F.col("audience").isNotNull(), F.col("line"))).alias("audience"), F.count(F.lit(1)).alias("n"))


def upsert_keep_existing(spark, d):
    """Inserts that meet no existing key."""
    return jobs(spark, d).where("status = 'queued'").join(jobs(spark, d).where("status = 'done'").select("run_after", "kind").distinct(), ["run_after", "kind"], "left_anti").select("id", "kind")


def retention(spark, d):
    """What the retention rules do to each event: kept, nullified or deleted unless an answer cites it."""
    e = _events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    cited = e.where("event_type = 'purchase'").select("k").distinct().withColumn("cited", F.lit(True))
    old = F.col("ts") < F.lit(EVENTS_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 14 DAYS")
    action = F.when(~old, "keep").when(F.col("cited"), "nullify").otherwise("delete")
    return e.join(cited, "k", "left").groupBy("event_type", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def gdpr_purge(spark, d):
    """Content and metadata of one role's turns removed; the rows stay."""
    c = read(spark, d, "conversations")
    mine = F.col("role") == "user"
    return c.select("conv_id", "turn", F.when(~mine, F.length("text")).alias("n_chars"), F.when(mine, "purged").otherwise("active").alias("status"))


def cascade_deactivation(spark, d):
    """Claims to derive anew after the evidence of some observations was switched off."""
    from ..plans.tables import evidence

    gone = read(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("observation_id"))
    return evidence(spark, d).where("active").join(gone, "observation_id", "left_semi").groupBy("claim_id").agg(F.count(F.lit(1)).alias("deactivated"))


def json_merge(spark, d):
    """Metadata merged with later keys winning."""
    e = _events(spark, d).select("event_id", F.from_json("props", "map<string,string>").alias("m"), "event_type")
    merged = F.map_concat(F.map_filter("m", lambda k, v: k != "type"), F.create_map(F.lit("type"), F.col("event_type")))
    return e.select("event_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("meta"))


def integrity_checks(spark, d):
    """Violations of each integrity rule."""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    c = li.agg(F.sum((~F.col("l_returnflag").isin("A", "N", "R")).cast("long")).alias("enum_returnflag"), F.sum((F.col("l_quantity") <= 0).cast("long")).alias("positive_quantity"))
    dup = li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.count(F.lit(1)).alias("unique_line"))
    orphan = li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("orphan_line"))
    wide = c.crossJoin(dup).crossJoin(orphan)  # three rows of one
    names = wide.columns
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("violations")) for n in names])).alias("r")).select("r.rule", "r.violations")


#: Two versions of a configuration, as an example.
CONFIG_OLD = {"answer": {"max_words": 120, "style": "short"}, "limits": {"hour": 20, "day": 100}, "scopes": {"web": True}}
CONFIG_NEW = {"answer": {"max_words": 150, "style": "short"}, "limits": {"hour": 20}, "scopes": {"web": True, "faq": True}}


def flatten_config(tree: dict, path: str = "") -> list[tuple[str, str]]:
    """(path, JSON value) of every leaf."""
    out = []
    for key, value in tree.items():
        at = f"{path}.{key}" if path else key
        out += flatten_config(value, at) if isinstance(value, dict) and value else [(at, json.dumps(value, sort_keys=True))]
    return out


def config_diff(spark, d, old: dict = CONFIG_OLD, new: dict = CONFIG_NEW):
    """Paths added, removed or changed between two configurations."""
    a = spark.createDataFrame(flatten_config(old), "path string, old_value string")
    b = spark.createDataFrame(flatten_config(new), "path string, new_value string")
    j = a.join(b, "path", "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return j.select("path", "old_value", "new_value", F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed").alias("change"))


def message_windows_tumbling(spark, d):
    """Messages per channel and 5-minute bucket."""
    e = _events(spark, d).groupBy(F.window("ts", "300 seconds").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    return e.select(F.col("w.start").alias("window_start"), "event_type", "n", "first_id")


def message_sessions(spark, d):
    """Sessions of each user that an hour of silence ends."""
    e = _events(spark, d).groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def context_before(spark, d):
    """Up to five earlier turns of each turn, by their ids in order (a row frame)."""
    c = read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(-5, -1)
    return c.select("conv_id", "turn", F.array_join(F.transform(F.collect_list("turn").over(w), lambda t: t.cast("string")), ",").alias("context"))


def reply_join(spark, d):
    """Each event with the one it replies to (props.k events earlier of the same user), if within the last 50."""
    e = _events(spark, d)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = e.select("event_id", "user_id", F.row_number().over(w).alias("n"), (F.get_json_object("props", "$.k").cast("long") % 60 + 1).alias("back"))
    target = n.select("user_id", F.col("n").alias("m"), F.col("event_id").alias("reply_to"))
    j = n.where("back <= 50").withColumn("m", F.col("n") - F.col("back"))
    return j.join(target, ["user_id", "m"]).select("event_id", "reply_to")


def interval_join(spark, d):
    """Context events within 30 minutes before each purchase of the same user: an equi-join on the time bucket too."""
    e = _events(spark, d)
    t = _epoch("ts")
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", t.alias("pt")).withColumn("b", F.explode(F.array(F.floor(F.col("pt") / 1800), F.floor(F.col("pt") / 1800) - 1)))
    c = e.where("event_type <> 'purchase'").select("event_id", "user_id", t.alias("ct"), F.floor(t / 1800).alias("b"))
    return p.join(c, ["user_id", "b"]).where("ct BETWEEN pt - 1800 AND pt").select("purchase_id", "event_id")


def followup_lookup(spark, d):
    """The question before each turn of the user in its conversation."""
    c = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    w = Window.partitionBy("conv_id").orderBy("turn", "h")
    return c.select("conv_id", "turn", F.lag("h").over(w).alias("previous"))


def context_budget(spark, d, budget: int = 600):
    """Turns that fit a character budget from the start; the first always does."""
    c = read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    upto = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rn = F.row_number().over(w)
    return c.withColumn("upto", upto).withColumn("rn", rn).where((F.col("upto") <= budget) | (F.col("rn") == 1)).select("conv_id", "turn", F.col("upto").cast("long").alias("used"))


def answer_cache(spark, d):
    """Cached answers that still hold: same profile, same epoch, younger than ten days. cached_answers has the whole rule."""
    e = _events(spark, d)
    epoch = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("epoch"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    put = e.withColumn("at_epoch", F.sum((F.col("event_type") == "purchase").cast("long")).over(w)).where("event_type IN ('view', 'search')")
    fresh = F.col("ts") > F.lit(EVENTS_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 10 DAYS")
    return put.join(epoch, "user_id").where(fresh & (F.col("at_epoch") == F.col("epoch"))).select("event_id", "user_id", F.sha2(F.concat_ws("\x1f", "user_id", "event_type", "at_epoch", "props"), 256).alias("cache_key"))


def discovery_budget(spark, d):
    """Two queries a day: knowledge gaps first, then seeds in rotation, each key once."""
    e = _events(spark, d).select(F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("key"), (F.col("event_type") == "error").alias("gap"), "event_id")
    once = e.groupBy("day", "key").agg(F.bool_or("gap").alias("gap"), F.min("event_id").alias("event_id"))
    order = Window.partitionBy("day").orderBy(F.desc("gap"), F.pmod(F.col("event_id") + F.dayofyear("day"), F.lit(100)), "event_id")
    return once.withColumn("rn", F.row_number().over(order)).where("rn <= 2").select("day", "key", "gap", "rn")


def eval_confusion(spark, d):
    """Rates of an answer evaluation with safe denominators."""
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    answered, good = F.col("n_chars") > 500, F.col("quality") == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = j.agg(n(answered & good).alias("tp"), n(answered & ~good).alias("fp"), n(~answered & good).alias("fn"), n(~answered & ~good).alias("tn"))
    return a.select("tp", "fp", "fn", "tn", F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")), 6).alias("recall"))


QUERIES = {f.__name__: f for f in (queue_stats, queue_claim_order, queue_prefix_caps, job_transitions, schedule_buckets, enqueue_once, usage_counters, rate_limit_tumbling, rate_limit_sliding_count, rate_limit_policy, latency_histogram, latency_percentiles, vote_tally, vote_quorum, label_stats, hash_sample, audit_verify, audit_digest, audit_chain_build, reconcile_actions, source_liveness, circuit_breaker, revision_history, current_revision, content_hash_changes, upsert_latest, upsert_merge_combine, upsert_keep_existing, retention, gdpr_purge, cascade_deactivation, json_merge, integrity_checks, config_diff, message_windows_tumbling, message_sessions, context_before, reply_join, interval_join, followup_lookup, context_budget, answer_cache, discovery_budget, eval_confusion)}

_AUDIT = """(SELECT user_id, event_id, body, CAST(row_number() OVER w AS INT) AS chain_seq, coalesce(sha256(lag(body) OVER w), '') AS prev_hash FROM
(SELECT user_id, event_id, concat_ws(chr(31), strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), event_type, props) AS body FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""
_VOTES = "(SELECT conv_id AS task_id, turn, ['keep', 'edit', 'reject'][length(text) % 3 + 1] AS decision FROM conversations)"
_REV = """(WITH o AS (SELECT o_custkey AS key, o_orderkey, o_orderdate, sha256(o_orderpriority) AS hash, lag(sha256(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
c AS (SELECT *, before IS NULL OR before <> hash AS changed FROM o)
SELECT key, rev, o_orderdate AS valid_from, hash FROM (SELECT *, CAST(sum(changed::INT) OVER (PARTITION BY key ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rev FROM c) WHERE changed)"""
_LE = ", ".join(f"CAST(sum(CASE WHEN value / 10.0::DOUBLE <= {b}::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS le_{n}" for n, b in enumerate(BUCKETS))
ORACLES = {
    "queue_stats": f"SELECT kind, status, count(*) AS n, min(run_after) AS oldest FROM ({JOBS_SQL}) GROUP BY ALL",
    "queue_claim_order": f"SELECT id, kind, priority, status, run_after, attempts + 1 AS attempts FROM ({JOBS_SQL}) WHERE status = 'queued' AND run_after <= TIMESTAMP '2001-06-01' ORDER BY priority, run_after, id LIMIT 20",
    "queue_prefix_caps": f"SELECT id, prefix, rn FROM (SELECT id, split_part(kind, '.', 1) AS prefix, CAST(row_number() OVER (PARTITION BY split_part(kind, '.', 1) ORDER BY priority, run_after, id) AS INT) AS rn FROM ({JOBS_SQL}) WHERE status = 'queued') WHERE rn <= CASE prefix WHEN 'llm' THEN 1 ELSE 2 END",
    "job_transitions": f"""WITH j AS (SELECT *, ['complete', 'fail', 'permanent', 'postpone', 'reclaim'][id % 5 + 1] AS outcome FROM ({JOBS_SQL})), k AS (SELECT *, outcome = 'permanent' OR (outcome = 'fail' AND attempts >= 3) AS dead FROM j)
SELECT id, outcome, CASE WHEN outcome = 'complete' THEN 'done' WHEN dead THEN 'dead' ELSE 'queued' END AS status, CASE WHEN outcome = 'postpone' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts,
CAST(CASE WHEN outcome = 'fail' AND NOT dead THEN least(3600, 30 * pow(2, greatest(attempts - 1, 0))) WHEN outcome = 'postpone' THEN 600 ELSE 0 END AS INT) AS wait_s FROM k""",
    "schedule_buckets": "SELECT s.schedule, CAST(floor(epoch(ts)::BIGINT / s.every_s) AS BIGINT) AS bucket, count(*) AS ticks FROM (SELECT date_trunc('second', ts) AS ts FROM events), (VALUES ('crawl', 900), ('faq', 86400)) s(schedule, every_s) GROUP BY ALL",
    "enqueue_once": "SELECT concat_ws(':', 'window', user_id, CAST(floor(epoch(date_trunc('second', ts)) / 300) AS BIGINT)) AS key, min(event_id) AS event_id FROM events GROUP BY 1",
    "usage_counters": "SELECT user_id, k AS window_kind, date_trunc(k, ts) AS window_start, count(*) AS n FROM events, (VALUES ('hour'), ('day')) v(k) GROUP BY ALL",
    "rate_limit_tumbling": """WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS hour_ok FROM events),
dd AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts), hour_ok ORDER BY ts, event_id) AS day_n FROM h) SELECT event_id, CASE WHEN NOT hour_ok THEN 'hour' WHEN day_n > 6 THEN 'day' ELSE 'ok' END AS decision FROM dd""",
    "rate_limit_sliding_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events)",
    "rate_limit_policy": """WITH r(role, hour, day) AS (VALUES ('BUILDING', 5, 2147483647), ('MACHINERY', 2147483647, 50), ('HOUSEHOLD', 3, 20)), c AS (SELECT c_custkey AS user_id, unnest([c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'HOUSEHOLD' END]) AS role FROM customer),
m AS (SELECT user_id, max(hour) AS h, max(day) AS d FROM c LEFT JOIN r USING (role) GROUP BY user_id) SELECT user_id, CAST(nullif(greatest(coalesce(h, 2), 2), 2147483647) AS INT) AS hour, CAST(nullif(greatest(coalesce(d, 10), 10), 2147483647) AS INT) AS day FROM m""",
    "latency_histogram": f"SELECT event_type, {_LE}, count(*) AS n FROM events GROUP BY event_type",
    "latency_percentiles": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[CAST(least(n - 1, floor(0.5::DOUBLE * n)) AS BIGINT) + 1] AS p50, v[CAST(least(n - 1, floor(0.95::DOUBLE * n)) AS BIGINT) + 1] AS p95 FROM l",
    "vote_tally": f"SELECT task_id, count(*) FILTER (decision = 'keep') AS keep, count(*) FILTER (decision = 'edit') AS edit, count(*) FILTER (decision = 'reject') AS reject FROM {_VOTES} GROUP BY task_id",
    "vote_quorum": f"""WITH v AS (SELECT *, CASE decision WHEN 'reject' THEN 'reject' ELSE 'keep' END AS side FROM {_VOTES}), n AS (SELECT *, row_number() OVER (PARTITION BY task_id, side ORDER BY turn, decision) AS n FROM v),
f AS (SELECT task_id, min({{'turn': turn, 'side': side}}) AS f FROM n WHERE n = 2 GROUP BY task_id) SELECT t.task_id, coalesce(f.f.side, 'open') AS outcome, f.f.turn AS closed_at FROM (SELECT DISTINCT task_id FROM v) t LEFT JOIN f USING (task_id)""",
    "label_stats": "SELECT lang, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
    "hash_sample": "SELECT event_id FROM events WHERE ('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 4))::INT::DOUBLE / 65535.0::DOUBLE <= 0.2::DOUBLE",
    "audit_verify": f"""SELECT user_id, min(CASE WHEN broken THEN chain_seq END) AS first_broken, count(*) AS n FROM (SELECT *, CASE WHEN event_id % 97 = 3 AND chain_seq > 1 THEN sha256('altered') ELSE prev_hash END <> coalesce(sha256(lag(body) OVER (PARTITION BY user_id ORDER BY chain_seq)), '') AS broken FROM {_AUDIT}) GROUP BY user_id""",
    "audit_digest": f"SELECT event_id, sha256(concat(prev_hash, body)) AS digest FROM {_AUDIT}",
    "audit_chain_build": f"""WITH RECURSIVE a AS MATERIALIZED (SELECT user_id, chain_seq, body FROM {_AUDIT}),
c AS (SELECT user_id, chain_seq, sha256(encode(body)) AS row_hash FROM a WHERE chain_seq = 1
UNION ALL SELECT a.user_id, a.chain_seq, sha256(unhex(row_hash) || encode(body)) FROM c JOIN a ON a.user_id = c.user_id AND a.chain_seq = c.chain_seq + 1)
SELECT user_id, CAST(chain_seq AS INT) AS chain_seq, row_hash FROM c""",
    "reconcile_actions": f"""WITH j AS ({JOBS_SQL}), w AS (SELECT id, status AS want FROM j WHERE id % 3 <> 0), h AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'old' ELSE status END AS have FROM j WHERE id % 4 <> 0)
SELECT id, CASE WHEN have IS NULL THEN 'create' WHEN want IS NULL THEN 'delete' WHEN want = have THEN 'noop' WHEN want = 'done' THEN 'lock' ELSE 'edit' END AS action FROM w FULL JOIN h USING (id)""",
    "source_liveness": """WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events), r AS (SELECT user_id, run, count(*) FILTER (event_type = 'error') AS n FROM e GROUP BY ALL)
SELECT user_id, max(n) AS longest, max(n) >= 3 AS unreachable FROM r GROUP BY user_id""",
    "circuit_breaker": """WITH g AS (SELECT user_id, max(row(ts, event_id)) AS g FROM events WHERE event_type <> 'error' GROUP BY user_id), f AS (SELECT e.user_id, count(*) AS failures FROM events e LEFT JOIN g USING (user_id) WHERE event_type = 'error' AND (g IS NULL OR row(ts, event_id) > g) GROUP BY 1)
SELECT user_id, failures, CAST(CASE WHEN failures >= 3 THEN least(failures, 48) ELSE 0 END AS INT) AS open_h FROM f""",
    "revision_history": f"SELECT key, rev, valid_from, hash FROM {_REV}",
    "current_revision": f"SELECT key, max(rev) AS rev, arg_max(hash, rev) AS hash FROM {_REV} GROUP BY key",
    "content_hash_changes": "SELECT doc_id, doc_id % 3 = 0 OR old IS NULL AS is_new FROM (SELECT doc_id, sha256(text) AS hash, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN sha256(source) ELSE sha256(text) END END AS old FROM documents) WHERE hash IS DISTINCT FROM old",
    "upsert_latest": "SELECT user_id, r.event_type, r.value FROM (SELECT user_id, arg_max({'event_type': event_type, 'value': value}, row(ts, event_id)) AS r FROM events GROUP BY user_id)",
    "retention": f"""WITH e AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events), c AS (SELECT DISTINCT k FROM e WHERE event_type = 'purchase') SELECT event_type, CASE WHEN ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY THEN 'keep' WHEN k IN (FROM c) THEN 'nullify' ELSE 'delete' END AS action, count(*) AS n FROM e GROUP BY ALL""",
    "gdpr_purge": "SELECT conv_id, turn, CAST(CASE WHEN role <> 'user' THEN length(text) END AS INT) AS n_chars, CASE WHEN role = 'user' THEN 'purged' ELSE 'active' END AS status FROM conversations",
    "integrity_checks": """SELECT 'enum_returnflag' AS rule, count(*) AS violations FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R') UNION ALL SELECT 'positive_quantity', count(*) FROM lineitem WHERE l_quantity <= 0
UNION ALL SELECT 'unique_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'orphan_line', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "config_diff": "WITH a(path, old_value) AS (VALUES {}), b(path, new_value) AS (VALUES {}) SELECT path, old_value, new_value, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE old_value IS DISTINCT FROM new_value".format(*[", ".join(f"('{p}', '{v}')" for p, v in flatten_config(c)) for c in (CONFIG_OLD, CONFIG_NEW)]),
    "message_windows_tumbling": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL",
    "message_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, s""",
    "context_before": "SELECT conv_id, turn, coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ','), '') AS context FROM conversations",
    "reply_join": """WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CAST(props->>'$.k' AS BIGINT) % 60 + 1 AS back FROM events) SELECT a.event_id, b.event_id AS reply_to FROM n a JOIN n b ON a.user_id = b.user_id AND b.n = a.n - a.back WHERE a.back <= 50""",
    "interval_join": """WITH e AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS t FROM events) SELECT p.event_id AS purchase_id, c.event_id FROM e p JOIN e c ON p.user_id = c.user_id AND c.t BETWEEN p.t - 1800 AND p.t WHERE p.event_type = 'purchase' AND c.event_type <> 'purchase'""",
    "followup_lookup": "SELECT conv_id, turn, lag(h) OVER (PARTITION BY conv_id ORDER BY turn, h) AS previous FROM (SELECT conv_id, turn, sha256(text) AS h FROM conversations WHERE role = 'user')",
    "context_budget": """SELECT conv_id, turn, CAST(upto AS BIGINT) AS used FROM (SELECT *, sum(length(text)) OVER w AS upto, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)) WHERE upto <= 600 OR rn = 1""",
    "answer_cache": f"""WITH ep AS (SELECT user_id, count(*) AS epoch FROM events WHERE event_type = 'purchase' GROUP BY 1), p AS (SELECT *, CAST(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_epoch FROM events)
SELECT event_id, user_id, sha256(concat_ws(chr(31), user_id, event_type, at_epoch, props)) AS cache_key FROM p JOIN ep USING (user_id) WHERE event_type IN ('view', 'search') AND at_epoch = epoch AND ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 10 DAY""",
    "discovery_budget": """WITH o AS (SELECT CAST(ts AS DATE) AS day, props->>'$.k' AS key, bool_or(event_type = 'error') AS gap, min(event_id) AS event_id FROM events GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY gap DESC, (event_id + dayofyear(day)) % 100, event_id) AS INT) AS rn FROM o) SELECT day, key, gap, rn FROM r WHERE rn <= 2""",
    "eval_confusion": """WITH j AS (SELECT n_chars > 500 AS a, quality = 1 AS g FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (a AND g) AS tp, count(*) FILTER (a AND NOT g) AS fp, count(*) FILTER (NOT a AND g) AS fn, count(*) FILTER (NOT a AND NOT g) AS tn FROM j)
SELECT tp, fp, fn, tn, round(tp::DOUBLE / greatest(1, tp + fp), 6) AS precision, round(tp::DOUBLE / greatest(1, tp + fn), 6) AS recall FROM c""",
}


def _with_evidence_sql() -> None:
    from ..plans.tables import EVIDENCE_SQL

    ORACLES["upsert_merge_combine"] = f"SELECT claim_id, grp, max(tier) AS tier, arg_min(audience, line) FILTER (audience IS NOT NULL) AS audience, count(*) AS n FROM ({EVIDENCE_SQL}) GROUP BY claim_id, grp"
    ORACLES["upsert_keep_existing"] = f"WITH j AS ({JOBS_SQL}) SELECT id, kind FROM j WHERE status = 'queued' AND NOT EXISTS (SELECT 1 FROM j x WHERE x.status = 'done' AND x.run_after = j.run_after AND x.kind = j.kind)"
    ORACLES["cascade_deactivation"] = f"SELECT claim_id, count(*) AS deactivated FROM ({EVIDENCE_SQL}) WHERE active AND observation_id IN (SELECT p_partkey FROM part WHERE p_size > 45) GROUP BY claim_id"
    ORACLES["json_merge"] = """SELECT event_id, '{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}' AS meta FROM (SELECT event_id, unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events UNION ALL SELECT event_id, 'type', event_type FROM events) GROUP BY event_id"""


_with_evidence_sql()
