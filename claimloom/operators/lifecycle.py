"""The steps between a question or message and stored knowledge: parsing, prompts, attempts, reviews, FAQ, provenance."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..functions import text as X
from ..plans.tables import CLAIMS_SQL, EVENTS_NOW, EVIDENCE_SQL, claims, evidence, read
from .evidence import _derived, derive_sql
from .texts import folded_sql

#: Scopes with their origins and least state, their spellings, and user-interface strings.
SCOPES = (("all", None, "corroborated", False), ("verified", None, "verified", False), ("faq", None, "verified", True), ("internal", "discord,manual,import", "corroborated", False), ("web", "web", "corroborated", False))
SCOPE_WORDS = {"web": "web", "site": "web", "internal": "internal", "faq": "faq", "verified": "verified", "all": "all"}
STRINGS = (("verified", "en", "Verified"), ("verified", "el", "Επιβεβαιωμένο"), ("disputed", "en", "Disputed"), ("disputed", "el", "Αμφισβητείται"), ("corroborated", "en", "Corroborated"), ("corroborated", "el", "Ενισχυμένο"), ("unverified", "en", "Unverified"), ("unverified", "el", "Ανεπιβεβαίωτο"))


def parse_question(raw: Column, scopes: dict[str, str] = SCOPE_WORDS, categories: tuple = ("content", "economy"), regions: tuple = ("EU", "NA")) -> Column:
    """struct(text, scope, category, region): leading "web:", "scope:x", "region:XX" and "#category" taken out of the text.

    A fold over the words; "leading" lasts until the first word that is kept."""
    words = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for pair in scopes.items() for x in pair])
    text = F.lit(None).cast("string")
    start = F.struct(F.lit(True).alias("lead"), text.alias("scope"), text.alias("category"), text.alias("region"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, word: Column) -> Column:
        low = F.lower(word)
        lead_name = F.when(acc["lead"] & F.endswith(low, F.lit(":")) & acc["scope"].isNull(), F.try_element_at(known, F.regexp_replace(low, ":$", "")))
        named = F.when(F.startswith(low, F.lit("scope:")), F.try_element_at(known, F.substring(low, 7, 100)))
        region = F.when(F.startswith(low, F.lit("region:")) & F.upper(F.substring(low, 8, 100)).isin(*regions), F.upper(F.substring(low, 8, 100)))
        tag = F.regexp_replace(F.substring(low, 2, 100), r"[?,.!;]+$", "")
        category = F.when(F.startswith(low, F.lit("#")) & tag.isin(*categories), tag)
        taken = lead_name.isNotNull() | named.isNotNull() | region.isNotNull() | category.isNotNull()
        return F.struct((acc["lead"] & taken).alias("lead"), F.coalesce(lead_name, named, acc["scope"]).alias("scope"), F.coalesce(category, acc["category"]).alias("category"), F.coalesce(region, acc["region"]).alias("region"), F.when(taken, acc["kept"]).otherwise(F.array_append(acc["kept"], word)).alias("kept"))

    return F.aggregate(words, start, step, lambda acc: F.struct(F.array_join(acc["kept"], " ").alias("text"), acc["scope"].alias("scope"), acc["category"].alias("category"), acc["region"].alias("region")))


def parsed_questions(spark, d):
    q = read(spark, d, "benchmark").select("item_id", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("web: ", "scope:faq region:eu ", "", "web: internal: ", "see web: ")]), (F.col("item_id") % 5 + 1).cast("int")), F.regexp_replace("text", r"\s+", " "), F.when(F.col("item_id") % 2 == 0, " #economy?").otherwise(" #nothing")).alias("raw"))
    p = q.select("item_id", parse_question(F.col("raw")).alias("p"))
    return p.select("item_id", "p.scope", "p.category", "p.region", F.md5("p.text").alias("text_md5"))


def scope_resolution(spark, d):
    """Claims by what each scope lets through: origins and a least state."""
    s = F.broadcast(spark.createDataFrame([(a, b.split(",") if b else None, c, e) for a, b, c, e in SCOPES], "scope string, origins array<string>, least string, faq_only boolean"))
    origin = F.element_at(F.array(*[F.lit(x) for x in ("discord", "web", "manual", "import")]), (F.col("claim_id") % 4 + 1).cast("int"))
    level = lambda c: F.when(c == "verified", 2).when(c == "corroborated", 1).otherwise(0)
    c = _derived(spark, d).select("claim_id", "verification", origin.alias("origin"))
    j = c.join(s, (F.col("origins").isNull() | F.array_contains("origins", F.col("origin"))) & (level(F.col("verification")) >= level(F.col("least"))))
    return j.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


def include_filter(spark, d):
    """Links that the source's include pattern keeps."""
    return read(spark, d, "pages").where(F.col("url").rlike(r"/(?:en|fr)/\d+")).select("page_id")


def json_key_exists(spark, d):
    return read(spark, d, "events").where(F.get_json_object("props", "$.k").isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def claim_provenance(spark, d):
    """Evidence with its observation, its source and the endorser (the same dimension under two names), if visible."""
    e = evidence(spark, d).where("active").where(F.col("audience").isNull() | (F.col("audience") == 6))
    o = read(spark, d, "part").select(F.col("p_partkey").alias("observation_id"), F.col("p_name").alias("title"))
    s = read(spark, d, "supplier")
    author = s.select(F.col("s_suppkey").alias("grp"), F.col("s_name").alias("author"))
    endorser = s.select((F.col("s_suppkey") * 2).alias("grp"), F.col("s_name").alias("endorser"))
    return e.join(o, "observation_id").join(author, "grp", "left").join(endorser, "grp", "left").select("claim_id", "line", "title", "author", "endorser", "stance")


def delete_not_listed(spark, d):
    """Rows of a materialised table that the configuration no longer lists."""
    return read(spark, d, "nation").join(read(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "left_anti").select("n_nationkey")


def update_from_due(spark, d):
    """Schedules that are due take the next bucket; the others stay (an update join)."""
    s = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 24).alias("last_bucket"))
    due = read(spark, d, "events").groupBy((F.col("user_id") % 24).alias("last_bucket")).agg(F.max("event_id").alias("bucket"))
    return s.join(due.where("bucket % 2 = 0"), "last_bucket", "left").select("s_suppkey", F.coalesce("bucket", "last_bucket").alias("bucket"))


def delete_stale_cache(spark, d):
    """Cache rows whose profile has moved to another epoch go."""
    cache = read(spark, d, "orders").select(F.col("o_orderkey").alias("cache_id"), (F.col("o_custkey") % 25).cast("int").alias("profile_id"), (F.col("o_orderkey") % 5).alias("epoch"))
    now = read(spark, d, "nation").select(F.col("n_nationkey").alias("profile_id"), (F.col("n_nationkey") % 5).cast("long").alias("epoch"))
    return cache.join(now, ["profile_id", "epoch"], "left_semi").groupBy("profile_id").agg(F.count(F.lit(1)).alias("kept"))


def llm_need(spark, d):
    """Whether an answer is put into words by a model: always, never, or if it is a list or a conflict."""
    e = read(spark, d, "events")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("auto", "always", "never")]), (F.col("user_id") % 3 + 1).cast("int"))
    need = F.when(mode == "never", False).when(F.col("event_type") == "error", False).when(mode == "always", True).otherwise(F.col("event_type").isin("click", "view"))
    return e.select("event_id", need.alias("need"))


def query_log_expiry(spark, d):
    """Log rows with the day on which their text is dropped; expired ones lose it now."""
    e = read(spark, d, "events")
    gone = F.col("ts") + F.expr("INTERVAL 14 DAYS")
    return e.select("event_id", F.to_date(gone).alias("expires_on"), F.when(gone >= F.lit(EVENTS_NOW).cast("timestamp_ntz"), F.col("props")).alias("props"), F.sha2(F.concat(F.lit("salt:"), "user_id"), 256).alias("user_hash"))


def prompt_sources(spark, d):
    """Messages of a window as the model sees them: pseudonyms in order of appearance, 2000 characters each, a total budget."""
    c = read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    first = F.min("turn").over(Window.partitionBy("conv_id", "role"))
    c = c.withColumn("first", first).withColumn("pseudonym", F.concat(F.lit("user"), F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first", "role"))))
    c = c.withColumn("clip", F.least(F.length("text"), F.lit(2000))).withColumn("upto", F.sum("clip").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    return c.where((F.col("upto") <= 6000) & (F.col("n") <= 30)).select("conv_id", "turn", F.concat(F.lit("S"), "n").alias("sid"), "pseudonym", "clip")


def repair_attempts(spark, d):
    """The first valid of two attempts at an output; bad output if both fail, unavailable if there was none."""
    li = read(spark, d, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") < 0.03, "timeout").when(F.col("l_tax") < 0.04, "invalid").otherwise("valid").alias("status"))
    g = li.groupBy("l_orderkey").agg(F.min(F.when(F.col("status") == "valid", F.col("l_linenumber"))).alias("attempt"), F.bool_and(F.col("status") == "timeout").alias("none"))
    return g.select("l_orderkey", "attempt", F.when(F.col("attempt").isNotNull(), "ok").when(F.col("none"), "unavailable").otherwise("bad_output").alias("outcome"))


def review_submit(spark, d):
    """New claims kept or rejected by the gate, or a review task unless one is open for them."""
    c = claims(spark, d).where("lifecycle = 'active'").select("claim_id", ((F.col("claim_id") * 37) % 1000 / 1000.0).alias("p"))
    open_tasks = claims(spark, d).where("open_conflict").select("claim_id").withColumn("open", F.lit(True))
    decision = F.when(F.col("p") >= 0.95, "keep").when(F.col("p") <= 0.05, "reject").when(F.col("open"), "already_open").otherwise("task")
    return c.join(open_tasks, "claim_id", "left").select("claim_id", decision.alias("decision"))


def apply_decision(spark, d):
    """Claims after review: keep and edit make them human-verified and active again, reject takes them out."""
    c = claims(spark, d).withColumn("decision", F.element_at(F.array(*[F.lit(x) for x in ("keep", "edit", "reject", "none")]), (F.col("claim_id") % 4 + 1).cast("int")))
    positive = F.col("decision").isin("keep", "edit")
    lifecycle = F.when(F.col("decision") == "reject", "rejected").when(positive & F.col("lifecycle").isin("rejected"), "active").otherwise(F.col("lifecycle"))
    return c.select("claim_id", lifecycle.alias("lifecycle"), (positive | F.col("human_verified")).alias("human_verified"))


def faq_draft(spark, d):
    """A draft's question: the model's if it is of 8 to 200 characters, else the template."""
    b = read(spark, d, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("What is "), F.substring("text", 1, 20), F.lit("?"))).when(F.col("item_id") % 3 == 1, "Why?").alias("drafted"))
    ok = F.coalesce(F.length("drafted").between(8, 200), F.lit(False))
    return b.select("item_id", F.when(ok, F.col("drafted")).otherwise(F.concat(F.lit("general: "), F.substring("text", 1, 80), F.lit("?"))).alias("question"), F.when(ok, "model").otherwise("template").alias("drafted_by"))


def faq_approve(spark, d):
    """Four eyes: who proposed an entry cannot approve it."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("faq_id"), (F.col("o_custkey") % 5).alias("by"), (F.col("o_orderkey") % 5).alias("approver"), "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", F.when(F.col("faq_id") % 2 == 0, "deprecated").otherwise("rejected")).when(F.col("by") == F.col("approver"), "needs_second").otherwise("published")
    return o.select("faq_id", status.alias("status"))


def infer_category(spark, d):
    """The category of each turn: the first alias of one that stands in it, else general."""
    t = X.tokens(F.col("text"))
    aliases = F.create_map(*[F.lit(x) for x in ("les", "content", "the", "economy", "und", "skills", "que", "content")])
    hit = F.get(F.filter(F.transform(t, lambda w: F.try_element_at(aliases, w)), lambda c: c.isNotNull()), F.lit(0))
    return read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(hit, F.lit("general")).alias("category"))


def manual_add(spark, d):
    """Statements added by hand: a known one gains evidence, a new one becomes a claim; trusted authors verify."""
    given = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(X.normalize(F.col("text"))).alias("norm"), (F.col("conv_id") % 5).alias("tier"))
    known = read(spark, d, "documents").select(F.md5(X.normalize(F.col("text"))).alias("norm")).distinct().withColumn("known", F.lit(True))
    return given.join(known, "norm", "left").select("conv_id", "turn", F.when(F.col("known"), "evidence").otherwise("claim").alias("effect"), (F.col("tier") >= 3).alias("verified"))


def explicit_capture(spark, d):
    """Context turns that a pin promotes, with the highest endorsing tier."""
    pins = read(spark, d, "events").where("event_type = 'click'").select((F.col("user_id") % 50).alias("conv_id"), (F.col("event_id") % 5).cast("int").alias("tier")).groupBy("conv_id").agg(F.max("tier").alias("endorser_tier"))
    return read(spark, d, "conversations").where("turn = 0").join(pins, "conv_id", "left").select("conv_id", "turn", F.when(F.col("endorser_tier").isNotNull(), "candidate").otherwise("context_only").alias("state"), "endorser_tier")


def materialize_config(spark, d):
    """Category rows of a nested configuration: parents before children, by position."""
    tree = [("content", ["skills"]), ("economy", []), ("general", [])]
    c = spark.createDataFrame(tree, "key string, children array<string>").select("key", F.explode(F.concat(F.array(F.struct(F.col("key").alias("k"), F.lit(None).cast("string").alias("parent"))), F.transform("children", lambda x: F.struct(x.alias("k"), F.col("key").alias("parent"))))).alias("r"))
    return c.select(F.col("r.k").alias("key"), "r.parent")


def localized_states(spark, d):
    """State names in each conversation's language."""
    s = F.broadcast(spark.createDataFrame(list(STRINGS), "key string, lang string, label string"))
    c = _derived(spark, d).select("claim_id", F.col("verification").alias("key"), F.when(F.col("claim_id") % 2 == 0, "el").otherwise("en").alias("lang"))
    return c.join(s, ["key", "lang"]).select("claim_id", "label", X.greeklish(F.col("label")).alias("latin"))


def prompt_versions(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.substring(F.sha2("text", 256), 1, 10).alias("version"))


def chronological_split(spark, d):
    """The first four fifths of each type's events in time train, the rest test."""
    w = Window.partitionBy("event_type")
    e = read(spark, d, "events").withColumn("n", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("total", F.count(F.lit(1)).over(w))
    return e.select("event_id", F.when(F.col("n") <= F.floor(F.col("total") * 0.8), "train").otherwise("test").alias("part"))


QUERIES = {f.__name__: f for f in (parsed_questions, scope_resolution, include_filter, json_key_exists, claim_provenance, delete_not_listed, update_from_due, delete_stale_cache, llm_need, query_log_expiry, prompt_sources, repair_attempts, review_submit, apply_decision, faq_draft, faq_approve, infer_category, manual_add, explicit_capture, materialize_config, localized_states, prompt_versions, chronological_split)}

_TOK = f"regexp_extract_all({folded_sql('text')}, '[\\p{{L}}\\p{{N}}]+(?:[.''’][\\p{{L}}\\p{{N}}]+)*')"
_NORM = f"md5(coalesce(array_to_string(list_transform({_TOK}, lambda t: replace(t, '’', '''')), ' '), ''))"
ORACLES = {
    "parsed_questions": r"""WITH q AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, item_id % 5 AS m FROM benchmark)
SELECT item_id, CASE WHEN m IN (0, 3) THEN 'web' WHEN m = 1 THEN 'faq' END AS scope, CASE WHEN item_id % 2 = 0 THEN 'economy' END AS category, CASE WHEN m = 1 THEN 'EU' END AS region,
md5(CASE m WHEN 3 THEN 'internal: ' WHEN 4 THEN 'see web: ' ELSE '' END || t || CASE WHEN item_id % 2 = 0 THEN '' ELSE ' #nothing' END) AS text_md5 FROM q""",
    "scope_resolution": f"""WITH c AS (SELECT CASE verification WHEN 'verified' THEN 2 WHEN 'corroborated' THEN 1 ELSE 0 END AS v, ['discord', 'web', 'manual', 'import'][claim_id % 4 + 1] AS o FROM {derive_sql()}),
s(scope, origins, least) AS (VALUES ('all', NULL, 1), ('verified', NULL, 2), ('faq', NULL, 2), ('internal', ['discord', 'manual', 'import'], 1), ('web', ['web'], 1)) SELECT scope, count(*) AS n FROM c JOIN s ON (origins IS NULL OR list_contains(origins, o)) AND v >= least GROUP BY scope""",
    "include_filter": r"SELECT page_id FROM pages WHERE regexp_matches(url, '/(?:en|fr)/\d+')",
    "json_key_exists": "SELECT event_type, count(*) AS n FROM events WHERE json_exists(props, '$.k') GROUP BY 1",
    "claim_provenance": f"""SELECT claim_id, line, p_name AS title, a.s_name AS author, b.s_name AS endorser, stance FROM ({EVIDENCE_SQL}) e JOIN part ON p_partkey = observation_id LEFT JOIN supplier a ON a.s_suppkey = grp LEFT JOIN supplier b ON b.s_suppkey * 2 = grp WHERE active AND (audience IS NULL OR audience = 6)""",
    "delete_not_listed": "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)",
    "update_from_due": "WITH u AS (SELECT user_id % 24 AS b, max(event_id) AS bucket FROM events GROUP BY 1) SELECT s_suppkey, coalesce(bucket, s_suppkey % 24) AS bucket FROM supplier LEFT JOIN u ON b = s_suppkey % 24 AND bucket % 2 = 0",
    "delete_stale_cache": "SELECT CAST(o_custkey % 25 AS INT) AS profile_id, count(*) AS kept FROM orders WHERE o_orderkey % 5 = (o_custkey % 25) % 5 AND o_custkey % 25 IN (SELECT n_nationkey FROM nation) GROUP BY 1",
    "llm_need": "SELECT event_id, CASE WHEN user_id % 3 = 2 OR event_type = 'error' THEN false WHEN user_id % 3 = 1 THEN true ELSE event_type IN ('click', 'view') END AS need FROM events",
    "query_log_expiry": f"SELECT event_id, CAST(ts + INTERVAL 14 DAY AS DATE) AS expires_on, CASE WHEN ts + INTERVAL 14 DAY >= TIMESTAMP '{EVENTS_NOW}' THEN props END AS props, sha256('salt:' || user_id) AS user_hash FROM events",
    "prompt_sources": """WITH f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations), c AS (SELECT conv_id, turn, 'user' || dense_rank() OVER (PARTITION BY conv_id ORDER BY first, role) AS pseudonym, CAST(least(length(text), 2000) AS INT) AS clip,
  sum(least(length(text), 2000)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM f) SELECT conv_id, turn, 'S' || n AS sid, pseudonym, clip FROM c WHERE upto <= 6000 AND n <= 30""",
    "repair_attempts": """WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.03::DOUBLE THEN 'timeout' WHEN l_tax < 0.04::DOUBLE THEN 'invalid' ELSE 'valid' END AS s FROM lineitem WHERE l_linenumber <= 2)
SELECT l_orderkey, min(l_linenumber) FILTER (s = 'valid') AS attempt, CASE WHEN count(*) FILTER (s = 'valid') > 0 THEN 'ok' WHEN bool_and(s = 'timeout') THEN 'unavailable' ELSE 'bad_output' END AS outcome FROM a GROUP BY 1""",
    "review_submit": f"WITH c AS (SELECT *, ((claim_id * 37) % 1000)::DOUBLE / 1000.0::DOUBLE AS p FROM ({CLAIMS_SQL}) WHERE lifecycle = 'active') SELECT claim_id, CASE WHEN p >= 0.95::DOUBLE THEN 'keep' WHEN p <= 0.05::DOUBLE THEN 'reject' WHEN open_conflict THEN 'already_open' ELSE 'task' END AS decision FROM c",
    "apply_decision": f"SELECT claim_id, CASE WHEN claim_id % 4 = 2 THEN 'rejected' ELSE lifecycle END AS lifecycle, claim_id % 4 < 2 OR human_verified AS human_verified FROM ({CLAIMS_SQL})",
    "faq_draft": "WITH b AS (SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN 'What is ' || left(text, 20) || '?' WHEN 1 THEN 'Why?' END AS q FROM benchmark) SELECT item_id, CASE WHEN length(q) BETWEEN 8 AND 200 THEN q ELSE 'general: ' || left(text, 80) || '?' END AS question, CASE WHEN length(q) BETWEEN 8 AND 200 THEN 'model' ELSE 'template' END AS drafted_by FROM b",
    "faq_approve": "SELECT o_orderkey AS faq_id, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'deprecated' ELSE 'rejected' END WHEN o_custkey % 5 = o_orderkey % 5 THEN 'needs_second' ELSE 'published' END AS status FROM orders",
    "infer_category": f"SELECT conv_id, turn, coalesce(list_filter(list_transform({_TOK}, lambda w: CASE w WHEN 'les' THEN 'content' WHEN 'que' THEN 'content' WHEN 'the' THEN 'economy' WHEN 'und' THEN 'skills' END), lambda c: c IS NOT NULL)[1], 'general') AS category FROM conversations",
    "manual_add": f"SELECT conv_id, turn, CASE WHEN {_NORM} IN (SELECT {_NORM} FROM documents) THEN 'evidence' ELSE 'claim' END AS effect, conv_id % 5 >= 3 AS verified FROM conversations WHERE role = 'user'",
    "explicit_capture": "WITH p AS (SELECT user_id % 50 AS conv_id, max(event_id % 5)::INT AS endorser_tier FROM events WHERE event_type = 'click' GROUP BY 1) SELECT c.conv_id, turn, CASE WHEN endorser_tier IS NOT NULL THEN 'candidate' ELSE 'context_only' END AS state, endorser_tier FROM conversations c LEFT JOIN p ON p.conv_id = c.conv_id WHERE turn = 0",
    "materialize_config": "SELECT * FROM (VALUES ('content', NULL), ('skills', 'content'), ('economy', NULL), ('general', NULL)) v(key, parent)",
    "localized_states": f"SELECT claim_id, CASE WHEN claim_id % 2 = 1 THEN upper(left(verification, 1)) || substr(verification, 2) ELSE CASE verification WHEN 'verified' THEN 'Επιβεβαιωμένο' WHEN 'disputed' THEN 'Αμφισβητείται' WHEN 'corroborated' THEN 'Ενισχυμένο' ELSE 'Ανεπιβεβαίωτο' END END AS label, CASE WHEN claim_id % 2 = 1 THEN upper(left(verification, 1)) || substr(verification, 2) ELSE CASE verification WHEN 'verified' THEN 'Epivevaiwmeno' WHEN 'disputed' THEN 'Amfisviteitai' WHEN 'corroborated' THEN 'Enisxymeno' ELSE 'Anepivevaiwto' END END AS latin FROM {derive_sql()}",
    "prompt_versions": "SELECT item_id, left(sha256(text), 10) AS version FROM benchmark",
    "chronological_split": "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= floor(count(*) OVER (PARTITION BY event_type) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM events",
}
