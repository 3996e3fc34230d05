"""Changes that touch few rows: configuration versions, purges that derive only the touched claims anew, and spellings.

Versions are runs of equal content: applying what is in force changes nothing, and a rollback applies an earlier version's
content again. A purge takes away the evidence of some observations, and only claims that had some of it are derived again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from ..functions import text as X
from ..plans.tables import EVIDENCE_NOW, EVIDENCE_SQL, HALF_LIVES, claims, evidence, read
from ..session import ship_package
from .evidence import POLICY, derive, derive_sql
from .postings import written
from .ranges import Rule, fold


class Versions(Rule):
    """A profile's versions: the content hash of each, and which is in force. An apply of another content makes the next
    version, and so does a rollback, with the content of the version that it names; the state grows with the versions that
    a profile has had."""

    def __init__(self):
        self.hashes: list[str] = []

    def step(self, op: str, content: str | None, target: int | None) -> tuple[int, str]:
        now = self.hashes[-1] if self.hashes else None
        if op == "rollback":
            if target is None or not 1 <= target <= len(self.hashes):
                return len(self.hashes), "no_version"
            content = self.hashes[target - 1]
        if content == now and self.hashes:
            return len(self.hashes), "unchanged"
        self.hashes.append(content)
        return len(self.hashes), "rolled_back" if op == "rollback" else "applied"


def versions(changes: DataFrame) -> DataFrame:
    """changes (profile, at, seq, op, content, target) with version (in force after each) and outcome."""
    hashed = changes.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    return fold(hashed, ["profile"], ["at", "seq"], ["op", "content_hash", "target"], Versions, "version int, outcome string").drop("content_hash")


def config_changes(events: DataFrame) -> DataFrame:
    """Events as changes of their user's configuration: an error rolls back to the version that props.k names, anything else
    sets the event type to a level of the value."""
    k = F.get_json_object("props", "$.k").cast("int")
    back = F.col("event_type") == "error"
    content = F.concat_ws("=", "event_type", F.floor(F.col("value") / 25).cast("string"))
    return events.select(F.col("user_id").alias("profile"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(back, "rollback").otherwise("apply").alias("op"), F.when(~back, content).alias("content"), F.when(back, k % 12).alias("target"))


def config_versions(spark, d):
    """The version in force after each change, and whether it was applied, rolled back, without effect or without such a version."""
    v = versions(config_changes(read(spark, d, "events")))
    return v.select(F.col("seq").alias("event_id"), "version", "outcome")


#: Claims whose ids are sent to every task; more are joined by a shuffle.
MAX_TOUCHED = 500_000


def _only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids, which go to every task if they are few enough."""
    few = ids.limit(MAX_TOUCHED + 1).count() <= MAX_TOUCHED
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


def purged(claims_df: DataFrame, evidence_df: DataFrame, gone: DataFrame, **options) -> DataFrame:
    """The claims that lose active evidence as the observations gone (observation_id) are purged, derived again: their
    columns, n_removed, and was_verification and was_score from before.

    Evidence of other claims is dropped by the scan's join with the touched claims' ids, before any shuffle."""
    active = evidence_df.where("active")
    lost = active.join(gone.select("observation_id").distinct(), "observation_id", "left_semi")
    touched = written(lost.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_removed")), "touched")
    ids = touched.select("claim_id")
    some, of = _only(claims_df, ids, "claim_id"), _only(active, ids, "claim_id")
    before = derive(some, of, **options).select("claim_id", F.col("verification").alias("was_verification"), F.col("support_score").alias("was_score"))
    after = derive(some, of.join(gone.select("observation_id").distinct(), "observation_id", "left_anti"), **options)
    return after.join(touched, "claim_id").join(before, "claim_id")


def purge_recompute(spark, d):
    """What the purge of all observations of the largest parts (size 46 and over) does to the claims that they touch."""
    gone = read(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("observation_id"))
    p = purged(claims(spark, d), evidence(spark, d), gone, policy=POLICY, now=EVIDENCE_NOW, half_lives=HALF_LIVES)
    return p.select("claim_id", "n_removed", "was_verification", "verification", "was_score", "support_score", "lifecycle", "n_sup", "n_con")


#: Spellings of a word at most.
SPELLINGS = 24


@udtf(returnType="spelling string, nth int")
class Spellings:
    """The Latin spellings of a Greek text, a row each."""

    def eval(self, text: str | None, limit: int) -> Iterator[tuple[str, int]]:
        for n, form in enumerate(X.spellings(text, limit) if text else []):
            yield form, n


def spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    """The Latin spellings of the words of part names, written in Greek letters, by a lateral join with a table function."""
    ship_package(spark)
    spark.udtf.register("claimloom_spellings", Spellings)
    words = read(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    words.select(F.translate("w", LATIN, GREEK).alias("word")).distinct().createOrReplaceTempView("claimloom_words")
    return spark.sql(f"SELECT word, spelling FROM claimloom_words, LATERAL claimloom_spellings(word, {SPELLINGS})")


# The Greek letter that stands for each Latin one.
LATIN, GREEK = "abcdefghiklmnoprstuvwxyz", "αβκδεφγηικλμνοπρστυβωχυζ"


QUERIES = {f.__name__: f for f in (config_versions, purge_recompute, spelling_variants)}

_GONE = "SELECT p_partkey FROM part WHERE p_size > 45"
_UNITS = "|".join(X.GREEK_PAIRS) + "|."


def _choices_sql(unit: str) -> str:
    listed = {u: list(v) for u, v in X.GREEK_SPELLINGS.items()}
    single = {u: [v] for u, v in (X.GREEK_LETTERS | X.GREEK_PAIRS).items() if u not in listed}
    return "CASE " + " ".join(f"WHEN {unit} = '{u}' THEN {v}" for u, v in (listed | single).items()) + f" ELSE [{unit}] END"


ORACLES = {
    "config_versions": """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN CAST(json_extract(props, '$.k') AS INT) % 12 END AS target,
  concat(event_type, '=', CAST(floor(value / 25) AS BIGINT)) AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, n, CASE WHEN target IS NULL THEN [content] ELSE [] END AS held, CASE WHEN target IS NULL THEN 'applied' ELSE 'no_version' END AS outcome FROM e WHERE n = 1
UNION ALL SELECT event_id, user_id, n, CASE WHEN outcome IN ('applied', 'rolled_back') THEN list_append(held, made) ELSE held END, outcome FROM (
  SELECT *, CASE WHEN target IS NOT NULL AND (target < 1 OR target > len(held)) THEN 'no_version' WHEN len(held) > 0 AND made = held[-1] THEN 'unchanged' WHEN target IS NOT NULL THEN 'rolled_back' ELSE 'applied' END AS outcome FROM (
    SELECT e.*, w.held, CASE WHEN e.target IS NULL THEN e.content ELSE w.held[e.target] END AS made FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)))
SELECT event_id, CAST(len(held) AS INT) AS version, outcome FROM w""",
    "purge_recompute": f"""WITH was AS {derive_sql()}, now AS {derive_sql().replace(EVIDENCE_SQL, f"SELECT * FROM ({EVIDENCE_SQL}) WHERE observation_id NOT IN ({_GONE})")},
t AS (SELECT claim_id, count(*) AS n_removed FROM ({EVIDENCE_SQL}) WHERE active AND observation_id IN ({_GONE}) GROUP BY 1)
SELECT claim_id, n_removed, was.verification AS was_verification, now.verification, was.support_score AS was_score, now.support_score, now.lifecycle, now.n_sup, now.n_con FROM t JOIN was USING (claim_id) JOIN now USING (claim_id)""",
    "spelling_variants": f"""WITH w AS (SELECT DISTINCT translate(unnest(regexp_extract_all(lower(p_name), '[a-z]+')), '{LATIN}', '{GREEK}') AS word FROM part),
u AS (SELECT word, list_transform(regexp_extract_all(word, '{_UNITS}'), lambda u: {_choices_sql('u')}) AS parts FROM w)
SELECT DISTINCT word, unnest(list_reduce(list_prepend([''], parts), lambda a, b: flatten(list_transform(a, lambda x: list_transform(b, lambda y: x || y)))[1:{SPELLINGS}])) AS spelling FROM u WHERE regexp_matches(word, '[Ͱ-Ͽ]')""",
}
