"""Text functions over the input tables, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import read


def _digest(column):
    return F.md5(column)


def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"), _digest(X.normalize(F.col("text"))).alias("norm_md5"))


def content_tokens(spark, d):
    t = read(spark, d, "documents").select("doc_id", X.content_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), _digest(F.array_join("t", " ")).alias("tokens_md5"))


def numbers(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(X.numbers(F.col("text"))), ",").alias("numbers"), X.has_number(F.col("text")).alias("has_number"))


def script_and_language(spark, d):
    c = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", X.script(c).alias("script"), X.language_style(c).alias("style"), X.supported_language(c).alias("supported"))


def is_question(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", X.is_question(F.col("text")).alias("question"))


def strip_noise(spark, d):
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("see "), "url", F.lit(" <@!12> <:x:9> 20 min"), "page_id").alias("t"))
    c = F.col("t")
    return p.select("page_id", X.strip_noise(c).alias("clean"), X.has_unit(c).alias("unit"), X.strip_mentions(c).alias("spoken"))


def render_text(spark, d):
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("[page]("), F.regexp_replace("url", "#.*", ""), F.lit(") for @everyone")).alias("t"))
    return p.select("page_id", X.safe_markdown(F.col("t")).alias("safe"), X.clip(F.col("t"), 30).alias("clipped"))


def references(spark, d):
    """Claim references, teaching prefixes and versions in text."""
    p = read(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "K-").when(F.col("p_partkey") % 3 == 1, "k").otherwise("note: "), F.col("p_partkey")).alias("t"), F.concat(F.lit("since patch "), F.col("p_size"), F.lit(".2 or v"), F.col("p_partkey")).alias("v"))
    return p.select("p_partkey", X.claim_number(F.col("t")).alias("claim_id"), X.teach_prefix(F.col("t")).alias("taught"), X.first_version(F.col("v"), [r"version (\d+\.\d+)", r"patch (\d+\.\d+)", r"v\d+"]).alias("version"))


def url_keys(spark, d):
    c = F.col("url")
    return read(spark, d, "pages").select("page_id", X.url_key(c).alias("url_key"), X.registrable_domain(c).alias("domain"))


def greeklish(spark, d):
    """Greek words put before each part's name, in Latin letters."""
    words = ("Θερμοπύλες", "ψυχή", "Ξένος μπαίνει", "αντίο", "ΟΥΡΑΝΟΣ")
    w = F.element_at(F.array(*[F.lit(x) for x in words]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", X.greeklish(F.concat_ws(" ", w, "p_name")).alias("latin"))


def coverage_score(spark, d):
    """Coverage of each user turn by the next assistant turn's tokens."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", X.content_tokens(F.col("text")).alias("t"))
    a = c.where("role = 'user'").select("conv_id", "turn", F.array_distinct("t").alias("q"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.array_distinct("t").alias("dt"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.coverage(F.col("q"), F.col("dt")), 6).alias("coverage"))


QUERIES = {f.__name__: f for f in (normalize_text, content_tokens, numbers, script_and_language, is_question, strip_noise, render_text, references, url_keys, greeklish, coverage_score)}


def folded_sql(c: str) -> str:
    return f"translate(strip_accents(lower(replace({c}, 'ß', 'ss'))), 'ς', 'σ')"


def tokens_sql(c: str) -> str:
    return f"list_transform(regexp_extract_all({folded_sql(c)}, '[\\p{{L}}\\p{{N}}]+(?:[.''’][\\p{{L}}\\p{{N}}]+)*'), lambda t: replace(t, '’', ''''))"


def words_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted({X.fold_text(w) for w in words})) + "]"


def is_content_sql(t: str) -> str:
    stop = words_sql(X.ENGLISH_STOPWORDS + X.GREEK_STOPWORDS + X.GREEKLISH_MARKERS)
    return f"NOT list_contains({stop}, {t}) AND (length({t}) > 1 OR regexp_matches({t}, '^[0-9]+$'))"


def content_sql(c: str) -> str:
    return f"list_filter({tokens_sql(c)}, lambda t: {is_content_sql('t')})"


def script_sql(c: str) -> str:
    greek, latin = (f"len(regexp_extract_all({c}, '{p}'))" for p in ("[Ͱ-Ͽἀ-῿]", "[a-zA-Z]"))
    return f"CASE WHEN {greek} = 0 AND {latin} = 0 THEN 'other' WHEN {greek} >= {latin} THEN 'greek' ELSE 'latin' END"


def question_sql(c: str) -> str:
    return f"coalesce(regexp_matches(trim({c}), '[?;;]$') OR coalesce(list_contains({words_sql(X.INTERROGATIVES)}, {tokens_sql(c)}[1]), false), false)"


_HIT = lambda words, t: f"len(list_filter({t}, lambda x: list_contains({words_sql(words)}, x)))"
ORACLES = {
    "normalize_text": f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, ' ')) AS norm_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
    "content_tokens": f"SELECT doc_id, CAST(len(t) AS INT) AS n, md5(coalesce(array_to_string(t, ' '), '')) AS tokens_md5 FROM (SELECT doc_id, {content_sql('text')} AS t FROM documents)",
    "numbers": r"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), lambda n: replace(n, ',', '.')))), ','), '') AS numbers, regexp_matches(text, '\d+(?:[.,]\d+)?') AS has_number FROM documents",
    "script_and_language": f"""WITH t AS (SELECT *, {tokens_sql('text')} AS t, {script_sql('text')} AS script, {tokens_sql('left(text, 5000)')} AS h FROM conversations), n AS (SELECT *, {_HIT(X.GREEKLISH_MARKERS, 't')} AS hits, {_HIT(X.ENGLISH_STOPWORDS, 't')} AS english, {_HIT(X.ENGLISH_STOPWORDS, 'h')}::DOUBLE / greatest(len(h), 1) AS share FROM t)
SELECT conv_id, turn, script, CASE WHEN script = 'greek' THEN 'el' WHEN (hits >= 2 AND hits > english) OR (hits >= 1 AND len(t) <= 4 AND english = 0) THEN 'greeklish' ELSE 'en' END AS style, CASE WHEN script = 'greek' THEN 'el' WHEN script = 'latin' AND share >= 0.12::DOUBLE THEN 'en' END AS supported FROM n""",
    "is_question": f"SELECT conv_id, turn, {question_sql('text')} AS question FROM conversations",
    "strip_noise": r"""WITH p AS (SELECT page_id, concat('see ', url, ' <@!12> <:x:9> 20 min', page_id) AS t FROM pages) SELECT page_id, trim(regexp_replace(regexp_replace(t, 'https?://\S+', ' ', 'g'), '<[@#][!&]?\d+>|<a?:\w+:\d+>', ' ', 'g')) AS clean,
regexp_matches(t, '(?i)\b\d+(?:[.,]\d+)?\s*(?:%|h|hr|hrs|m|min|mins|s|sec|k|kk|x|lvl|level|ώρες|λεπτά|lepta|wres)\b') AS unit, trim(regexp_replace(t, '<@!?\d+>', '', 'g')) AS spoken FROM p""",
    "render_text": r"""WITH p AS (SELECT page_id, concat('[page](', regexp_replace(url, '#.*', ''), ') for @everyone') AS t FROM pages) SELECT page_id, regexp_replace(regexp_replace(t, '\[([^\]]*)\]\((https?://[^)\s]+)\)', '\1 (<\2>)', 'g'), '@(everyone|here)', '@' || chr(8203) || '\1', 'g') AS safe,
CASE WHEN length(t) > 30 THEN rtrim(left(t, 29)) || '…' ELSE t END AS clipped FROM p""",
    "references": r"""WITH p AS (SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'K-' WHEN 1 THEN 'k' ELSE 'note: ' END, p_partkey) AS t, concat('since patch ', p_size, '.2 or v', p_partkey) AS v FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS claim_id, CASE WHEN p_partkey % 3 = 2 THEN CAST(p_partkey AS VARCHAR) END AS taught, regexp_extract(v, 'patch (\d+\.\d+)', 1) AS version FROM p""",
    "url_keys": r"""SELECT page_id, lower(regexp_extract(url, '^(\w+)://', 1)) || '://' || lower(regexp_extract(url, '^\w+://([^/:?#]+)', 1)) || regexp_replace(regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1), '/+$', '') || CASE WHEN regexp_matches(url, '^[^#]*\?') THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS url_key,
regexp_extract(lower(regexp_extract(url, '^\w+://([^/:?#]+)', 1)), '([^.]+\.[^.]+)$', 1) AS domain FROM pages""",
    "greeklish": "SELECT p_partkey, concat_ws(' ', ['Thermopyles', 'psyxi', 'Ksenos mpainei', 'antio', 'Ouranos'][p_partkey % 5 + 1], p_name) AS latin FROM part",
    "coverage_score": f"""WITH c AS (SELECT conv_id, turn, role, list_distinct({content_sql('text')}) AS t FROM conversations), j AS (SELECT a.conv_id, a.turn, a.t AS q, b.t AS dt FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(q, lambda x: len(list_filter(dt, lambda y: x = y OR (length(x) >= 4 AND length(y) >= 4 AND (starts_with(y, x) OR starts_with(x, y))) OR (length(x) >= 5 AND length(y) >= 5 AND left(x, 5) = left(y, 5)))) > 0))::DOUBLE / len(q), 6) END AS coverage FROM j""",
}
