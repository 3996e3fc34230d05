"""Text functions, ingest rules, web helpers and queue pieces on literal rows."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from claimloom.functions import text as X
from claimloom.operators import ingest, retrieval, web, workflow
from claimloom.sources import readers
from claimloom.streaming import flows


def values(spark, fn, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in frame.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def slow_tokens(text):
    return [t.replace("’", "'") for t in re.findall(r"[^\W_]+(?:[.'’][^\W_]+)*", X.fold_text(text))]


def test_tokens_match_the_exact_path(spark):
    texts = ["Ποιός ΜΟΝΟΜΆΧΟΣ;", "Straße don’t v1.2 _x_ É", "", "Ξένος’ ΐ ΰ ΑΫ", "naïve café Ångström", "a.b.c 3,5 x-y"]
    assert values(spark, X.tokens, texts) == [slow_tokens(t) for t in texts]


@given(st.lists(st.text(alphabet=st.sampled_from(" abzABZ09.,'’_-éÉßçñöüΑάΆΐςΣϊΰΏω"), max_size=30), min_size=1, max_size=25))
@settings(max_examples=6, deadline=None)
def test_normalize_is_idempotent_and_exact(spark, texts):
    once = values(spark, X.normalize, texts)
    assert once == [" ".join(slow_tokens(t)) for t in texts]
    assert values(spark, X.normalize, once) == once


def test_language_and_questions(spark):
    assert values(spark, X.language_style, ["pws kanw enchant", "πώς κάνω", "how do I enchant", "pote", "12"]) == ["greeklish", "el", "en", "greeklish", "en"]
    assert values(spark, X.script, ["abc", "αβγ", "12", "aα"]) == ["latin", "greek", "other", "greek"]
    assert values(spark, X.is_question, ["where is it", "it is here?", "πότε ανοίγει", "it is here", "", None, "really;"]) == [True, True, True, False, False, False, True]
    assert values(spark, X.teach_prefix, ["learn: Fire", "ΜΆΘΕ:  νερό", "nothing", "Note:x"]) == ["Fire", "νερό", None, "x"]
    assert values(spark, X.content_tokens, ["The boss of the Fire Temple 5 x"]) == [["boss", "fire", "temple", "5"]]


def test_greeklish(spark):
    assert values(spark, X.greeklish, ["Ουρανός και γη", "plain Text", "ΨΥΧΗ"]) == ["Ouranos kai gi", "plain Text", "Psyxi"]
    assert {"thea", "8ea"} <= set(X.spellings("θεά")) and X.spellings("abc") == [] and len(X.spellings("χωυηθξ")) <= 24


def test_text_helpers(spark):
    assert values(spark, X.safe_markdown, ["[a](https://b.c) @everyone"]) == ["a (<https://b.c>) @​everyone"]
    assert values(spark, lambda c: X.clip(c, 5), ["abcdef", "abcd ef", "abc"]) == ["abcd…", "abcd…", "abc"]
    assert values(spark, X.claim_number, ["K-12", "12", "x12", "k-7"]) == [12, 12, None, 7]
    assert values(spark, X.url_key, ["HTTPS://Ex.com:8080/a/?q=1#f", "http://x.y/"]) == ["https://ex.com/a?q=1", "http://x.y"]
    assert values(spark, X.numbers, ["1,5 and 1.5 and 20"]) == [["1.5", "20"]]


def test_token_match_and_coverage(spark):
    pairs = [("boss", "boss"), ("boss", "bosses"), ("bo", "boss"), ("spawning", "spawned"), ("temple", "tempest"), ("abcd", "abce")]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["m"] for r in frame.select("i", X.token_match(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()]
    assert got == [True, True, False, True, False, False]
    frame = spark.createDataFrame([(["boss", "klasi"], ["boss"]), ([], ["boss"])], "q array<string>, d array<string>")
    assert [r[0] for r in frame.select(X.coverage(F.col("q"), F.col("d"), F.array(F.lit("klasi")))).collect()] == [1.0, 0.0]


@pytest.mark.parametrize(
    ("text", "tier", "entity", "alias", "want"),
    [
        ("lol", 2, 0, 0, "drop"), ("<@123> 😂 https://x.y", 2, 0, 0, "drop"), ("where does the boss spawn?", 2, 0, 0, "context"), ("I really like this game a lot honestly", 2, 0, 0, "context"),
        ("The Fire Temple boss respawns every 4 hours", 2, 1, 0, "candidate"), ("Enchanting to +10 costs about 300k kinah", 2, 0, 1, "candidate"), ("trust me this works fine for everyone", 3, 0, 0, "candidate"), ("x" * 4001, 2, 0, 0, "context"),
    ],
)
def test_prefilter(spark, text, tier, entity, alias, want):
    frame = spark.createDataFrame([(text, tier, alias, entity, False)], "text string, author_tier int, alias_hits int, entity_hits int, is_reply_to_question boolean")
    assert ingest.prefilter(frame).first()["decision"] == want


def test_model_output_parsing_and_rules(spark):
    source = "The boss respawns every 4 hours in patch 1.2 of the game"
    claim = lambda **k: {"statement": "The boss respawns every 4 hours", "type": "fact", "category": "content", "source_ids": ["S1"], "quotes": ["boss respawns every 4 hours"]} | k
    import json

    cases = [({}, None), ({"type": "opinion"}, "V7_type"), ({"statement": "short"}, "V6_length"), ({"statement": "look at http://evil.example now"}, "V6_links"), ({"source_ids": ["S9"]}, "V2_sources"), ({"quotes": ["dragons appear at midnight"]}, "V3_quotes"), ({"statement": "The boss respawns every 9 hours"}, "V8_numbers")]
    data = [(i, source, "```json\n" + json.dumps({"claims": [claim(**k)]}) + "\n```" if i % 2 else json.dumps({"claims": [claim(**k)]})) for i, (k, _) in enumerate(cases)] + [(99, source, "[1]"), (98, source, "no json")]
    frame = spark.createDataFrame(data, "doc_id long, text string, raw string").withColumn("parsed", ingest.parse_output(F.col("raw")))
    got = {r["doc_id"]: r["rule"] for r in ingest.validate(frame).collect()}
    assert got == {i: rule for i, (_, rule) in enumerate(cases)}


def test_fuzzy_quotes():
    assert ingest.indel_ratio("abcdef", "xxabcdefxx") == 100.0
    assert 80 < ingest.indel_ratio("abcdef", "xxabXdefxx") < 90
    assert ingest.indel_ratio("", "abc") == 0.0


def test_gate_precision_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 6))
    p = 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1])))
    y = (rng.random(900) < p).astype(float)
    model = ingest.gate_model(x[:600], y[:600])
    score = 1 / (1 + np.exp(-((x[600:] - model["mean"]) / model["std"] @ np.array(model["weights"]) + model["bias"])))
    assert model["keep"] >= 0.8 and y[600:][score >= model["keep"]].mean() > 0.88
    random = ingest.gate_model(x[:600], rng.integers(0, 2, 600).astype(float))
    assert random["keep"] is None and random["reject"] is None


def test_pages_and_urls():
    title, text, date, sure = web.read_page('<html><head><title>A  b</title><meta property="article:published_time" content="2026-09-01T10:00"></head><body><nav>x</nav><p>' + "word " * 30 + "</p></body></html>")
    assert (title, date, sure) == ("A b", "2026-09-01", "metadata") and text == ("word " * 30).strip()
    assert web.read_page(None) == (None, None, None, "unknown")
    refused = {"ftp://a/": "scheme", "http://u:p@a.b/": "credentials", "http://10.0.0.1/": "address", "http://[::ffff:127.0.0.1]/": "address", "http://x.local": "host", "http://": "no_host", "https://example.com/a": None, "http://8.8.8.8/": None, "http://a:99999/": "malformed"}
    assert {u: web.url_refusal(u) for u in refused} == refused


def test_chunks():
    text = "\n".join(["a" * 700, "b" * 700, "c" * 500, ("Sentence one. " * 300).strip(), "end"])
    got = web.chunk_text(text)
    assert all(len(c) <= 1601 for c in got) and "".join(got).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert web.chunk_text("") == [] and got[0] == "a" * 700 + "\n" + "b" * 700


def test_feeds_and_site_maps(spark):
    rss = "<rss><channel><item><link>http://a/1</link></item><item><link>http://a/2</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="http://b/1"/></entry></feed>'
    assert values(spark, web.feed_items, [rss, atom]) == [["http://a/1", "http://a/2"], ["http://b/1"]]
    bomb = '<!DOCTYPE x [<!ENTITY a "b">]><urlset><url><loc>http://c/</loc></url></urlset>'
    assert values(spark, web.sitemap_items, ['<urlset xmlns="u"><url><loc>http://c/1</loc></url></urlset>', bomb]) == [["http://c/1"], []]


def test_config_round_trip():
    tree = workflow.CONFIG_NEW
    assert readers.load_config(readers.dump_config(tree)) == tree
    assert workflow.flatten_config({"a": {"b": 1}, "c": {}}) == [("a.b", "1"), ("c", "{}")]


def test_entities_skip_bad_rows(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("type,name,aliases\nboss,Fire Lord,FL|fire lord|the lord\n,Nameless,x\nboss,,y\nnpc,Ann,\n")
    names, aliases = readers.entities(spark, f"file://{path}")
    assert {(r["type"], r["name"]) for r in names.collect()} == {("boss", "Fire Lord"), ("npc", "Ann")}
    assert {(r["name"], r["norm"]) for r in aliases.collect()} == {("Fire Lord", "fire lord"), ("Fire Lord", "fl"), ("Fire Lord", "the lord"), ("Ann", "ann")}


def test_streams_give_what_batches_give(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i + (i * 13) % 5), i % 3, "view", float(i), "{}") for i in range(120)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.coalesce(1).orderBy("ts").write.parquet(f"{tmp_path}/all")
    import shutil
    from pathlib import Path

    shutil.copy(next(Path(tmp_path, "all").glob("*.parquet")), tmp_path / "events.parquet")
    batch = {r["event_id"]: r["accepted"] for r in workflow.rate_limit_sliding_greedy(spark, str(tmp_path)).collect()}
    stream = {r["event_id"]: r["accepted"] for r in flows.stream_limited(spark, str(tmp_path)).collect()}
    assert batch == stream and 0 < sum(batch.values()) < len(batch)
    a = {tuple(r) for r in flows.stream_windows(spark, str(tmp_path)).collect()}
    b = {tuple(r) for r in workflow.message_windows_tumbling(spark, str(tmp_path)).collect()}
    assert a == b
    live = flows.run(flows.windows(flows.event_stream(spark, str(tmp_path))), "w", "append")
    assert {tuple(r) for r in live.collect()} <= b


def test_trigram_similarity_of_a_typo(spark):
    frame = spark.createDataFrame([("spiritmastr", "the spiritmaster class")], "q string, d string")
    q, d = (frame.select(retrieval.trigrams(F.col(c))).first()[0] for c in ("q", "d"))
    assert len(set(q) & set(d)) / len(set(q)) > retrieval.TRIGRAM_MIN
