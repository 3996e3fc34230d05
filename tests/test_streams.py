"""Streams: the same end state in any order and across restarts; batches that count whole or not at all."""

from __future__ import annotations

import datetime
import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from claimloom.streaming import flows, outbox, stateful
from claimloom.streaming.stateful import Revision, replay, retractions

START = datetime.datetime(2024, 1, 1)
OPS = "message_id string, at timestamp, seq long, op string, content string"


def test_revisions_and_status():
    def of(*ops):
        return replay([(n, n, *op) for n, op in enumerate(ops)])

    assert of(("create", "a"), ("edit", "a"), ("edit", "b")) == Revision(2, 2, "b", "active")
    assert of(("edit", "x"), ("delete", None), ("create", "a")) == Revision(2, 1, "a", "active")
    assert of(("create", "a"), ("delete", None), ("edit", "b"), ("create", "c")) == Revision(0, 1, "a", "deleted")
    assert of(("create", "a"), ("delete", None), ("purge", None)) == Revision(None, 1, None, "purged")
    assert of(("create", None), ("edit", None), ("pin", "z")) == Revision(0, 1, None, "active")
    assert of() == of(("pin", "a")) == Revision()


KINDS = st.tuples(st.sampled_from(["create", "edit", "edit", "delete", "purge", "pin"]), st.sampled_from("abc"))


@given(st.lists(KINDS, max_size=8), st.randoms(use_true_random=False), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_retractions_of_any_order_lead_to_the_state(kinds, rng, step):
    ops = [(n, n, *k) for n, k in enumerate(kinds)]
    shuffled = rng.sample(ops, len(ops))
    now, told, seen = Revision(), [], []
    for v, at in enumerate(range(0, len(shuffled), step), 1):
        seen += shuffled[at : at + step]
        new = replay(seen)
        told += retractions("m", v, now, new)
        now = new
    active: dict[int, str | None] = {}
    for _, _, change, seq, _, _, content in told:
        if change == "activate":
            active[seq] = content
        elif change.startswith("source_"):
            del active[seq]  # what no longer counts was told to count before
    want = replay(ops)
    assert now == want and list(active) == ([] if want.seq is None else [want.seq])


def operations(n: int, seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    kinds = ["create", "edit", "edit", "edit", "delete", "purge", "pin"]
    return [(f"m{rng.randrange(12)}", START + datetime.timedelta(minutes=i), i, rng.choices(kinds, [4, 4, 4, 4, 1, 1, 1])[0], rng.choice("abcd")) for i in range(n)]


def state_of(ops: list[tuple]) -> dict:
    out = {}
    for message in {o[0] for o in ops}:
        r = replay([(int(at.timestamp() * 1e6), seq, op, content) for m, at, seq, op, content in ops if m == message])
        if r.status:
            out[message] = (r.status, r.rev, r.seq, r.content)
    return out


def put(spark, rows: list[tuple], folder, name: str, schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def ops_stream(spark, folder):
    return spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


@pytest.mark.parametrize("seed", [0, 1])
def test_any_order_and_a_restart_midway_give_one_state(spark, tmp_path, seed):
    ops = operations(90)
    shuffled = random.Random(seed).sample(ops, len(ops)) if seed else ops
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n in range(2):
        put(spark, shuffled[n * 20 : n * 20 + 20], tmp_path, f"in/{n}", OPS)
    first = flows.drain(stateful.changes(ops_stream(spark, tmp_path / "in")), out, mark)
    assert {r["message_id"]: (r["status"], r["rev"], r["seq"], r["content"]) for r in stateful.messages_now(first).collect()} == state_of(shuffled[:40])
    for n in range(2, 5):
        put(spark, shuffled[n * 20 : n * 20 + 20], tmp_path, f"in/{n}", OPS)
    put(spark, shuffled[:20], tmp_path, "in/again", OPS)  # what comes twice changes nothing
    told = flows.drain(stateful.changes(ops_stream(spark, tmp_path / "in")), out, mark)
    assert {r["message_id"]: (r["status"], r["rev"], r["seq"], r["content"]) for r in stateful.messages_now(told).collect()} == state_of(ops)
    off = told.where(F.col("change").startswith("source_")).groupBy("message_id", "seq", "v").count()
    assert off.where("count > 1").count() == 0


def test_timers_fold_old_operations(spark, tmp_path):
    day = lambda n, *rest: ("m", START + datetime.timedelta(days=n), n, *rest)
    gone = lambda n, *rest: ("d", START + datetime.timedelta(days=n), n, *rest)
    far = ("other", START + datetime.timedelta(days=300), 300, "create", "z")
    batches = [[day(0, "create", "a"), day(1, "edit", "b"), gone(0, "create", "secret"), gone(1, "delete", None)], [far], [("other", far[1], 301, "pin", None)], [day(0.5, "edit", "late")[:2] + (50, "edit", "late"), ("m", START + datetime.timedelta(days=301), 302, "edit", "c")]]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n, rows in enumerate(batches):
        put(spark, rows, tmp_path, f"in/{n}", OPS)
        told = flows.drain(stateful.changes(ops_stream(spark, tmp_path / "in"), keep="30 days"), out, mark)
    rows = {r["message_id"]: r for r in stateful.messages_now(told).collect()}
    # revision 2 was folded, so the late edit does not come between; the next one is revision 3
    assert (rows["m"]["rev"], rows["m"]["content"], rows["m"]["status"]) == (3, "c", "active") and rows["d"]["status"] == "deleted"
    assert all(r["change"] == "too_late" for r in told.where("seq = 50").collect())


def counts(b):
    g = b.groupBy("op").agg(F.count(F.lit(1)).alias("n"))
    return {"state": g, "jobs": g.select(F.concat(F.lit("job:"), "op").alias("key"))}


def test_a_batch_that_fails_between_its_writes_is_not_seen(spark, tmp_path, monkeypatch):
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    state, jobs = (spark.createDataFrame([], ddl).schema for ddl in ("op string, n long", "key string"))
    ops = operations(60)
    put(spark, ops[:30], tmp_path, "in/0", OPS)
    assert outbox.committed(spark, out, "state", state).count() == 0
    outbox.run_outbox(ops_stream(spark, tmp_path / "in"), out, mark, counts)
    whole = [sorted(map(tuple, outbox.committed(spark, out, t, s).drop("batch").collect())) for t, s in (("state", state), ("jobs", jobs))]
    put(spark, ops[30:], tmp_path, "in/1", OPS)

    def broken(b):
        bad = F.udf(lambda _: 1 / 0, "string")
        return counts(b) | {"jobs": counts(b)["jobs"].select(bad("key").alias("key"))}

    with pytest.raises(Exception, match="ZeroDivisionError"):
        outbox.run_outbox(ops_stream(spark, tmp_path / "in"), out, mark, broken)
    assert (tmp_path / "out/state/batch=1").exists()  # the first table was written, but does not count
    assert [sorted(map(tuple, outbox.committed(spark, out, t, s).drop("batch").collect())) for t, s in (("state", state), ("jobs", jobs))] == whole
    outbox.run_outbox(ops_stream(spark, tmp_path / "in"), out, mark, counts)
    total = {r["op"]: r["n"] for r in outbox.committed(spark, out, "state", state).groupBy("op").agg(F.sum("n").alias("n")).collect()}
    want = {k: len(list(v)) for k, v in itertools.groupby(sorted(o[3] for o in ops))}
    assert total == want and outbox.committed(spark, out, "jobs", jobs).where("batch = 1").count() == len({o[3] for o in ops[30:]})


def test_a_committed_batch_is_not_written_again(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    put(spark, operations(10), tmp_path, "in/0", OPS)
    outbox.run_outbox(ops_stream(spark, tmp_path / "in"), out, f"file://{tmp_path}/mark", counts)
    seen = []
    outbox.run_outbox(ops_stream(spark, tmp_path / "in"), out, f"file://{tmp_path}/another-mark", lambda b: seen.append(b) or counts(b))
    assert outbox.last_commit(spark, out) == 0 and not seen


MESSAGES = "channel string, t long, message_id long, reply long"


def test_context_spans_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i * 100, i, i - 1 - rng.randrange(80) if rng.random() < 0.8 else None) for i in range(260)]
    for n in range(4):
        put(spark, rows[n * 65 : n * 65 + 65], tmp_path, f"in/{n}", MESSAGES)
    source = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {r["message_id"]: (list(r["context"]), r["reply_found"]) for r in flows.run(stateful.contexts(source), "contexts").collect()}
    held: dict = {"a": [], "b": []}
    for channel, t, m, reply in rows:
        recent = [x for x, at in held[channel][-5:] if t - at <= 1800]
        found = reply in [x for x, _ in held[channel][-50:]]
        assert got[m] == (([reply] if found and reply not in recent else []) + recent, found)
        held[channel].append((m, t))


class OneValue:
    """A handle that counts the calls of the state store."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


def test_a_message_costs_few_calls_of_the_state_store_however_many_its_operations():
    handle, message = OneValue(), stateful.Message(1000)
    message.init(handle)
    ops = [(n * 1_000_000, n, "create" if n == 0 else "edit", str(n)) for n in range(50)]
    rows = [dict(zip(("at_us", "seq", "op", "content"), o, strict=True)) for o in ops]
    told = list(message.handleInputRows(("m",), iter(rows[:30]), None))
    assert handle.calls == ["get", "register", "update"] and told[-1]["seq"] == 29
    handle.calls.clear()
    told = list(message.handleInputRows(("m",), iter(rows[30:] + rows[:5]), None))
    assert handle.calls == ["get", "delete", "register", "update"] and handle.timers == {49 * 1000 + 1000}
    assert [(r["change"], r["seq"], r["rev"]) for r in told] == [("source_edited", 29, 30), ("activate", 49, 50)]
    list(message.handleExpiredTimer(("m",), None, None))
    told = list(message.handleInputRows(("m",), iter([{"at_us": 5, "seq": 90, "op": "edit", "content": "late"}, {"at_us": 60_000_000, "seq": 91, "op": "edit", "content": "z"}]), None))
    assert [(r["change"], r["seq"]) for r in told] == [("too_late", 90), ("source_edited", 49), ("activate", 91)]


def contexts_of(rows: list[tuple]) -> list[tuple]:
    """message, context, whether its reply is held, of (channel, t, message, reply) in their order."""
    held, out = {}, []
    for channel, t, m, reply in rows:
        last = held.setdefault(channel, [])
        recent, found = [x for x, at in last[-5:] if t - at <= 1800], reply in [x for x, _ in last[-50:]]
        out.append((m, ([reply] if found and reply not in recent else []) + recent, found))
        last.append((m, t))
    return out


def test_context_of_batches_spans_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(5)
    big = 1 << 60  # a reply's id must not pass through a float
    rows = [(rng.choice("aaaab") if i < 195 else "a", i * 100, big + i, big + i - 1 - rng.randrange(80) if rng.random() < 0.8 else None) for i in range(260)]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    for n in range(4):
        put(spark, rows[n * 65 : n * 65 + 65], tmp_path, f"in/{n}", MESSAGES)
        if n % 2:
            got = sorted((r["message_id"], list(r["context"]), r["reply_found"]) for r in stateful.context_batches(source, out, mark).collect())
            assert got == sorted(contexts_of(rows[: n * 65 + 65]))
    last = outbox.committed(spark, out, "held", spark.createDataFrame([], "channel string, place int, t long, message_id long").schema)
    # channel b, which the last batch did not name, is still held
    assert {r["channel"]: r["count"] for r in last.where(f"batch = {outbox.last_commit(spark, out)}").groupBy("channel").count().collect()}.keys() == {"a", "b"}


def test_a_hot_channel_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    """No task walks more than a range of it; before, one frame held a channel's whole batch."""
    put(spark, [("a", i, i, i - 2) for i in range(2000)], tmp_path, "in/0", MESSAGES)
    source = spark.readStream.schema(MESSAGES).parquet(f"{tmp_path}/in/0")

    def marked(source, out, mark, batch):
        outbox.run_outbox(source, out, mark, lambda b: {name: df.withColumn("part", F.spark_partition_id()) for name, df in batch(b).items()})

    monkeypatch.setattr(stateful, "run_outbox", marked)
    out = f"file://{tmp_path}/out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = stateful.context_batches(source, out, f"file://{tmp_path}/mark").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["message_id"], list(r["context"]), r["reply_found"]) for r in got) == contexts_of([("a", i, i, i - 2) for i in range(2000)])
    assert spark.read.parquet(f"{out}/contexts").select("part").distinct().count() > 1


class Kept:
    """A handle that keeps one list."""

    rows = None

    def getListState(self, name, schema):
        return self

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def test_a_channel_tells_blocks_at_a_time(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(stateful.Channel, "BLOCK", 7)
    rng = random.Random(1)
    rows = [("a", i * 100, i % 90, i - 1 - rng.randrange(70) if i % 3 else None) for i in range(200)]  # ids come again
    channel, got = stateful.Channel(50, 5, 1800), []
    channel.init(Kept())
    for part in (rows[:120], rows[120:]):
        shuffled = rng.sample(part, len(part))
        frame = pd.DataFrame({"message_id": [r[2] for r in shuffled], "t": [r[1] for r in shuffled], "reply": [r[3] or 0 for r in shuffled], "replies": [int(r[3] is not None) for r in shuffled]})
        told = list(channel.handleInputRows(("a",), iter([frame[:50], frame[50:]]), None))
        assert max(map(len, told)) == 7
        got += [(m, list(c), bool(f)) for x in told for m, c, f in zip(x["message_id"], x["context"], x["reply_found"], strict=True)]
    assert got == contexts_of(rows)
