"""Keyed state over streams: message revisions with retractions, channels' context, sliding limits.

Processors run under transformWithState on the RocksDB state store. A message's state holds its operations, so that
those that come late or in another order lead to the same revisions; a timer in event time folds the operations that are
older than KEEP into one row, which bounds the state and closes the message to operations older than that."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranges import Ring, Sliding, fold
from ..session import ship_package
from .outbox import committed, last_commit, run_outbox

LATE, KEEP = "2 days", "60 days"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Revision(NamedTuple):
    """Where a message stands: the operation whose content holds (None: none does), its number and content, and the status
    (None before the message was made)."""

    seq: int | None = None
    rev: int = 0
    content: str | None = None
    status: str | None = None


def replay(ops: list[tuple[int, int, str, str | None]], start: Revision = Revision()) -> Revision:
    """The message after operations (time, number, kind, content) in their order.

    A create makes it; later creates and edits with other content are revisions; after a delete or purge none counts. A
    delete keeps the knowledge, a purge (before or after a delete) takes it away. Other kinds, and what comes before the
    first create, do not count."""
    now = start
    for _, seq, kind, content in sorted(ops, key=lambda o: o[:2]):
        if now.status is None and kind != "create":
            continue
        if kind == "purge":
            now = Revision(None, now.rev, None, "purged")
        elif now.status in ("deleted", "purged"):
            continue
        elif kind == "delete":
            now = now._replace(status="deleted")
        elif kind in ("create", "edit") and (now.status is None or content != now.content):
            now = Revision(seq, now.rev + 1, content, "active")
    return now


CHANGE = "message_id string, v long, change string, seq long, rev long, status string, content string"
_CHANGE_ROW = Row(*[c.split()[0] for c in CHANGE.split(", ")])


def retractions(message: str, v: int, old: Revision, new: Revision) -> list[tuple]:
    """What a move from one state to another tells those downstream: evidence of which operation no longer counts, which
    does, and the new status or number."""
    out = []
    if old.seq is not None and old.seq != new.seq:
        out.append((message, v, "source_deleted" if new.status == "purged" else "source_edited", old.seq, old.rev, new.status, None))
    if new.seq is not None and old.seq != new.seq:
        out.append((message, v, "activate", new.seq, new.rev, new.status, new.content))
    elif old != new and not out:
        out.append((message, v, "status", new.seq, new.rev, new.status, new.content))
    return out


_REVISION = "struct<seq: long, rev: long, content: string, status: string>"


class Message(StatefulProcessor):
    """One value a message, as a call of the state store costs far more than the few fields that it moves: how often a state
    was told, when the timer is due, up to which time operations are folded (null: none are), the state told last, what the
    folded operations led to, and the operations since."""

    SCHEMA = f"v long, due long, until long, now {_REVISION}, base {_REVISION}, ops array<struct<at: long, seq: long, op: string, content: string>>"

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("message", self.SCHEMA)

    def _stored(self) -> tuple:
        found = self.state.get()
        if found is None:
            return 0, None, None, Revision(), Revision(), {}
        told, due, until, now, base, ops = found
        return told, due, until, Revision(*now), Revision(*base), {o[1]: tuple(o) for o in ops}

    def _store(self, told: int, due: int | None, until: int | None, now: Revision, base: Revision, ops: dict) -> None:
        self.state.update((told, due, until, tuple(now), tuple(base), list(ops.values())))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told, due, until, old, base, ops = self._stored()
        out, latest = [], None
        for row in rows:
            at, seq = row["at_us"], row["seq"]
            if until is not None and at <= until:
                out.append((key[0], told, "too_late", seq, None, old.status, None))
                continue
            ops[seq] = (at, seq, row["op"], row["content"])
            latest = at if latest is None else max(latest, at)
        if latest is not None:
            new = replay(list(ops.values()), base)
            made = retractions(key[0], told + 1, old, new)
            if made:
                out += made
                told, old = told + 1, new
            at_ms = latest // 1000 + self.keep_ms
            if due is None or due < at_ms:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(at_ms)
                due = at_ms
            self._store(told, due, until, old, base, ops)
        return (_CHANGE_ROW(*o) for o in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Folds the operations; of a deleted message the content goes now."""
        told, _, until, old, base, ops = self._stored()
        new = replay(list(ops.values()), base)
        if new.status in ("deleted", "purged"):
            new = new._replace(content=None)
        ends = [o[0] for o in ops.values()] + ([] if until is None else [until])
        self._store(told, None, max(ends), new, new, {})
        return iter(())

    def close(self) -> None:
        pass


def _ms(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def changes(ops: DataFrame, late: str = LATE, keep: str = KEEP) -> DataFrame:
    """The retractions of a stream of operations: message_id, at (timestamp), seq, op, content.

    Operations that come more than late after others of the stream are dropped once their message is folded."""
    ready(ops.sparkSession)
    o = ops.withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    return o.groupBy("message_id").transformWithState(Message(_ms(keep)), CHANGE, "Append", "EventTime")


def messages_now(told: DataFrame) -> DataFrame:
    """The state of each message after a change log, one row a message: status, rev, the number of the operation whose
    content holds, and that content."""
    known = told.where("change <> 'too_late'")
    last = known.groupBy("message_id").agg(F.max_by(F.struct("status", "rev"), "v").alias("s"), F.max(F.when(F.col("change") == "activate", F.struct("v", "seq", "content"))).alias("a"), F.max(F.when(F.col("change").isin("source_edited", "source_deleted"), F.col("v"))).alias("off"))
    holds = F.col("a.v") >= F.coalesce("off", F.lit(0))
    return last.select("message_id", "s.status", "s.rev", F.when(holds, F.col("a.seq")).alias("seq"), F.when(holds, F.col("a.content")).alias("content"))


class Channel(StatefulProcessor):
    """held: the last messages in order. A batch's messages are held as four numbers each and walked BLOCK at a time."""

    BLOCK = 1 << 14

    def __init__(self, size: int, n: int, within: int):
        self.size, self.n, self.within = size, n, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "message_id long, t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ("message_id", "t", "reply", "replies")
        messages = np.concatenate([np.stack([f[c].to_numpy(np.int64) for c in columns], axis=1) for f in rows])
        order = np.lexsort((messages[:, 0], messages[:, 1]))
        kept = [(int(m), int(t)) for m, t in self.held.get()] if self.held.exists() else []
        held = np.array(kept, dtype=np.int64).reshape(-1, 2)
        for at in range(0, len(order), self.BLOCK):
            block = messages[order[at : at + self.BLOCK]]
            every = np.concatenate([held, block[:, :2]])
            context, found = self._contexts(every, len(held), block[:, 2], block[:, 3] == 1)
            held = every[-self.size :]
            yield pd.DataFrame({"message_id": block[:, 0], "context": context, "reply_found": found})
        self.held.put([(int(m), int(t)) for m, t in held])

    def _contexts(self, every: np.ndarray, first: int, reply: np.ndarray, replies: np.ndarray) -> tuple[list, np.ndarray]:
        """The contexts of the messages from the first on, those before being held, and whether their replies are found."""
        place, t = np.arange(first, len(every)), every[first:, 1]

        def before(lag: int) -> tuple[np.ndarray, np.ndarray]:
            return every[np.maximum(place - lag, 0)], place >= lag

        found = np.zeros(len(place), dtype=bool)
        for lag in range(1, self.size + 1):
            earlier, there = before(lag)
            found |= there & replies & (earlier[:, 0] == reply)
        ids, takes = [reply], [found]
        for lag in range(min(self.n, self.size), 0, -1):
            earlier, there = before(lag)
            ids.append(earlier[:, 0])
            takes.append(there & (t - earlier[:, 1] <= self.within))
        takes[0] = found & ~np.any([take & (i == reply) for i, take in zip(ids[1:], takes[1:], strict=True)], axis=0)
        ids, takes = np.stack(ids, axis=1), np.stack(takes, axis=1)
        return np.split(ids[takes], takes.sum(axis=1).cumsum()[:-1]), found

    def close(self) -> None:
        pass


def contexts(messages: DataFrame, size: int = 50, n: int = 5, within: int = 1800) -> DataFrame:
    """A stream of messages (channel, t, message_id, reply) with their prior context; a channel's come in order of time,
    batch by batch. One task walks a channel's messages of a batch; context_batches spreads them."""
    ready(messages.sparkSession)
    m = messages.select("channel", "t", "message_id", F.coalesce("reply", F.lit(0)).cast("long").alias("reply"), F.col("reply").isNotNull().cast("long").alias("replies"))
    return m.groupBy("channel").transformWithStateInPandas(Channel(size, n, within), "message_id long, context array<long>, reply_found boolean", "Append", "None")


def context_batches(messages: DataFrame, out: str, mark: str, size: int = 50, n: int = 5, within: int = 1800) -> DataFrame:
    """What contexts() tells, of the batches that a stream of messages has, on from its checkpoint mark.

    The state is a table: the last size messages of every channel, written beside a batch's contexts and committed with them
    (see outbox.py). A batch is walked behind it in sorted ranges, so that a channel of any length is spread over tasks."""
    held = T.StructType([messages.schema["channel"], *T.StructType.fromDDL("place int, t long, message_id long").fields])

    def tables(b: DataFrame) -> dict[str, DataFrame]:
        before = committed(b.sparkSession, out, "held", held).where(F.col("batch") == last_commit(b.sparkSession, out))
        new = b.select("channel", F.lit(size).alias("place"), "t", "message_id", "reply")
        every = before.select("channel", "place", "t", "message_id", F.lit(None).cast("long").alias("reply")).unionByName(new)
        order = ["place", "t", "message_id"]
        back = F.row_number().over(Window.partitionBy("channel").orderBy(*[F.desc(c) for c in order]))
        last = every.withColumn("back", back).where(F.col("back") <= size).select("channel", (F.lit(size) - F.col("back")).cast("int").alias("place"), "t", "message_id")
        walked = fold(every, ["channel"], order, ["t", "message_id", "reply"], lambda: Ring(size, n, within), "context array<long>, reply_found boolean")
        return {"contexts": walked.where(F.col("place") == size).select("message_id", "context", "reply_found"), "held": last}

    run_outbox(messages, out, mark, tables)
    return committed(messages.sparkSession, out, "contexts", T.StructType.fromDDL("message_id long, context array<long>, reply_found boolean")).drop("batch")


class Limited(StatefulProcessor):
    """The times that a user's window still holds."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getListState("taken", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule = Sliding(self.limit, self.window)
        rule.taken.extend(int(t) for (t,) in self.taken.get()) if self.taken.exists() else None
        frame = pd.concat(list(rows)).sort_values(["t", "event_id"])
        accepted = [rule.step(int(t))[0] for t in frame["t"]]
        self.taken.put([(t,) for t in rule.taken])
        yield pd.DataFrame({"event_id": frame["event_id"], "accepted": accepted})

    def close(self) -> None:
        pass


def limited(events: DataFrame, limit: int = 2, window_s: int = 21600) -> DataFrame:
    """Greedy sliding limit per user; the state is the times accepted in the window, no more than limit."""
    ready(events.sparkSession)
    e = events.select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return e.groupBy("user_id").transformWithStateInPandas(Limited(limit, window_s), "event_id long, accepted boolean", "Append", "None")


#: Which operation an event stands for; an error is a moderator's delete, of a high value a purge.
OPS = {"signup": "create", "view": "edit", "click": "edit"}
PURGE_FROM = 15


def operations(events: DataFrame) -> DataFrame:
    """Events as operations on messages: a message is a user and one of its ten threads."""
    op = F.when(F.col("event_type") == "error", F.when(F.col("value") >= PURGE_FROM, "purge").otherwise("delete"))
    for kind, name in OPS.items():
        op = F.when(F.col("event_type") == kind, name).otherwise(op)
    thread = F.get_json_object("props", "$.k").cast("long") % 10
    return events.select(F.concat_ws(":", "user_id", thread).alias("message_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.coalesce(op, F.lit("pin")).alias("op"), F.floor(F.col("value") / 10).cast("string").alias("content"))

