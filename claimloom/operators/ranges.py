"""Rules that walk a key's rows in order with a small state, over sorted ranges, so that a hot key is spread over tasks.

Rows are dealt into ranges of (key, order). Each range is walked on its own first, its last key to the end. Where a range
goes on with the key that the one before it ends with, it needs that one's last state. Most ranges have an end state that
does not depend on it: they hold a later key, or the rule has forgotten what came before (it says so by `settled`). The
others are walked again from the state before them, a round for each range of such a chain, all chains at once. Then every
range is walked once more from its right state. The driver holds one state a range; states are bounded by the rule."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.tables import read
from .blocks import small_batches
from .postings import written


class Rule:
    """What a walk does for one key: step() takes a row's columns in order and gives the result's. Instances are pickled."""

    settled = False

    def step(self, *row):
        raise NotImplementedError


def _walk(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str], make: Callable[[], Rule], starts: dict[int, bytes]):
    """For each batch its rows' results, then the end of every range met: (pid, first key, last key, holds more, rule)."""
    pid = first = key = rule = None
    several = False
    for b in batches:
        out = []
        of = zip(b.column("pid").to_pylist(), zip(*[b.column(k).to_pylist() for k in keys], strict=True), zip(*[b.column(c).to_pylist() for c in columns], strict=True), strict=True)
        ends = []
        for p, k, row in of:
            if p != pid:
                if pid is not None:
                    ends.append((pid, first, key, several, rule))
                pid, first, key, several = p, k, k, False
                rule = pickle.loads(starts[p]) if p in starts else make()
            elif k != key:
                key, several, rule = k, True, make()
            out.append(rule.step(*row))
        yield b, out, ends
    if pid is not None:
        yield None, [], [(pid, first, key, several, rule)]


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], make: Callable[[], Rule], result: str, ranges: int | None = None) -> DataFrame:
    """df with the columns of the DDL string result, computed by walking each key's rows in order with a rule of its own.

    keys and order together should tell rows apart; equal ones may come in any order. Nulls come first and are one key."""
    spark = df.sparkSession
    small_batches(spark)
    by = [*keys, *order]
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *by).withColumn("pid", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    walked = dealt.repartition("pid").sortWithinPartitions("pid", *by)
    state = to_arrow_schema(T.StructType.fromDDL("pid int, first binary, last binary, free boolean, rule binary"))

    def ends_of(starts: dict[int, bytes]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, ends in _walk(batches, keys, columns, make, starts):
                if ends:
                    yield pa.RecordBatch.from_pylist([{"pid": p, "first": pickle.dumps(a), "last": pickle.dumps(z), "free": more or rule.settled, "rule": pickle.dumps(rule)} for p, a, z, more, rule in ends], schema=state)

        return run

    needed = walked.select("pid", *by, *[c for c in columns if c not in by])
    found = {r["pid"]: r for r in needed.mapInArrow(ends_of({}), "pid int, first binary, last binary, free boolean, rule binary").collect()}
    order_of = sorted(found)
    starts: dict[int, bytes] = {}
    known = {p: found[p]["rule"] for n, p in enumerate(order_of) if found[p]["free"] or n == 0 or found[p]["first"] != found[order_of[n - 1]]["last"]}
    goes_on = {p: q for q, p in zip(order_of, order_of[1:], strict=False) if found[p]["first"] == found[q]["last"]}
    while waiting := [p for p in order_of if p not in known and goes_on[p] in known]:
        now = {p: known[goes_on[p]] for p in waiting}
        known |= {r["pid"]: r["rule"] for r in needed.where(F.col("pid").isin(waiting)).mapInArrow(ends_of(now), "pid int, first binary, last binary, free boolean, rule binary").collect()}
    starts = {p: known[q] for p, q in goes_on.items()}
    shared = spark.sparkContext.broadcast(starts)
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(result).fields])
    added, names = to_arrow_schema(T.StructType.fromDDL(result)), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, out, _ in _walk(batches, keys, columns, make, shared.value):
            if b is not None:
                made = [pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), added, strict=True)] if out else [pa.array([], type=f.type) for f in added]
                kept = [b.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *added.names])

    return walked.mapInArrow(run, schema)


class Sliding(Rule):
    """Accepts if fewer than limit were accepted in the window before; rejected ones take no slot."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window, self.taken, self.last, self.settled = limit, window, deque(), None, False

    def step(self, t: int) -> tuple[bool]:
        self.settled |= self.last is not None and t - self.last >= self.window
        self.last = t
        while self.taken and self.taken[0] <= t - self.window:
            self.taken.popleft()
        ok = len(self.taken) < self.limit
        if ok:
            self.taken.append(t)
        return (ok,)


class Limits(Rule):
    """A sliding minute, then a tumbling hour, then a tumbling day (UTC). What the day rejects is given back to the hour;
    a minute's slot that was taken stays taken, whatever the others say."""

    def __init__(self, minute: int, hour: int, day: int):
        self.most, self.slots, self.hour, self.day, self.last, self.settled = (minute, hour, day), deque(), (None, 0), (None, 0), None, False

    def step(self, t: int) -> tuple[str]:
        minute, hour, day = self.most
        self.settled |= self.last is not None and t - self.last >= 60 and t // 86400 != self.last // 86400
        self.last = t
        while self.slots and t - self.slots[0] >= 60:
            self.slots.popleft()
        if len(self.slots) >= minute:
            return ("minute",)
        self.slots.append(t)
        self.hour = self.hour if self.hour[0] == t // 3600 else (t // 3600, 0)
        self.day = self.day if self.day[0] == t // 86400 else (t // 86400, 0)
        if self.hour[1] >= hour:
            return ("hour",)
        if self.day[1] >= day:
            return ("day",)
        self.hour, self.day = (self.hour[0], self.hour[1] + 1), (self.day[0], self.day[1] + 1)
        return ("ok",)


class Latest(Rule):
    """The last given row (side 0) at or before each asking one (side 1)."""

    def __init__(self):
        self.given, self.settled = None, False

    def step(self, side: int, *given) -> tuple:
        if side == 0:
            self.given, self.settled = given, True
        return self.given or (None,) * len(given)


class Ring(Rule):
    """A channel's last messages: the ids of up to n before each one, no older than the bound, and the one that it replies to
    if it is still held; that one leads if it is none of the n."""

    def __init__(self, size: int = 50, n: int = 5, within: int = 1800):
        self.held, self.n, self.within, self.settled = deque(maxlen=size), n, within, False

    def step(self, t: int, message: int, reply: int | None) -> tuple[list[int], bool]:
        recent = [m for m, at in list(self.held)[-self.n :] if t - at <= self.within]
        found = reply is not None and any(m == reply for m, _ in self.held)
        self.held.append((message, t))
        self.settled = len(self.held) == self.held.maxlen
        return ([reply] if found and reply not in recent else []) + recent, found


def _events(spark, d) -> DataFrame:
    return read(spark, d, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))


def rate_limit_sliding_greedy(spark, d, limit: int = 2, window_s: int = 21600):
    """Accepts a request if fewer than limit were accepted in the window before; rejected ones take no slot."""
    e = _events(spark, d).select("event_id", "user_id", "t")
    return fold(e, ["user_id"], ["t", "event_id"], ["t"], lambda: Sliding(limit, window_s), "accepted boolean").select("event_id", "accepted")


#: Requests a minute, an hour and a day.
LIMITS = (1, 2, 40)


def rate_limit_windows(spark, d):
    """What decides each request of a channel (an event type): the sliding minute, the hour, the day, or ok."""
    e = _events(spark, d).select("event_id", "event_type", "t")
    return fold(e, ["event_type"], ["t", "event_id"], ["t"], lambda: Limits(*LIMITS), "decision string").select("event_id", "decision")


def with_context(messages: DataFrame, size: int = 50, n: int = 5, within: int = 1800) -> DataFrame:
    """messages (channel, t, message_id, reply) with context and reply_found."""
    return fold(messages, ["channel"], ["t", "message_id"], ["t", "message_id", "reply"], lambda: Ring(size, n, within), "context array<long>, reply_found boolean")


def messages_of(events: DataFrame) -> DataFrame:
    """Events as messages: the event type is the channel, and props.k tells how many messages of all channels back the one is
    that a message replies to."""
    back = F.get_json_object("props", "$.k").cast("long") + 1
    return events.select(F.col("event_type").alias("channel"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("message_id"), (F.col("event_id") - back).alias("reply"))


def message_context(spark, d):
    """Each message with its prior context: up to five of its channel's messages within 30 minutes, and the one it replies to."""
    c = with_context(messages_of(read(spark, d, "events")))
    return c.select("message_id", F.array_join(F.transform("context", lambda m: m.cast("string")), ",").alias("context"), "reply_found")


def asof_by_scope(asking: DataFrame, given: DataFrame) -> DataFrame:
    """asking (id, scope, at) with the value of the latest given row (scope, valid_from, idx, value) at or before its time,
    of its scope or of none; ties go to the larger idx. Nulls where there is none; given rows without a time take no part."""

    def latest(of: DataFrame, to: DataFrame) -> DataFrame:
        given = to.select("scope", F.col("valid_from").alias("at"), F.lit(0).alias("side"), "idx", F.lit(None).cast(dict(asking.dtypes)["id"]).alias("id"), "valid_from", "value")
        none = [F.lit(None).cast(dict(to.dtypes)[c]).alias(c) for c in ("idx", "valid_from", "value")]
        asked = of.select("scope", "at", F.lit(1).alias("side"), none[0], "id", none[1], none[2])
        kind = ", ".join(f"last_{c} {dict(to.dtypes)[c]}" for c in ("valid_from", "idx", "value"))
        found = fold(given.unionByName(asked), ["scope"], ["at", "side", "idx", "id"], ["side", "valid_from", "idx", "value"], Latest, kind)
        return found.where("side = 1").select("id", F.when(F.col("last_valid_from").isNotNull(), F.struct("last_valid_from", "last_idx", "last_value")).alias("found"))

    given = given.where(F.col("valid_from").isNotNull())
    of_all = given.where(F.col("scope").isNull())
    own = latest(asking, given.where(F.col("scope").isNotNull())).select("id", F.col("found").alias("own"))
    every = latest(asking.withColumn("scope", F.lit(None).cast(dict(asking.dtypes)["scope"])), of_all).select("id", F.col("found").alias("every"))
    return own.join(every, "id").select("id", F.greatest("own", "every")["last_value"].alias("value"))


def version_by_scope(spark, d):
    """The version in force in its region (a nation, or all) when each claim was made.

    Claims are orders; finished urgent orders stand for releases, in their customer's nation, or everywhere if the customer
    makes machinery."""
    nation = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    o = read(spark, d, "orders").join(nation, "o_custkey")
    asking = o.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("int").alias("scope"), F.to_date("o_orderdate").alias("at"))
    released = o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    given = released.select(F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey").cast("int")).alias("scope"), F.to_date("o_orderdate").alias("valid_from"), F.col("o_orderkey").cast("long").alias("idx"), F.concat(F.lit("v"), "o_orderkey").alias("value"))
    return asof_by_scope(asking, given).select(F.col("id").alias("claim_id"), F.col("value").alias("version"))


QUERIES = {f.__name__: f for f in (rate_limit_sliding_greedy, rate_limit_windows, message_context, version_by_scope)}

_T = "CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT)"
ORACLES = {
    "rate_limit_sliding_greedy": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, {_T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {_T}, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, n, true AS accepted, [t] AS taken FROM e WHERE n = 1
UNION ALL SELECT event_id, user_id, n, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END FROM (SELECT e.*, list_filter(w.taken, lambda x: x > e.t - 21600) AS live FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT event_id, accepted FROM w""",
    "rate_limit_windows": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, event_type, {_T} AS t, row_number() OVER (PARTITION BY event_type ORDER BY {_T}, event_id) AS n FROM events),
w AS (SELECT event_id, event_type, n, t, 'ok' AS decision, [t] AS slots, 1 AS in_hour, 1 AS in_day FROM e WHERE n = 1
UNION ALL SELECT event_id, event_type, n, t, decision, CASE WHEN decision = 'minute' THEN live ELSE list_append(live, t) END, h + CAST(decision = 'ok' AS INT), g + CAST(decision = 'ok' AS INT) FROM (
  SELECT *, CASE WHEN len(live) >= {LIMITS[0]} THEN 'minute' WHEN h >= {LIMITS[1]} THEN 'hour' WHEN g >= {LIMITS[2]} THEN 'day' ELSE 'ok' END AS decision FROM (
    SELECT e.*, list_filter(w.slots, lambda x: e.t - x < 60) AS live, CASE WHEN e.t // 3600 = w.t // 3600 THEN w.in_hour ELSE 0 END AS h, CASE WHEN e.t // 86400 = w.t // 86400 THEN w.in_day ELSE 0 END AS g FROM w JOIN e ON e.event_type = w.event_type AND e.n = w.n + 1)))
SELECT event_id, decision FROM w""",
    "message_context": f"""WITH m AS (SELECT event_id, event_type, {_T} AS t, event_id - CAST(json_extract(props, '$.k') AS BIGINT) - 1 AS reply FROM events),
w AS (SELECT *, list({{'m': event_id, 't': t}}) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS held FROM m),
c AS (SELECT event_id, reply, list_transform(list_filter(coalesce(held, [])[-5:], lambda x: w.t - x.t <= 1800), lambda x: x.m) AS recent, list_contains(list_transform(coalesce(held, []), lambda x: x.m), reply) AS found FROM w)
SELECT event_id AS message_id, coalesce(array_to_string(CASE WHEN found AND NOT list_contains(recent, reply) THEN list_prepend(reply, recent) ELSE recent END, ','), '') AS context, found AS reply_found FROM c""",
    "version_by_scope": """WITH o AS (SELECT o_orderkey, c_nationkey AS scope, CAST(o_orderdate AS DATE) AS day, o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS released, c_mktsegment = 'MACHINERY' AS everywhere FROM orders JOIN customer ON o_custkey = c_custkey),
own AS (SELECT scope, day AS valid_from, max(o_orderkey) AS idx FROM o WHERE released AND NOT everywhere GROUP BY ALL), every AS (SELECT day AS valid_from, max(o_orderkey) AS idx FROM o WHERE released AND everywhere GROUP BY ALL),
a AS (SELECT o.*, own.valid_from AS f1, own.idx AS i1 FROM o ASOF LEFT JOIN own ON o.scope = own.scope AND o.day >= own.valid_from), b AS (SELECT a.*, every.valid_from AS f2, every.idx AS i2 FROM a ASOF LEFT JOIN every ON a.day >= every.valid_from)
SELECT o_orderkey AS claim_id, CASE WHEN i1 IS NULL AND i2 IS NULL THEN NULL ELSE concat('v', CASE WHEN i2 IS NULL OR (i1 IS NOT NULL AND (f1, i1) > (f2, i2)) THEN i1 ELSE i2 END) END AS version FROM b""",
}
