"""Helpers that the corpus operators share: shared scratch tables, batch sizes and row-preserving Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..session import discard, scratch_path, ship_package  # noqa: F401

#: Rows and bytes that one Arrow batch carries to a Python worker, and rows that a Parquet scan holds; texts may be long.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 1000, 16 << 20, 512


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and lost executors cost no recomputation.

    A written table rather than checkpoint(): the latter computes its input twice."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """A name for each of names that none of the columns has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Readies Python workers: sends the package and bounds what they hold at once. Session-wide; results never change."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; only on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def word_count(text, separators: str):
    """The runs of other characters in a text that the regex separators (runs of them) leaves; null as 0."""
    pieces = F.split(text, separators, -1)
    empty = lambda piece: F.when(piece == "", 1).otherwise(0)
    return F.coalesce(F.greatest(F.size(pieces) - empty(F.get(pieces, F.lit(0))) - empty(F.element_at(pieces, -1)), F.lit(0)), F.lit(0)).cast("long")


def smallest_hashes(ids: DataFrame, n: int, group: str | None = None) -> list[tuple]:
    """(doc_id, group's value, place from 0) of the n ids of each group whose hashes are smallest; without a group (doc_id, place).

    Ids come to the driver once each, and only those below a hash threshold set from an estimate of the number of
    distinct ids: about n of each group, however many tasks or repeats there are."""
    by = [group] if group else []
    counts = ids.groupBy(*by).agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()
    share = {r[group] if group else None: min(1.0, 1.2 * n / max(1, r["n"]) + 40 / max(1, r["n"])) for r in counts}
    at = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    if group:
        shares = F.broadcast(ids.sparkSession.createDataFrame(sorted(share.items()), f"__g {dict(ids.dtypes)[group]}, __share double"))
        near = ids.join(shares, F.col(group) == F.col("__g")).where(at <= F.col("__share")) if share else ids.limit(0)
    else:
        near = ids.where(at <= F.lit(share.get(None, 1.0)))
    out, places = [], {}
    for row in sorted((r["h"], r["doc_id"], *[r[c] for c in by]) for r in near.groupBy("doc_id", *by).agg(F.first(F.xxhash64("doc_id")).alias("h")).collect()):
        place = places.setdefault(row[2:], 0)
        if place < n:
            out.append((*row[1:], place))
            places[row[2:]] += 1
    return out


def taken_whole(sized: list[tuple], most: int) -> list:
    """The names of (place, size, name) that fit most together, whole, by place; those too large for it come last, and
    one at least is taken."""
    out, held = [], 0
    for _, size, name in sorted(sized, key=lambda x: (x[1] > most, x[0])):
        if not out or held + size <= most:
            out.append(name)
            held += size
    return out


def map_texts(df: DataFrame, text: str, fields: str, make: Callable[[], Callable[[list], list]], keep: list[str]) -> DataFrame:
    """Adds the columns of the DDL string fields, computed from whole texts, to the columns keep of every row.

    make() runs once a task and returns a function from a list of texts (None for null) to one list or array per field.
    Rows are neither joined nor dropped, so null or repeated ids need no care; only the texts go to Python and only the
    results come back. A result replaces a kept column of its name. The function counts as non-deterministic so that filters on its results do not run it twice."""
    small_batches(df.sparkSession)
    added = T.StructType.fromDDL(fields)
    types = [f.type for f in arrow_schema(fields)]
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            results = [pa.array(r, type=t) for r, t in zip(work(batch.to_pylist()), types, strict=True)]
            yield pa.StructArray.from_arrays(results, names=names)
            del batch, results
            pa.default_memory_pool().release_unused()

    made = F.arrow_udf(run, added).asNondeterministic()
    kept = [F.col(f"`{c}`") for c in keep if c not in names]
    return df.select(*kept, made(F.col(f"`{text}`")).alias("__made")).select(*kept, *[F.col("__made").getField(n).alias(n) for n in names])


def id_hash_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as remainder -1, so they are neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


#: Rows of a table that are sent to every task without a look at what its keys hold.
FEW = 10_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the facts of their key; facts has one row a key, with the number of its rows in column n. Null is a key.

    Up to FEW facts are sent to every task. Of more, keys that hold more than one in `spark.sql.shuffle.partitions` of all rows, of which there are fewer than that, are sent
    to every task; the rest are shuffled, so no task gets the rows of a hot key. facts should be cheap to compute or written."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, count = unused([*rows.columns, *facts.columns], "join_key", "join_rows")
    facts = materialize(facts.withColumnRenamed(key, name).withColumnRenamed("n", count), "facts")
    same, size = rows[key].eqNullSafe(F.col(name)), F.col(count)
    if facts.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(facts), same).drop(name, count)
    total = facts.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot, rest = facts.where(size * parts > total), facts.where(size * parts <= total)
    others = rows.join(F.broadcast(hot.select(name)), same, "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(others.join(rest, same)).drop(name, count)
