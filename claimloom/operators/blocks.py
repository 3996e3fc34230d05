"""Products of two tables block by block: each block of one meets each block of the other on the executors.

Rows are packed into blocks of bounded size, a block being one row that holds an Arrow table. Spark joins the two tables
of blocks (by broadcast where its own size check allows that, else partition by partition), and a task passes on only
the best of the pairs that it sees, so no pair of rows that is not among them is ever a row. Nothing is collected, and
the number of blocks on either side may grow with the data."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package

#: Rows and Arrow bytes of a block at most (a single larger row is a block of its own).
ROWS, BYTES = 256, 1 << 20
#: Arrow bytes that go to a Python worker at a time, and rows that a Parquet scan holds.
BATCH_BYTES, SCAN_ROWS = 8 << 20, 512
#: Candidates that a task holds before it drops all but the best.
HELD = 200_000
#: Prepared blocks of the rows and of the questions that a task keeps.
KEPT = {"l": 1, "r": 4}


def small_batches(spark: SparkSession) -> None:
    """Readies Python workers: sends the package and bounds what they hold at once. Session-wide; results never change."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def packed(df: DataFrame, label: str, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """df as blocks: block (a number of its own) and data (an Arrow stream); written."""
    spark = df.sparkSession
    small_batches(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, bulk = [], 0, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_ipc(pa.Table.from_batches(held).combine_chunks())], pa.binary())], names=["data"])

        for batch in batches:
            step = max(1, min(rows, int(size * batch.num_rows / max(1, batch.nbytes)))) if batch.num_rows else 1
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                if held and (n + some.num_rows > rows or bulk + some.nbytes > size):
                    yield block()
                    held, n, bulk = [], 0, 0
                held.append(some)
                n, bulk = n + some.num_rows, bulk + some.nbytes
        if held:
            yield block()

    path = scratch_path(spark, label)
    df.mapInArrow(pack, "data binary").withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.schema("data binary, block long").parquet(path)


def _columns(table: dict[str, np.ndarray], order: list[str]) -> np.ndarray:
    """The order of rows by group, then by the columns of order (a minus: descending)."""
    keys = [-table[c[1:]] if c.startswith("-") else table[c] for c in order]
    return np.lexsort(keys[::-1])


def best_of(table: dict[str, np.ndarray], group: str, order: list[str], k: int, ties: str | None = None) -> dict[str, np.ndarray]:
    """The k best rows of each group, best first; with ties, also all further ones that equal the k-th in that column."""
    at = _columns(table, [group, *order])
    table = {c: v[at] for c, v in table.items()}
    groups = table[group]
    place = np.arange(len(groups)) - np.searchsorted(groups, groups)
    keep = place < k
    if ties is not None and len(groups):
        last = np.searchsorted(groups, groups, side="left") + np.minimum(k, np.searchsorted(groups, groups, side="right") - np.searchsorted(groups, groups)) - 1
        keep |= table[ties] == table[ties][last]
    return {c: v[keep] for c, v in table.items()}


def _last(table: dict[str, np.ndarray], group: str, order: list[str], k: int) -> list[np.ndarray]:
    """Of the groups of a table (sorted as best_of does) with k rows: the group and what ranks its k-th, the id aside."""
    groups = table[group]
    at = np.flatnonzero(np.arange(len(groups)) - np.searchsorted(groups, groups) == k - 1)
    return [groups[at], *[table[c.lstrip("-")][at].astype(np.float64) for c in order[:-1]]]


def meet(rows: DataFrame, asked: DataFrame, left: Callable[[pa.Table], object], right: Callable[[pa.Table], object], pair: Callable[[object, object], dict[str, np.ndarray]], schema: str, group: str, order: list[str], k: int, ties: str | None = None) -> DataFrame:
    """The best rows of pair(left(block of rows), right(block of asked)) over all pairs of blocks, k of each group a task.

    left and right prepare a block, and a task keeps the latest few; pair gives columns of the schema. order names
    the columns that rank a group's rows (a minus: descending), an id last. A block of asked that has raised() learns there
    what the k-th of a group's rows has reached in the task."""
    names = T.StructType.fromDDL(schema).names
    both = rows.select(F.col("block").alias("l"), F.col("data").alias("ldata")).crossJoin(asked.select(F.col("block").alias("r"), F.col("data").alias("rdata")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, OrderedDict[int, object]] = {"l": OrderedDict(), "r": OrderedDict()}
        held: list[dict[str, np.ndarray]] = []
        n = least = 0

        def prepared(side: str, number: int, data: pa.Scalar, make: Callable) -> object:
            some = ready[side]
            if number not in some:
                some[number] = make(pa.ipc.open_stream(data.as_buffer()).read_all())
                if len(some) > KEPT[side]:
                    some.popitem(last=False)
            return some[number]

        def pruned() -> dict[str, np.ndarray]:
            return best_of({c: np.concatenate([h[c] for h in held]) for c in names}, group, order, k, ties)

        for batch in batches:
            for i in range(batch.num_rows):
                found = pair(prepared("l", batch.column("l")[i].as_py(), batch.column("ldata")[i], left), prepared("r", batch.column("r")[i].as_py(), batch.column("rdata")[i], right))
                if len(found[group]):
                    held.append(found)
                    n += len(found[group])
                pa.default_memory_pool().release_unused()
                if n > HELD + 2 * least:
                    held = [pruned()]
                    n = least = len(held[0][group])
                    floors = _last(held[0], group, order, k)
                    for some in ready["r"].values():
                        if hasattr(some, "raised"):
                            some.raised(*floors)
        if held:
            out = pruned()
            yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

    return both.mapInArrow(run, schema)
