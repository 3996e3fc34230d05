"""Transactional outbox: a micro-batch's tables count together or not at all.

A batch writes each of its tables under its number, then one commit record, by a rename. Readers take only numbers up to
the last record; a batch that fails between its writes is written over by the retry, which has the same number."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def commit(spark: SparkSession, out: str, number: int, rows: dict[str, str]) -> None:
    """Records that batch number is whole; rows has the schema of each of its tables."""
    made, fs = _files(spark, f"{out}/_commits/.{number}.tmp")
    stream = fs.create(made, True)
    stream.write(bytearray(json.dumps(rows).encode()))
    stream.close()
    done, _ = _files(spark, f"{out}/_commits/{number}")
    fs.delete(done, False)
    if not fs.rename(made, done):
        raise OSError(f"could not record batch {number}")


def last_commit(spark: SparkSession, out: str) -> int:
    """The number of the last whole batch; -1 if there is none. Batches are committed in order."""
    at, fs = _files(spark, f"{out}/_commits")
    if not fs.exists(at):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


def committed(spark: SparkSession, out: str, name: str, schema: T.StructType) -> DataFrame:
    """The rows of a table in whole batches, with their batch."""
    last, numbered = last_commit(spark, out), T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.createDataFrame([], numbered) if last < 0 else spark.read.schema(numbered).parquet(f"{out}/{name}").where(F.col("batch") <= last)


def run_outbox(source: DataFrame, out: str, mark: str, batch: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
    """Drains a stream: batch gives the tables of a micro-batch by name."""
    spark = source.sparkSession

    def write(frame: DataFrame, number: int) -> None:
        if number <= last_commit(spark, out):  # a retry of a whole batch
            return
        tables = batch(frame)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        commit(spark, out, number, {name: df.schema.simpleString() for name, df in tables.items()})

    source.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
