"""Best-fit packing of documents' token ids into sequences, by best-two-fit over the histogram of lengths.

A bin is filled greedily, each time with the longest piece that still fits; then its smallest piece is taken out if two
unpacked pieces fit the expanded gap more tightly. Pieces of one length are interchangeable, so bins are planned on the
at most max_len counts of lengths: the pattern of one bin is repeated while its pieces last. The plan's size depends on
max_len, not on the number of documents.

Cases: a null or empty text is the end id alone, a piece of length 1; no documents give no rows; repeated rows and ids
are packed each; other columns are ignored; only documents longer than max_len are cut, the first piece taking the
remainder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tokens
from .common import arrow_schema, load, materialize, small_batches

MAX_LEN = 2048


def plan_bins(counts: dict[int, int], cap: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in one bin, how many such bins), until every piece is packed."""
    left = np.zeros(cap + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        bin_: dict[int, int] = {}
        room = cap
        free = left.copy()
        lengths = np.flatnonzero(free)
        at = len(lengths)
        while True:
            at = min(at, int(np.searchsorted(lengths, room, side="right")))
            if at == 0:
                break
            at -= 1
            longest = int(lengths[at])
            n = int(min(free[longest], room // longest))
            bin_[longest] = n
            free[longest] -= n
            room -= n * longest
        if room:
            smallest = min(bin_)
            gap = room + smallest
            best, pair = smallest, None
            fits = np.flatnonzero(free[: gap + 1])
            for a in fits[::-1].tolist():
                if 2 * a < best or best == gap:
                    break
                b = fits[: int(np.searchsorted(fits, min(gap - a, a), side="right"))]
                if len(b) and b[-1] == a and free[a] < 2:
                    b = b[:-1]
                if len(b) and a + int(b[-1]) > best:
                    best, pair = a + int(b[-1]), (a, int(b[-1]))
            if pair:
                bin_[smallest] -= 1
                if not bin_[smallest]:
                    del bin_[smallest]
                for x in pair:
                    bin_[x] = bin_.get(x, 0) + 1
        repeats = min(int(left[x]) // n for x, n in bin_.items())
        for x, n in bin_.items():
            left[x] -= n * repeats
        plan.append((bin_, repeats))
    return plan


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = tokens.GROUP_BYTES) -> DataFrame:
    """One row per piece, with the task that made it (part) and its number there among pieces of its length (nth)."""
    small_batches(docs.sparkSession)
    schema = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for ids, found in tokens.encoded_groups(batches, tokenizer, group_bytes):
            rows: list[tuple] = []
            for doc_id, raw in zip(ids, found, strict=True):
                n, start, piece = len(raw) // 4, 0, 0
                while start < n:
                    length = (n - start) % max_len or max_len
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    rows.append((doc_id, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, nth))
                    start, piece = start + length, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = tokens.GROUP_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = materialize(token_pieces(docs, tokenizer or tokens.tokenizer_path(), max_len, id_col, text_col, group_bytes), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce("before", F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_len rows at most

    # For a length, its pieces fill the patterns in turn: (first piece's number, first sequence, pieces a bin, offset there).
    slots: dict[int, list[tuple[int, int, int, int]]] = {length: [] for length in counts}
    used, sequence = dict.fromkeys(counts, 0), 0
    for bin_, repeats in plan_bins(counts, max_len):
        offset = 0
        for length in sorted(bin_, reverse=True):
            slots[length].append((used[length], sequence, bin_[length], offset))
            used[length] += bin_[length] * repeats
            offset += length * bin_[length]
        sequence += repeats
    table = {length: np.array(rows, dtype=np.int64).T for length, rows in slots.items()}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    numbered = pieces.join(before, (pieces["length"] == before["l"]) & (pieces["part"] == before["p"])).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("number"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                length = int(lengths[rows[0]])
                first, seq, each, offset = shared.value[length]
                at = np.searchsorted(first, numbers[rows], side="right") - 1
                within = numbers[rows] - first[at]
                sequences[rows] = seq[at] + within // each[at]
                offsets[rows] = offset[at] + within % each[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences), pa.array(offsets)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, fields)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
