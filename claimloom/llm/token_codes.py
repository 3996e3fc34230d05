"""Token-id output as directly addressable codes: any token is read from the file without decoding a block.

Every id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of the ids that have one, a bitmap
with a 1 for each of them that goes on at level k+1, and a rank directory (ones before every 512th bit). Token i is read
by following its bits: its place at the next level is the rank of its bit.

Cases: a null or empty text encodes to the end id alone; no documents give no segments and no rows; repeated rows and
ids are each written and read (ordered by id, then a hash of the text, then the place in the table; nulls first);
other columns are ignored; a document longer than a segment's size gets a segment to itself."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tokens
from .common import arrow_schema, load, materialize, scratch_path, small_batches

MAGIC = b"DACS\x01"
RANK_STEP = 512
#: Token ids after which a segment is closed.
SEGMENT_TOKENS = 1 << 20


def pack(ids: np.ndarray) -> bytes:
    """The ids (unsigned, below 2**32) as one addressable segment."""
    parts, level, rest = [], 0, ids.astype(np.uint32)
    while len(rest) or level == 0:
        higher = rest >> np.uint32(8)
        on = higher > 0
        bits = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-len(on) // RANK_STEP) * RANK_STEP, dtype=bool)
        padded[: len(on)] = on
        ranks = np.concatenate([[0], padded.reshape(-1, RANK_STEP).sum(axis=1).cumsum()]).astype("<u4")
        parts.append(len(rest).to_bytes(8, "little") + rest.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest, level = higher[on], level + 1
    return MAGIC + bytes([level]) + b"".join(parts)


class Codes:
    """Random access to a packed segment."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of addressable codes")
        at, self.levels = len(MAGIC) + 1, []
        for _ in range(raw[len(MAGIC)]):
            n = int.from_bytes(raw[at : at + 8], "little")
            at += 8
            chunks = np.frombuffer(raw, np.uint8, n, at)
            bits = np.frombuffer(raw, np.uint8, -(-n // 8), at + n)
            ranks = np.frombuffer(raw, "<u4", -(-n // RANK_STEP) + 1, at + n + len(bits))
            at += n + len(bits) + 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_STEP
        low = block * RANK_STEP // 8
        ones = int(np.bitwise_count(bits[low : i // 8]).sum())
        rest = int(bits[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(ranks[block]) + ones + rest.bit_count()

    def token(self, i: int) -> int:
        """Token i alone."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop, reading only their own chunks of each level."""
        out = np.zeros(max(stop - start, 0), dtype="<u4")
        where = np.arange(len(out))
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            low = start // 8
            on = np.unpackbits(bits[low : -(-stop // 8)], bitorder="little")[start - 8 * low : stop - 8 * low].astype(bool)
            where = where[on]
            if not len(where):
                break
            start = self._rank(level, start)
            stop = start + len(where)
        return out


SEGMENTS = "shard int, segment int, shard_start long, doc_ids array<long>, lengths array<long>, n_tokens long, codes binary"
ENCODED = "id long, hash long, part int, nth long, ids binary"


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a hash of the text, the row's place (task and number there) and the ids of every whole text, the end id last.

    Ids take two bytes each where the vocabulary allows it, else four. Texts are encoded where they are read, so that
    none is in a shuffle."""
    small_batches(docs.sparkSession)
    schema = arrow_schema(ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, kind = TaskContext.get().partitionId(), 0, tokens.worker_encoder(tokenizer).id_type()
        for ids, found, hashes in tokens.encoded_groups(batches, tokenizer, also=2):
            codes = [np.frombuffer(raw, "<u4").astype(kind).tobytes() for raw in found]
            row = [ids, hashes, np.full(len(ids), part), nth + np.arange(len(ids)), codes]
            nth += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
            del found, codes, row
            pa.default_memory_pool().release_unused()

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.when(text.isNotNull(), F.xxhash64(text)).alias("hash")).mapInArrow(run, ENCODED)


def write_codes(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes every whole text and writes the ids in ascending id order under path, one row a segment.

    The encoded rows are written once (the range sort samples them first) and sorted as two bytes an id. Shards are
    ranges of (id, hash of the text, place), so their numbers are in id order and rows of one id spread over shards;
    shard_start counts the ids before a segment within its shard. Parquet is only the container: it gives atomic,
    retried commits on any store that Spark writes."""
    order = ["id", "hash", "part", "nth"]
    ordered = materialize(encoded(docs, tokenizer, id_col, text_col), "encoded", "zstd").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = arrow_schema(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind, shard = tokens.worker_encoder(tokenizer).id_type(), TaskContext.get().partitionId()
        segment = before = held = 0
        ids: list = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            row = [[shard], [segment], [before], [list(ids)], [[len(p) for p in parts]], [held], [pack(np.concatenate(parts))]]
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, raw in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                codes = np.frombuffer(raw.as_py(), kind)
                if parts and held + len(codes) > segment_tokens:
                    yield close()
                    segment, before, held = segment + 1, before + held, 0
                    ids.clear()
                    parts.clear()
                ids.append(doc_id)
                parts.append(codes)
                held += len(codes)
        if parts:
            yield close()

    ordered.mapInArrow(run, SEGMENTS).write.parquet(path, compression="zstd")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and shard, segment).

    Only the shards' totals, as many as there are write tasks, meet in one place; every segment is opened where it lies."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    starts, run = {}, 0
    for row in sorted(totals, key=lambda r: r["shard"]):
        starts[row["shard"]] = run
        run += row["n"]
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, segment int"
    small_batches(spark)

    schema = arrow_schema(fields)

    def open_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, at = Codes(row["codes"]), 0
                n = len(row["doc_ids"])
                lengths = np.array(row["lengths"], dtype=np.int64)
                places = np.concatenate([[0], lengths.cumsum()])
                every = codes.slice(0, len(codes))
                crc = [zlib.crc32(every[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                at = starts[row["shard"]] + row["shard_start"] + places[:-1]
                columns = [row["doc_ids"], at, lengths, crc, [row["shard"]] * n, [row["segment"]] * n]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return files.mapInArrow(open_segments, fields)


def op8_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-codes")
    write_codes(load(spark, sf_dir, "documents"), path, tokens.tokenizer_path())
    return read_codes(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
