"""Compression of vectors to short codes: a codebook for each part of a vector, learned by the filtering form of Lloyd's
algorithm in exact integers.

A vector is cut into PARTS equal parts, and a part's code is the number of the nearest entry of its position's codebook.
Tasks deal their vectors into blocks and build, for each block and position, a balanced kd-tree whose nodes hold the
bounding box, the sum and the count of their parts. The trees are written once. In each round a walk from the root drops,
at every node, the entries that are nowhere in the box nearer than the one nearest to its middle (ties go to the lower
entry, so entries that are nowhere better and come later go as well); where one entry is left, the whole subtree is
assigned to it by its cached sum and count, and only leaves with several entries left look at their parts. A round sends
one sum for each component of each entry from a task; the driver holds the codebooks alone, whose size depends on the
width of a vector and not on the number of rows.

All arithmetic is on 64-bit integers, so results depend neither on how rows are dealt out nor on the trees.

Cases: vectors that are null or hold null or non-finite components are dropped. Shorter vectors count as filled up with
zeros to the longest kept one, and all are filled up to a multiple of PARTS. Codebooks start with the smallest distinct
ids, null as the largest, and of rows that repeat an id with the least vector; with fewer ids than entries there are fewer
entries. Rows that repeat an id are coded each. Integers beyond the bound up to which the error of a vector fits 64 bits
(16,384 in a component, for 64 components) count as the bound; a label's error is at most the largest long. No kept
rows give no rows. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_schema, load, materialize, small_batches, spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors and bytes of vectors in a block at most, and parts that a leaf aims at.
BLOCK_ROWS, BLOCK_BYTES, LEAF = 16_384, 16 << 20, 16
LONGEST = 2**63 - 1
BLOCK = "ids array<long>, labels array<string>, points binary, trees array<struct<order: binary, low: binary, high: binary, total: binary, count: binary>>"


def kept_vector(v: Column) -> Column:
    """Whether a vector is there and holds finite components alone."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def component_bound(width: int) -> int:
    """The largest power of two up to which four times the squared distance of two vectors of this width fits 64 bits."""
    return 1 << int((60 - np.ceil(np.log2(max(1, width)))) // 2 - 1)


def integers(vectors: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, in rows of one width."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bound = component_bound(width)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -bound, bound).astype(np.int32)


class Tree:
    """A balanced kd-tree over the parts of a block. Level l has 2**l nodes, each over an equal stretch of order, which is
    filled up with rows of weight 0 (their numbers are those beyond the block's rows)."""

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, count: np.ndarray):
        self.points, self.order, self.low, self.high, self.total, self.count = points, order, low, high, total, count
        self.depth = (len(count) + 1).bit_length() - 2

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        n, width = points.shape
        depth = max(0, int(np.ceil(np.log2(n / leaf)))) if n > leaf else 0
        size = -(-n // (1 << depth)) << depth
        filled = np.concatenate([points, np.repeat(points[-1:], size - n, axis=0)])
        order = np.arange(size, dtype=np.int32).reshape(1, size)
        for _ in range(depth):
            held = filled[order]
            axis = (held.max(axis=1).astype(np.int64) - held.min(axis=1)).argmax(axis=1)
            key = np.take_along_axis(held, axis[:, None, None], axis=2)[:, :, 0]
            half = order.shape[1] // 2
            order = np.take_along_axis(order, np.argpartition(key, half, axis=1), axis=1).reshape(-1, half)
        held = filled[order]
        low, high = [held.min(axis=1)], [held.max(axis=1)]
        real = order < n
        total, count = [(held.astype(np.int64) * real[:, :, None]).sum(axis=1)], [real.sum(axis=1)]
        while len(low[-1]) > 1:
            for column, join in ((low, np.minimum), (high, np.maximum), (total, np.add), (count, np.add)):
                column.append(join(column[-1][::2], column[-1][1::2]))
        stack = lambda levels, kind: np.concatenate(levels[::-1]).astype(kind)
        return cls(points, order.reshape(-1), stack(low, np.int32), stack(high, np.int32), stack(total, np.int64), stack(count, np.int32))

    def packed(self) -> dict:
        return {name: np.ascontiguousarray(getattr(self, name)).tobytes() for name in ("order", "low", "high", "total", "count")}

    @classmethod
    def unpacked(cls, points: np.ndarray, raw: dict) -> Tree:
        width = points.shape[1]
        table = lambda name, kind: np.frombuffer(raw[name], kind).reshape(-1, width)
        return cls(points, np.frombuffer(raw["order"], np.int32), table("low", np.int32), table("high", np.int32), table("total", np.int64), np.frombuffer(raw["count"], np.int32))

    def filtered(self, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]]:
        """(level, nodes, entry of each) of the subtrees that one entry owns, then (depth, leaves, None, entries left in each)."""
        k = len(entries)
        nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        for level in range(self.depth + 1):
            at = nodes + (1 << level) - 1
            low, high = self.low[at].astype(np.int64), self.high[at].astype(np.int64)
            far = ((2 * entries[None] - (low + high)[:, None]) ** 2).sum(axis=2)
            best = np.where(left, far, LONGEST).argmin(axis=1)
            own = entries[best][:, None]
            away = entries[None] - own
            corner = np.where(away > 0, high[:, None], low[:, None])
            gap = (away * (entries[None] + own - 2 * corner)).sum(axis=2)  # least excess of an entry's distance in the box
            left = left & ~((gap > 0) | ((gap == 0) & (best[:, None] < np.arange(k))))
            alone = left.sum(axis=1) == 1
            yield level, nodes[alone], best[alone], left[alone]
            nodes, left = nodes[~alone], left[~alone]
            if level == self.depth:
                yield level, nodes, None, left
            elif not len(nodes):
                return
            else:
                nodes, left = (2 * nodes[:, None] + np.arange(2)).reshape(-1), np.repeat(left, 2, axis=0)

    def _members(self, leaves: np.ndarray) -> np.ndarray:
        return self.order.reshape(1 << self.depth, -1)[leaves]

    def _nearest(self, rows: np.ndarray, left: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """The nearest entry left of every row of the leaves (rows beyond the block's: of its last)."""
        held = self.points[np.minimum(rows, len(self.points) - 1)].astype(np.int64)
        best, out = np.full(rows.shape, LONGEST), np.zeros(rows.shape, dtype=np.int64)
        for j in range(len(entries)):
            at = np.flatnonzero(left[:, j])
            far = ((held[at] - entries[j]) ** 2).sum(axis=2)
            nearer = far < best[at]
            best[at] = np.where(nearer, far, best[at])
            out[at] = np.where(nearer, j, out[at])
        return out

    def sums(self, entries: np.ndarray) -> np.ndarray:
        """For each entry the sum of its parts, and their number as a last component."""
        out = np.zeros((len(entries), entries.shape[1] + 1), dtype=np.int64)
        for level, nodes, owner, left in self.filtered(entries):
            if owner is not None:
                at = nodes + (1 << level) - 1
                np.add.at(out, owner, np.concatenate([self.total[at], self.count[at][:, None]], axis=1))
            elif len(nodes):
                rows = self._members(nodes)
                real = rows < len(self.points)
                nearest, rows = self._nearest(rows, left, entries)[real], rows[real]
                np.add.at(out, nearest, np.concatenate([self.points[rows], np.ones((len(rows), 1), np.int32)], axis=1).astype(np.int64))
        return out

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The entry of every part of the block, in the block's order."""
        placed = np.zeros(len(self.order), dtype=np.int64)
        for level, nodes, owner, left in self.filtered(entries):
            placed.reshape(1 << level, -1)[nodes] = owner[:, None] if owner is not None else self._nearest(self._members(nodes), left, entries)
        out = np.zeros(len(self.points), dtype=np.int64)
        real = self.order < len(self.points)
        out[self.order[real]] = placed[real]
        return out


def _blocks(kept: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """id, label, v of kept as blocks with the trees of each part."""
    spark, schema = kept.sparkSession, arrow_schema(BLOCK)
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * width)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(batch: list) -> pa.RecordBatch:
            ids, labels, points = (np.concatenate(x) for x in zip(*batch))
            trees = [Tree.build(x).packed() for x in np.split(points, parts, axis=1)]
            return pa.RecordBatch.from_pylist([{"ids": ids.tolist(), "labels": labels.tolist(), "points": points.tobytes(), "trees": trees}], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                some = batch.slice(start, rows)
                objects = lambda c: np.array(c.to_pylist(), dtype=object)
                if n and n + some.num_rows > rows:
                    yield block(held)
                    held, n = [], 0
                held.append((objects(some.column("id")), objects(some.column("label")), integers(some.column("v"), width, scale)))
                n += some.num_rows
        if n:
            yield block(held)

    small_batches(spark)
    return materialize(kept.mapInArrow(build, BLOCK), "vector-trees")


def _trees(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[list, list, np.ndarray, list[Tree]]]:
    """ids, labels, points and trees of every block of a batch."""
    for n in range(batch.num_rows):
        row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
        points = np.frombuffer(row["points"], np.int32).reshape(-1, width)
        yield row["ids"] if "ids" in row else [], row["labels"] if "labels" in row else [], points, [Tree.unpacked(np.ascontiguousarray(x), raw) for x, raw in zip(np.split(points, parts, axis=1), row["trees"], strict=True)]


def _first_codebooks(kept: DataFrame, width: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """(part, entry, component) of the smallest ids' vectors; at most `entries` vectors come to the driver."""
    ids = [r["id"] for r in kept.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    wanted = F.col("id").isin([x for x in ids if x is not None])
    if None in ids:
        wanted = F.coalesce(wanted, F.lit(False)) | F.col("id").isNull()
    found = kept.where(wanted).groupBy("id").agg(F.min("v").alias("v")).collect()
    vectors = [list(r["v"]) for r in sorted(found, key=lambda r: (r["id"] is None, r["id"]))]
    points = integers(pa.array(vectors, pa.list_(pa.float64())), width, scale)
    return np.stack(np.split(points.astype(np.int64), parts, axis=1))


def codebook_text(books: np.ndarray) -> str:
    """All components by part, entry and place, joined by commas."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """id, label (as text), code and error of every kept vector, and the codebooks (part, entry, component)."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").alias("v")).where(kept_vector(F.col("v")))
    longest = kept.agg(F.max(F.size("v")).alias("n")).first()["n"]
    coded = "id long, label string, code string, error long"
    if longest is None:
        return spark.createDataFrame([], coded), np.zeros((parts, 0, 0), dtype=np.int64)
    width = max(1, -(-longest // parts)) * parts
    blocks = _blocks(kept, width, parts, scale)
    books = _first_codebooks(kept, width, parts, entries, scale)
    part_sums = arrow_schema("at int, n long")
    for _ in range(rounds):

        def one_round(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            total = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
            for batch in batches:
                for _, _, _, trees in _trees(batch, width, parts):
                    for part, tree in enumerate(trees):
                        total[part] += tree.sums(books[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], schema=part_sums)

        found = blocks.select("points", "trees").mapInArrow(one_round, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(books.size + books.shape[0] * books.shape[1], dtype=np.int64)
        for r in found:
            total[r["at"]] = r["n"]
        total = total.reshape(*books.shape[:2], -1)
        count = total[:, :, -1:]
        books = np.where(count > 0, np.floor_divide(total[:, :, :-1], np.maximum(count, 1)), books)

    schema, final = arrow_schema(coded), books

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, points, trees in _trees(batch, width, parts):
                codes = np.stack([tree.codes(final[part]) for part, tree in enumerate(trees)], axis=1)
                near = np.concatenate([final[part][codes[:, part]] for part in range(parts)], axis=1)
                error = ((points - near) ** 2).sum(axis=1)
                raw = codes.astype(np.uint8).tobytes().hex()
                text = [raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(text, pa.string()), pa.array(error, pa.int64())], schema=schema)

    return materialize(blocks.mapInArrow(code, coded), "vector-codes"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(load(spark, sf_dir, "embeddings"))
    # a label's total is at most the largest long; nulls are one label
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    by_label = by_label.select("label", "n", F.least("sum", F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return spread_join(coded, by_label, "label").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """Plain Lloyd in DuckDB SQL: every part against every entry, for vectors of one length that parts divides."""
    far = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT rid, p.pos, any_value(p.x) AS x, CAST(min({far} * {entries} + c.nth) AS BIGINT) AS best FROM p JOIN c{n} c USING (pos) GROUP BY rid, p.pos)")
        if n < rounds:
            steps.append(f"""m{n} AS MATERIALIZED (
  SELECT pos, nth, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT pos, best % {entries} AS nth, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL
  ) GROUP BY pos, nth
), c{n + 1} AS MATERIALIZED (SELECT c.pos, c.nth, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON c.pos = m.pos AND c.nth = m.nth)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, pos, v[pos * w + 1:(pos + 1) * w] AS x FROM (SELECT *, len(v) // {parts} AS w FROM k), (SELECT unnest(range({parts})) AS pos)
), c0 AS MATERIALIZED (
  SELECT pos, nth, x FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS nth FROM k) f USING (rid) WHERE nth < {entries}
), {", ".join(steps)}, e AS (
  SELECT rid, string_agg(printf('%02x', best % {entries}), '' ORDER BY pos) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY rid
), h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, nth)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (rid), h
"""
