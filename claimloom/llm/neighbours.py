"""Approximate nearest neighbours by a forest of random-projection trees.

Trees split at the median of a projection onto the difference of two random sample vectors; they are fitted on a bounded
sample and sent to all workers, and every vector is sent down every tree. A query searches all trees through one shared
priority queue (the margin to the nearest split passed so far), until its leaves hold enough vectors. Queries then stream
past the leaves that they reached, in double precision on the original vectors, and the best go on. A task holds one leaf
at a time, and a leaf with more than LEAF_ROWS vectors is dealt into chunks that its queries all visit.

Equal vectors are one entry with its K+1 smallest ids, which is all that K neighbours other than the query's own row can
need; so a vector that a third of all rows share costs no more than another.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors are neighbours of those of
their own length alone, as there is no distance to others, and each length is searched by itself; ties go to the smaller id; rows that repeat an id and its vector count once; with K candidates or
fewer all are found; no queries or no rows give no rows; other columns are ignored."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import load, materialize, small_batches, smallest_hashes

K = 10
#: Bound of the sample that the trees are fitted on; trees; vectors aimed at in a leaf.
FIT_ROWS, TREES, LEAF, SEED = 20_000, 8, 160, 11
#: A query's leaves hold this share of all vectors (counted once a tree). It is what recall over 0.9 takes on vectors that
#: fill the sphere evenly, which no index can prune; clustered ones do with far less.
LOOK_SHARE = 2.0
#: Vectors of a leaf that a task holds at once.
LEAF_ROWS = 50_000
#: Rows of the best so far that a task holds before it passes them on.
HELD_ROWS = 1_000_000
FIELDS = ("tree", "leaf", "entry", "v")
FOUND = np.dtype([("query", np.int64), ("entry", np.int64), ("score", np.float64)])


class Tree:
    """Arrays: normal and cut of inner nodes, children (negative: a leaf's number, minus one), share of the sample in a leaf."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.cuts, self.children, self.sizes = [], [], [], []
        self.root = self._grow(sample, np.arange(len(sample)), leaf, rng)
        self.normals = np.array(self.normals, dtype=np.float64).reshape(len(self.cuts), sample.shape[1])
        self.cuts = np.array(self.cuts)

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaf: int, rng) -> int:
        if len(rows) > leaf:
            for _ in range(5):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                normal = a - b
                norm = np.linalg.norm(normal)
                if norm == 0:
                    continue
                normal = normal / norm
                at = sample[rows] @ normal
                cut = float(np.median(at))
                left = at < cut
                if 0 < left.sum() < len(rows):
                    node = len(self.cuts)
                    self.normals.append(normal)
                    self.cuts.append(cut)
                    self.children.append(None)
                    self.children[node] = (self._grow(sample, rows[left], leaf, rng), self._grow(sample, rows[~left], leaf, rng))
                    return node
        self.sizes.append(len(rows))
        return -len(self.sizes)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector."""
        out = np.zeros(len(vectors), dtype=np.int32)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                left = vectors[rows] @ self.normals[node] < self.cuts[node]
                todo += [(self.children[node][0], rows[left]), (self.children[node][1], rows[~left])]
        return out


class Forest:
    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.scale = max(1.0, total / max(1, len(sample)))  # rows for each row of the sample
        self.trees = [Tree(sample, max(4, int(leaf / self.scale)), rng) for _ in range(trees)] if len(sample) else []

    def search(self, query: np.ndarray, look_at: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, until the leaves hold look_at vectors."""
        margins = [t.normals @ query - t.cuts for t in self.trees]
        queue = [(0.0, n, t.root) for n, t in enumerate(self.trees)]
        heapq.heapify(queue)
        out, seen = [], 0.0
        while queue and seen < look_at:
            bound, n, node = heapq.heappop(queue)
            while node >= 0:
                margin = float(margins[n][node])
                near, far = self.trees[n].children[node][:: -1 if margin >= 0 else 1]
                heapq.heappush(queue, (max(bound, abs(margin)), n, far))
                node = near
            out.append((n, -node - 1))
            seen += self.trees[n].sizes[-node - 1] * self.scale
        return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v of the vectors that take part."""
    v = F.col(vector_col)  # floats stay as they are: a shuffle then moves half the bytes
    if dict(vectors.dtypes)[vector_col] != "array<float>":
        v = v.cast("array<double>")
    df = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(finite & F.exists("v", lambda x: x != 0.0))


def nearest(vectors: DataFrame, is_query, k: int = K, fit_rows: int = FIT_ROWS, trees: int = TREES, leaf: int = LEAF, look_share: float = LOOK_SHARE, leaf_rows: int = LEAF_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found to every row where is_query (a condition on column id) holds."""
    spark = vectors.sparkSession
    small_batches(spark)
    valid = usable(vectors, id_col, vector_col)
    # the k+1 smallest ids of each distinct vector; the limit also works before the shuffle, so copies never meet
    nth = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    firsts = valid.withColumn("n", nth).where(F.col("n") <= k + 1)
    entries = materialize(firsts.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("entry", F.element_at("ids", 1)), "entries")
    parts = [_of_length(valid, entries.where(F.size("v") == dims), is_query, dims, total, k, fit_rows, trees, leaf, look_share, leaf_rows) for dims, total in sorted(map(tuple, entries.groupBy(F.size("v")).count().collect()))]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_length(valid: DataFrame, entries: DataFrame, is_query, dims: int, total: int, k: int, fit_rows: int, trees: int, leaf: int, look_share: float, leaf_rows: int) -> DataFrame:
    """The same among the vectors of one length."""
    spark = valid.sparkSession
    picked = spark.createDataFrame([(i,) for i, _ in smallest_hashes(entries.select(F.col("entry").alias("doc_id")), fit_rows)], "entry long")
    sample = sorted((r["entry"], r["v"]) for r in entries.select("entry", "v").join(F.broadcast(picked), "entry").collect())
    forest = spark.sparkContext.broadcast(Forest(np.array([v for _, v in sample], dtype=np.float64), total, trees, leaf))

    look_at = look_share * total
    kind = dict(entries.dtypes)["v"]

    asked = valid.where(is_query).where(F.size("v") == dims).select(F.col("id").alias("query_id"), F.col("v").alias("qv")).distinct()
    asked = materialize(asked.join(entries.select("entry", "v"), F.col("qv") == F.col("v")).select("query_id", "entry"), "queries")
    queries = entries.join(asked.select("entry").distinct(), "entry").select("entry", "v")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dims)
            for n, tree in enumerate(forest.value.trees):
                size = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, n, np.int32)), pa.array(tree.leaves(found)), batch.column(0), batch.column(1)], names=["tree", "leaf", "entry", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dims)
            for at in range(len(found)):
                places = np.array(forest.value.search(found[at], look_at), dtype=np.int32).reshape(-1, 2)
                pick = pa.array(np.full(len(places), at))
                yield pa.RecordBatch.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1]), batch.column(0).take(pick), batch.column(1).take(pick)], names=["tree", "leaf", "entry", "v"])

    fields = f"tree int, leaf int, entry long, v {kind}"
    stored = entries.select("entry", "v").mapInArrow(descend, fields)
    # leaves too large for a task are dealt into chunks; there are few leaves, and fewer such ones. Vectors go down the
    # trees once more for it, which costs less than to write them once a tree
    counts = stored.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(leaf_rows)).cast("int").alias("chunks"))
    large = F.broadcast(materialize(counts.where("chunks > 1"), "large-leaves"))
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = stored.join(large, ["tree", "leaf"], "left").select(*FIELDS, F.pmod(F.xxhash64("entry"), chunks).cast("int").alias("chunk"), F.lit(0).alias("side"))
    visits = queries.mapInArrow(search, fields).join(large, ["tree", "leaf"], "left")
    visits = visits.select(*FIELDS, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(1).alias("side"))
    # a leaf's vectors come before its queries, by id
    met = visits.unionByName(dealt).repartition("tree", "leaf", "chunk").sortWithinPartitions("tree", "leaf", "chunk", "side", "entry")

    def pruned(parts: list[np.ndarray]) -> np.ndarray:
        """The k+1 nearest distinct entries of each query among rows (query, entry, distance)."""
        every = np.concatenate([np.zeros(0, FOUND), *parts])
        every = every[np.lexsort((every["entry"], every["score"], every["query"]))]
        fresh = np.ones(len(every), dtype=bool)
        fresh[1:] = (every["query"][1:] != every["query"][:-1]) | (every["entry"][1:] != every["entry"][:-1])
        every = every[fresh]
        return every[np.arange(len(every)) - np.searchsorted(every["query"], every["query"]) <= k]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k+1 nearest entries that this task's leaves hold to each query that reached one of them."""

        def rows(found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[n])) for n in FOUND.names], names=list(FOUND.names))

        place, held, size = None, [], 0
        ids, near = [np.zeros(0, np.int64)], [np.zeros((0, dims))]
        for batch in batches:
            tree, leaf, chunk, entry, side = (batch.column(n).to_numpy() for n in ("tree", "leaf", "chunk", "entry", "side"))
            v = batch.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, dims)
            cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(leaf) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tree)], strict=True):
                if place != (tree[a], leaf[a], chunk[a]):
                    place, ids, near = (tree[a], leaf[a], chunk[a]), [], []
                if side[a] == 0:
                    ids.append(entry[a:z])
                    near.append(v[a:z])
                    continue
                if not ids:
                    continue
                ids, near = [np.concatenate(ids)], [np.concatenate(near)]
                step = max(1, 2_000_000 // (len(ids[0]) * dims))
                for at in range(a, z, step):
                    end = min(z, at + step)
                    d = np.sqrt(((v[at:end, None, :] - near[0][None, :, :]) ** 2).sum(axis=2))
                    best = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
                    out = np.zeros(best.size, FOUND)
                    out["query"], out["entry"], out["score"] = np.repeat(entry[at:end], best.shape[1]), ids[0][best].reshape(-1), np.take_along_axis(d, best, axis=1).reshape(-1)
                    held.append(out)
                    size += len(out)
                if size > 2 * HELD_ROWS:
                    held = [pruned(held)]
                    size = len(held[0])
                    if size > HELD_ROWS:
                        yield rows(held[0])
                        held, size = [], 0
        yield rows(pruned(held))

    found = met.mapInArrow(compare, "query long, entry long, score double")
    found = found.groupBy("query", "entry").agg(F.min("score").alias("score"))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "entry"))).where(F.col("n") <= k + 1)
    rows = found.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    lists = rows.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("best"))
    placed = asked.join(lists, asked["entry"] == lists["query"]).select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return placed.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
