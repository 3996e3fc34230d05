"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a nonzero vector of r+1 bits; the mask of a nonzero vector v keeps the positions whose vector
has an odd product with v. At most r differing bits span at most r dimensions, so some v is orthogonal to all of them
and its mask keeps none: every pair within radius r agrees in one of the 2**(r+1)-1 masked tables. A bucket with more
than BUCKET fingerprints is split again by masks over the bits that it leaves open, which loses no pair either; after
three levels so few bits are open that buckets are small by arithmetic. Buckets give the edges of a spanning forest,
never all pairs, and components are found by minimum labels with pointer jumping on distributed tables.

Cases: a text without words (null and empty too) has fingerprint zero and is linked like any other; fewer words than a
shingle make one shingle; copies and repeated rows share a fingerprint and thus a component; a null id counts for no
component's smallest id, and a component of null ids alone has a null id; no rows give no rows; other columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, load, map_texts, materialize, small_batches, spread_join

WORDS, RADIUS, HASH_SEED = 3, 3, 42
BUCKET, LEVELS = 1024, 3
_SLICE = 1 << 18


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's word shingles; as a signed number."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = (lengths + 1).cumsum() - 1
    width = min(words, len(tokens))
    stops = ends[width - 1 :].tolist()
    starts = (ends - lengths)[: len(stops)].tolist()
    digest, totals = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(stops), _SLICE):
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)], dtype="<u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * totals > len(stops), bitorder="little")
    return int(set_bits.view("<i8")[0])


def covering_masks(open_bits: int, radius: int = RADIUS) -> list[int]:
    """Masks over the positions set in open_bits such that any radius of them escape at least one mask."""
    positions = [i for i in range(64) if open_bits >> i & 1]
    kinds = 2 ** (radius + 1) - 1
    return [sum(1 << p for k, p in enumerate(positions) if ((k % kinds + 1) & v).bit_count() & 1) for v in range(1, kinds + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fingerprints: DataFrame, radius: int) -> DataFrame:
    """fp, mask, key: the masked tables of the first level."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(2**64 - 1, radius)])
    return fingerprints.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _split(members: DataFrame, radius: int) -> DataFrame:
    """fp, mask, key of full buckets' members, in the tables of the next level."""
    small_batches(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finer: dict[int, np.ndarray] = {}
        for batch in batches:
            fps, masks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            out = [(np.zeros(0, np.int64),) * 2]
            for mask in np.unique(masks).tolist():
                if mask not in finer:
                    finer[mask] = np.array([_signed((mask & (2**64 - 1)) | m) for m in covering_masks(~mask & (2**64 - 1), radius)], dtype=np.int64)
                own = fps[masks == mask]
                out.append((np.repeat(own, len(finer[mask])), np.tile(finer[mask], len(own))))
            fp, mask = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(mask), pa.array(fp & mask)], names=["fp", "mask", "key"])

    return members.select("fp", "mask").mapInArrow(run, "fp long, mask long, key long")


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) of every component that links of at most radius bits make in one bucket."""
    u = fps.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    label = np.arange(len(u))
    todo = np.ones(len(u), dtype=bool)
    links = []
    order = np.argsort(fps)
    for root in order.tolist():
        if not todo[root]:
            continue
        member, front = np.zeros(len(u), dtype=bool), np.zeros(len(u), dtype=bool)
        member[root] = front[root] = True
        while front.any():
            front = near[front].any(axis=0) & ~member
            member |= front
        todo &= ~member
        label[member] = root
        links += [(int(fps[i]), int(fps[root])) for i in np.flatnonzero(member).tolist() if i != root]
    return links


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """a, b: links from buckets of at most BUCKET fingerprints, given as arrays."""
    spark = buckets.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            links = [x for i in range(len(column)) for x in spanning_links(column[i].values.to_numpy(zero_copy_only=False), radius)]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def links_within(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: distinct fingerprints' links (a spanning forest of each bucket), complete up to connectivity."""
    keys, found = _keys(fingerprints, radius), []
    for level in range(LEVELS):
        sizes = keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
        sizes = materialize(sizes, f"buckets-{level}")
        found.append(sizes.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).select(F.col("hi").alias("a"), F.col("lo").alias("b")))
        large = (F.col("n") > BUCKET) & (F.lit(level) < LEVELS - 1)
        some = keys.join(sizes.where((F.col("n") > 2) & ~large).select("mask", "key"), ["mask", "key"])
        found.append(_bucket_links(some.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")), radius))
        if level == LEVELS - 1 or sizes.where(large).limit(1).count() == 0:
            break
        members = keys.join(sizes.where(large).select("mask", "key"), ["mask", "key"]).select("fp", "mask", "key")
        keys = materialize(_split(members, radius).distinct(), f"split-{level}")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each linked node's component. Only whether anything changed reaches the driver."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        # the least label of a node's neighbours, then the label of that label
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(seen, "node").select("node", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        of = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        new = materialize(lower.join(of, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("root"), "was"), "labels")
        discard(labels)
        labels = new.select("node", "root")
        if new.where("root <> was").limit(1).count() == 0:
            discard(both)
            return labels


def fingerprinted(docs: DataFrame, keep: list[str], words: int = WORDS, text_col: str = "text", name: str = "fp") -> DataFrame:
    """The columns keep of every row with its fingerprint (signed 64 bits) in column name, written."""

    def make():
        return lambda texts: [[fingerprint(t, words) for t in texts]]

    return materialize(map_texts(docs, text_col, f"{name} long", make, keep), "fingerprints")


def fingerprint_components(marked: DataFrame, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """fp, component_id (the smallest id reachable by links), root (the smallest fingerprint of the component) and n (the
    rows of the fingerprint)."""
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links_within(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return materialize(rooted.join(least, "root").select("fp", "component_id", "root", "n"), "components")


def near_duplicates(docs: DataFrame, keep: list[str], words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns keep of every row with fp, component_id and root."""
    marked = fingerprinted(docs, list(dict.fromkeys([*keep, id_col])), words, text_col)
    return spread_join(marked, fingerprint_components(marked, radius, id_col), "fp")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
