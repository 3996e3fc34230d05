"""Near-duplicates, mixing, nearest neighbours and the pipeline against brute force."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from claimloom.llm import mixing, neighbours, simhash

from .fixtures import prose, rows, table


def slow_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    for text in [None, "", "a", "A b", "a b C", "ÉÀ x y z"] + [r[1] for r in rows()[:10]]:
        assert simhash.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


def test_every_pair_within_the_radius_escapes_a_mask():
    rng = np.random.default_rng(5)
    for open_bits in (2**64 - 1, int(rng.integers(0, 2**63)), 0b1011011, 0):
        masks = simhash.covering_masks(open_bits)
        positions = [i for i in range(64) if open_bits >> i & 1]
        for _ in range(300):
            flips = sum(1 << int(p) for p in rng.choice(positions, min(3, len(positions)), replace=False)) if positions else 0
            assert any(m & flips == 0 for m in masks)


def groups(fps: list[int]) -> list[int]:
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def chained(n: int) -> list[int]:
    rng = np.random.default_rng(9)
    out = [int(rng.integers(0, 2**63))]
    while len(out) < n:
        flips = sum(1 << int(p) for p in rng.choice(64, int(rng.integers(1, 5)), replace=False))
        out.append(out[int(rng.integers(len(out)))] ^ flips if rng.random() < 0.9 else int(rng.integers(0, 2**63)))
    return out


def test_components_of_chains_and_full_buckets(spark, monkeypatch):
    for bucket in (1024, 3):  # the small bound splits buckets again and again
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        fps = sorted(set(chained(220)))
        frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links_within(frame)).collect()}
        got, want = defaultdict(set), defaultdict(set)
        for f, g in zip(fps, groups(fps), strict=True):
            got[roots.get(simhash._signed(f), simhash._signed(f))].add(f)
            want[g].add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_table(spark):
    data = rows() + [(400 + i, rows()[44][1] + " extra" * i, "en", "s", 0, 0.0, "") for i in range(4)]
    got = simhash.near_duplicates(table(spark, data), ["doc_id"]).collect()
    fps = [slow_fingerprint(r[1]) for r in data]
    least: dict[int, int | None] = {}
    for r, g in zip(data, groups(fps), strict=True):
        known = [x for x in (least.get(g), r[0]) if x is not None]
        least[g] = min(known) if known else None
    want = Counter((r[0], f, least[g]) for r, f, g in zip(data, fps, groups(fps), strict=True))
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(table(spark, []), ["doc_id"]).collect() == []


def slow_mixture(data):
    import hashlib
    import re

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data]
    sources = sorted({r[3] for r in data}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(n for r, n in zip(data, size, strict=True) if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, rest, free = {}, 1.5 * sum(size), set(sources)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if 2 * own[s] <= weight[s] * level}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * own[s] for s in over}
        rest -= sum(2.0 * own[s] for s in over)
        free -= over
    out = []
    for s in sources:
        mine = sorted(((hashlib.md5(f"mix-1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, n) for r, n in zip(data, size, strict=True) if r[3] == s))
        whole = math.floor(target[s] / own[s]) if own[s] else 0
        left = math.floor(target[s]) - whole * own[s]
        for _, known, i, n in mine:
            part = max(0, min(left, n))
            left -= part
            out.append((i if known else None, n, own[s], round(target[s], 6), whole * n + part))
    return Counter(out)


def test_mixing(spark):
    got = mixing.mixture(table(spark)).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == slow_mixture(rows())
    for data in ([], [(1, None, None, None, 0, 0.0, "")]):
        assert [r["taken"] for r in mixing.mixture(table(spark, data)).collect()] == [0] * len(data)
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
        assert r["taken"] <= 2 * r["size"]
    assert all(sum(r["taken"] for r in v) == math.floor(v[0]["target"] + 1e-9) for v in by_source.values())


def test_mixed_documents_keep_columns_and_counts(spark):
    docs = table(spark)
    times = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs).collect())
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert set(times.values()) <= {1, 2, 3, 6} and (100, None) not in times


def vectors(n: int = 400):
    rng = np.random.default_rng(4)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(n)]
    data += [(1000 + i, data[0][1]) for i in range(30)]  # copies of a query
    return data + [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] + [1.0] * 7), (2004, [float("inf")] + [1.0] * 7), (2005, [1.0, 2.0]), (None, [1.0] * 8), data[5]]


def test_nearest_neighbours(spark):
    data = vectors()
    frame = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in neighbours.nearest(frame, F.col("id") % 100 == 0, look_share=neighbours.TREES).collect():  # every leaf
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: np.array(v) for i, v in data if i is not None and i < 2000}
    assert set(got) == {i for i in usable if i % 100 == 0}
    for q, found in got.items():
        want = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert [i for _, i, _ in sorted(found)] == [i for _, i in want]
        assert np.allclose([s for _, _, s in sorted(found)], [s for s, _ in want])


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(few, F.col("id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(2, 0.0), (1, 1.414214)]
    assert neighbours.nearest(few.where("false"), F.lit(True)).collect() == []


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(9000, 24)).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest(frame, F.col("id") % 300 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert recall(v, got) >= 0.9


def test_recall_on_a_table_larger_than_its_sample_and_leaves(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(3000, 16)), rng.normal(size=(1, 16)) + rng.normal(size=(2500, 16)) / 1000]).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest(frame, F.col("id") % 100 == 0, fit_rows=600, leaf_rows=40).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert len(got) == 55 and all(len(x) == 10 for x in got.values())
    assert recall(v, got) >= 0.9


def recall(v, got) -> float:
    hits = sum(len(set(np.argsort(((v - v[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) & found) for q, found in got.items())
    return hits / (10 * len(got))


def test_stages_follow_their_operators(spark, tmp_path):
    """Each stage against what a direct version of its decision keeps."""
    import corpus_pipeline
    from claimloom.llm import rules

    data = [r for r in rows() if r[0] != 105] + [(500 + i, prose("en", 70, i).upper().replace(" ", "!! "), "en", "src1", 0, 0.0, "") for i in range(12)]
    docs = table(spark, data)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(500, 512)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = out.collect()
        out = stage(spark, out, str(tmp_path))
        if name == names[-1]:
            break
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns
        after = Counter(out.collect())
        if name == "language_id":
            assert after == Counter(r for r in before if r["text"] and any(c.isalpha() for c in r["text"]))
        if name == "quality_rules":
            kept = {r["doc_id"] for r in after}
            assert set(range(60)) <= kept and all(rules.statistics(r["text"])[0][0] >= 50 for r in after)
        if name == "simhash_near_dedup":
            fps = [slow_fingerprint(r["text"]) for r in before]
            least = {}
            for r, g in sorted(zip(before, groups(fps), strict=True), key=lambda x: (x[0]["doc_id"] is None, x[0]["doc_id"] or 0)):
                least.setdefault(g, r["doc_id"])
            assert Counter(r["doc_id"] for r in after.elements()) == Counter(least.values())
        if name == "source_mixing":
            texts = {(r["doc_id"], r["text"]) for r in before}
            assert {(r["doc_id"], r["text"]) for r in after} <= texts and max(after.values()) <= 2
    assert sum(r["piece"] == 0 for r in out.collect()) == sum(after.values())
    total = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert total == out.count()
