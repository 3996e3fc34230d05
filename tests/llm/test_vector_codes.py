"""Vector codes against a plain Lloyd in Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from claimloom.llm import vector_codes
from claimloom.llm.vector_codes import Tree

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, n long"


def plain(data: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[list[tuple], list]:
    """(vec_id, label, code, error) of the kept rows, and the codebooks."""
    kept = [(i, v, lab) for i, v, lab in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = lambda v: [[math.floor(float(np.float32(x)) * 4096) for x in ([*v] + [0.0] * parts * width)[p * width : (p + 1) * width]] for p in range(parts)]
    rows = [(i, cut(v), lab) for i, v, lab in kept]
    first: dict = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, list(v)), list(v))
    ids = sorted(first, key=lambda i: (i is None, i))[:entries]
    books = [[cut(first[i])[p] for i in ids] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((far(x, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            owned = [[] for _ in books[p]]
            for _, v, _ in rows:
                owned[best(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own) for c in zip(*own, strict=True)] if own else e for own, e in zip(owned, books[p], strict=True)]
    out = []
    for i, v, lab in rows:
        found = [best(v[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    return out, books


def frame(spark, data: list[tuple]):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in data], VECTORS)


def check(spark, data: list[tuple]) -> None:
    wanted, books = plain(data)
    coded, got_books = vector_codes.compress(frame(spark, data))
    got = [(r["id"], r["label"], r["code"], r["error"]) for r in coded.collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert got_books.tolist() == books
    assert sorted(got, key=key) == sorted([(i, None if lab is None else str(lab), c, e) for i, lab, c, e in wanted], key=key)


@pytest.mark.parametrize("seed,n,k,steps", [(1, 700, 16, 8), (2, 40, 24, 3), (3, 300, 8, 2), (4, 11, 16, 50)])
def test_trees_agree_with_plain_assignment(seed, n, k, steps):
    rng = np.random.default_rng(seed)
    points = rng.integers(-steps, steps, (n, 3)).astype(np.int32)  # many ties and equal points
    entries = points[rng.choice(n, min(n, k), replace=False)].astype(np.int64)
    far = ((points[:, None].astype(np.int64) - entries[None]) ** 2).sum(axis=2)
    tree = Tree.unpacked(points, Tree.build(points, leaf=4).packed())
    assert (tree.codes(entries) == far.argmin(axis=1)).all()
    sums = tree.sums(entries)
    for j in range(len(entries)):
        mine = points[far.argmin(axis=1) == j]
        assert sums[j].tolist() == [*mine.astype(np.int64).sum(axis=0).tolist(), len(mine)]


def test_whole_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(c, c + 50, (500, 4)) for c in (-9000, 0, 9000)]).astype(np.int32)
    entries = np.array([[-9000] * 4, [0] * 4, [9000] * 4])
    looked = sum(len(nodes) for _, nodes, owner, _ in Tree.build(points).filtered(entries) if owner is None)
    assert looked <= 2  # leaves that straddle two clusters


def test_against_plain_lloyd(spark):
    rng = np.random.default_rng(8)
    data = [(int(i), (rng.normal(size=16) * 0.3).round(2).tolist(), int(rng.integers(3))) for i in rng.permutation(400)]
    data += [(i, data[0][1], None) for i in range(400, 600)]  # one vector in a third of all rows
    data += [(None, data[5][1], 1), (7, [0.5] * 16, 2), (7, [-0.5] * 16, 2), data[3], (900, None, 1), (901, [float("nan")] + [0.0] * 15, 1), (902, [float("inf")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [0.0] * 16, 0), (-3, [-1.5] * 16, 0)]
    check(spark, data)


def test_few_short_and_odd_vectors(spark):
    check(spark, [(5, [0.1, 0.2, 0.3], 1)])
    check(spark, [(5, [0.1] * 9, 1), (6, [], 1), (None, [0.2] * 3, None), (None, [0.1] * 3, None), (1, [3.25] * 17, 1)])


def test_huge_components_count_as_the_bound(spark):
    coded, books = vector_codes.compress(frame(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]))
    assert sorted(r["error"] for r in coded.collect()) == [0, 0, 0] and abs(books).max() == vector_codes.component_bound(8)


def test_no_kept_rows(spark):
    coded, _ = vector_codes.compress(frame(spark, [(1, None, 1), (2, [float("nan")], 1)]))
    assert coded.count() == 0


def test_labels_and_digest_of_the_query(spark, tmp_path):
    data = [(i, [i % 7 - 3.0, i % 5 - 2.5] * 4, None if i % 4 == 0 else i % 3) for i in range(200)]
    frame(spark, data).write.parquet(str(tmp_path / "embeddings.parquet"))
    wanted, books = plain(data)
    total: dict = {}
    for _, lab, _, error in wanted:
        total[lab] = total.get(lab, 0) + error
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    got = vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, code, error, total[lab], digest) for i, lab, code, error in wanted)


def test_query_without_rows(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert vector_codes.op12_vector_codes(spark, str(tmp_path)).collect() == []
