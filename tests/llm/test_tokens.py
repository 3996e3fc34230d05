"""Encoding, token files and packing."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from claimloom.llm import packing, token_codes, tokens

from .fixtures import rows, table


@pytest.fixture(scope="module")
def encoder():
    return tokens.worker_encoder(tokens.tokenizer_path())


def whole(encoder, text):
    return np.array(encoder.library.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()


def test_pieces_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(2)
    texts = [None, "", " ", "\n", " a", "a ", "a\nb", "it's  fine", "<|endoftext|> x", "é　 x", "\x1c a b", "A.B, c.\nD."] + ["".join(rng.choice(" \n\ta.1é\x85's!,Ωß") for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert got == whole(encoder, text), repr(text)


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_any_text(encoder, texts):
    assert encoder.encode(texts) == [whole(encoder, t) for t in texts]


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), np.array([0]), np.array([255, 256, 65535, 65536, 2**32 - 1]), rng.integers(0, 50257, 5000), rng.integers(0, 300, 1500)):
        ids = ids.astype(np.uint32)
        codes = token_codes.Codes(token_codes.pack(ids))
        assert len(codes) == len(ids) and (codes.slice(0, len(ids)) == ids).all()
        for i in range(0, len(ids), 37):
            assert codes.token(i) == ids[i] and (codes.slice(i, min(len(ids), i + 91)) == ids[i : i + 91]).all()
    with pytest.raises(ValueError):
        token_codes.Codes(b"nothing")


def test_token_files(spark, encoder, tmp_path):
    path = f"file://{tmp_path}/codes"
    token_codes.write_codes(table(spark), path, tokens.tokenizer_path(), segment_tokens=700)
    got = token_codes.read_codes(spark, path).orderBy("start").collect()
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, w in zip(got, want, strict=True):
        raw = whole(encoder, w[1])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (w[0], start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4


def test_token_files_of_no_documents(spark, tmp_path):
    path = f"file://{tmp_path}/codes"
    token_codes.write_codes(table(spark, []), path, tokens.tokenizer_path())
    assert token_codes.read_codes(spark, path).collect() == []


def packed_ok(pieces, cap):
    bins = defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    return len(bins)


def test_packing(spark, encoder):
    got = packing.pack_documents(table(spark), max_len=256).collect()
    used = packed_ok(got, 256)
    ids = [whole(encoder, r[1]) for r in rows()]
    total = sum(len(x) // 4 for x in ids)
    assert sum(r["length"] for r in got) == total and used <= 1.05 * -(-total // 256)
    want = Counter()
    for doc, raw in zip([r[0] for r in rows()], ids, strict=True):
        n, start, piece = len(raw) // 4, 0, 0
        while start < n:
            length = (n - start) % 256 or 256
            want[(doc, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))] += 1
            start, piece = start + length, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packing.pack_documents(table(spark, [])).collect() == []


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=150, deadline=None)
def test_plan_packs_everything(counts):
    plan = packing.plan_bins(counts, 40)
    packed = Counter()
    for bin_, repeats in plan:
        assert sum(x * n for x, n in bin_.items()) <= 40
        for x, n in bin_.items():
            packed[x] += n * repeats
    assert packed == Counter(counts)
    bins, total = sum(r for _, r in plan), sum(x * n for x, n in counts.items())
    assert bins <= 2 * -(-total // 40) + 1


def test_two_smaller_pieces_replace_the_smallest():
    # greedy takes 6 and 3; 2 + 2 fit the gap of 4 more tightly than 3
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ({6: 1, 2: 2}, 1)


def test_a_segment_decoded_whole_gives_the_documents_of_its_slices(spark, tmp_path):
    import zlib

    import numpy as np

    from claimloom.llm import token_codes, tokens

    path = f"{tmp_path}/codes"
    docs = spark.createDataFrame([(n, "word " * n) for n in range(40)], "doc_id long, text string").coalesce(1)
    token_codes.write_codes(docs, path, tokens.tokenizer_path())
    segment = spark.read.parquet(path).orderBy("shard", "segment").collect()
    got = {r["doc_id"]: r["ids_crc32"] for r in token_codes.read_codes(spark, path).collect()}
    for row in segment:
        at = np.concatenate([[0], np.cumsum(row["lengths"])])
        codes = token_codes.Codes(row["codes"])
        assert [got[i] for i in row["doc_ids"]] == [zlib.crc32(codes.slice(int(a), int(b)).tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
