"""Quotes that nearly stand in a text: a window of it is as good as LEAST percent alike.

The windows are those of a partial ratio: all that are as long as the quote, and shorter ones at either end of the text.
A window (of w characters, the quote of m) is alike by 2 * c / (m + w), where c is their longest common subsequence. So at
least LEAST = 90 percent leave at most (m + w) / 10, that is m // 5, insertions and deletions, each of which breaks one piece
of the quote at most; whatever stands of its pieces lies on m // 5 + 1 neighbouring diagonals of quote and text. Only where
enough pieces lie so close are windows compared, which loses none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import packed

#: Percent that a window must be alike; the bounds on edits and pieces are those of 90.
LEAST = 90
#: Characters of a text that are looked at together, and how many pieces may stand there.
CHARACTERS, HITS = 1 << 16, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def edits(m: int) -> int:
    """Insertions and deletions that a quote of m characters may have."""
    return m // 5


def piece_length(m: int) -> int:
    """The longest pieces of at most four characters of which one must be left whole; 1 to 4."""
    return next(g for g in (4, 3, 2, 1) if m // g > edits(m))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _keys(codes: np.ndarray, g: int) -> np.ndarray:
    """A number for each g characters in a row; others may share it."""
    n = max(len(codes) - g + 1, 0)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(g):
        key = (key + codes[i : i + n].astype(np.uint64) + np.uint64(1)) * _ODD
    return key


def _alike(common: int, m: int, w: int) -> bool:
    return 200 * common >= LEAST * (m + w)


def _bits(quote: str) -> dict[str, int]:
    """The places of each character of a quote as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(quote):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(bits: dict[str, int], m: int, text: str) -> int:
    """The length of the longest common subsequence of a quote and a text."""
    every = free = (1 << m) - 1
    for c in text:
        met = free & bits.get(c, 0)
        free = ((free + met) | (free - met)) & every
    return m - free.bit_count()


def _begins(bits: dict[str, int], m: int, text: str) -> bool:
    """Whether a beginning of the text that is shorter than the quote is alike."""
    every = free = (1 << m) - 1
    least = -(-9 * m // 11)  # a shorter one is not alike even if all of it is common
    for w, c in enumerate(text[: m - 1], 1):
        met = free & bits.get(c, 0)
        free = ((free + met) | (free - met)) & every
        if w >= least and _alike(m - free.bit_count(), m, w):
            return True
    return False


def stands(bits: dict[str, int], m: int, text: str, first: int, last: int) -> bool:
    """Whether a window as long as the quote is alike, of those that begin at first .. last."""
    first, last, need = max(first, 0), min(last, len(text) - m), -(-LEAST * m // 100)
    if first > last or _common(bits, m, text[first : last + m]) < need:
        return False
    while first <= last:
        found = _common(bits, m, text[first : first + m])
        if found >= need:
            return True
        first += need - found  # a window one further has one common character more at most
    return False


def alike(quote: str, text: str) -> bool:
    """Whether a quote and a text of the same length are alike; either may be the one whose windows are taken."""
    m = len(quote)
    return any(_alike(_common(_bits(a), m, b), m, m) or _begins(_bits(a), m, b) or _begins(_bits(a[::-1]), m, b[::-1]) for a, b in ((quote, text), (text, quote)))


class Quotes:
    """A block of quotes and where their pieces stand in them."""

    def __init__(self, table: pa.Table):
        self.ids, self.texts = table.column(0).to_pylist(), table.column(1).to_pylist()
        self.sizes = np.array([len(q) for q in self.texts], dtype=np.int64)
        grams = np.array([piece_length(m) for m in self.sizes.tolist()], dtype=np.int64)
        self.band = self.sizes // 10
        self.need = self.sizes // grams - 2 * self.band
        self.need_at_end = self.sizes // grams - self.sizes // 5
        self.pieces, self.kept = {}, {}
        for g in np.unique(grams).tolist():
            some = np.flatnonzero(grams == g)
            keys = np.concatenate([_keys(_codes(self.texts[i]), g)[::g] for i in some.tolist()])
            count = self.sizes[some] // g
            owner = np.repeat(some, count)
            place = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * g
            order = np.argsort(keys, kind="stable")
            known, starts, times = np.unique(keys[order], return_index=True, return_counts=True)
            self.pieces[g] = (known, starts, times, owner[order], place[order])

    def bits(self, i: int, turned: bool = False) -> dict[str, int]:
        """_bits of a quote, or of the quote read backwards."""
        if (i, turned) not in self.kept:
            self.kept[i, turned] = _bits(self.texts[i][::-1] if turned else self.texts[i])
        return self.kept[i, turned]

    def diagonals(self, codes: np.ndarray, most: int) -> np.ndarray | None:
        """Where pieces stand in a text: quote * span + diagonal + length of the quote, sorted; None if these are too many."""
        span, spots = self.span(codes), []
        for g, (known, _, times, _, _) in self.pieces.items():
            keys = _keys(codes, g)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            spot = np.flatnonzero(known[at] == keys)
            spots.append((spot, at[spot]))
            most -= int(times[at[spot]].sum())
        if most < 0:
            return None
        out = []
        for (spot, at), (_, starts, times, owner, place) in zip(spots, self.pieces.values(), strict=True):
            size = times[at]
            flat = np.arange(size.sum()) + np.repeat(starts[at] - (np.cumsum(size) - size), size)
            own = owner[flat]
            out.append(own * span + np.repeat(spot, size) + (self.sizes[own] - place[flat]))
        return np.sort(np.concatenate(out))

    def span(self, codes: np.ndarray) -> int:
        return len(codes) + 2 * int(self.sizes.max()) + 2

    def near(self, codes: np.ndarray, most: int) -> list[tuple[int, int, int]] | None:
        """(quote, first, last): where windows that are alike can begin in a text; first is None for shorter ones that it
        begins with, last for those that it ends with. None if more than most pieces stand in the text."""
        hits = self.diagonals(codes, most)
        if hits is None:
            return None
        span, size, quotes = self.span(codes), len(codes), np.arange(len(self.sizes))
        own = np.repeat(quotes, np.diff(np.searchsorted(hits, np.append(quotes, len(quotes)) * span)))
        earliest = np.arange(len(hits)) - (self.need[own] - 1)
        close = np.flatnonzero((earliest >= 0) & (hits[np.maximum(earliest, 0)] >= hits - self.band[own]))
        own = own[close]
        diagonal, band = hits[close] - own * span - self.sizes[own], self.band[own]
        fresh = np.flatnonzero((np.diff(own, prepend=-1) > 0) | (np.diff(diagonal, prepend=0) > 2 * band))
        until = np.append(fresh[1:], len(own)) - 1 if len(fresh) else fresh
        out = list(zip(own[fresh].tolist(), (diagonal - band)[fresh].tolist(), (diagonal + band)[until].tolist(), strict=True))
        every, low, high = quotes * span + self.sizes, 2 * self.sizes // 11, self.sizes // 10
        for begins, middle, low, high in ((True, 0, low, high), (False, size - self.sizes, high, low)):  # noqa: B020
            held = np.searchsorted(hits, every + middle + high, side="right") - np.searchsorted(hits, every + np.maximum(middle - low, -self.sizes))
            out += [(i, None, 0) if begins else (i, 0, None) for i in np.flatnonzero((held >= self.need_at_end) & (self.sizes <= size)).tolist()]
        return out

    def found(self, text: str) -> list[int]:
        """Numbers of the quotes that nearly stand in a text, but not whole."""
        out = {i for i in np.flatnonzero(self.sizes == len(text)).tolist() if alike(self.texts[i], text)}
        codes, beyond = _codes(text), int(self.sizes.max()) + 1
        start, step = 0, CHARACTERS
        while start < len(codes):
            part = codes[start : start + step + beyond]
            places = self.near(part, HITS if step > 1 else len(part) * len(self.texts) * beyond)
            if places is None:
                step = max(1, step // 4)
                continue
            for i, first, last in places:
                m = len(self.texts[i])
                if i in out or m >= len(text):
                    continue
                if first is None:
                    near = start == 0 and _begins(self.bits(i), m, text)
                elif last is None:
                    near = start + len(part) == len(codes) and _begins(self.bits(i, True), m, text[::-1])
                else:
                    near = stands(self.bits(i), m, text, first + start, last + start)
                if near:
                    out.add(i)
            start += step
        return sorted(i for i in out if self.texts[i] not in text)


def nearly_found(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, item_id: quotes (item_id, q) that nearly stand in texts (doc_id, s) which do not hold them whole. Blocks of
    texts meet blocks of quotes on the executors."""
    some, cores = texts.where("s <> ''").select("doc_id", "s"), texts.sparkSession.sparkContext.defaultParallelism
    if some.rdd.getNumPartitions() < cores:  # few files: blocks for all cores
        some = some.repartition(cores)
    both = packed(some, "text-blocks").selectExpr("data AS texts").crossJoin(packed(quotes.select("item_id", "q"), "quote-blocks").selectExpr("block", "data AS quotes"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Quotes] = {}
        opened = lambda data: pa.ipc.open_stream(data.as_buffer()).read_all()
        for batch in batches:
            for data, number, given in zip(*(batch.column(c) for c in ("texts", "block", "quotes")), strict=True):
                if number.as_py() not in kept:
                    if len(kept) > 3:
                        kept.clear()
                    kept[number.as_py()] = Quotes(opened(given))
                block, table = kept[number.as_py()], opened(data)
                pairs = [(d, block.ids[i]) for d, text in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True) for i in block.found(text)]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["doc_id", "item_id"])

    return both.mapInArrow(search, "doc_id long, item_id long")
