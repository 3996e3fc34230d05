"""Language identification by cross-parsing entropy.

A suffix automaton is built from labelled text of each language. A text is parsed against each automaton into the
longest phrases that occur there; the language whose normalised phrase count (phrases times the bits that point into its
text) is least wins. Parsing runs over many texts at once: one NumPy step advances every open parse by one character.

Texts are lower-cased, and runs of anything but letters become one space. Every letter of the labelled texts is a symbol;
edges are a sparse table, so alphabets may be large. A long text is cut into blocks that are parsed side by side; a
block's parse is then carried on into the next until both begin a phrase at one place, which gives the parse of the
whole text.

Cases: a null text, or one without a letter (the empty text too), is `und` with score 0; ties go to the first language
by code point; without any labelled text every text is `und`; repeated rows get equal results, and of labelled rows that
repeat an id and language the least text is learned from; other columns pass through or are ignored, and result columns
replace kept ones of the same name."""

from __future__ import annotations

import math
import random
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import id_hash_mod, load, map_texts, materialize, smallest_hashes, taken_whole

#: Bounds of the labelled sample: whole texts per language, and characters per language that they hold together.
FIT_DOCS, FIT_CHARS = 120, 100_000
#: Characters that are parsed side by side in one block; characters of texts that are parsed at once.
BLOCK, PARSE_CHARS = 2048, 4_000_000
UND = "und"

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point, 1 if it is a letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, dtype=bool)
        for start in range(0, 0x110000, 0x1000):
            for c in range(start, start + 0x1000):
                table[c] = unicodedata.category(chr(c))[0] == "L"
        _LETTERS.append(table)
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def letters_only(text: str) -> np.ndarray:
    """Lower-case code points with one space (32) for every run of other characters; none if there is no letter."""
    points = code_points(text.lower())
    letter = letter_table()[points]
    if not letter.any():
        return points[:0]
    out = np.where(letter, points, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = out[keep]
    return out[:-1] if out[-1] == 32 else out


class SuffixAutomaton:
    """All substrings of a symbol sequence (symbols from 1); state 0 is the root.

    Edges lie in one table: the edge of a state by a symbol at the state's base plus the symbol, if the place is owned by
    the state. Bases are drawn so that no two edges share a place."""

    def __init__(self, symbols: list[int], alphabet: int):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for s in symbols:
            current = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and s not in nxt[p]:
                nxt[p][s] = current
                p = link[p]
            if p != -1:
                q = nxt[p][s]
                if length[p] + 1 == length[q]:
                    link[current] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(s) == q:
                        nxt[p][s] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current
        edges = sum(map(len, nxt))
        size = 2 * edges + 2 * alphabet + 16
        used = bytearray(size)
        self.base = np.zeros(len(nxt), dtype=np.int32)
        self.owner, self.to = np.full(size + alphabet, -1, dtype=np.int32), np.zeros(size + alphabet, dtype=np.int32)
        draw = random.Random(1)
        for state in sorted((i for i, e in enumerate(nxt) if len(e) > 1), key=lambda i: -len(nxt[i])):
            own = nxt[state]
            while True:
                base = draw.randrange(size - alphabet)
                if not any(used[base + s] for s in own):
                    break
            self.base[state] = base
            for s, to in own.items():
                used[base + s] = 1
                self.owner[base + s], self.to[base + s] = state, to
        single = [(i, *next(iter(e.items()))) for i, e in enumerate(nxt) if len(e) == 1]
        if single:
            states, by, to = np.array(single, dtype=np.int32).T
            free = alphabet + np.flatnonzero(np.frombuffer(used, np.uint8)[alphabet:] == 0)[: len(single)]
            self.base[states] = free - by
            self.owner[free], self.to[free] = states, to
        self.first = np.zeros(alphabet, dtype=np.int32)  # from the root; 0 where no phrase begins so
        for s, to in nxt[0].items():
            self.first[s] = to

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each parse is after its next symbol, and whether the symbol begins a phrase there."""
        at = self.base[states] + symbols
        dead = self.owner[at] != states
        return np.where(dead, self.first[symbols], self.to[at]), dead | (states == 0)

    def phrases(self, grid: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases of the text that begins in each block, for blocks in columns of grid, longest first.

        after is the block that follows in the same text, or -1; a block that one follows is as long as grid. Entries of
        blocks that others precede are not defined."""
        n = len(lengths)
        state = np.zeros(n, dtype=np.int32)
        begins = np.zeros(grid.shape, dtype=bool)
        open_at = np.searchsorted(-lengths, -np.arange(1, len(grid) + 1), side="right")  # blocks longer than step
        for at, m in enumerate(open_at.tolist()):
            state[:m], begins[at, :m] = self.step(state[:m], grid[at, :m])
        total = begins.sum(axis=0)
        # carry each block's parse on through the next, until that one's own parse begins a phrase at the same place
        lane = np.flatnonzero(after >= 0)
        met, more, left = np.zeros(n, dtype=bool), np.zeros(n, np.int64), np.zeros(n, np.int32)
        if len(lane):
            met[lane], more[lane], left[lane] = self._carried(grid, lengths, begins, after[lane], state[lane])
        count = total.copy()
        for head in np.setdiff1d(lane, after[lane]).tolist():
            at = head
            while after[at] >= 0:
                total[head] += more[at]
                if met[at]:
                    at = after[at]
                    total[head] += count[at]
                    continue
                found, now = False, left[at]
                at = after[at]
                while not found and after[at] >= 0:  # on through blocks that the parse does not join
                    at = after[at]
                    found, new, now = self._carried_on(grid[: lengths[at], at], begins[: lengths[at], at], int(now))
                    total[head] += new + (count[at] if found else 0)
        return total

    def _carried(self, grid: np.ndarray, lengths: np.ndarray, begins: np.ndarray, block: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For parses that come into blocks in these states: whether each meets the block's own, the phrases that it begins
        before (less those of the block's own up to there, if it does), and its state after the block."""
        met, more, skipped = np.zeros(len(block), dtype=bool), np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        left, lane, size = state.copy(), np.arange(len(block)), lengths[block]
        for at in range(len(grid)):
            lane = lane[size[lane] > at]
            if not len(lane):
                break
            left[lane], new = self.step(left[lane], grid[at, block[lane]])
            own = begins[at, block[lane]]
            met[lane] = new & own
            more[lane] += new & ~own
            skipped[lane] += own & ~new
            lane = lane[~(new & own)]
        return met, more - np.where(met, skipped, 0), left

    def _carried_on(self, symbols: np.ndarray, begins: np.ndarray, state: int) -> tuple[bool, int, int]:
        """The same for one parse."""
        base, owner, to, first = self.base, self.owner, self.to, self.first
        more = skipped = 0
        for symbol, own in zip(symbols.tolist(), begins.tolist(), strict=True):
            at = base[state] + symbol
            new = state == 0 or owner[at] != state
            if new and own:
                return True, more - skipped, 0
            state = first[symbol] if owner[at] != state else to[at]
            more += new
            skipped += own
        return False, more, int(state)


class LanguageModel:
    """An automaton for each language, and what parsing needs."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        parts = {k: [p for t in v if len(p := letters_only(t))] for k, v in samples.items()}
        self.points = np.unique(np.concatenate([np.array([32], np.uint32), *[p for v in parts.values() for p in v]]))
        self.automata, self.bits = [], []
        for k in self.languages:
            text = np.concatenate([np.zeros(0, np.uint32), *[np.append(p, 32) for p in parts[k]]]).astype(np.uint32)
            self.automata.append(SuffixAutomaton((1 + np.searchsorted(self.points, text)).tolist(), len(self.points) + 1))
            self.bits.append(math.log2(max(len(text), 2)))
        self._symbol_of: np.ndarray | None = None

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """The symbol of each code point; 0 for one that no sample has."""
        if self._symbol_of is None:
            self._symbol_of = np.zeros(0x110000, dtype=np.int32)
            self._symbol_of[self.points] = 1 + np.arange(len(self.points))
        return self._symbol_of[points]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (code points of letters_only) in each language."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        start = held = 0
        for stop in range(1, len(texts) + 1):
            held += len(texts[stop - 1])
            if stop == len(texts) or held + len(texts[stop]) > PARSE_CHARS:
                out[start:stop] = self._phrases(texts[start:stop])
                start, held = stop, 0
        return out

    def _phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        owners = np.array([i for i, t in enumerate(texts) for _ in range(0, len(t), BLOCK)], dtype=np.int64)
        if not len(owners) or not self.languages:
            return out
        blocks = [t[a : a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
        lengths = np.array([len(b) for b in blocks])
        order = np.argsort(-lengths, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        after = np.full(len(blocks), -1)  # by column
        follows = np.flatnonzero(owners[1:] == owners[:-1])
        after[place[follows]] = place[follows + 1]
        lengths = lengths[order]
        grid = np.zeros((int(lengths[0]), len(blocks)), dtype=np.int32)
        for column, b in enumerate(order.tolist()):
            grid[: len(blocks[b]), column] = self._symbols(blocks[b])
        heads = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        for k, automaton in enumerate(self.automata):
            out[owners[heads], k] = automaton.phrases(grid, lengths, after)[place[heads]]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points = [letters_only(t) if t else np.zeros(0, np.uint32) for t in texts]
        cost = self.phrases(points) * np.array(self.bits)
        labels, scores = [], []
        for p, row in zip(points, cost, strict=True):
            if not len(p) or not self.languages:
                labels.append(UND)
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            others = np.delete(row, best)
            labels.append(self.languages[best])
            # the share of the runner-up's bits that the winner saves, doubled and capped: 1 is beyond doubt
            scores.append(float(min(1.0, 2 * (1 - row[best] / others.min()))) if len(others) and others.min() > 0 else 1.0)
        return labels, scores


def fit_languages(docs: DataFrame, learn, docs_per_language: int = FIT_DOCS, chars: int = FIT_CHARS) -> LanguageModel:
    """Learns from whole texts among the rows where learn holds: at most docs_per_language of each language, and no more
    characters of it than chars, unless a single text is longer.

    The rows are those of the smallest hashes of the id, so the sample is the same however the table is partitioned."""
    spark = docs.sparkSession
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = smallest_hashes(usable.select("doc_id", "lang"), docs_per_language, "lang")
    if not chosen:
        return LanguageModel({})
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, lang string, place int"))
    texts = usable.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"]).groupBy("lang", "doc_id", "place").agg(F.min("text").alias("text"))
    texts = materialize(texts.where(F.length("text") > 0), "samples")
    sizes = [(r["lang"], r["doc_id"], r["place"], r["n"]) for r in texts.select("lang", "doc_id", "place", F.length("text").alias("n")).collect()]
    kept = [(lang, doc_id) for lang in {s[0] for s in sizes} for doc_id in taken_whole([(p, n, d) for k, d, p, n in sizes if k == lang], chars)]
    samples: dict[str, list[str]] = {}
    if kept:
        rows = texts.join(F.broadcast(spark.createDataFrame(kept, "lang string, doc_id long")), ["lang", "doc_id"]).select("lang", "place", "text").collect()
        for lang, _, text in sorted((r["lang"], r["place"], r["text"]) for r in rows):
            samples.setdefault(lang, []).append(text)
    return LanguageModel(samples)


def with_language(docs: DataFrame, model: LanguageModel, keep: list[str], label: str = "lang_pred", score: str = "score", text_col: str = "text") -> DataFrame:
    """The columns keep of docs with the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: list(shared.value.predict(texts))

    return map_texts(docs, text_col, f"{label} string, {score} double", make, keep)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit_languages(docs, id_hash_mod("doc_id", 4) != 2)
    held = docs.select("doc_id", "text", (id_hash_mod("doc_id", 4) == 2).alias("held_out"))
    return with_language(held, model, ["doc_id", "held_out"])
