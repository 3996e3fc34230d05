"""Quality rules: exact statistics of each whole text, two fixed rules, and an isolation forest on the statistics.

The forest's trees cut random statistics at random values of a bounded sample; documents with short paths are
anomalous. The threshold on the anomaly score is calibrated on labelled rows that pass the fixed rules: the one with the
best balanced accuracy among those that keep at least MIN_KEPT of the good ones.

Cases: a null or empty text has no words, so it fails the rules; fewer than three words have no repeated window; with
no labelled rows of both kinds nothing but the rules rejects; repeated rows get equal results; of sampled rows that
repeat an id the least label and the least text count; other columns pass through or are ignored, and result columns
replace kept ones of the same name."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import load, map_texts, smallest_hashes

SYMBOL_BYTES = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rows of the bounded sample, trees, rows a tree, and the least share of good labelled rows that stays.
FIT_ROWS, TREES, TREE_ROWS, MIN_KEPT, SEED = 6000, 128, 256, 0.995, 17
#: Steps between the scores 0 and 1 that a threshold is chosen from.
STEPS = 10_000

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Further statistics, for the forest alone.
FEATURES = (
    "upper", "digit", "punct", "symbol", "pipe", "bang", "dup_lines", "repeat_words", "mean_word", "space_runs",
    "compressed", "pure_words", "vocabulary", "line_spread", "word_spread", "closed_words", "single_letters",
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    v = len(number)
    pairs = ids[:-2] * v + ids[1:-1]
    if v > 2_000_000:  # keep the combined key within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    for shift in range(3):
        cover[shift : n - 2 + shift] |= twice
    return int(cover.sum())


_CLASSES = np.zeros((256, 6), dtype=np.int64)
for _column, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", SYMBOL_BYTES, b"|", b"!")):
    _CLASSES[list(_members), _column] = 1
#: Whether each code point is a capital.
CAPITALS = np.array([chr(n).isupper() for n in range(0x110000)])


_IS_SPACE, _IMPURE, _CLOSING = np.zeros(256, dtype=bool), np.zeros(256, dtype=np.int64), np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True
_IMPURE[33:127] = [not chr(c).isalpha() and chr(c) != "'" for c in range(33, 127)]
_CLOSING[list(b".!?,;:")] = True


def shape(raw: bytes, words: list[bytes], lines: list[bytes]) -> list[float]:
    """How far a text compresses, and how its words and lines are built: words of letters alone (closing punctuation
    counts as none), distinct words (a power of their number), spread of the lengths of lines and words (over their mean),
    words that close with punctuation, and words of one byte."""
    if not words:
        return [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    held = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], _IS_SPACE[held], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    size, closed = ends - starts, _CLOSING[held[ends - 1]]
    impure = np.add.reduceat(_IMPURE[held], starts) - closed
    n = len(starts)
    line = np.array([len(x) for x in lines])
    spread = lambda x: float(x.std() / x.mean())
    vocabulary = math.log(1 + len(set(words))) / math.log(1 + n)
    return [len(zlib.compress(raw, 1)) / len(raw), float((impure <= 0).sum()) / n, vocabulary, spread(line), spread(size), float(closed.sum()) / n, float((size == 1).sum()) / n]


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The base statistics of a text, and the forest's."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text or "")
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(histogram[list(SPACE)].sum())
    word_chars = chars - spaces
    n_symbols = int(histogram[list(SYMBOL_BYTES)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    base = (len(words), word_chars, n_symbols, n_dup, n_repeat)
    n, c = max(1, len(words)), max(1, word_chars)
    upper, digit, punct, symbol, pipe, bang = (histogram @ _CLASSES).tolist()
    if not raw.isascii():  # capitals of every script
        upper = int(CAPITALS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].sum())
    return base, [upper / c, digit / c, punct / n, symbol / n, pipe / n, bang / n, n_dup / max(1, len(lines)), n_repeat / n, min(40.0, word_chars / n), max(0, spaces - len(words)) / n, *shape(raw, words, lines)]


def fails(base: np.ndarray) -> np.ndarray:
    """Whether rows of base statistics fail a fixed rule."""
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])


class IsolationForest:
    """Random binary trees in arrays; score() is 2 to the minus mean path length over its expectation."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.rows = min(tree_rows, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(2, self.rows)))))
        feature, cut, left, size, level = [], [], [], [], []

        def grow(sample: np.ndarray, at: int, down: int) -> None:
            spread = sample.max(axis=0) - sample.min(axis=0) if len(sample) else np.zeros(rows.shape[1])
            free = np.flatnonzero(spread > 0)
            size[at], level[at] = len(sample), down
            if down >= depth or len(sample) <= 1 or not len(free):
                return
            f = int(rng.choice(free))
            value = float(rng.uniform(sample[:, f].min(), sample[:, f].max()))
            child = len(feature)
            for column in (feature, cut, left, size, level):
                column.extend([-1, -1] if column in (feature, left) else [0, 0])
            feature[at], cut[at], left[at] = f, value, child
            below = sample[:, f] < value
            grow(sample[below], child, down + 1)
            grow(sample[~below], child + 1, down + 1)

        self.roots = []
        for _ in range(trees if len(rows) else 0):
            at = len(feature)
            self.roots.append(at)
            for column, empty in ((feature, -1), (cut, 0.0), (left, -1), (size, 0), (level, 0)):
                column.append(empty)
            grow(rows[rng.choice(len(rows), self.rows, replace=False)], at, 0)
        self.feature, self.cut, self.left = np.array(feature, np.int32), np.array(cut), np.array(left, np.int32)
        self.path = np.array(level, float) + np.array([_expected(s) for s in size])
        self.depth = depth

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.roots or not len(rows):
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root, dtype=np.int32)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(f, 0)] >= self.cut[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / max(_expected(self.rows), 1e-9))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class RuleModel:
    """The forest and the calibrated threshold; good and bad are labelled rows that pass the fixed rules, as the forest
    decides on no others."""

    def __init__(self, features: np.ndarray, good: np.ndarray, bad: np.ndarray):
        self.forest = IsolationForest(features)
        self.threshold = float("inf")
        if len(good) and len(bad):
            g, b = np.sort(self.forest.score(good)), self.forest.score(bad)
            best = 0.0
            for t in np.unique(np.concatenate([g, b])):
                kept = np.searchsorted(g, t, side="right") / len(g)
                caught = (b > t).mean()
                if kept >= MIN_KEPT and kept + caught - 1 > best:
                    best, self.threshold = kept + caught - 1, float(t)

    def judge(self, texts: list[str | None]) -> list[list]:
        """The base statistics, base_failed, kept and the anomaly score."""
        pairs = [statistics(t) for t in texts]
        base = np.array([b for b, _ in pairs], dtype=np.int64).reshape(-1, 5)
        score = self.forest.score(np.array([f for _, f in pairs]).reshape(-1, len(FEATURES)))
        failed = fails(base)
        return [*base.T, failed, ~failed & ~(score > self.threshold), score]


def _sampled(docs: DataFrame, labels: DataFrame | None, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of at most rows documents (smallest hashes of the id), their labels, and whether they fail a fixed rule;
    only numbers come to the driver."""
    spark = docs.sparkSession
    source = (docs if labels is None else labels.where(F.col("quality").isNotNull())).where(F.col("doc_id").isNotNull())
    chosen = smallest_hashes(source.select("doc_id"), rows)
    if not chosen:
        return np.zeros((0, len(FEATURES))), np.zeros(0, dtype=int), np.zeros(0, dtype=bool)
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, place int"))
    quality = {} if labels is None else {r["place"]: r["quality"] for r in source.join(picked, "doc_id").groupBy("place").agg(F.min("quality").alias("quality")).collect()}
    texts = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("place").agg(F.min("text").alias("text"))
    found = map_texts(texts, "text", "base array<long>, features array<double>", lambda: lambda texts: [list(x) for x in zip(*map(statistics, texts))] or [[], []], ["place"])
    got = sorted((r["place"], r["base"], r["features"]) for r in found.collect())
    base = np.array([b for _, b, _ in got], dtype=np.int64).reshape(-1, 5)
    return np.array([f for *_, f in got]).reshape(-1, len(FEATURES)), np.array([quality.get(p, 1) for p, *_ in got], dtype=int), fails(base)


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> RuleModel:
    """The forest from at most rows documents, as each of its trees takes TREE_ROWS of them; the threshold from all labelled
    ones that pass the fixed rules, whose scores are counted in STEPS steps before they come to the driver."""
    features, *_ = _sampled(docs, None, rows)
    model = RuleModel(features, np.zeros((0, len(FEATURES))), np.zeros((0, len(FEATURES))))
    quality = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    judged = with_rules(docs, model, ["doc_id"]).select("doc_id", "base_failed", F.ceil(F.col("anomaly") * STEPS).alias("step"))
    counts = judged.where(~F.col("base_failed")).join(quality, "doc_id").groupBy("step").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))
    found = np.array(sorted((r["step"], r["good"], r["bad"]) for r in counts.collect()), dtype=np.int64).reshape(-1, 3)
    model.threshold = best_threshold(found[:, 0] / STEPS, found[:, 1], found[:, 2])
    return model


def best_threshold(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The score of best balanced accuracy among those that keep at least MIN_KEPT of the good rows, from the numbers of good
    and bad rows up to each score (ascending); infinity without one or without rows of a kind."""
    if not good.sum() or not bad.sum():
        return float("inf")
    kept, caught = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    worth = np.where(kept >= MIN_KEPT, kept + caught - 1, 0.0)
    at = int(np.argmax(worth))
    return float(scores[at]) if worth[at] > 0 else float("inf")


def with_rules(docs: DataFrame, model: RuleModel, keep: list[str], prefix: str = "", text_col: str = "text") -> DataFrame:
    """The columns keep of docs with the statistics, base_failed, kept and anomaly; prefix guards against clashing names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = STATS + ", base_failed boolean, kept boolean, anomaly double"
    fields = ", ".join(prefix + f for f in fields.split(", "))

    def make():
        return lambda texts: shared.value.judge(texts)

    return map_texts(docs, text_col, fields, make, keep)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit_rules(docs, load(spark, sf_dir, "labels"))
    return with_rules(docs, model, ["doc_id"])
