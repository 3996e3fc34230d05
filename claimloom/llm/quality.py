"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of PASSAGE words. An encoder maps each passage's byte profile to a vector; a gated
attention (tanh times sigmoid) weighs the vectors; the weighted sum gives the document's score. Only documents carry
labels; encoder, attention and scorer learn from them together, by Adam on the log loss, with NumPy.

Cases: a null or empty text is one empty passage and is scored like any other; very long texts have as many passages as
they need; with labels of one kind only (or none) every score is that kind's (or 1); repeated rows get equal results; of
labelled rows that repeat an id the least label and the least text are learned from; result columns replace kept ones of
the same name, other columns are ignored, and labels, lang, source and doc_id are no inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import id_hash_mod, load, map_texts, materialize, smallest_hashes, taken_whole

PASSAGE = 64
#: Bounds of the labelled sample that is fitted, with all passages of each row: rows, and passages of all together.
FIT_DOCS, FIT_PASSAGES = 3000, 40_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, SEED = 24, 12, 24, 128, 4e-3, 5
FEATURES = 256 + 4
THRESHOLD = 0.3


def passages(text: str | None) -> np.ndarray:
    """A row per passage: square roots of its byte shares, then word length, distinct words, words of repeated lines, size."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    seen: set[bytes] = set()
    words: list[bytes] = []
    again: list[int] = []
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            words += own
            again += [int(line in seen)] * len(own)
            seen.add(line)
    starts = range(0, max(1, len(words)), PASSAGE)
    out = np.zeros((len(starts), FEATURES), dtype=np.float32)
    for row, at in enumerate(starts):
        part = words[at : at + PASSAGE]
        if not part:
            continue
        body = np.frombuffer(b"".join(part), np.uint8)
        out[row, :256] = np.bincount(body, minlength=256)[:256] / len(body)
        out[row, 256:] = min(2.0, len(body) / len(part) / 10), len(set(part)) / len(part), sum(again[at : at + PASSAGE]) / len(part), len(part) / PASSAGE
    out[:, :256] = np.sqrt(out[:, :256])
    return out


class AttentionModel:
    """Weights by name; score() for stacked passages of many documents."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"encode": init(FEATURES, HIDDEN), "encode_b": np.zeros(HIDDEN, np.float32), "attend": init(HIDDEN, ATTENTION), "gate": init(HIDDEN, ATTENTION), "weigh": init(ATTENTION, 1)[:, 0], "score": init(HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        w = self.w
        h = np.tanh(x @ w["encode"] + w["encode_b"])
        t, g = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        raw = (t * g) @ w["weigh"]
        sizes = np.diff(np.append(first, len(x)))
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["bias"][0], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "sizes": sizes}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean log loss."""
        w, f = self.w, self._forward(x, first)
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d[:, None] * w["score"], f["sizes"], axis=0)
        inner = (f["h"] * dz).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["a"] * inner, first), f["sizes"])
        draw = f["a"] * (inner - mean)
        dt = draw[:, None] * w["weigh"] * f["g"] * (1 - f["t"] ** 2)
        dg = draw[:, None] * w["weigh"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ w["attend"].T + dg @ w["gate"].T
        du = dh * (1 - f["h"] ** 2)
        return {"encode": x.T @ du, "encode_b": du.sum(axis=0), "attend": f["h"].T @ dt, "gate": f["h"].T @ dg, "weigh": (f["t"] * f["g"]).T @ draw, "score": f["z"].T @ d, "bias": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> AttentionModel:
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 1.0
            return self
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                sizes = np.array([len(bags[i]) for i in part])
                grads = self.gradients(np.concatenate([bags[i] for i in part]), sizes.cumsum() - sizes, y[part])
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + 1e-4 * self.w[k])).astype(np.float32)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 200):
            bags = [passages(t) for t in texts[at : at + 200]]
            sizes = np.array([len(b) for b in bags])
            out[at : at + len(bags)] = self._forward(np.concatenate(bags), sizes.cumsum() - sizes)["p"]
        return out


def fit_quality(docs: DataFrame, labels: DataFrame, learn, rows: int = FIT_DOCS, most: int = FIT_PASSAGES) -> AttentionModel:
    """Fits on labelled documents where learn (a condition on doc_id) holds, with all passages of each: at most rows of
    them, those of the smallest id hashes, and no more passages together than most, unless a single text has more.

    Passage profiles are made on the executors; those of the rows that are fitted come to the driver."""
    spark = docs.sparkSession
    usable = labels.where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = smallest_hashes(usable.select("doc_id"), rows)
    if not chosen:
        return AttentionModel().fit([], np.zeros(0))
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, place int"))
    joined = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "place").agg(F.min("text").alias("text"))
    made = map_texts(joined, "text", "bag binary", lambda: lambda texts: [[passages(t).astype(np.float16).tobytes() for t in texts]], ["doc_id", "place"])
    labelled = usable.join(picked, "doc_id").select("doc_id", "quality")
    bags = materialize(made.join(F.broadcast(labelled), "doc_id"), "bags")
    width = 2 * FEATURES
    sizes = [(r["place"], r["n"], r["doc_id"]) for r in bags.select("place", "doc_id", (F.length("bag") / width).cast("int").alias("n")).collect()]
    kept = [(d,) for d in taken_whole(sizes, most)]
    if not kept:
        return AttentionModel().fit([], np.zeros(0))
    found = sorted((r["place"], r["quality"], bytes(r["bag"])) for r in bags.join(F.broadcast(spark.createDataFrame(kept, "doc_id long")), "doc_id").select("place", "quality", "bag").collect())
    return AttentionModel().fit([np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for _, _, b in found], np.array([q for _, q, _ in found], dtype=np.float32))


def with_quality(docs: DataFrame, model: AttentionModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of every row with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            score = shared.value.score(texts).astype(float)
            return [score, (score >= THRESHOLD).astype(np.int32)]

        return work

    return map_texts(docs, text_col, "score double, predicted int", make, keep)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit_quality(docs, load(spark, sf_dir, "labels"), id_hash_mod("doc_id", 5) != 0)
    held = docs.select("doc_id", "text", (id_hash_mod("doc_id", 5) == 0).alias("held_out"))
    return with_quality(held, model, ["doc_id", "held_out"])
