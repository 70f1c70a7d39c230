"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of about 60 words. A passage is encoded from its own content:
its character trigrams are hashed to ``BUCKETS`` and embedded by a matrix that is learnt with the
rest, and so are its words' lengths and repeats. Gated attention, learnt from the labels of whole
documents alone, weighs the passages; the weighted representation is scored by a logistic unit.

    h_i = tanh(W x_i + b)
    a_i = softmax_i(w . (tanh(V h_i) * sigmoid(U h_i)))
    score = sigmoid(c . sum_i a_i h_i + d)

The fit is on at most about ``max_documents`` labelled rows, chosen by hash; fewer of them where
they have more than ``max_passages`` passages, so that every passage of each takes part. Both are
parameters, and what comes to the driver is a kilobyte per passage. Scoring covers every
passage of every text, a narrow pass that holds one text's passages at a time.

Defined results
- null, empty or wordless texts: one passage of zeros, and the score that it gets;
- labels for unknown documents and null labels are ignored, repeated ones count again;
- no labelled row of either class: every score is 1, as nothing speaks against a text;
- empty table: empty result; other columns pass through unread, but for one of the name that the
  caller gives the score, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import word_count
from .neardup import word_hashes
from .toxicity import fold_of

PASSAGE = 60
BUCKETS = 256
FEATURES = BUCKETS + 4


def passages(text: str | None) -> np.ndarray:
    """A row per passage: square roots of its shares of hashed trigrams, its shares of different and of repeated words, their mean length, their number."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    start, end, word = word_hashes(raw)
    m = len(word)
    if not m:
        return np.zeros((1, FEATURES), dtype=np.float32)
    n = max(1, round(m / PASSAGE))
    first = m * np.arange(n + 1) // n  # of a passage's words
    size = np.diff(first)
    of_word = np.repeat(np.arange(n), size)
    begin = np.append(start[first[:-1]], end[-1])
    of_byte = np.repeat(np.arange(n), np.diff(begin))
    r = raw[begin[0] : begin[-1]].astype(np.uint32)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if len(r) > 2:
        code = ((r[:-2] << 16 | r[1:-1] << 8 | r[2:]) * np.uint32(0x9E3779B1)) >> 24
        within = of_byte[:-2] == of_byte[2:]
        counts = np.bincount((of_byte[:-2] * BUCKETS + code)[within], minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, :BUCKETS] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1))[:, None])
    key = np.sort(word >> np.uint64(24) | of_word.astype(np.uint64) << np.uint64(40))
    new = np.append(True, key[1:] != key[:-1])
    out[:, BUCKETS] = np.bincount((key >> np.uint64(40)).astype(np.int64)[new], minlength=n) / size
    again = (word[1:] == word[:-1]) & (of_word[1:] == of_word[:-1])
    out[:, BUCKETS + 1] = np.bincount(of_word[1:][again], minlength=n) / size
    out[:, BUCKETS + 2] = np.add.reduceat(end - start, first[:-1]) / size / 10
    out[:, BUCKETS + 3] = np.minimum(1, size / PASSAGE)
    return out


class AttentionBag:
    """The network; parameters in ``p``."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[-1]), shape)

        self.p = {"W": start(hidden, FEATURES), "b": np.zeros(hidden), "V": start(gate, hidden), "U": start(gate, hidden), "w": start(gate), "c": start(hidden), "d": np.zeros(1)}
        self.centre, self.spread = np.zeros(FEATURES, dtype=np.float32), np.ones(FEATURES, dtype=np.float32)
        self.trained = False

    def _forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"].T.astype(x.dtype) + p["b"])
        t = np.tanh(h @ p["V"].T)
        g = 1 / (1 + np.exp(-np.clip(h @ p["U"].T, -40, 40)))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def gradients(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the bags' weighted cross-entropy, by parameter."""
        p, f = self.p, self._forward(x, starts, bag)
        dy = (f["y"] - labels) * weight
        dz = dy[:, None] * p["c"]
        da = (dz[bag] * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])
        dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[bag] + dt @ p["V"] + dg @ p["U"]) * (1 - f["h"] ** 2)
        return {"c": f["z"].T @ dy, "d": np.array([dy.sum()]), "w": (f["t"] * f["g"]).T @ de, "V": dt.T @ f["h"], "U": dg.T @ f["h"], "W": dh.astype(x.dtype).T @ x, "b": dh.sum(axis=0)}

    def bags(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 per bag."""
        if not bags:
            return np.empty(0)
        if not self.trained:
            return np.ones(len(bags))
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        x = (np.concatenate(bags) - self.centre) * (1 / self.spread)
        return self._forward(np.clip(x, -8, 8), starts, np.repeat(np.arange(len(bags)), sizes))["y"]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = 200, rate: float = 0.02, decay: float = 1e-3) -> None:
        """Full-batch Adam on the cross-entropy of the bags, both classes weighing the same."""
        if not bags or labels.min() == labels.max():
            return
        sizes = np.array([len(b) for b in bags])
        starts, bag = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(bags)), sizes)
        x = np.concatenate(bags)
        self.centre = x.mean(axis=0, dtype=np.float64).astype(np.float32)
        self.spread = x.std(axis=0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
        x -= self.centre
        x /= self.spread
        np.clip(x, -8, 8, out=x)
        weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
        p, first, second = self.p, {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for step in range(1, steps + 1):
            grad = self.gradients(x, starts, bag, labels, weight)
            for k, g in grad.items():
                g = g + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.trained = True


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_documents: int = 4_000, max_passages: int = 60_000, seed: int = 5) -> AttentionBag:
    """Fit on labelled rows (doc_id, quality) outside fold ``held_out``, as many of each class where there are enough.

    ``max_documents`` and ``max_passages`` bound the rows and their passages in expectation: the hash of
    a doc_id decides, so that the rows of one doc_id stand or fall together.
    """
    marked = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and _id is not null")
    marked = marked.where(fold_of(F.col("_id"), folds) != held_out)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1_000_000))

    def chosen(shares: dict[int, float]) -> DataFrame:
        share = F.lit(0.0)
        for label, s in shares.items():
            share = F.when(F.col("label") == label, s).otherwise(share)
        # few enough to broadcast, and no text is shuffled
        picked = marked.where(place < share * 1_000_000)
        return texts.join(F.broadcast(picked), texts["doc_id"] == picked["_id"]).select("doc_id", "text", "label")

    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    shares = {label: min(1.0, max_documents / len(counts) / n) for label, n in counts.items()}
    held = chosen(shares).agg(F.count("*").alias("rows"), F.sum(F.greatest(F.lit(1), F.round(word_count(F.col("text")) / PASSAGE))).alias("passages")).first()
    # repeated ids can bring more rows than labels were picked
    over = max(1.0, (held["rows"] or 0) / max_documents, (held["passages"] or 0) / max_passages)

    @F.pandas_udf("binary")
    def measure(text: pd.Series) -> pd.Series:
        return pd.Series([passages(t).tobytes() for t in text], dtype=object)

    rows = chosen({label: s / over for label, s in shares.items()})
    sample = sorted(rows.select("doc_id", "label", measure("text").alias("x")).collect())
    model = AttentionBag(seed=seed)
    model.fit([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in sample], np.array([r["label"] for r in sample], dtype=float))
    return model


def score(docs: DataFrame, model: AttentionBag, name: str = "score") -> DataFrame:
    """``docs`` with the probability ``name`` of good quality; a narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        texts, out = list(text), []
        for lo in range(0, len(texts), 64):
            out.append(held.value.bags([passages(t) for t in texts[lo : lo + 64]]))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(name, quality(F.col("text").cast("string")))
