"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages, and only the bag has a label. Each passage is encoded as h = tanh(W x + b);
gated attention a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))) weighs the passages, the weighted
sum of the h_k stands for the document, and a logistic unit scores it. All weights are learned together from
document labels by Adam. Passages are described by how classes of characters follow each other and by
repetition, not by words, so that the model holds for languages it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.toxicity import held_out, labelled_sample
from postmill.llm.words import replacing

PASSAGE = 512  # UTF-8 bytes
SAMPLE = 6_000  # labelled documents the model is fitted on, at most
HIDDEN, GATE = 24, 12
STEPS, RATE, DECAY = 300, 0.02, 1e-4

# Classes of bytes, each a class of its own where a string has one character.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!", "?", "|", "%$#&*@~^", "<>{}[]()\\/=_+", "\"'`:;-"]
_OTHER, _HIGH = len(_CLASSES), len(_CLASSES) + 1
KINDS = _HIGH + 1
CLASS_OF = np.full(256, _OTHER, np.int64)
CLASS_OF[128:] = _HIGH
for _i, _chars in enumerate(_CLASSES):
    CLASS_OF[list(_chars.encode())] = _i
WIDTH = KINDS * KINDS + 5


def _repetition(text: str) -> tuple[float, ...]:
    """Shares of distinct words and of distinct lines, lengths: the same for all passages of a document."""
    words, lines = text.split(), text.split("\n")
    n = len(words)
    return (len(set(words)) / max(1, n), len(set(lines)) / max(1, len(lines)), np.log1p(n) / 10, len(text) / max(1, n) / 10, np.log1p(len(lines)) / 5)


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts, one row each, and the number of them per text (at least one)."""
    raw = [(t or "").encode() for t in texts]
    counts = np.array([max(1, -(-len(r) // PASSAGE)) for r in raw], np.int64)
    x = np.zeros((int(counts.sum()), WIDTH), np.float32)
    row = 0
    for t, r, n in zip(texts, raw, counts):
        if r:
            kind = CLASS_OF[np.frombuffer(r, np.uint8)]
            pair = kind[:-1] * KINDS + kind[1:] + (np.arange(len(r) - 1) // PASSAGE) * (KINDS * KINDS)
            seen = np.bincount(pair, minlength=n * KINDS * KINDS)[: n * KINDS * KINDS].reshape(n, -1)
            x[row:row + n, :-5] = np.sqrt(seen / np.maximum(1, seen.sum(1, keepdims=True)))
            x[row:row + n, -5:] = _repetition(t)
        row += n
    return x, counts


class Attention:
    """The network; parameters are float64 arrays in a fixed order."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        s = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = [s(WIDTH, HIDDEN), np.zeros(HIDDEN), s(HIDDEN, GATE), s(HIDDEN, GATE), s(GATE, 1)[:, 0], s(HIDDEN, 1)[:, 0], np.zeros(1)]
        self.centre, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def _forward(self, x: np.ndarray, counts: np.ndarray):
        w, b, v, u, q, c, d = self.p
        start = np.r_[0, np.cumsum(counts)[:-1]]
        h = np.tanh(x @ w + b)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-np.clip(h @ u, -30, 30)))
        e = (t * g) @ q
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), counts))
        a = e / np.repeat(np.add.reduceat(e, start), counts)
        z = np.add.reduceat(a[:, None] * h, start)
        return start, h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ c + d, -30, 30)))

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self._forward((x - self.centre) / self.scale, counts)[-1] if len(counts) else np.zeros(0)

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 512, seed: int = 11) -> Attention:
        """Adam over batches of documents, in an order fixed by the seed."""
        self.centre, self.scale = x.mean(0), x.std(0) + 0.02
        self.p[-1][:] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        r, start = np.random.default_rng(seed), np.r_[0, np.cumsum(counts)[:-1]]
        m, s = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for step in range(1, steps + 1):
            pick = r.permutation(len(y))[:batch]
            rows = np.concatenate([np.arange(start[i], start[i] + counts[i]) for i in pick])
            grads = self._gradients((x[rows] - self.centre) / self.scale, counts[pick], y[pick])
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps))
            for i, g in enumerate(grads):
                g = g + DECAY * self.p[i]
                m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
                self.p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, u, q, c, d = self.p
        start, h, t, g, a, z, p = self._forward(x, counts)
        out = (p - y) / len(y)  # loss by the logit
        dz = np.repeat(out[:, None] * c, counts, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, start), counts))  # through the softmax
        dtg = de[:, None] * q
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ v.T + dg @ u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ out, np.array([out.sum()])]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, part: int = 2, most: int = SAMPLE) -> Attention:
    """Fit on a bounded sample of labelled rows outside the held-out part. Without labels of both kinds every
    text scores alike, by the share of labels."""
    sample = labelled_sample(docs, labels, label, parts, part, most)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, y in zip(b["text"], b["label"]):
                x, _ = passages([t])
                yield pd.DataFrame({"label": [y], "n": [len(x)], "x": [x.astype(np.float16).tobytes()]})

    got = sample.mapInPandas(encode, "label int, n long, x binary").toPandas().sort_values(["n", "label", "x"], ignore_index=True)
    model = Attention()
    y = got["label"].to_numpy(float)
    if got["label"].nunique() < 2:
        model.p[-2][:] = 0
        model.p[-1][:] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return model
    x = np.concatenate([np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in got["x"]]).astype(np.float32)
    return model.fit(x, got["n"].to_numpy(np.int64), y)


def scorer(model: Attention):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out, group, size = [], [], 0
        for t in texts.to_pylist():
            group.append(t)
            size += len(t or "")
            if size > 1 << 21:  # passages of a few MB of text are held at once
                out.append(model.score(*passages(group)))
                group, size = [], 0
        out.append(model.score(*passages(group)))
        # Sums of a text depend on its neighbours in the last digits; equal texts score alike.
        return pa.array(np.round(np.concatenate(out), 12))

    return score


def score_quality(docs: DataFrame, model: Attention, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Input columns plus score (0 to 1) and predicted (1 from ``threshold`` on).

    All passages of the whole text count. A null or empty text is one empty passage. Repeated rows score
    alike; an empty table gives an empty result; input columns named like an added one are replaced.
    """
    rows = replacing(docs.withColumn("_score", scorer(model)(F.col(text))), "score", "predicted")
    return rows.withColumnRenamed("_score", "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labelled rows not held out."""
    scored = score_quality(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
