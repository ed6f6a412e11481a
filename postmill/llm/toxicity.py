"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

The lexicon holds beginnings of words, weighted by how much more often labelled toxic documents have
them than the others. Where several match at one word the longest counts, so exception phrases are
simply longer entries of weight 0. Sums of weights, by length of the text, go through a logistic fit.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import replacing
from postmill.operators.settle import settle

# Letters of other scripts that look like Latin ones, and what digits and signs stand for in words: fixed values.
LOOKALIKES = dict(zip("асеорхуівкмнтаԁԍһјӏѕԝαεικνορτυχωϲ", "aceopxyibkmhtadghjlswaeikvoptuxwc", strict=True))
STANDS_FOR = dict(zip("0134578@$", "oieastbas", strict=True))
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "class clown", "stupid simple", "pathetic fallacy")

SHORTEST, LONGEST = 3, 9  # letters of a lexicon entry
LEAST_DOCS = 5  # labelled toxic documents an entry is in
LEAST_WEIGHT = 1.5  # log odds
MOST_COUNTED = 200_000  # entries a task counts before it passes them on
SAMPLE = 12_000  # labelled documents a model is fitted on, at most
FEATURES = 5
THRESHOLD = 0.7  # least score that is predicted toxic


def _fold_table() -> dict[int, str]:
    table = {i: " " for i in range(0x250) if not chr(i).isalnum() and chr(i) not in "@$"}
    table |= {ord(a): b for a, b in LOOKALIKES.items()}
    return table | {0x2019: " ", 0x2018: " ", 0x201C: " ", 0x201D: " ", 0x2013: " ", 0x2014: " ", 0x2026: " ", 0x200B: "", 0x200C: "", 0x200D: "", 0x00AD: "", 0xFEFF: ""}


FOLDS = _fold_table()
_SUBSTITUTED = re.compile(r"[^\W_]*(?:[^\W\d_][0134578@$]|[0134578@$][^\W\d_])[\w@$]*")
_STANDS_FOR = str.maketrans(STANDS_FOR)


def fold(text: str | None) -> str:
    """Lower case, look-alike letters to Latin, digits and signs inside words to letters, other signs to spaces."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(FOLDS)
    if any(c in text for c in STANDS_FOR):
        text = _SUBSTITUTED.sub(lambda m: m.group().translate(_STANDS_FOR), text)
    return f" {text}"


def beginnings(folded: str) -> set[str]:
    return {w[:n] for w in set(folded.split()) for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


class Model(NamedTuple):
    weights: dict[str, float]
    centre: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray  # the last one is the intercept


def automaton(weights: dict[str, float], exceptions=EXCEPTIONS) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, x in weights.items():
        a.add_word(f" {w}", x)
    for phrase in exceptions:
        a.add_word(f" {phrase}", 0.0)
    a.make_automaton()
    return a


def features(a: ahocorasick.Automaton, text: str | None) -> tuple[float, ...]:
    folded = fold(text)
    found = [x for _, x in a.iter_long(folded) if x]
    n, total = folded.count(" ") + 1, sum(found)
    return (np.log1p(total), total / (n + 10) ** 0.5, 10 * total / (n + 20), max(found, default=0.0), float(np.log1p(len(found))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic fit by Newton steps: centre, scale, coefficients with the intercept last."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    b, penalty = np.zeros(z.shape[1]), ridge * len(x) * np.r_[np.ones(x.shape[1]), 0.0]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (y - p) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, b


def _weights(counts: pd.DataFrame, toxic: str, other: str, n_toxic: int, n_other: int) -> dict[str, float]:
    t, o = counts[toxic].to_numpy(float), counts[other].to_numpy(float)
    odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((o + 0.5) / (n_other + 1))
    keep = (t >= LEAST_DOCS) & (odds >= LEAST_WEIGHT)
    return dict(zip(counts["entry"][keep].tolist(), odds[keep].tolist()))


def _telling(t: Column, o: Column, n_toxic: int, n_other: int) -> Column:
    """The test of _weights for columns, a little wider, as logarithms may be rounded in other ways."""
    odds = F.log((t + 0.5) / (n_toxic + 1)) - F.log((o + 0.5) / (n_other + 1))
    return (t >= LEAST_DOCS) & (odds >= LEAST_WEIGHT - 1e-9)


def held_out(doc_id, parts: int, part: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int, doc_id="doc_id", text="text") -> DataFrame:
    """Texts with a label, outside the held-out part: (text, label), ``most`` rows at most, in hash order of
    their ids. A document labelled twice has the larger label. Only the chosen ids are broadcast."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id), parts, part))
        .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most)
    )
    ids = settle(ids, "label-ids")
    chosen = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    # Copies would make chance words of one text look telling: each text counts once.
    return settle(chosen.groupBy(F.sha1(F.coalesce("text", F.lit("")))).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, part: int = 1, most: int = SAMPLE) -> Model:
    """Lexicon and logistic fit from a bounded sample of labelled rows.

    The fit's features come from documents that the lexicon of its own was not made from. Without labels
    of both kinds there is no lexicon, and every text scores alike.
    """
    sample = labelled_sample(docs, labels, label, parts, part, most)
    sizes = {(r["label"], r["fold"]): r["n"] for r in sample.groupBy("label", (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 2).alias("fold")).agg(F.count("*").alias("n")).collect()}
    n = {y: sizes.get((y, 0), 0) + sizes.get((y, 1), 0) for y in (0, 1)}
    nothing = Model({}, np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES), np.log((n[1] + 0.5) / (n[0] + 0.5))])
    if not n[0] or not n[1]:
        return nothing

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, int, int]] = Counter()
        passed = lambda: pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["entry", "label", "fold", "n"])
        for b in batches:
            for t, y in zip(b["text"], b["label"]):
                half = zlib.crc32((t or "").encode()) % 2
                seen.update((e, y, half) for e in beginnings(fold(t)))
                if len(seen) > MOST_COUNTED:
                    yield passed()
                    seen.clear()
        yield passed()

    side = lambda y, half: F.sum(F.when((F.col("label") == y) & (F.col("fold") == half), F.col("n")).otherwise(0)).alias(f"n{y}{half}")
    counts = sample.mapInPandas(count, "entry string, label int, fold int, n long").groupBy("entry").agg(*(side(y, half) for y in (0, 1) for half in (0, 1)))
    # Only entries that some lexicon takes come to the driver.
    first_one = _telling(F.col("n10"), F.col("n00"), sizes.get((1, 0), 0), sizes.get((0, 0), 0))
    full_one = _telling(F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01"), n[1], n[0])
    counts = counts.filter(first_one | full_one).toPandas().sort_values("entry", ignore_index=True)
    counts["n0"], counts["n1"] = counts["n00"] + counts["n01"], counts["n10"] + counts["n11"]
    first = _weights(counts, "n10", "n00", sizes.get((1, 0), 0), sizes.get((0, 0), 0))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(first)
        for b in batches:
            rows = [(*features(a, t), y) for t, y in zip(b["text"], b["label"]) if zlib.crc32((t or "").encode()) % 2]
            yield pd.DataFrame(rows, columns=[*(f"f{i}" for i in range(FEATURES)), "label"])

    got = sample.mapInPandas(measure, ", ".join(f"f{i} double" for i in range(FEATURES)) + ", label int").toPandas()
    if got["label"].nunique() < 2:
        return nothing
    got = got.sort_values(got.columns.tolist())
    return Model(_weights(counts, "n1", "n0", n[1], n[0]), *_logistic(got.iloc[:, :FEATURES].to_numpy(float), got["label"].to_numpy(float)))


def scorer(model: Model):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton(model.weights)
        for texts in batches:
            x = np.array([features(a, t.as_py()) for t in texts], float).reshape(-1, FEATURES)
            z = ((x - model.centre) / model.scale) @ model.coefficients[:-1] + model.coefficients[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Input columns plus score (0 to 1) and predicted (1 from ``threshold`` on).

    The whole text counts. Null and empty texts score like a text without any entry of the lexicon. Repeated
    rows score alike; an empty table gives an empty result; input columns named like an added one are replaced.
    """
    rows = replacing(docs.withColumn("_score", scorer(model)(F.col(text))), "score", "predicted")
    return rows.withColumnRenamed("_score", "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labelled rows not held out."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
