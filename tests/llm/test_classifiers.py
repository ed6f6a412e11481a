import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import quality, toxicity
from tests.llm.helpers import SCHEMA, empty, hostile, rows_of, words

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=900):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        w = words(r.randrange(5, 200), i)
        bad, junk = i % 5 == 0, i % 4 == 0
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "M0r0n!", "grolbix" + r.choice("abcdef"), "мoron"]))
        if junk:
            w = [x + r.choice(["%%%", "$$$", "&&&"]) for x in w]
        rows.append(" ".join(w))
        labels.append((i + 1, int(not junk), int(bad), "x"))
    return rows, labels


def held(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(spark, kind):
    texts, labels = corpus()
    docs, labelled = spark.createDataFrame(rows_of(texts), SCHEMA), spark.createDataFrame(labels, LABELS)
    run, at, parts, part = (toxicity.toxicity, 2, 3, 1) if kind == "toxic" else (quality.quality, 1, 4, 2)
    got = {r["doc_id"]: r for r in run(docs, labelled).collect()}
    assert len(got) == len(texts)
    right = n = 0
    for row in labels:
        r = got[row[0]]
        assert r["held_out"] == held(row[0], parts, part) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["held_out"]:
            n, right = n + 1, right + (r["predicted"] == row[at])
    assert right >= 0.97 * n > 50


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_held_out_labels_change_nothing(spark, run):
    parts, part = (3, 1) if run is toxicity.toxicity else (4, 2)
    texts, labels = corpus(300)
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    flipped = [(i, 1 - q, 1 - t, x) if held(i, parts, part) else (i, q, t, x) for i, q, t, x in labels]
    a, b = ({(r["doc_id"], r["score"]) for r in run(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_hostile_rows(spark, run):
    texts, labels = corpus(200)
    docs = hostile(spark).unionByName(spark.createDataFrame(rows_of(texts), SCHEMA).withColumn("doc_id", F.col("doc_id") + 100))
    labels = [(i + 100, q, t, x) for i, q, t, x in labels] + [(None, 1, 1, None), (1, None, None, None), (2, 1, 1, "x"), (2, 0, 0, "x")]
    got = run(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (5, 6)}) == 1
    none = spark.createDataFrame([], LABELS)
    assert len({round(r["score"], 12) for r in run(docs, none).collect()}) == 1
    assert run(empty(spark), none).count() == 0


def test_folding_and_exceptions():
    assert toxicity.fold("ІDI0T, m0r0n 2024 @b").split() == ["idiot", "moron", "2024", "ab"]
    a = toxicity.automaton({"trash": 2.0, "tra": 1.0})
    assert [x for _, x in a.iter_long(toxicity.fold("Trashy trash can, trap tr4sh extra"))] == [2.0, 0.0, 1.0, 2.0]
    assert toxicity.features(a, None)[0] == 0


def test_gradients_of_the_attention_network():
    r = np.random.default_rng(0)
    net = quality.Attention()
    x, counts, y = r.normal(size=(9, quality.WIDTH)), np.array([2, 1, 6]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := net.score(x, counts)) + (1 - y) * np.log(1 - p))
    for p, g in zip(net.p, net._gradients(x, counts, y)):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-4)


def test_rare_telling_words_of_a_large_vocabulary(spark):
    r = random.Random(8)
    ids = [i for i in range(400) if not held(i, 3, 1)][:160]
    neutral = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(12_000)]
    rows = []
    for label in (0, 1):
        bags = [[] for _ in range(80)]
        for w in neutral:
            for b in r.sample(range(80), 8):
                bags[b].append(w)
        rows += [(ids[80 * label + b], " ".join(bag + ["qqvexing"] * (label and b < 6)), label) for b, bag in enumerate(bags)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert "qqvexing" in toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")).weights
