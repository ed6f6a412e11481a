import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from postmill.llm import importance
from tests.llm import helpers as h

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, percent=10, buckets=10_000, longest=1, min_words=20):
    """docs: (id, text) -> multiset of (id, words, features, weight, score, rank)."""
    def runs(text):
        w = FEATURE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(at(f) for _, _, fs in found for f in fs), Counter(at(f) for x in target for f in runs(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, n, fs in found:
        weight = sum(gain(at(f)) for f in fs)
        x = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * percent // 100]
    rest = Counter(rows) - Counter(drawn)
    return Counter((*r, k) for k, r in enumerate(drawn, 1)) + Counter({(*r, None): n for r, n in rest.items()})


def result(docs, target, **more):
    return Counter(tuple(r) for r in importance.resample(docs, target, **more).collect())


def tables(spark, n, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice(["Target", "word", "é9", "x"]) + str(rng.randrange(30)) for _ in range(rng.randrange(60)))) for i in range(n)]
    docs += [(n + i, docs[1][1]) for i in range(n // 3)]  # a third are copies
    target = ["target1 target2, é93"] * 40
    return docs, target, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")


@pytest.mark.parametrize("bound", [100_000, 7])
def test_equals_the_plain_rule(spark, monkeypatch, bound):
    monkeypatch.setattr(importance, "BRACKET_ROWS", bound)  # a low bound takes the sketches, brackets and cells
    docs, target, d, t = tables(spark, 500, 1)
    assert result(d, t) == plain(docs, target)
    assert result(d, t, percent=37, longest=2, buckets=97, min_words=5) == plain(docs, target, 37, 97, 2, 5)


def test_ties_on_one_score_are_cut_by_id(spark, monkeypatch):
    monkeypatch.setattr(importance, "BRACKET_ROWS", 5)
    rows = [(i, 30, 30, 0, 7 if i % 4 else 9, i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long, row_ long").repartition(4)
    assert tuple(importance.cutoff(df, 400, 250)) == (7, 199, 199)
    assert tuple(importance.cutoff(df, 400, 1))[:2] == (9, 0) and tuple(importance.cutoff(df, 400, 400))[:2] == (7, 399)


def test_hostile_and_empty_tables(spark):
    df = h.hostile(spark, [" ".join(["a", "B9"] * 20)] * 12)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    t = spark.createDataFrame([("a b9",), (None,)], "text string")
    for percent in (10, 50, 100):
        got, want = result(df, t, percent=percent), plain(docs, ["a b9", None], percent)
        assert sorted(map(str, got.elements())) == sorted(map(str, want.elements()))
    assert result(h.empty(spark), t) == Counter()
    assert result(df, t.limit(0)) == plain(docs, [])
    assert result(df.limit(0).union(df.filter("doc_id = 1")), t, percent=0) == plain([(1, None)], ["a b9"], 0)


def test_gains_follow_the_formula():
    s, t = np.array([5, 0, 1]), np.array([0, 4, 1])
    assert list(importance.bucket_gains(s, t)) == [math.floor(1000 * math.log((b + 1) * 9 / ((a + 1) * 8))) for a, b in zip(s, t)]
