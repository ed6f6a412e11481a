from collections import defaultdict

import pytest

from postmill.llm import mixing
from tests.llm.helpers import WORD, empty, hostile, rows_of, SCHEMA, words


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Fill by weight; what is above a source's bound is shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = most * sizes[s]
            free.remove(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def check(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    goal = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
    return {s: (taken[s], goal[s]) for s in sizes}


def test_mix_meets_each_target_to_the_word(spark):
    source = lambda i: "big" if i % 3 else ("tiny" if i % 2 else None)
    docs = spark.createDataFrame(rows_of([" ".join(words(i % 90, i)) for i in range(400)], source), SCHEMA)
    for taken, goal in check(docs).values():
        assert taken == int(goal)
    a, b = ({(r["doc_id"], r["taken"]) for r in mixing.mix(d).collect()} for d in (docs, docs.repartition(7)))
    assert a == b


def test_hostile_rows(spark):
    for taken, goal in check(hostile(spark)).values():
        assert abs(taken - goal) <= 4  # rows that repeat an id share what is left in whole words
    assert mixing.mix(empty(spark)).count() == 0


def test_read_mix_repeats_rows(spark):
    docs = hostile(spark)
    mixed = mixing.read_mix(docs)
    assert mixed.schema == docs.schema
    assert mixed.count() == sum(r["epochs"] for r in mixing.mix(docs).collect())
    assert mixing.read_mix(empty(spark)).count() == 0
