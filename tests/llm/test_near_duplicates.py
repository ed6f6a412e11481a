import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import embeddings, minhash
from postmill.llm.components import connected_components
from tests.llm.helpers import SCHEMA, component_map, empty, hostile, rows_of, shingle_set, words


def families(seed=0):
    """Texts of 3 to 300 words with exact and near copies, chains, and a base that is not the smallest id."""
    r = random.Random(seed)
    texts = []
    for f in range(40):
        base = words(r.choice([3, 6, 30, 120, 300]), 1000 * seed + f)
        for _ in range(r.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 8]) * len(base) // 120):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            texts.append((" ".join(copy), " \n".join(copy).upper())[r.random() < 0.2])
            if r.random() < 0.3:
                base = copy
    r.shuffle(texts)
    return texts


def plain(texts, percent):
    sets = [shingle_set(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, component_map(range(len(texts)), edges)


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_finds_what_all_pairs_find(spark, percent):
    texts = families(percent)
    sets, want = plain(texts, percent)
    got = {r["doc_id"] - 1: r for r in minhash.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA), percent).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"] - 1, got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_minhash_hostile_rows(spark):
    docs = hostile(spark)
    got = {}
    for r in minhash.near_duplicates(docs, 85).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == docs.count()
    assert all(r["component_id"] == i for i in (1, 2, 3) for r in got[i])
    assert [r["component_id"] for i in (5, 6) for r in got[i]] == [5, 5, 5] and not got[6][0]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in got[None])
    assert minhash.near_duplicates(empty(spark), 85).count() == 0


def test_star_rounds_reach_what_the_first_centre_misses(spark):
    """The smallest id is near its neighbour only; the others hang together by a chain."""
    base = words(200, 5)
    texts = []
    for i in range(8):
        texts.append(" ".join(base))
        base = base[:i * 20] + [f"n{i}a", f"n{i}b"] + base[i * 20 + 2:]
    _, want = plain(texts, 85)
    got = {r["doc_id"] - 1: r["component_id"] - 1 for r in minhash.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA), 85).collect()}
    assert got == want and set(want.values()) == {0}


def test_densified_bins_agree_like_the_similarity():
    r = np.random.default_rng(1)
    total = same = 0
    for _ in range(300):
        a = np.unique(r.integers(0, 2**64, 24, dtype=np.uint64))
        b = np.unique(np.r_[a[2:], r.integers(0, 2**64, 2, dtype=np.uint64)])
        x, y = minhash.signature(a, 120), minhash.signature(b, 120)
        same, total = same + (x == y).sum(), total + 120
    assert abs(same / total - 22 / 26) < 0.03


def test_components_of_paths_and_stars(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 400)] + [(r.randrange(500, 560), r.randrange(500, 560)) for _ in range(50)] + [(7, 7)]
    r.shuffle(edges)
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == component_map(nodes, [e for e in edges if e[0] != e[1]])


def vectors(seed, n, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for i in range(n // 3):
        x[r.integers(n)] = x[r.integers(n)] + r.normal(size=d) * r.choice([0, 0.02, 0.05, 0.08])
    return x * r.uniform(0.01, 50, (n, 1))


@pytest.mark.parametrize("block", [64, 4096])
def test_vectors_as_all_pairs(spark, block):
    x = vectors(4, 900)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = component_map(range(len(x)), list(zip(*np.nonzero(near))))
    rows = [(i, v.tolist(), i % 3, 1) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int"), block=block).collect()}
    found, links = sum(r["n_links"] for r in got.values()), int(near.sum())
    assert links > 100 and 0.995 * links <= found <= links
    if found == links:
        assert all((got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), want[i]) for i in range(len(x)))


def uneven_vectors(kind, d, n, seed=3):
    """Directions spread unevenly over the dimensions; half the rows are near copies at a cosine of about 0.95."""
    r = np.random.default_rng(seed)
    make = (lambda m, b=r.normal(size=(16, d)): r.normal(size=(m, 16)) @ b) if kind == "rank 16" else (lambda m: r.normal(size=(m, d)) / np.arange(1, d + 1))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(make(n // 2))
    return np.concatenate([x, unit(x + unit(make(n // 2)) * 0.32)])


@pytest.mark.parametrize("kind, d", [("rank 16", 768), ("1/i", 384), ("1/i", 768)])
def test_uneven_vectors_lose_no_link(spark, kind, d):
    x = uneven_vectors(kind, d, 1200)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = component_map(range(len(x)), list(zip(*np.nonzero(near))))
    got = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert near.sum() > 500
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (near[i].sum(), want[i]) for i in range(len(x))}


def test_vectors_in_all_directions_are_sieved(spark):
    """Their cells are all near each other: without the sieve each vector is copied to most of them."""
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(r.normal(size=(6000, 64)))
    x[:300] = unit(x[300:600] + unit(r.normal(size=(300, 64))) * 0.325)
    x[600:700] = unit(x[700] + unit(r.normal(size=(100, 64))) * 0.2)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = component_map(range(len(x)), list(zip(*np.nonzero(near))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_vectors(df, per_region=(1000, 2000), block=64).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (near[i].sum(), want[i]) for i in range(len(x))}
    distinct = df.withColumnRenamed("vec_id", "key").cache()
    cells = {64: embeddings.Cells(64, embeddings._fit(distinct, len(x))[64], 6)}
    visits = embeddings.sieved(distinct, cells, 6, 0.025**0.5, 0.95).distinct().count()
    assert len(cells[64].centres) > 30 and near.any(1).sum() <= visits < 3000


def test_sketches_never_fall_below_the_cosine():
    for d in (3, 31, 64, 200):
        x = uneven_vectors("1/i", d, 600)
        x = np.concatenate([x, -x[:5]])
        cells = embeddings.Cells(d, (x[:50], np.full(50, 0.02)), 5)
        s = cells.sketch(x).astype(float) / 127
        assert ((x @ x.T) - s @ s.T).max() <= embeddings.ROUNDED
        home = np.arange(len(x)) % 50
        at = cells.region(home, np.arange(len(x)))
        assert set(at) == set(range(5)) and all(cells.span[r][0] <= h < cells.span[r][1] for r, h in zip(at, home))


def test_hostile_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (2, one), (2, one), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 3.0]), (8, [1.0, float("nan"), 3.0]),
            (9, [1.0, float("inf"), 3.0]), (None, one), (10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [-1.0, -2.0, -3.0]), (13, [1e-200, 2e-200, 3e-200]), (14, [1e200, 2e200, 3e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in embeddings.near_vectors(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(5, 1, True)] and got[2] == [(5, 1, False)] * 2 and got[3] == [(5, 1, False)] and got[13] == got[14] == [(5, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 12)) and got[None] == [(0, None, True)]
    assert got[10] == [(1, 10, True)] and got[11] == [(1, 10, False)]
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_a_round_of_centres_as_on_one_machine(spark):
    x = vectors(5, 700)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[:30]
    home = (x @ centres.T).argmax(1)
    want = np.array([x[home == c].sum(0) for c in range(30)])
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>").repartition(3)
    got = embeddings.moved(df, {x.shape[1]: centres})
    assert np.allclose(got[x.shape[1]], want)
