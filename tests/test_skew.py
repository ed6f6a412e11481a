import bisect
import random

from pyspark.sql import functions as F

from postmill.operators.settle import settle
from postmill.operators.skew import cumulative, first_per_key, join_one_per_key, top_n_per_key

random.seed(3)
DATA = [("hot" if random.random() < 0.4 else f"k{random.randrange(40)}", i, random.randrange(1000)) for i in range(6000)]


def frame(spark):
    return spark.createDataFrame(DATA, "k string, i int, v int")


def test_top_n_per_key_keeps_every_row_it_should(spark):
    got = top_n_per_key(frame(spark), ["k"], [F.col("v").desc(), F.col("i")], 7).collect()
    want = {}
    for k, i, v in DATA:
        want.setdefault(k, []).append((-v, i))
    assert {(r.k, r.rank, r.i) for r in got} == {
        (k, n + 1, i) for k, xs in want.items() for n, (_, i) in enumerate(sorted(xs)[:7])
    }


def test_first_per_key(spark):
    got = {r.k: r.i for r in first_per_key(frame(spark), ["k"], F.col("i")).collect()}
    want = {}
    for k, i, _ in DATA:
        want.setdefault(k, i)
    assert got == want


def test_join_one_per_key_with_hot_and_missing_keys(spark):
    left = frame(spark).withColumn("k", F.when(F.col("i") % 50 != 0, F.col("k")))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", None), ("zz", 9)], "k string, w int")
    got = join_one_per_key(left, right, "k")
    plain = left.join(right, "k", "left").select("k", "i", "v", "w")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert got.count() == len(DATA)


def test_cumulative_matches_sorted_ranks(spark):
    values = sorted(v for _, _, v in DATA)
    counts = frame(spark).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    for cells in (1, 5, 4096):
        for r in cumulative(counts, "v", cells=cells).collect():
            assert r.upto == bisect.bisect_right(values, r.v)


def test_settle_reads_back_the_same_rows(spark):
    df = frame(spark).withColumn("a", F.array("k", "k"))
    again = settle(df)
    assert again.dtypes == df.dtypes and again.count() == len(DATA)
