"""Shapes that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SALTS = 64


def top_n_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = SALTS
) -> DataFrame:
    """First ``n`` rows of each key in ``order``, which must be a total order.

    Two rounds: every (key, salt) keeps its own first n, then the survivors are ranked. No
    task sees a whole key, and Spark's window group limit already cuts rows before the
    first exchange. Adds the final ``rank``.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order_inputs(df)), F.lit(salts)))
    first = (
        salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)))
        .filter(F.col("_r") <= n)
        .drop("_r", "_salt")
    )
    return first.withColumn(
        "rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    ).filter(F.col("rank") <= n)


def order_inputs(df: DataFrame) -> list[Column]:
    """Hashable columns of a frame (maps have no hash)."""
    return [F.col(f"`{n}`") for n, t in df.dtypes if "map<" not in t and "variant" not in t]


def filter_here(df: DataFrame, keep: Column) -> DataFrame:
    """Filter on computed columns without having the optimizer copy them below the projection.

    Pushing such a filter down would inline its whole expression tree a second time. Filter
    on stored columns before calling, those should reach the scan.
    """
    marked = df.withColumns({"_keep": keep, "_here": F.spark_partition_id()})
    return marked.filter(F.col("_keep") & (F.col("_here") >= 0)).drop("_keep", "_here")


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One whole row per key, the smallest by ``order``; combined before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def join_one_per_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a table with one row per key; each side is read once.

    A hot key is split by the adaptive skew join: its rows on the left are dealt out over several
    tasks, and the single row on the right goes to each of them (``session`` forces it on).
    """
    payload = [c for c in right.columns if c != key]
    one = right.select(F.col(key).alias("_one_key"), F.struct(*payload).alias("_one"))
    joined = left.join(one, F.col(key) == F.col("_one_key"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("_one")[c].alias(c) for c in payload])


def cumulative(counts: DataFrame, value: str, n: str = "n", cells: int = 256) -> DataFrame:
    """Rows at or below each value, from a table of distinct values with counts.

    ``counts`` has one row per distinct value. Cells are cut at approximate quantiles of the distinct
    values, so an outlier changes no other cell; the running total over cells is the only single-task
    step and has at most ``cells`` rows, the one inside a cell sees about 1/cells of the distinct values. A value
    finds its cell among every ``step``-th cut, then among the cuts behind that one.
    """
    step = max(1, math.isqrt(cells))
    at = [i / cells for i in range(1, cells)] or [0.5]
    found = counts.agg(F.percentile_approx(value, at, 10 * cells).alias("q")).select(
        F.struct("q", F.filter("q", lambda _, i: (i + 1) % step == 0).alias("coarse")).alias("cuts")
    ).scalar()
    upto = lambda cuts: F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col(value))), F.lit(0))
    celled = counts.withColumn("_cuts", found).withColumn("_coarse", upto(F.col("_cuts.coarse"))).withColumn(
        "_cell", F.col("_coarse") * step + upto(F.slice("_cuts.q", F.col("_coarse") * step + 1, step - 1 or 1))
    ).drop("_cuts", "_coarse")
    per_cell = celled.groupBy("_cell").agg(F.sum(n).alias("_s"))
    before = per_cell.select(
        "_cell",
        (F.sum("_s").over(W.orderBy("_cell")) - F.col("_s")).alias("_before"),
    )
    inside = F.sum(n).over(W.partitionBy("_cell").orderBy(value))
    return (
        celled.join(F.broadcast(before), "_cell")
        .withColumn("upto", F.col("_before") + inside)
        .drop("_cell", "_before")
    )
