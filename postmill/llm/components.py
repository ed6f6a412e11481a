"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.settle import settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node that has an edge; component is its smallest reachable id.

    Every round hangs each node's larger neighbours on its smallest one, then the smaller ones; all
    steps are joins and pre-aggregated minima, and each round's edges are written, so no lineage grows.
    Edges with a null end or equal ends are ignored; repeated edges count once.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = settle(e, "edges")
    while not _all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _all_stars(e: DataFrame) -> bool:
    """Whether each larger end has one edge and is no smaller end: then the edges are the components."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, smallest id of its component) of the bipartite links of a block."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return []
    m, a, b = linked[np.ix_(rows, cols)], left[rows].copy(), right[cols].copy()
    top = np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(m, b[None, :], top).min(1))
        b2 = np.minimum(b, np.where(m, a2[:, None], top).min(0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    ids, roots = np.r_[left[rows], right[cols]], np.r_[a, b]
    keep = ids != roots
    return list(set(zip(ids[keep].tolist(), roots[keep].tolist())))
