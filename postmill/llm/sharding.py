"""Sharding by histogram sort: exact bytes below candidate keys, refined probes, one exchange.

Keys are 63-bit hashes. For each wanted boundary an interval of keys is known in which it lies. Every
round counts, exactly and over all partitions, the bytes and rows below evenly spaced probes inside the
open intervals, and narrows them. A boundary is settled when a probe is within the tolerance or a
single row is left in its interval. Only the counts (a few hundred rows) come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.words import utf8
from postmill.operators.settle import settle

TOP = 1 << 63
PROBES = 32  # per open boundary and round


def _counts(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe (probes ascend)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, number = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b["key"].to_numpy(np.uint64), side="right")
            np.add.at(weight, at, b["size"].to_numpy(np.int64))
            np.add.at(number, at, 1)
        seen = np.flatnonzero(number)
        yield pd.DataFrame({"at": seen, "weight": weight[seen], "number": number[seen]})

    found = (
        rows.select("key", "size").mapInPandas(count, "at long, weight long, number long")
        .groupBy("at").agg(F.sum("weight").alias("weight"), F.sum("number").alias("number")).collect()
    )
    weight, number = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in found:
        weight[r["at"]], number[r["at"]] = r["weight"], r["number"]
    return np.cumsum(weight)[:-1], np.cumsum(number)[:-1]


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001) -> tuple[list[int], int]:
    """Keys at which shards 1, 2, ... begin, and the number of rows.

    ``rows`` has key (0 to 2**63 - 1) and size. Each boundary is within ``tolerance`` of a shard's even
    share of the bytes, or as near to it as whole rows allow.
    """
    totals = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, n = totals["bytes"] or 0, totals["rows"]
    goal = [total * i / shards for i in range(1, shards)]
    # Per boundary: key, bytes and rows below, at the interval's two ends.
    low, high = [(0, 0, 0)] * len(goal), [(TOP, total, n)] * len(goal)
    done: dict[int, int] = {}
    slack = tolerance * total / shards
    while len(done) < len(goal):
        probes: set[int] = set()
        for i in range(len(goal)):
            a, b = low[i], high[i]
            if i in done:
                continue
            near = min((a, b), key=lambda x: abs(x[1] - goal[i]))
            if abs(near[1] - goal[i]) <= slack or b[2] - a[2] <= 1 or b[0] - a[0] <= 1:
                done[i] = near[0]
                continue
            steps = min(PROBES, b[0] - a[0] - 1)
            probes.update(a[0] + (b[0] - a[0]) * j // (steps + 1) for j in range(1, steps + 1))
        if not probes:
            continue
        at = np.array(sorted(probes), np.uint64)
        weight, number = _counts(rows, at)
        for i in range(len(goal)):
            if i not in done:
                j = int(np.searchsorted(weight, goal[i], side="right"))  # the first probe with more below it
                if j and at[j - 1] > low[i][0]:
                    low[i] = (int(at[j - 1]), int(weight[j - 1]), int(number[j - 1]))
                if j < len(at) and at[j] < high[i][0]:
                    high[i] = (int(at[j]), int(weight[j]), int(number[j]))
    return [done[i] for i in range(len(goal))], n


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, tolerance: float = 0.001, part_rows: int = 50_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard (null).

    Documents are placed in the order of a hash of id and text, so copies of a text spread over the shards.
    Rows equal in id and text cannot be told apart and stay in one shard. A null text has no bytes and
    the CRC of none (0); a null id is an id like any other. An empty table gives an empty result. Other
    columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = utf8(F.col(text))
    rows = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
            F.xxhash64(F.col(doc_id), F.col(text)).bitwiseAND(F.lit(TOP - 1)).alias("key"),
        ),
        "shard",
    )
    starts, n = splitters(rows, shards, tolerance)
    # Each shard is exchanged as several parts of bounded size; slots start where the part before ends.
    pieces = max(1, -(-n // (shards * part_rows)))
    edges = [0, *starts, TOP]
    cuts = np.array([a + (b - a) * j // pieces for a, b in zip(edges, edges[1:]) for j in range(pieces)][1:], np.uint64)
    _, below = _counts(rows, cuts) if len(cuts) else (None, np.zeros(0, np.int64))
    first = np.concatenate([[0], below]).astype(np.int64)
    first = first - np.repeat(first[::pieces], pieces)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = np.searchsorted(cuts, b["key"].to_numpy(np.uint64), side="right")
            b["part"], b["shard"], b["first"] = part, (part // pieces).astype(np.int32), first[part]
            yield b

    # The id goes through pandas as text, so that a null does not turn it into a float.
    number = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id", "text_crc32"))
    ids = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        place, "doc_id string, size long, text_crc32 long, key long, part long, shard int, first long"
    )
    return ids.select(
        F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + number - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
