"""Resampling documents towards a target: hashed features weigh them, noise from their ids ranks them, a share is drawn.

The features of documents and target are counted in hash buckets; a bucket's gain is the logarithm of its smoothed
share in the target over that in the documents. The gains, one array of fixed length, score every whole text in one
pass. A document's weight plus Gumbel noise of its id is its score, so the highest scores are a draw without
replacement, in which the odds are the weights.

The draw is not sorted as a whole to find its end: a quantile sketch gives a bracket of scores that should hold the
cutoff, exact counts outside confirm it (or widen it), a bracket with many rows is narrowed by a sketch of its own, and
only the rows inside are sorted. The drawn rows are then ranked in cells cut by quantiles, with exact counts before each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.tokens import LETTERS_DIGITS, Buckets, raw, words
from postmill.operators.settle import settle

BRACKET_ROWS = 100_000  # rows of a bracket that are sorted
SKETCH = 10_000  # accuracy of the quantile sketch
CELLS = 4_096  # cells at most in which drawn rows are ranked


def features(text: bytes, longest: int) -> Iterator[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by a blank."""
    found = words(text, LETTERS_DIGITS)
    yield from found
    for n in range(2, longest + 1):
        yield from (b" ".join(found[i : i + n]) for i in range(len(found) - n + 1))


def bucket_counts(texts: DataFrame, text: str, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts per bucket: at most ``buckets`` rows per task, and as many in all, are passed on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for data in b.column(0):
                total += np.bincount(np.fromiter((known[f] for f in features(data.as_py(), longest)), np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = texts.select(raw(F.col(text)).alias("text")).mapInArrow(count, "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for r in found:
        total[r["bucket"]] = r["n"]
    return total


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket, B the number of buckets."""
    all_s, all_t, b = int(documents.sum()), int(target.sum()), len(documents)
    ratio = ((int(t) + 1) * (all_s + b) / ((int(s) + 1) * (all_t + b)) for s, t in zip(documents, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


_WEIGHED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])


def weigher(gains: np.ndarray, longest: int):
    """Column function: words, features and summed gains of a text's bytes."""

    @F.pandas_udf(_WEIGHED)
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Buckets(len(gains))
        for texts in batches:
            out = []
            for data in texts:
                n = len(words(data, LETTERS_DIGITS))
                at = np.fromiter((known[f] for f in features(data, longest)), np.int64)
                out.append((n, len(at), int(gains[at].sum())))
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return weigh


def noise(doc_id: Column, seed: str) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of a hash of seed and id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_")]


def _bracket(rows: DataFrame, column: str, before: int, n: int) -> tuple[int, int, int]:
    """(low, high, rows below low) of an ascending column such that the row at place ``before`` (from 0) of n lies in it.

    Sketched quantiles around the place are confirmed by exact counts, and widened until they hold it.
    """
    slack = 4 / SKETCH
    while True:
        at = before / n
        low, high = rows.agg(F.percentile_approx(column, [max(0.0, at - slack), min(1.0, at + slack)], SKETCH).alias("q")).first()["q"]
        edge = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).first() if slack >= 1 else None
        if edge:
            low, high = edge["a"], edge["b"]
        c = F.col(column)
        below, upto = rows.agg(F.sum((c < low).cast("bigint")), F.sum((c <= high).cast("bigint"))).first()
        if below <= before < upto:
            return low, high, below
        slack *= 8


def cutoff(rows: DataFrame, n: int, draw: int):
    """The last drawn row (score, doc_id, row_) of the first ``draw`` of n in order, 1 <= draw <= n."""
    inside, place, size = rows.withColumn("falling", -F.col("score")), draw - 1, n
    numeric = dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    for column in ("falling", *(("doc_id",) if numeric else ())):
        while size > BRACKET_ROWS:
            low, high, below = _bracket(inside, column, place, size)
            inside = inside.filter(F.col(column).between(low, high))
            place -= below
            size = inside.count()
            if low == high:
                break
    return inside.orderBy(*_order()).select("score", "doc_id", "row_").offset(place).limit(1).first()


def ranked(drawn: DataFrame, n: int) -> DataFrame:
    """Drawn rows with their rank. Cells of equal scores are cut at quantiles, counted exactly, and sorted one by one."""
    cells = min(CELLS, n // BRACKET_ROWS)
    cuts = drawn.agg(F.percentile_approx("score", [i / (cells + 1) for i in range(1, cells + 1)], SKETCH).alias("q")).first()["q"] if cells else []
    cuts = sorted(set(cuts or []))
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    celled = drawn.withColumn("cell_", above)
    sizes = celled.groupBy("cell_").agg(F.count("*").alias("n")).collect()  # at most CELLS + 1 rows
    offset, first = 0, {}
    for r in sorted(sizes, key=lambda r: r["cell_"]):
        first[r["cell_"]] = offset
        offset += r["n"]
    start = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in first.items() for x in kv]), F.col("cell_").cast("bigint")) if first else F.lit(0)
    place = F.row_number().over(Window.partitionBy("cell_").orderBy(*_order()))
    return celled.withColumn("rank", start + place).drop("cell_")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, min_words: int = 20, seed: str = "2024",
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null where it is not drawn.

    Of the rows with at least ``min_words`` words, floor(percent / 100) of them with the highest scores are drawn; ties go
    to the smaller id, then (ids that repeat) to an arbitrary but fixed row. A null or empty text has no features and
    weight 0 and is not drawn; a null id takes its noise from the word null and comes after other ids. An empty table
    gives no rows; an empty target gives every bucket its share of the documents alone. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    weigh = weigher(gains, longest)
    found = docs.select(F.col(doc_id).alias("doc_id"), weigh(raw(F.col(text))).alias("w")).select("doc_id", "w.*")
    scored = found.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "row_": F.monotonically_increasing_id()})
    scored = settle(scored, "importance")
    open_ = scored.filter(F.col("n_words") >= min_words)
    n = open_.count()
    draw = n * percent // 100
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("bigint")
    if not draw:
        return scored.withColumn("rank", none).select(*out)
    last = cutoff(open_, n, draw)
    same_id = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"]))
    # Ids order with nulls last: before the last one come smaller ids, and all ids where it is null.
    earlier = F.col("doc_id") < F.lit(last["doc_id"]) if last["doc_id"] is not None else F.col("doc_id").isNotNull()
    tied = F.coalesce(earlier, F.lit(False)) | (same_id & (F.col("row_") <= last["row_"]))
    in_draw = (F.col("n_words") >= min_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tied))
    return ranked(scored.filter(in_draw), draw).select(*out).unionByName(scored.filter(~in_draw).withColumn("rank", none).select(*out))


# A CRC-32 per distinct word, byte by byte, from a table of its 256 steps.
SQL = r"""
WITH RECURSIVE step(b, c, i) AS (SELECT b, b::BIGINT, 0 FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY b) AS tbl FROM step WHERE i = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d), ew AS (SELECT unnest(ws) AS w FROM e),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM ew)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM ew JOIN hashed USING (w) GROUP BY 1),
gain AS (SELECT b AS bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM ew) + 10000))::DOUBLE))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
weight AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weight ON weight.doc_id = d.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM placed) THEN rank END AS rank FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id
"""
