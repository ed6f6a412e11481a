"""Mixing sources to target weights by hash order and exact prefix sums. DataFrame operations only.

Each row gets a hash-random key. Words are summed over equal key ranges within each source, prefix
sums over those ranges find the range in which a source's budget ends, and only that one range is
sorted, to find the key at which the budget ends exactly. What a row gives then follows from its own
key and one row per source, so texts are never exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.words import n_words, replacing
from postmill.operators.settle import settle

KEY_DIGITS = 15  # hex digits of a key
RANGE_DIGITS = 3  # leading digits that name a key range: 4096 ranges per source
OUT = ("size", "source_size", "target", "taken", "epochs")
FEW_SOURCES = 10_000  # as many plan rows at most are broadcast (below 1 MB)


def mix_key(doc_id: Column, seed: str) -> Column:
    """Hash-random 60-bit key as hex text; its order is the order in which a source is read."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, KEY_DIGITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code point order (null last) weigh ``weights``, repeating. The level at which
    ``sum(least(most * size, level * weight))`` meets ``share`` of all words is the largest of
    (words - caps of those before) / (weights from here on), in order of cap / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    return (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("left")).over(every))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def mix_plan(docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2, seed="mix", doc_id="doc_id", text="text", source="source") -> DataFrame:
    """One row per source: source_size, target, whole (epochs read to the end), and where the last
    epoch ends: rows with a key below ``cut_key`` are read once more, those at it give ``cut_words``
    of their ``cut_size`` words in proportion."""
    narrow = settle(
        docs.select(F.col(source).alias("source"), mix_key(F.col(doc_id), seed).alias("key"), n_words(F.col(text)).alias("size")), "mix"
    ).withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    parts = settle(narrow.groupBy("source", "part").agg(F.sum("size").alias("size")), "mix-parts")
    targets = (
        source_targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        .withColumn("budget", F.floor("target"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size"))
    )
    targets = settle(targets, "mix-targets")
    few = targets.count() <= FEW_SOURCES
    small = F.broadcast if few else (lambda df: df)

    def crossing(df: DataFrame, by: str) -> DataFrame:
        """Of each source, the row in which the running sum passes what is left of the budget."""
        w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("upto", F.sum("size").over(w)).filter("upto - size <= need AND need < upto")

    need = targets.select(F.col("source").alias("s"), F.col("rest").alias("need"))
    cut_part = crossing(parts.join(small(need), F.col("source").eqNullSafe(F.col("s"))), "part")
    cut_part = cut_part.select("s", F.col("part").alias("p"), (F.col("need") - F.col("upto") + F.col("size")).alias("need"))
    inside = narrow.join(small(cut_part), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    cut_key = crossing(inside.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("need").alias("need")), "key")
    cut_key = cut_key.select(
        F.col("source").alias("s"), F.col("key").alias("cut_key"), (F.col("need") - F.col("upto") + F.col("size")).alias("cut_words"), F.col("size").alias("cut_size")
    )
    plan = targets.join(cut_key, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = settle(plan.select("source", "source_size", "target", "whole", "cut_key", "cut_words", "cut_size"), "mix-plan")
    return F.broadcast(plan) if few else plan


def mix(docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2, seed="mix", doc_id="doc_id", text="text", source="source") -> DataFrame:
    """Input rows with size, source_size, target, taken (words the mix takes, repeats counted) and
    epochs (how often the row is read, the last time perhaps in part).

    Sources share ``share`` of all words by weight; none gives more than ``most`` times its size.
    A null or empty text has size 0 and gives nothing. A null source is a source of its own, the last.
    Rows that repeat a doc_id have one key: where the budget ends among them, each gives words in
    proportion. An empty table gives an empty result. Input columns named like an added one are replaced.
    """
    plan = mix_plan(docs, weights, share, most, seed, doc_id, text, source)
    plan = plan.select(*[F.col(c).alias(f"_plan_{c}") for c in plan.columns])
    once_more = (
        F.when(F.col("_key") < F.col("_plan_cut_key"), F.col("size"))
        .when(F.col("_key") == F.col("_plan_cut_key"), F.expr("size * _plan_cut_words div _plan_cut_size"))
        .otherwise(0)
    )
    rows = docs.withColumns({"_size": n_words(F.col(text)), "_key": mix_key(F.col(doc_id), seed), "_source": F.col(source)})
    rows = replacing(rows, *OUT).withColumnRenamed("_size", "size")
    return (
        rows.join(plan, F.col("_source").eqNullSafe(F.col("_plan_source")))
        .withColumns({"source_size": F.col("_plan_source_size"), "target": F.col("_plan_target"), "_more": once_more})
        .withColumns({"taken": F.col("size") * F.col("_plan_whole") + F.col("_more")})
        .withColumns({"epochs": F.when(F.col("size") > 0, F.col("_plan_whole") + (F.col("_more") > 0).cast("bigint")).otherwise(0)})
        .drop("_key", "_source", "_more", *plan.columns)
    )


def read_mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", **how) -> DataFrame:
    """The mixed corpus itself: each row as often as the mix reads it, in the input's columns.

    The row at which a budget ends is read whole. Rows without words are in no mix.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_from"))
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("epochs")))
    return mix(rows, doc_id="_id", text="_text", source="_from", **how).filter("epochs > 0").withColumn("_time", times).select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, cap / weight AS ratio FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
t AS (SELECT source, source_size, least(cap::DOUBLE, (max(level) OVER ()) * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
k AS (SELECT d.doc_id, d.size, b.*, floor(b.target)::BIGINT - b.whole * b.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.key) AS tied
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * whole + CASE WHEN upto <= rest THEN size WHEN upto - tied >= rest THEN 0 ELSE (size * (rest - (upto - tied)))::BIGINT // tied::BIGINT END)::BIGINT AS taken
FROM k
"""
