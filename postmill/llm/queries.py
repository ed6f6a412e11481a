"""Queries over the corpus tables, one per operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, divergence, embeddings, importance, minhash, mixing, quality, rules, secrets, sharding, suffixes, toxicity, warc
from postmill.llm.words import configured, table
from postmill.operators.settle import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = configured(fn)
        if sql:
            ORACLE[name] = sql
        return QUERIES[name]

    return wrap


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


@query("op3_histogram_shards")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf, "documents"), shards=24)


@query("op10_mix_sources", mixing.SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_secret_scan")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf, "documents"))


@query("op5_warc_round_trip", warc.SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"), new_path(spark, "warc"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op2_attention_quality")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op1_minhash", minhash.SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), percent=85)


@query("op8_spaced_seed_decontamination", decontaminate.SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.withColumn("items", F.array_join(F.transform("items", lambda i: i.cast("string")), ","))


@query("op6_spherical_cells", embeddings.SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


@query("op9_suffix_repeats", suffixes.SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.repeat_digest(table(spark, sf, "documents"))


@query("op11_source_divergence", divergence.SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(table(spark, sf, "documents"))


@query("op12_importance_resample", importance.SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_quality_rules")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
