"""A corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, in the columns of documents, which is written
and read again as the next stage's docs; the last returns the shard of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, minhash, mixing, sharding, toxicity
from postmill.llm.words import configured, own_name, table
from postmill.operators.settle import settle

SHARDS = 24


@configured
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scorer(model)(F.col("text")) < toxicity.THRESHOLD)


@configured
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id (with any rows that repeat that id and text).

    Different texts under one id are judged apart: where an id has several, id and text hash stand for it.
    """
    text_hash = F.xxhash64("text")
    several = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text_hash).alias("x"), F.max(text_hash).alias("y")).filter("x <> y")
    key = F.col("doc_id")
    if not several.isEmpty():
        number = dict(docs.dtypes)["doc_id"] != "string"
        # Keys sort as their ids do.
        first = F.lpad(F.hex(key.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") if number else F.concat(key, F.lit("\0"))
        key = F.concat(first, F.lpad(F.hex(text_hash), 16, "0"))
    found = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text"), percent=80)
    gone = own_name("removed")
    removed = found.filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(removed, key == F.col(gone), "left_anti")


@configured
def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, short items included."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), whole=True)


@configured
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it reads them."""
    return mixing.read_mix(docs)


@configured
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [
    ("toxicity", not_toxic), ("near_dedup", one_of_each), ("decontamination", no_test_items), ("mixing", mixed), ("sharding", sharded),
]
# Model, bucket hashes and permuted order have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; results between them are written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
