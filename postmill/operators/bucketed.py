"""A store of rows by id in hash buckets, of which a new version rewrites only those that changed.

A version is a manifest: one row per bucket with the folder that holds it, its number of rows and a checksum. Buckets
whose count and checksum stay keep their files under their names; the others are written to folders of their own, never
over old ones. So a version that is not committed leaves every earlier one readable, and writing it again does no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST_DDL = "bucket int, path string, n bigint, checksum string"


def _checksum(types: list[tuple[str, str]]) -> Column:
    """Two sums over the rows' hashes, independent of their order. Maps and variants have no hash but their text."""
    h = F.xxhash64(*[F.to_json(f"`{c}`") if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in types])
    return F.concat_ws("/", F.bit_xor(h).cast("string"), F.sum(F.pmod(h, F.lit(1 << 40))).cast("string"))


def manifest(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST_DDL).parquet(f"{store}/manifests/v={version}")


def read_store(spark: SparkSession, store: str, version: int) -> DataFrame:
    """Rows of one version; a version without rows has the columns alone."""
    paths = [r["path"] for r in manifest(spark, store, version).collect()]  # one per bucket
    schema = spark.read.parquet(f"{store}/schemas/v={version}").schema
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_store(rows: DataFrame, store: str, version: int, base: int | None = None, buckets: int = BUCKETS, key: str = "id") -> int:
    """Write ``rows``, a whole new state, as ``version`` on top of ``base``; returns the number of buckets rewritten."""
    spark = rows.sparkSession
    bucketed = rows.withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    now = {r["bucket_"]: (r["n"], r["c"]) for r in bucketed.groupBy("bucket_").agg(F.count("*").alias("n"), _checksum(rows.dtypes).alias("c")).collect()}
    held = {r["bucket"]: r for r in manifest(spark, store, base).collect()} if base is not None else {}
    kept = {b: r for b, r in held.items() if now.get(b) == (r["n"], r["checksum"])}
    changed = [b for b in now if b not in kept]
    folder = f"{store}/data/{version}-{uuid.uuid4().hex}"
    if changed:
        # A bucket goes to a few tasks, so a large one is not one file.
        spread = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4))
        bucketed.filter(F.col("bucket_").isin(changed)).repartition("bucket_", spread).write.partitionBy("bucket_").parquet(folder)
    listed = [(b, r["path"], r["n"], r["checksum"]) for b, r in kept.items()] + [(b, f"{folder}/bucket_={b}", *now[b]) for b in changed]
    rows.limit(0).write.mode("overwrite").parquet(f"{store}/schemas/v={version}")
    spark.createDataFrame(listed, MANIFEST_DDL).coalesce(1).write.mode("overwrite").parquet(f"{store}/manifests/v={version}")
    return len(changed)
