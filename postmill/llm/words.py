"""Column helpers the corpus operators share."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

# Shuffle files go when the query that made them ends: results of several steps are written in between.
# Batches to Python are bounded by bytes, as texts can be long.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def configured(fn):
    """A function of a session (and more) that runs under the settings above."""

    @functools.wraps(fn)
    def run(spark: SparkSession, *more):
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        return fn(spark, *more)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text, no bytes for null."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """Input columns without those an operator is about to add under the same name."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def own_name(label: str) -> str:
    """A column name that no input has."""
    return f"{label}_{uuid.uuid4().hex}"
