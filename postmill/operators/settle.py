"""Write an intermediate result once, when later steps read it more than once."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset (tests), the warehouse, which every Spark deployment shares as well.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/settled").rstrip("/")


def new_path(spark: SparkSession, label: str = "settled") -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """The same rows read back from a written table: no recompute, lost executors do no harm."""
    return settle_parts([df], label)


def settle_parts(parts: Iterable[DataFrame], label: str = "settled") -> DataFrame:
    """Frames of one schema, written one after the other, read as one table."""
    paths, first = [], None
    for df in parts:
        first = first if first is not None else df
        paths.append(new_path(df.sparkSession, label))
        df.write.option("compression", "zstd").parquet(paths[-1])
    table = first.sparkSession.read.schema(first.schema).parquet(*paths)
    table.settled_paths = paths
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more; other frames are left alone."""
    for table in tables:
        spark = table.sparkSession
        for path in getattr(table, "settled_paths", ()):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
