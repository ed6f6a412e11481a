"""Session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


# HotSpot never compiles methods above 8000 bytes of bytecode; Spark then does better with
# split projections than with one huge generated method.
HUGE_METHOD = 8000


# Planning settings the operators rely on, set by the session and by every registered query.
PLANNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": str(HUGE_METHOD),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even when the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffle files go when the step that made them ends; what later steps read is written.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(app: str = "postmill", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        **PLANNING,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
