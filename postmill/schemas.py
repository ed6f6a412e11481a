"""Declared schemas and ``conform``, the additive-evolution helper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_DDL = (
    "externalId STRING, title STRING, company STRING, location STRING, postedAt STRING, "
    "employmentType STRING, easyApply BOOLEAN, salaryText STRING, summary STRING, "
    "description STRING, url STRING, retrievedAt STRING, extractorProvenance MAP<STRING,STRING>"
)
FUNNEL_DDL = (
    "STRUCT<availableCount: STRING, capturedRawCount: STRING, postHardFilterCount: STRING, "
    "postDedupeCount: STRING, importedCount: STRING>"
)


def _struct(ddl: str) -> str:
    parts, depth, cur = [], 0, ""
    for ch in ddl:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    parts.append(cur)
    return "STRUCT<" + ", ".join(p.strip().replace(" ", ": ", 1) for p in parts) + ">"


CAPTURE_DDL = (
    "sourceId STRING, sourceName STRING, searchUrl STRING, capturedAt STRING, "
    f"expectedCount STRING, pageUrl STRING, captureFunnel {FUNNEL_DDL}, "
    # A large capture is recorded in parts: number of the part, place of its first row, rows of all parts.
    f"part INT, partOffset BIGINT, rowCount BIGINT, jobs ARRAY<{_struct(RAW_DDL)}>, _corrupt STRING"
)

POSTING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("posted_at", T.TimestampType()),
        T.StructField("employment_type", T.StringType()),
        T.StructField("easy_apply", T.BooleanType()),
        T.StructField("salary_text", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("normalized_hash", T.StringType()),
        T.StructField("structured_meta", T.StringType()),
        T.StructField("metadata_quality_score", T.LongType()),
        T.StructField("missing_required_fields", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the schema; columns that are missing become typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
