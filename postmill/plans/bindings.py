"""Domain tables built from the given star-schema tables.

Each ``b_*`` function returns a DataFrame; ``sqlkit`` holds the same definitions as SQL.
Small dimensions are SQL VALUES lists, so both sides read the very same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.core import iso, lower_text, text
from postmill.params import SOURCE_TYPES

AS_OF_RAW = "2001-11-05 00:00:00"
AS_OF_POSTING = "2001-08-02 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"

SOURCE_COLUMNS = (
    "source_id, source_name, source_type, enabled, search_url, max_jobs, cache_ttl_hours, "
    "required_terms, required_all, required_any, exclude_any, fields, enforce_content, keywords"
)
# One row per source: lists are joined by '|'.
SOURCE_ROWS = """
('src0', 'Platform roles', 'linkedin_capture_file', true, 'https://www.linkedin.com/jobs/search/?keywords=product+manager&f_TPR=r604800', 500, CAST(NULL AS INT), '', 'ring|brand', '', 'small', '', true, ''),
('src1', 'Product Manager AI', 'builtin_search', true, 'https://builtin.example.com/jobs?search=ml%20engineer&daysSinceUpdated=3', 200, CAST(NULL AS INT), '', '', 'widget|rod|the', 'hot', '', false, ''),
('src2', 'Data roles', 'wellfound_search', true, 'https://wellfound.example.com/jobs?q=data', 1000, 48, '', '', '', '', '', false, 'genai research'),
('src3', 'Plates', 'ashby_search', true, 'https://www.google.com/search?q=site%3Ajobs.ashbyhq.com+plate&tbs=qdr:w', 300, CAST(NULL AS INT), '', 'plate', '', '', '', false, ''),
('src4', 'Everything else', 'google_search', true, 'https://www.google.com/search?q=jobs&tbs=qdr:d', 50, CAST(NULL AS INT), '', '', '', 'economy|promo', '', false, ''),
('src5', 'Red goods', 'indeed_search', true, 'https://www.indeed.com/jobs?q=red&fromage=7&salaryType=%24120%2C000', 400, 6, 'red', 'blue', '', '', 'title|company', true, ''),
('src6', 'Open feed', 'ziprecruiter_search', true, 'https://www.ziprecruiter.com/jobs-search?search=open&days=10&refine_by_salary=90000', 100, CAST(NULL AS INT), '', '', '', '', '', false, ''),
('src7', 'Leads', 'remoteok_search', false, 'not a url', 250, CAST(NULL AS INT), '', '', 'lead gizmo|old', '', '', false, '')
""".strip()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ts(value: str):
    return F.lit(value).cast("timestamp")


def values(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def terms_of(c):
    return F.filter(F.split(c, r"\|"), lambda t: t != "")


def b_source(spark: SparkSession) -> DataFrame:
    return values(spark, SOURCE_COLUMNS, SOURCE_ROWS)


def source_type_of(n):
    return F.element_at(F.array(*[F.lit(t) for t in SOURCE_TYPES]), (n % 8 + 1).cast("int"))


def b_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw postings, one per line item; ``pos`` is a unique, total order."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate",
    )
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supp = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
        .join(nation, supp.s_nationkey == nation.n_nationkey)
    )
    key = F.col("l_orderkey")
    return j.select(
        F.concat(F.lit("src"), (key % 8).cast("string")).alias("source_id"),
        source_type_of(key).alias("source_type"),
        F.concat_ws(
            "|",
            F.date_format("l_shipdate", "yyyyMMdd"),
            F.lpad(key.cast("string"), 12, "0"),
            F.col("l_linenumber").cast("string"),
            F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 14, "0"),
            F.lpad(F.col("l_partkey").cast("string"), 10, "0"),
            F.lpad(F.col("l_suppkey").cast("string"), 8, "0"),
        ).alias("pos"),
        F.when(
            F.col("l_partkey") % 5 != 0, F.concat_ws("-", key, F.col("l_linenumber"))
        ).alias("external_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.col("s_name").alias("company"),
        F.when(F.col("l_linenumber") != 7, F.col("n_name")).alias("location"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("posted_at"),
        F.when(
            ~((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10)), F.col("l_linestatus")
        ).alias("employment_type"),
        F.when(
            F.col("l_discount") != 0,
            F.concat(F.lit("$"), F.floor("l_extendedprice").cast("string")),
        ).alias("salary_text"),
        F.lit(None).cast("string").alias("summary"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
        F.when(
            (F.col("l_tax") == 0) & (F.col("l_partkey") % 3 == 0),
            F.concat(F.lit("posting "), F.col("l_partkey").cast("string")),
        )
        .otherwise(
            F.concat(
                F.lit("https://jobs.example.com/p/"),
                F.col("l_partkey").cast("string"),
                F.lit("?s="),
                F.col("l_suppkey").cast("string"),
            )
        )
        .alias("url"),
        F.col("l_shipdate").cast("timestamp").alias("seen_at"),
    )


def b_posting(spark: SparkSession, sf: str) -> DataFrame:
    """Stored postings, one per order."""
    orders = table(spark, sf, "orders")
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = orders.join(cust, orders.o_custkey == cust.c_custkey).join(
        nation, cust.c_nationkey == nation.n_nationkey
    )
    key = F.col("o_orderkey")
    title = F.concat_ws(" ", "c_mktsegment", "o_orderpriority")
    at = F.col("o_orderdate").cast("timestamp")
    return j.select(
        key.cast("string").alias("id"),
        key.alias("num"),
        F.concat(F.lit("src"), (key % 8).cast("string")).alias("source_id"),
        source_type_of(key).alias("source_type"),
        F.concat(F.lit("https://jobs.example.com/o/"), key.cast("string")).alias("source_url"),
        F.when(key % 3 == 0, key.cast("string")).alias("external_id"),
        title.alias("title"),
        F.col("c_name").alias("company"),
        F.col("n_name").alias("location"),
        at.alias("posted_at"),
        F.col("o_orderstatus").alias("employment_type"),
        (key % 2 == 0).alias("easy_apply"),
        F.when(
            key % 11 != 0, F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"))
        ).alias("salary_text"),
        F.concat_ws(" ", "c_mktsegment", "o_orderpriority", "n_name", "o_orderstatus").alias(
            "description"
        ),
        F.sha2(
            F.concat_ws("|", F.lower("c_name"), F.lower(title)), 256
        ).alias("normalized_hash"),
        F.concat(F.lit('{"title":"'), title, F.lit('"}')).alias("structured_meta"),
        F.when(key % 11 != 0, 100).otherwise(83).cast("bigint").alias("metadata_quality_score"),
        F.when(key % 11 != 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("salary")))
        .alias("missing_required_fields"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def b_status(spark: SparkSession, sf: str) -> DataFrame:
    """Application status rows: 0..1 per posting."""
    key = F.col("o_orderkey")
    k = key % 7
    at = F.col("o_orderdate").cast("timestamp")
    return (
        table(spark, sf, "orders")
        .filter(k < 4)
        .select(
            key.cast("string").alias("job_id"),
            F.when(k == 0, "applied")
            .when(k == 1, "rejected")
            .when(k == 2, "skip_for_now")
            .otherwise("viewed")
            .alias("status"),
            F.when(key % 5 == 0, F.concat(F.lit("note "), (key % 3).cast("string")))
            .otherwise("")
            .alias("notes"),
            at.alias("last_action_at"),
            F.when(k == 0, at).alias("submitted_at"),
        )
    )


def b_doc(spark: SparkSession, sf: str) -> DataFrame:
    """Long free text as postings, status by the label table."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("source_id"),
        F.col("lang").alias("location"),
        F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"),
        F.concat(F.lit("Company "), F.col("lang")).alias("company"),
        F.col("text").alias("description"),
        F.when(F.col("toxic") == 1, "rejected")
        .when(F.col("quality") == 1, "applied")
        .alias("status"),
    )


def b_page(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.concat(F.lit("src"), (F.col("page_id") % 8).cast("string")).alias("source_id"),
        "page_id", "url", "html",
    )


def b_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Refresh event log: one source per user."""
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("source_id"),
        source_type_of(F.col("user_id")).alias("source_type"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(t == "error", "transient_error")
        .when(t == "purchase", "challenge")
        .otherwise("success")
        .alias("outcome"),
        F.when(k % 2 == 0, "manual").otherwise("scheduled").alias("mode"),
    )


def b_event(spark: SparkSession, sf: str) -> DataFrame:
    ch = F.col("user_id") % 4
    return table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("event"),
        F.when(ch == 0, "CLI ").when(ch == 1, "dashboard").when(ch == 2, "npm").otherwise("other")
        .alias("channel"),
        F.when(F.col("user_id") % 3 == 0, "authenticated").when(F.col("user_id") % 3 == 1, "x")
        .alias("identity_mode"),
        F.col("user_id").cast("string").alias("distinct_id"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        "props",
    )


def page_text(c):
    return text(F.regexp_replace(c, "<[^>]+>", " "))


__all__ = [n for n in dir() if n.startswith("b_")] + ["table", "ts", "values", "iso", "lower_text"]
