"""Capture files and snapshots as tables, and the writers of the results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postmill.functions.core import collapse, half_up, nonempty
from postmill.operators.filters import passing
from postmill.operators.skew import filter_here
from postmill.params import SOURCE_TYPES
from postmill.schemas import CAPTURE_DDL, RAW_DDL

# Capture field names -> column names.
RENAMES = {
    "externalId": "external_id", "postedAt": "posted_at", "employmentType": "employment_type",
    "easyApply": "easy_apply", "salaryText": "salary_text", "retrievedAt": "retrieved_at_text",
    "extractorProvenance": "provenance",
}


def _snake(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in df.columns})


def read_captures(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per capture: a file each, or with ``lines`` a line each; broken ones keep a flag."""
    df = (
        spark.read.schema(CAPTURE_DDL)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return df.withColumns(
        {
            "file": F.col("_metadata.file_path"),
            "broken": F.col("_corrupt").isNotNull(),
            "payload_error": F.when(F.col("_corrupt").isNotNull(), "payload_invalid_object").when(
                F.col("jobs").isNull(), "payload_jobs_missing"
            ),
        }
    ).drop("_corrupt")


def capture_rows(captures: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row per posting: its place in the whole capture, capture time and page stamped on.

    Parts of a large capture are put together by their offsets, so no list holds more than one part. With ``sources``
    (source_id, source_type) the rows carry their source's type, as a refresh reads them.
    """
    rows = captures.select(
        F.col("sourceId").alias("source_id"),
        F.col("capturedAt").alias("retrieved_at"),
        F.col("pageUrl").alias("page_url"),
        "file", F.coalesce("partOffset", F.lit(0)).alias("_offset"),
        F.posexplode("jobs").alias("_at", "job"),
    ).withColumn("pos", (F.col("_offset") + F.col("_at")).cast("int"))
    flat = _snake(rows.select("source_id", "page_url", "file", "pos", "job.*", "retrieved_at")).drop("retrieved_at_text")
    return flat if sources is None else flat.join(sources.select("source_id", "source_type"), "source_id", "left")


def _count(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(n >= 0, half_up(n)).cast("bigint")


def capture_heads(captures: DataFrame) -> DataFrame:
    """Per capture: what ``quality.capture_summary`` reads, plus the five funnel counts; the first part speaks for all."""
    f = F.col("captureFunnel")
    return captures.filter(F.coalesce("part", F.lit(0)) == 0).select(
        F.col("sourceId").alias("source_id"),
        F.to_timestamp(F.try_to_timestamp(nonempty(F.trim("capturedAt")))).alias("captured_at"),
        F.coalesce(F.col("rowCount").cast("int"), F.size("jobs"), F.lit(0)).alias("job_count"),
        F.col("expectedCount").alias("expected_count"),
        "broken",
        "payload_error",
        _count(f["availableCount"]).alias("available_count"),
        _count(f["capturedRawCount"]).alias("captured_raw_count"),
        _count(f["postHardFilterCount"]).alias("post_hard_filter_count"),
        _count(f["postDedupeCount"]).alias("post_dedupe_count"),
        _count(f["importedCount"]).alias("imported_count"),
    )


def read_posting_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of postings (fixture form), one row each."""
    return _snake(spark.read.schema(RAW_DDL).option("multiLine", True).json(path))


def collect_sources(frames: list[DataFrame], sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Union the per-type readers, keep configured sources, apply the hard filter.

    Rows of a source type nobody can read are left to ``unsupported``, so that the caller fails that
    source and no other.
    """
    known = _union(frames).filter(F.col("source_type").isin(SOURCE_TYPES))
    mine = known.join(sources.select("source_id"), "source_id", "left_semi")
    return passing(mine, rules)


def unsupported(frames: list[DataFrame]) -> DataFrame:
    """Sources with rows of a type nobody can read: source_id, source_type, rows, error."""
    t = F.col("source_type")
    odd = _union(frames).filter(~F.coalesce(t.isin(SOURCE_TYPES), F.lit(False)))
    return odd.groupBy("source_id", "source_type").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "error", F.concat(F.lit("unsupported source type: "), F.coalesce(t, F.lit("null")))
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---- writers ------------------------------------------------------------------------------

# Column -> capture field, for the rows of a payload.
FIELDS = {
    "external_id": "externalId", "title": "title", "company": "company", "location": "location", "posted_at": "postedAt",
    "employment_type": "employmentType", "easy_apply": "easyApply", "salary_text": "salaryText", "summary": "summary",
    "description": "description", "url": "url",
}


PART_ROWS = 10_000  # rows of a capture in one record


def capture_payloads(rows: DataFrame, heads: DataFrame, pos: str = "pos", part_rows: int = PART_ROWS) -> DataFrame:
    """Captures as they are recorded: records of (source_id, captured_at) with payload head and rows in order.

    ``heads`` has source_id, captured_at, page_url and expected_count; a capture without rows keeps an empty list. A
    capture of more than ``part_rows`` rows becomes several records, each with its part number, the place of its first
    row and the number of all rows; only as many rows as a part has are ever in one list.
    """
    keys = ["source_id", "captured_at"]
    job = F.struct(*[F.col(c).alias(f) for c, f in FIELDS.items() if c in rows.columns])
    place = F.row_number().over(W.partitionBy(*keys).orderBy(pos)) - 1
    placed = rows.select(*keys, place.alias("p"), job.alias("j")).withColumn("part", F.expr(f"p div {part_rows}").cast("int"))
    listed = placed.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("p", "j"))).alias("l"))
    sizes = listed.groupBy(*keys).agg(F.sum(F.size("l")).alias("n"))
    jobs = F.transform("l", lambda x: x["j"])
    joined = heads.join(sizes, keys, "left").join(listed, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    several = F.col("n") > part_rows
    return joined.select(
        F.col("source_id").alias("sourceId"),
        F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("capturedAt"),
        F.col("page_url").alias("pageUrl"),
        F.col("expected_count").cast("string").alias("expectedCount"),
        F.struct(
            F.when(F.col("expected_count") > 0, half_up(F.col("expected_count")).cast("string")).alias("availableCount"),
            F.col("n").cast("string").alias("capturedRawCount"),
        ).alias("captureFunnel"),
        F.when(several, F.col("part")).alias("part"), F.when(several, F.col("part").cast("bigint") * part_rows).alias("partOffset"), F.when(several, F.col("n")).alias("rowCount"),
        F.coalesce(jobs, F.array().cast(listed.select(jobs.alias("x")).schema["x"].dataType)).alias("jobs"),
    )


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Captures as JSON lines; ``read_captures(path, lines=True)`` reads them back."""
    payloads.write.mode("append").option("ignoreNullFields", "true").option("compression", "gzip").json(path)


def write_captures(rows: DataFrame, path: str) -> None:
    """Rows of many captures, partitioned by source; no capture passes through one task."""
    rows.write.mode("append").partitionBy("source_id").json(path)


def capture_funnel_record(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Five-count funnel per source for the payload head."""
    n = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("captured_raw_count"))
    none = F.lit(None).cast("bigint")
    return expected.join(n, "source_id", "left").select(
        "source_id",
        F.when(F.col("expected_count") > 0, half_up(F.col("expected_count"))).cast("bigint")
        .alias("available_count"),
        F.coalesce("captured_raw_count", F.lit(0)).alias("captured_raw_count"),
        none.alias("post_hard_filter_count"),
        none.alias("post_dedupe_count"),
        none.alias("imported_count"),
    )


def write_quarantine(artifacts: DataFrame, path: str) -> None:
    artifacts.write.mode("append").partitionBy("source_id", "outcome").json(path)


def write_log(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Append-only logs: retention audit, events, run deltas, diagnostics."""
    w = rows.write.mode("append")
    (w.partitionBy(partition) if partition else w).json(path)


def write_shortlist(top: DataFrame, path: str, as_json: bool = False) -> None:
    """Top list (50 rows by construction) as one JSON or Markdown file."""
    if as_json:
        top.coalesce(1).write.mode("overwrite").json(path)
    else:
        top.orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(path)


REPORTED = "generated_at"


def write_report(report: DataFrame, path: str, generated_at: str) -> None:
    """One diagnostics report as a partition of the history, named by its time (ISO text); written again it replaces itself."""
    report.write.mode("overwrite").parquet(f"{path}/{REPORTED}={generated_at.replace(':', '-')}")


def report_times(spark: SparkSession, path: str) -> list[str]:
    """Times of the reports there are, ascending, from the names of the partitions alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{REPORTED}="))


def latest_report(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest report with its time; no other partition is opened. None before the first."""
    times = report_times(spark, path)
    return spark.read.parquet(f"{path}/{REPORTED}={times[-1]}").withColumn(REPORTED, F.lit(times[-1])) if times else None


# ---- accessibility snapshots --------------------------------------------------------------

# Shapes of snapshot lines, and texts that are never part of a posting.
BUTTON = r'^\s*- button "(.+)" \[ref=[^\]]+\] \[cursor=pointer\]:$'
INLINE = r"^\s*- (?:(?:paragraph|generic) \[ref=[^\]]+\]|text): (.+)$"
NOISE = [
    "·", "Easy Apply", "Viewed", "Saved", "Applied", "Actively reviewing applicants",
    "Be an early applicant",
]
NOISE_PATTERN = (
    r"^(?:Dismiss |Posted on )|(?i:school alumni work here|connection works here|(?<![A-Za-z0-9_])benefits?(?![A-Za-z0-9_]))"
)
PAY_PATTERN = r"(?i)\$\d|(?<![A-Za-z0-9_])\d+/[hy]r(?![A-Za-z0-9_])"


def snapshot_blocks(files: DataFrame) -> DataFrame:
    """Indented snapshot text -> one posting per button block.

    ``files`` has file and text. A button line opens a block; the block ends at the first
    later line that is not indented deeper. The first three texts that are not noise, with
    adjacent repeats folded, are title, company and location. A file is one captured screen and
    stays one row: its lines are cut and read in place, and only the postings found are exchanged,
    as a screen recorded twice counts once.
    """
    button = lambda c: F.regexp_extract(c, BUTTON, 1)
    # Few lines pass the plain test, which comes first.
    opens = lambda c: c.contains(" Dismiss ") & button(c).contains(" Dismiss ") & ~button(c).startswith("Dismiss ")
    lines = F.transform(
        F.split("text", r"\r?\n"),
        lambda c, i: F.struct(i.alias("pos"), F.length(F.regexp_extract(c, r"^(\s*)", 1)).alias("indent"), opens(c).alias("opens"), c.alias("line")),
    )
    cut = files.select("file", F.filter(lines, lambda x: F.trim(x["line"]) != "").alias("lines")).withColumn(
        # Places of the lines that open a block, counted from 1, and the place behind the last line.
        "at", F.filter(F.transform("lines", lambda x, i: F.when(x["opens"], i + 1)), lambda i: i.isNotNull())
    ).withColumn("ends", F.concat(F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), F.array(F.size("lines") + 1)))
    blocks = cut.select("file", F.explode(F.transform(
        "at", lambda i, k: F.struct(F.get("lines", i - 1).alias("head"), F.slice("lines", i + 1, F.get("ends", k) - i - 1).alias("rest"))
    )).alias("b")).select("file", "b.*")
    # Lambdas name their argument once where that is costly: it would be computed once per mention.
    inline = lambda x: F.trim(F.regexp_extract(x["line"], INLINE, 1))
    noise = lambda t: t.isin(NOISE) | t.rlike(NOISE_PATTERN)
    named = lambda t: collapse(F.regexp_replace(t, r"(?i)\s*\(Verified job\)\s*", " "))
    some = lambda a: F.filter(a, lambda t: t != "")
    closing = F.col("closing")
    ended = blocks.withColumn("closing", F.array_position(F.transform("rest", lambda x: x["indent"] <= F.col("head.indent")), True).cast("int"))
    texts = ended.select(
        "file", F.col("head.pos").alias("block"), button(F.col("head.line")).alias("summary"),
        some(F.transform(F.when(closing > 0, F.slice("rest", 1, closing - 1)).otherwise(F.col("rest")), inline)).alias("inline"),
    )
    useful = texts.withColumn("t", some(F.transform(F.filter("inline", lambda t: ~noise(t)), named))).withColumn(
        "t", F.filter("t", lambda t, i: (i == 0) | (t != F.get("t", i - 1)))
    )
    found = useful.select(
        "file", "block", *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate(("title", "company", "location"))], "summary",
        F.get(F.filter("inline", lambda t: t.rlike(PAY_PATTERN)), F.lit(0)).alias("salary_text"),
        F.get(F.transform(F.filter("inline", lambda t: t.startswith("Posted on ")), lambda t: F.trim(F.substring(t, F.lit(11), F.length(t)))), F.lit(0)).alias("posted_at"),
        F.array_contains("inline", "Easy Apply").alias("easy_apply"),
    )
    return filter_here(found, F.col("title").isNotNull() & F.col("company").isNotNull()).repartition("file").distinct()
