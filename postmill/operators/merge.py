"""State changes of the posting store, each as a table in, a table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.core import half_up, nonempty, packed, unpacked
from postmill.operators.conflicts import SEQUENTIAL_ROWS, first_set
from postmill.operators.settle import settle
from postmill.operators.skew import first_per_key, join_one_per_key
from postmill.params import RETENTION_DAYS, STATUSES

# What an upsert overwrites; identity, source and creation time stay.
UPDATED = [
    "external_id", "title", "company", "location", "posted_at", "employment_type", "easy_apply",
    "salary_text", "description", "normalized_hash", "structured_meta",
    "metadata_quality_score", "missing_required_fields", "updated_at",
]
SIGNATURE = ["source_id", "source_url", *[c for c in UPDATED if c != "updated_at"]]


# ---- matching -------------------------------------------------------------------------------

def resolve_incoming(base: DataFrame, incoming: DataFrame, pos: str = "pos", in_one_task: int = SEQUENTIAL_ROWS) -> DataFrame:
    """Incoming rows folded to one per stored row, with ``surviving_id`` and ``matched``: what upserts one row at a time leave.

    A row goes to the row with its id, else to the one with its (source_id, source_url), stored before or made by a row
    before it. A row that finds neither makes a new stored row under its own id and URL; rows after it find that one, while a row that went
    elsewhere leaves its id and URL free. So the makers are the rows of which neither key was taken by a maker before
    them. Only keys and positions are matched and folded; the payload of the last row of each target, and of its
    maker, is fetched once. Rows with equal ``pos`` count in the order they are stored in.
    """
    rows = settle(incoming.withColumn("_n", F.monotonically_increasing_id()), "incoming")
    url_key = F.to_json(F.struct("source_id", "source_url"))
    keys = rows.select("id", url_key.alias("_uk"), F.struct(F.col(pos).alias("p"), "_n").alias("o"))
    by_id = base.select("id", F.lit(True).alias("_by_id"))
    by_url = base.select(url_key.alias("_uk"), F.col("id").alias("_url_id"))
    j = join_one_per_key(join_one_per_key(keys, by_id, "id"), by_url, "_uk")
    j = settle(j, "incoming-keys")
    new = j.filter("_by_id IS NULL AND _url_id IS NULL").groupBy("id", "_uk").agg(F.min("o").alias("o"))
    marks = settle(new.select("o", F.col("_uk").alias("a"), F.col("id").alias("b"), F.lit(0).cast("bigint").alias("_page")), "incoming-new")
    makers = marks.join(first_set(marks, in_one_task).withColumnRenamed("_n", "_maker"), F.col("o._n") == F.col("_maker"), "left_semi")
    by_id = makers.select(F.col("b").alias("id"), F.col("o").alias("_made"))
    by_url = makers.select(F.col("a").alias("_uk"), F.col("b").alias("_url_maker"))
    j = join_one_per_key(join_one_per_key(j, by_id, "id"), by_url, "_uk")
    own = F.when(F.col("_by_id") | (F.col("_made") <= F.col("o")), F.col("id"))
    target = j.withColumn("surviving_id", F.coalesce(own, "_url_id", "_url_maker")).groupBy("surviving_id").agg(
        F.max("o").alias("_last"), F.min("o").alias("_first"), F.bool_or(F.coalesce((F.col("surviving_id") == F.col("_url_id")) | F.col("_by_id"), F.lit(False))).alias("matched")
    )
    target = settle(target, "incoming-targets")
    fresh = [c for c in incoming.columns if c in UPDATED]
    made = [c for c in incoming.columns if c not in (*UPDATED, "id", pos)]
    last = rows.select(F.col("_n").alias("_l"), *fresh)
    first = rows.select(F.col("_n").alias("_f"), *made)
    whole = target.join(last, F.col("_last._n") == F.col("_l")).join(first, F.col("_first._n") == F.col("_f"))
    return whole.select("surviving_id", "matched", *[c for c in incoming.columns if c not in ("id", pos)])


def upsert_postings(base: DataFrame, incoming: DataFrame, pos: str = "pos") -> DataFrame:
    """New snapshot of the store; ``change`` tells inserted, updated and kept rows apart."""
    new = resolve_incoming(base, incoming, pos)
    b = base.select(F.col("id").alias("_key"), F.struct(*base.columns).alias("_b"))
    n = new.select(F.col("surviving_id").alias("_key"), F.struct("*").alias("_n"))
    j = b.join(n, "_key", "full_outer")
    return j.select(*overlaid(base.columns, new.columns))


def overlaid(cols: list[str], incoming_cols: list[str]) -> list[Column]:
    """Columns of the new snapshot and ``change``, from ``_key``, the stored row ``_b`` and the resolved one ``_n``."""
    have_b, have_n = F.col("_b").isNotNull(), F.col("_n").isNotNull()

    def pick(c: str) -> Column:
        if c == "id":
            return F.col("_key")
        old = F.col("_b")[c]
        if c not in incoming_cols:
            return old
        fresh = F.col("_n")[c]
        if c in UPDATED:
            return F.when(have_n, fresh).otherwise(old)
        return F.when(have_b, old).otherwise(fresh)

    change = F.when(~have_n, "kept").when(have_b, "updated").otherwise("inserted")
    return [*[pick(c).alias(c) for c in cols], change.alias("change")]


def upsert_counts(merged: DataFrame) -> DataFrame:
    c = F.col("change")
    return merged.agg(
        F.count_if(c != "kept").alias("rows_written"),
        F.count_if(c == "inserted").alias("inserted"),
        F.count_if(c == "updated").alias("updated"),
    )


def upsert_keyed(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Overwrite by key: the update's row replaces the stored one whole."""
    b = base.select(F.col(key), F.struct(*[c for c in base.columns if c != key]).alias("_b"))
    u = updates.select(F.col(key), F.struct(*[c for c in base.columns if c != key]).alias("_u"))
    j = b.join(u, key, "full_outer").withColumn("_r", F.coalesce("_u", "_b"))
    return j.select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in base.columns])


def upsert_evaluations(base: DataFrame, updates: DataFrame) -> DataFrame:
    rounded = updates.withColumns(
        {
            "confidence": half_up(F.col("confidence")).cast("int"),
            "freshness_days": half_up(F.col("freshness_days")).cast("bigint"),
        }
    )
    return upsert_keyed(base, rounded, "job_id")


def upsert_status(base: DataFrame, updates: DataFrame, only_from: str | None = None) -> DataFrame:
    """Status merge: ``submitted_at`` is set by 'applied' and never cleared.

    ``only_from`` applies an update only where the stored status (missing = new) is that one,
    which is how opening a posting turns new into viewed.
    """
    u = updates.select(
        "job_id", F.struct("status", "notes", F.col("at").alias("at")).alias("_u")
    )
    b = base.select("job_id", F.struct(*[c for c in base.columns if c != "job_id"]).alias("_b"))
    j = b.join(u, "job_id", "full_outer")
    applies = F.col("_u").isNotNull()
    if only_from:
        applies = applies & (F.coalesce(F.col("_b.status"), F.lit("new")) == only_from)
    j = j.withColumn("_go", applies).filter(F.col("_go") | F.col("_b").isNotNull())
    go = F.col("_go")
    sent = F.when(F.col("_u.status") == "applied", F.col("_u.at"))
    return j.select(
        "job_id",
        F.when(go, F.col("_u.status")).otherwise(F.col("_b.status")).alias("status"),
        F.when(go, F.col("_u.notes")).otherwise(F.col("_b.notes")).alias("notes"),
        F.when(go, F.col("_u.at")).otherwise(F.col("_b.last_action_at")).alias("last_action_at"),
        F.when(go, F.coalesce(sent, F.col("_b.submitted_at")))
        .otherwise(F.col("_b.submitted_at"))
        .alias("submitted_at"),
    )


def restore_status(statuses: DataFrame, previous: DataFrame) -> DataFrame:
    """Put back the status a posting had before it was opened; an unknown (null) one changes nothing.

    ``previous``: job_id, previous_status - one row per posting.
    """
    p = previous.select("job_id", "previous_status")
    j = statuses.join(p, "job_id", "left").withColumn("status", F.coalesce("previous_status", "status"))
    return j.select(*statuses.columns)


# ---- status across duplicates -----------------------------------------------------------------

def inherited_status(postings: DataFrame, applications: DataFrame) -> DataFrame:
    """Status rows for postings without one whose duplicates have one.

    The latest action of the group wins, then the smallest id.
    """
    a = applications.select(packed(F.col("job_id")).alias("_id"), "status", "notes", "last_action_at")
    j = postings.select(packed(F.col("id")).alias("_id"), packed(F.col("normalized_hash")).alias("_hash")).join(a, "_id", "left")
    order = F.struct((-F.unix_micros("last_action_at")).alias("t"), unpacked(F.col("_id")).alias("i"))
    rep = (
        j.filter("status IS NOT NULL AND _hash IS NOT NULL")
        .groupBy("_hash")
        .agg(F.min_by(F.struct("status", "notes", "last_action_at"), order).alias("r"))
    )
    bare = j.filter("status IS NULL").select("_id", "_hash")
    got = join_one_per_key(bare, rep, "_hash").filter("r IS NOT NULL")
    return got.select(unpacked(F.col("_id")).alias("job_id"), "r.status", "r.notes", "r.last_action_at")


def propagate_status(postings: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates by hash -> updates by posting id; an unknown hash is kept as its own id.

    ``updates``: normalized_hash, status, notes, at - one row per hash.
    """
    keyed = updates.select("normalized_hash", F.struct("status", "notes", "at").alias("u"))
    ids = join_one_per_key(
        postings.select("id", "normalized_hash"), keyed, "normalized_hash"
    ).filter("u IS NOT NULL")
    unknown = keyed.join(
        postings.select("normalized_hash").distinct(), "normalized_hash", "left_anti"
    )
    out = ids.select(F.col("id").alias("job_id"), "u.*")
    return out.unionByName(unknown.select(F.col("normalized_hash").alias("job_id"), "u.*"))


# ---- deletes ----------------------------------------------------------------------------------

def prune_absent(
    postings: DataFrame, applications: DataFrame, surviving: DataFrame, sources: DataFrame
) -> DataFrame:
    """Ids to delete: unseen postings of the sources that ran, with status new or viewed."""
    status = applications.select(packed(F.col("job_id")).alias("_id"), "status")
    absent = (
        postings.join(sources.select("source_id"), "source_id", "left_semi")
        .select(packed(F.col("id")).alias("_id"))
        .join(surviving.select(packed(F.col("surviving_id")).alias("_id")), "_id", "left_anti")
        .join(status, "_id", "left")
    )
    return absent.filter(F.coalesce("status", F.lit("new")).isin("new", "viewed")).select(unpacked(F.col("_id")).alias("id"))


def drop_dependents(table: DataFrame, deleted: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows whose posting is not deleted."""
    return table.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def retention_policy_rows(spark, policy: dict[str, int | None] | None = None) -> DataFrame:
    days = policy or RETENTION_DAYS
    rows = ", ".join(
        f"('{s}', {'CAST(NULL AS INT)' if days.get(s) is None else int(days[s])})" for s in STATUSES
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(status, ttl_days)")


def retention(joined: DataFrame, policy: DataFrame, as_of: Column) -> DataFrame:
    """Add ``expired``: older than the time to live of its status; applied never expires.

    ``joined`` has status (missing = new), last_action_at, updated_at, created_at.
    """
    age = F.unix_micros(as_of) - F.unix_micros(
        F.coalesce("last_action_at", "updated_at", "created_at")
    )
    j = joined.withColumn("status", F.coalesce("status", F.lit("new"))).join(
        policy, "status", "left"
    )
    limit = F.col("ttl_days") * F.lit(86400000000)
    old = (F.col("ttl_days") > 0) & (age >= limit) & (F.col("status") != "applied")
    return j.withColumn("expired", F.coalesce(old, F.lit(False))).drop("ttl_days")


def retention_summary(marked: DataFrame) -> DataFrame:
    """Deleted per status (all listed), total and protected applied rows."""
    e, s = F.col("expired"), F.col("status")
    return marked.agg(
        *[F.count_if(e & (s == v)).alias(f"deleted_{v}") for v in STATUSES],
        F.count_if(e).alias("total_deleted"),
        F.count_if(s == "applied").alias("protected_applied"),
    )


# ---- deltas and run log -----------------------------------------------------------------------

def classify_delta(base: DataFrame, incoming: DataFrame, pos: str = "pos") -> DataFrame:
    """Incoming rows (first per id) marked new, updated or unchanged against the store."""
    cols = [c for c in SIGNATURE if c in base.columns and c in incoming.columns]
    sig, mine = signature(base, cols), signature(incoming, cols)
    b = base.select("id", "source_id", "source_url", sig.alias("_sig"))
    by_id = b.select("id", F.col("_sig").alias("_id_sig"))
    url_key = F.to_json(F.struct("source_id", "source_url"))
    by_url = b.select(url_key.alias("_uk"), F.col("_sig").alias("_url_sig"))
    # Rows meet as signatures, not with their payload.
    signed = incoming.select("id", "source_id", F.col(pos).alias("_pos"), mine.alias("_mine"), url_key.alias("_uk"))
    keyed = first_per_key(signed, ["id"], F.col("_pos")).join(by_id, "id", "left")
    j = join_one_per_key(keyed, by_url, "_uk")
    return j.select("id", "source_id", delta_of(F.coalesce("_id_sig", "_url_sig"), F.col("_mine")).alias("delta"))


def signature(df: DataFrame, cols: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[_canon(df, c) for c in cols]), {"ignoreNullFields": "false"}), 256)


def delta_of(old: Column, mine: Column) -> Column:
    """What a row is to the store, by the signature of its stored row (null = none) and its own."""
    return F.when(old.isNull(), "new").when(old == mine, "unchanged").otherwise("updated")


def _canon(df: DataFrame, c: str) -> Column:
    """Trimmed text with blanks as null; other types unchanged."""
    kind = dict(df.dtypes)[c]
    return (nonempty(F.trim(F.col(c))) if kind == "string" else F.col(c)).alias(c)


def delta_counts(classified: DataFrame) -> DataFrame:
    d = F.col("delta")
    return classified.groupBy("source_id").agg(
        F.count_if(d == "new").alias("new_count"),
        F.count_if(d == "updated").alias("updated_count"),
        F.count_if(d == "unchanged").alias("unchanged_count"),
    )


COUNTS = ["new_count", "updated_count", "unchanged_count", "imported_count"]


def run_log_rows(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows fit for the run log: run and source required, counts whole and not negative."""
    run, source = nonempty(F.trim("run_id")), nonempty(F.trim("source_id"))
    counts = {
        c: F.greatest(F.lit(0), half_up(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))).cast("bigint")
        for c in COUNTS
    }
    return rows.withColumns({"run_id": run, "source_id": source, **counts}).filter(
        "run_id IS NOT NULL AND source_id IS NOT NULL"
    ).withColumn("recorded_at", F.coalesce("recorded_at", as_of))


def latest_run(log: DataFrame) -> DataFrame:
    """Newest log row per source by (recorded_at, run_id)."""
    rest = [c for c in log.columns if c != "source_id"]
    top = log.groupBy("source_id").agg(
        F.max_by(F.struct(*rest), F.struct("recorded_at", "run_id")).alias("r")
    )
    return top.select("source_id", "r.*")


def run_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sources"), *[F.sum(c).alias(c) for c in COUNTS]
    )
