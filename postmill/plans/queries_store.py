"""Store merges, deltas, retention, refresh policy and event counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.core import iso
from postmill.operators import merge, run, throttle
from postmill.operators.identity import backfill_identity
from postmill.operators.settle import settle
from postmill.params import REFRESH_LABELS, REFRESH_POLICY, RISK_CLASS
from postmill.plans import bindings as b
from postmill.plans import queries_quality as qq
from postmill.plans import queries_score as qs
from postmill.plans import sqlkit as k
from postmill.plans.catalog import query
from postmill.plans.sqlkit import sql

AS_OF = b.AS_OF_POSTING

# ---- incoming batch -------------------------------------------------------------------------

_COLS = "source_type, source_id, source_url, external_id, title, company, location, posted_at, employment_type, easy_apply, salary_text, description, normalized_hash, structured_meta, metadata_quality_score, missing_required_fields, created_at, updated_at"
COLS = [c.strip() for c in _COLS.split(",")]


def b_incoming(spark, sf):
    """Changed, re-keyed, unchanged and new rows, some twice in the batch."""
    p = b.b_posting(spark, sf)
    m = F.col("num") % 10
    new = m == 9
    base = p.filter((m < 8) | new)
    shaped = base.withColumns(
        {
            "id": F.when(new, (F.col("num") + 1000000000).cast("string"))
            .when(m == 2, F.concat(F.lit("re"), F.col("id"))).otherwise(F.col("id")),
            "source_url": F.when(new, F.concat("source_url", F.lit("/new"))).otherwise(F.col("source_url")),
            "salary_text": F.when(m == 1, "$1").otherwise(F.col("salary_text")),
            # Rows that differ from the stored ones in a computed column alone, and in blanks alone.
            "structured_meta": F.when(m == 4, "{}").otherwise(F.col("structured_meta")),
            "metadata_quality_score": F.when(m == 5, 50).otherwise(F.col("metadata_quality_score")),
            "missing_required_fields": F.when(m == 6, F.array(F.lit("location"), F.lit("salary"))).otherwise(F.col("missing_required_fields")),
            "title": F.when(m == 7, F.concat(F.lit(" "), "title", F.lit(" "))).otherwise(F.col("title")),
            "updated_at": b.ts(AS_OF),
        }
    )
    first = shaped.withColumn("pos", F.col("num"))
    again = shaped.filter(m == 3).withColumns(
        {"pos": F.col("num") + 2000000000, "location": F.lit("second copy")}
    )
    return first.unionByName(again).select("id", "pos", *COLS)


k.cte(
    "b_incoming", "b_posting",
    f"""SELECT id, pos, {_COLS} FROM (SELECT * EXCLUDE (id, source_url, salary_text, updated_at, structured_meta, metadata_quality_score, missing_required_fields, title), num AS pos,
  CASE WHEN num % 10 = 4 THEN '{{}}' ELSE structured_meta END AS structured_meta, CASE WHEN num % 10 = 5 THEN 50 ELSE metadata_quality_score END AS metadata_quality_score,
  CASE WHEN num % 10 = 6 THEN ['location', 'salary'] ELSE missing_required_fields END AS missing_required_fields, CASE WHEN num % 10 = 7 THEN ' ' || title || ' ' ELSE title END AS title,
  CASE WHEN num % 10 = 9 THEN CAST(num + 1000000000 AS VARCHAR) WHEN num % 10 = 2 THEN 're' || id ELSE id END AS id,
  CASE WHEN num % 10 = 9 THEN source_url || '/new' ELSE source_url END AS source_url, CASE WHEN num % 10 = 1 THEN '$1' ELSE salary_text END AS salary_text,
  CAST('{AS_OF}' AS TIMESTAMP) AS updated_at FROM b_posting WHERE num % 10 < 8 OR num % 10 = 9)
UNION ALL SELECT id, num + 2000000000 AS pos, {_COLS.replace('location', "'second copy' AS location").replace('updated_at', f"CAST('{AS_OF}' AS TIMESTAMP) AS updated_at")} FROM b_posting WHERE num % 10 = 3""",
)
k.cte(
    "b_resolved", "b_incoming b_posting",
    """SELECT * FROM (SELECT i.*, coalesce(p1.id, p2.id, i.id) AS surviving_id, p1.id IS NOT NULL OR p2.id IS NOT NULL AS matched,
  row_number() OVER (PARTITION BY coalesce(p1.id, p2.id, i.id) ORDER BY pos DESC) AS rn
 FROM b_incoming i LEFT JOIN b_posting p1 ON p1.id = i.id LEFT JOIN b_posting p2 ON p2.source_id = i.source_id AND p2.source_url = i.source_url) WHERE rn = 1""",
)
_UP = [c for c in COLS if c in merge.UPDATED]
k.cte(
    "b_merged", "b_resolved b_posting",
    f"""SELECT coalesce(p.id, r.surviving_id) AS id, {', '.join(f'CASE WHEN r.surviving_id IS NOT NULL THEN r.{c} ELSE p.{c} END AS {c}' if c in _UP else f'CASE WHEN p.id IS NOT NULL THEN p.{c} ELSE r.{c} END AS {c}' for c in COLS)},
 CASE WHEN r.surviving_id IS NULL THEN 'kept' WHEN p.id IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM b_posting p FULL JOIN b_resolved r ON r.surviving_id = p.id""",
)


def stored(spark, sf):
    return b.b_posting(spark, sf).select("id", *COLS)


@query("q_upsert", sql("b_merged", f"SELECT id, change, source_url, title, location, salary_text, external_id, {k.iso('created_at')} AS created_at, {k.iso('updated_at')} AS updated_at FROM b_merged"))
def q_upsert(spark, sf):
    m = merge.upsert_postings(stored(spark, sf), b_incoming(spark, sf))
    return m.select(
        "id", "change", "source_url", "title", "location", "salary_text", "external_id",
        iso(F.col("created_at")).alias("created_at"), iso(F.col("updated_at")).alias("updated_at"),
    )


@query("q_upsert_counts", sql("b_merged", "SELECT count(*) FILTER (WHERE change <> 'kept') AS rows_written, count(*) FILTER (WHERE change = 'inserted') AS inserted, count(*) FILTER (WHERE change = 'updated') AS updated FROM b_merged"))
def q_upsert_counts(spark, sf):
    return merge.upsert_counts(merge.upsert_postings(stored(spark, sf), b_incoming(spark, sf)))


_SIG = [c for c in merge.SIGNATURE if c in COLS]


def _trimmed(c, t):
    return f"trim({t}.title)" if c == "title" else f"{t}.{c}"


k.cte(
    "b_delta", "b_incoming b_posting",
    f"""SELECT i.id, i.source_id, CASE WHEN p1.id IS NULL AND p2.id IS NULL THEN 'new'
  WHEN {' AND '.join(f'{_trimmed(c, "i")} IS NOT DISTINCT FROM CASE WHEN p1.id IS NOT NULL THEN p1.{c} ELSE p2.{c} END' for c in _SIG)} THEN 'unchanged' ELSE 'updated' END AS delta
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM b_incoming) WHERE rn = 1) i
LEFT JOIN b_posting p1 ON p1.id = i.id LEFT JOIN b_posting p2 ON p2.source_id = i.source_id AND p2.source_url = i.source_url""",
)


@query("q_delta", sql("b_delta", "SELECT source_id, count(*) FILTER (WHERE delta = 'new') AS new_count, count(*) FILTER (WHERE delta = 'updated') AS updated_count, count(*) FILTER (WHERE delta = 'unchanged') AS unchanged_count FROM b_delta GROUP BY 1"))
def q_delta(spark, sf):
    return merge.delta_counts(merge.classify_delta(stored(spark, sf), b_incoming(spark, sf)))


@query("q_delta_rows", sql("b_delta", "SELECT id, delta FROM b_delta"))
def q_delta_rows(spark, sf):
    return merge.classify_delta(stored(spark, sf), b_incoming(spark, sf)).select("id", "delta")


@query(
    "q_upsert_eval",
    sql("b_eval", "SELECT job_id, CASE WHEN n % 3 = 0 THEN n % 101 ELSE score END AS score, CASE WHEN n % 3 = 0 THEN CAST(floor(n % 50 + 0.6 + 0.5) AS INT) ELSE confidence END AS confidence FROM (SELECT *, CAST(job_id AS INT) AS n FROM b_eval) UNION ALL SELECT 'x' || o_orderkey, 7, 1 FROM orders WHERE o_orderkey % 50 = 0"),
)
def q_upsert_eval(spark, sf):
    base = qs.b_eval(spark, sf).select("job_id", "score", "confidence", "freshness_days")
    n = F.col("job_id").cast("int")
    changed = base.filter(n % 3 == 0).select(
        "job_id", (n % 101).alias("score"), (n % 50 + F.lit(0.6)).alias("confidence"),
        F.lit(None).cast("double").alias("freshness_days"),
    )
    new = b.table(spark, sf, "orders").filter("o_orderkey % 50 = 0").select(
        F.concat(F.lit("x"), "o_orderkey").alias("job_id"), F.lit(7).alias("score"),
        F.lit(0.9).alias("confidence"), F.lit(2.4).alias("freshness_days"),
    )
    return merge.upsert_evaluations(base, changed.unionByName(new)).select(
        "job_id", "score", "confidence"
    )


def _updates(spark, sf):
    key = F.col("o_orderkey")
    return b.table(spark, sf, "orders").filter(key % 4 == 0).select(
        key.cast("string").alias("job_id"),
        F.when(key % 8 == 0, "applied").otherwise("viewed").alias("status"),
        F.lit("moved").alias("notes"), b.ts(AS_OF).alias("at"),
    )


@query(
    "q_status_upsert",
    sql("b_status", f"""SELECT coalesce(s.job_id, u.job_id) AS job_id, CASE WHEN u.job_id IS NOT NULL THEN u.status ELSE s.status END AS status, CASE WHEN u.job_id IS NOT NULL THEN 'moved' ELSE s.notes END AS notes,
 {k.iso(f"CASE WHEN u.job_id IS NOT NULL THEN CAST('{AS_OF}' AS TIMESTAMP) ELSE s.last_action_at END")} AS last_action_at,
 {k.iso(f"CASE WHEN u.status = 'applied' THEN CAST('{AS_OF}' AS TIMESTAMP) ELSE s.submitted_at END")} AS submitted_at
FROM b_status s FULL JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 8 = 0 THEN 'applied' ELSE 'viewed' END AS status FROM orders WHERE o_orderkey % 4 = 0) u ON u.job_id = s.job_id"""),
)
def q_status_upsert(spark, sf):
    m = merge.upsert_status(b.b_status(spark, sf), _updates(spark, sf))
    return m.withColumns({c: iso(F.col(c)) for c in ("last_action_at", "submitted_at")})


@query(
    "q_mark_viewed",
    sql("b_status", """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, coalesce(s.status, 'viewed') AS status FROM orders LEFT JOIN b_status s ON s.job_id = CAST(o_orderkey AS VARCHAR)
 WHERE s.job_id IS NOT NULL OR o_orderkey % 4 = 0"""),
)
def q_mark_viewed(spark, sf):
    opened = _updates(spark, sf).withColumn("status", F.lit("viewed"))
    return merge.upsert_status(b.b_status(spark, sf), opened, only_from="new").select(
        "job_id", "status"
    )


@query(
    "q_restore_status",
    sql("b_status", "SELECT job_id, CASE CAST(job_id AS BIGINT) % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'skip_for_now' ELSE status END AS status, notes FROM b_status"),
)
def q_restore_status(spark, sf):
    s, n = b.b_status(spark, sf), F.col("job_id").cast("bigint") % 3
    before = s.select("job_id", F.when(n == 0, "new").when(n == 1, "skip_for_now").alias("previous_status"))
    return merge.restore_status(s, before).select("job_id", "status", "notes")


@query(
    "q_inherit_status",
    sql("b_posting b_status", f"""SELECT p.id AS job_id, r.status, r.notes, {k.iso('r.last_action_at')} AS last_action_at FROM b_posting p JOIN
 (SELECT * FROM (SELECT normalized_hash, s.*, row_number() OVER (PARTITION BY normalized_hash ORDER BY last_action_at DESC, job_id) AS rn FROM b_status s JOIN b_posting p ON p.id = s.job_id) WHERE rn = 1) r
 ON r.normalized_hash = p.normalized_hash WHERE p.id NOT IN (SELECT job_id FROM b_status)"""),
)
def q_inherit_status(spark, sf):
    got = merge.inherited_status(b.b_posting(spark, sf), b.b_status(spark, sf))
    return got.withColumn("last_action_at", iso(F.col("last_action_at")))


k.cte("b_hash_update", "b_posting", "SELECT normalized_hash, CASE WHEN max(num) % 2 = 0 THEN 'rejected' ELSE 'applied' END AS status FROM b_posting GROUP BY 1 HAVING max(num) % 5 = 0 UNION ALL SELECT sha256('gone' || o_orderkey), 'viewed' FROM orders WHERE o_orderkey % 100 = 0")


@query("q_propagate_status", sql("b_posting b_hash_update", "SELECT coalesce(p.id, u.normalized_hash) AS job_id, u.status FROM b_hash_update u LEFT JOIN b_posting p ON p.normalized_hash = u.normalized_hash"))
def q_propagate_status(spark, sf):
    p = b.b_posting(spark, sf)
    top = p.groupBy("normalized_hash").agg(F.max("num").alias("m")).filter("m % 5 = 0")
    known = top.select("normalized_hash", F.when(F.col("m") % 2 == 0, "rejected").otherwise("applied").alias("status"))
    gone = b.table(spark, sf, "orders").filter("o_orderkey % 100 = 0").select(
        F.sha2(F.concat(F.lit("gone"), "o_orderkey"), 256).alias("normalized_hash"), F.lit("viewed").alias("status")
    )
    updates = known.unionByName(gone).withColumns({"notes": F.lit(""), "at": b.ts(AS_OF)})
    return merge.propagate_status(p, updates).select("job_id", "status")


k.cte("b_pruned", "b_resolved b_posting b_status", """SELECT p.id FROM b_posting p LEFT JOIN b_status s ON s.job_id = p.id WHERE p.source_id IN ('src0', 'src1', 'src2', 'src3', 'src4')
 AND p.id NOT IN (SELECT surviving_id FROM b_resolved) AND coalesce(s.status, 'new') IN ('new', 'viewed')""")


@query("q_prune", sql("b_pruned b_status", "SELECT id, 'posting' AS part FROM b_pruned UNION ALL SELECT job_id, 'status kept' FROM b_status WHERE job_id NOT IN (SELECT id FROM b_pruned)"))
def q_prune(spark, sf):
    p, s = stored(spark, sf), b.b_status(spark, sf)
    ran = b.b_source(spark).filter("source_id <= 'src4'")
    alive = merge.resolve_incoming(p, b_incoming(spark, sf))
    gone = merge.prune_absent(p, s, alive, ran)
    left = merge.drop_dependents(s, gone)
    return gone.select("id", F.lit("posting").alias("part")).unionByName(
        left.select(F.col("job_id").alias("id"), F.lit("status kept").alias("part"))
    )


k.cte(
    "b_retention", "b_posting b_status",
    f"""SELECT p.id, coalesce(s.status, 'new') AS status, coalesce(ttl > 0 AND epoch_us(CAST('{AS_OF}' AS TIMESTAMP)) - epoch_us(coalesce(s.last_action_at, p.updated_at)) >= ttl * 86400000000 AND coalesce(s.status, 'new') <> 'applied', false) AS expired
FROM b_posting p LEFT JOIN b_status s ON s.job_id = p.id LEFT JOIN (VALUES ('new', 30), ('viewed', 45), ('skip_for_now', 21), ('rejected', 14), ('applied', NULL)) AS v(st, ttl) ON v.st = coalesce(s.status, 'new')""",
)


def retention(spark, sf):
    s = b.b_status(spark, sf).select(F.col("job_id").alias("id"), "status", "last_action_at")
    joined = b.b_posting(spark, sf).join(s, "id", "left")
    return merge.retention(joined, merge.retention_policy_rows(spark), b.ts(AS_OF))


@query("q_retention", sql("b_retention", "SELECT id, status, CAST(expired AS INT) AS expired FROM b_retention"))
def q_retention(spark, sf):
    return retention(spark, sf).select("id", "status", F.col("expired").cast("int").alias("expired"))


@query("q_retention_summary", sql("b_retention", "SELECT " + ", ".join(f"count(*) FILTER (WHERE expired AND status = '{s}') AS deleted_{s}" for s in ("new", "viewed", "applied", "skip_for_now", "rejected")) + ", count(*) FILTER (WHERE expired) AS total_deleted, count(*) FILTER (WHERE status = 'applied') AS protected_applied FROM b_retention"))
def q_retention_summary(spark, sf):
    return merge.retention_summary(retention(spark, sf))


@query(
    "q_backfill",
    sql("b_posting", f"""SELECT id, sha256(CASE WHEN source_type = 'linkedin_capture_file' THEN 'linkedin:' || lower(c2) || '|' || lower(title) WHEN external_id IS NOT NULL THEN source_type || ':external:' || lower(external_id) ELSE 'url:' || lower(source_url) END) AS normalized_hash,
  c2 AS company, l2 AS location FROM (SELECT *, CASE WHEN num % 6 = 0 THEN location ELSE company END AS c2, CASE WHEN num % 6 = 0 THEN NULL ELSE location END AS l2 FROM b_posting)"""),
)
def q_backfill(spark, sf):
    p = stored(spark, sf).withColumn(
        "company", F.when(F.col("id").cast("int") % 6 == 0, F.upper("title")).otherwise(F.col("company"))
    )
    return backfill_identity(p).select("id", "normalized_hash", "company", "location")


# ---- run log --------------------------------------------------------------------------------

k.cte(
    "b_log", "b_raw_run",
    f"""SELECT source_id, run_id, CAST(greatest(0, floor(nw + 0.5)) AS BIGINT) AS new_count, CAST(greatest(0, up) AS BIGINT) AS updated_count, 0::BIGINT AS unchanged_count, CAST(n AS BIGINT) AS imported_count,
 coalesce(recorded, CAST('{b.AS_OF_RAW}' AS TIMESTAMP)) AS recorded_at FROM (SELECT source_id, run_id, count(*) / 2.0 AS nw, count(*) - 20 AS up, count(*) AS n, CASE WHEN count(*) % 9 <> 0 THEN max(seen_at) END AS recorded FROM b_raw_run GROUP BY 1, 2) WHERE n % 7 <> 0""",
)


def run_log(spark, sf):
    n = F.count(F.lit(1))
    rows = qq.raw_runs(spark, sf).groupBy("source_id", "run_id").agg(
        (n / 2).alias("new_count"), (n - 20).alias("updated_count"),
        F.lit("n/a").alias("unchanged_count"), n.alias("imported_count"),
        F.when(n % 9 != 0, F.max("seen_at")).alias("recorded_at"),
    )
    blank = rows.withColumn(
        "run_id", F.when(F.col("imported_count") % 7 != 0, F.col("run_id")).otherwise("  ")
    )
    return merge.run_log_rows(blank, b.ts(b.AS_OF_RAW))


_LOG = f"source_id, run_id, new_count, updated_count, unchanged_count, imported_count, {k.iso('recorded_at')} AS recorded_at"


def _log_out(df):
    return df.select(
        "source_id", "run_id", *merge.COUNTS, iso(F.col("recorded_at")).alias("recorded_at")
    )


@query("q_run_log", sql("b_log", f"SELECT {_LOG} FROM b_log"))
def q_run_log(spark, sf):
    return _log_out(run_log(spark, sf))


@query("q_latest_run", sql("b_log", f"SELECT {_LOG} FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY recorded_at DESC, run_id DESC) AS rn FROM b_log) WHERE rn = 1"))
def q_latest_run(spark, sf):
    return _log_out(merge.latest_run(run_log(spark, sf)))


@query("q_run_totals", sql("b_log", "SELECT split_part(run_id, '|', 2) AS run_id, count(*) AS sources, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in merge.COUNTS) + " FROM b_log GROUP BY 1"))
def q_run_totals(spark, sf):
    week = F.element_at(F.split("run_id", r"\|"), 2)
    return merge.run_totals(run_log(spark, sf).withColumn("run_id", week))


# ---- a whole run ----------------------------------------------------------------------------

# Two refreshes; the weeks between the two dates are captured by both.
FIRST_UNTIL, SECOND_FROM = "2000-07-03 00:00:00", "2000-05-01 00:00:00"
RUN_DAYS = {"new": 1500, "viewed": 1800, "skip_for_now": 900, "rejected": 700, "applied": None}


def captured(spark, sf):
    """Raw rows of weekly runs as a refresh reads them. A posting is known by its URL."""
    rows = qq.raw_runs(spark, sf).withColumns({"external_id": F.lit(None).cast("string"), "retrieved_at": F.col("seen_at")})
    return rows.select(
        "source_id", "source_type", "run_id", "pos", "captured_at", "retrieved_at", "external_id", "title", "company", "location",
        "posted_at", "employment_type", "salary_text", "summary", "description", "url",
    )


def acted_on(postings):
    """Statuses someone gave to four sevenths of the postings, by id."""
    n = F.conv(F.substring("id", 1, 6), 16, 10).cast("bigint") % 7
    return postings.withColumn("_n", n).filter("_n < 4").select(
        F.col("id").alias("job_id"),
        F.when(F.col("_n") == 0, "applied").when(F.col("_n") == 1, "rejected").when(F.col("_n") == 2, "skip_for_now").otherwise("viewed").alias("status"),
        F.concat(F.lit("note "), F.col("_n").cast("string")).alias("notes"), F.col("updated_at").alias("last_action_at"),
        F.when(F.col("_n") == 0, F.col("updated_at")).alias("submitted_at"),
    )


def two_runs(spark, sf):
    """The second of two refreshes: the store of the first, with statuses, meets later captures."""
    raw, as_of, policy = captured(spark, sf), b.ts(b.AS_OF_RAW), merge.retention_policy_rows(spark, RUN_DAYS)

    def one(rows, store, statuses, *spent):
        rows = rows.drop("captured_at")
        runs = rows.select(*qq.KEYS).distinct().withColumn("expected_count", F.lit(qq.EXPECTED))
        return run.refresh(store, statuses, rows, as_of, runs, policy, qq.TIGHT, spent=spent)

    nothing = spark.createDataFrame([], "job_id string, status string, notes string, last_action_at timestamp, submitted_at timestamp")
    first = one(raw.filter(F.col("captured_at") < b.ts(FIRST_UNTIL)), None, nothing)
    statuses = settle(acted_on(first.postings), "statuses")
    return one(raw.filter(F.col("captured_at") >= b.ts(SECOND_FROM)), first.postings, statuses, first.table)


_TTL = "CASE {} " + " ".join(f"WHEN '{s}' THEN {d if d else 'NULL'}" for s, d in RUN_DAYS.items()) + " END"
_AGE = f"epoch_us(CAST('{b.AS_OF_RAW}' AS TIMESTAMP)) - epoch_us({{}})"
_SAME = ["source_url", "title", "company", "location", "posted_at", "employment_type", "salary_text", "description", "hash"]
k.cte(
    "b_run_row", "b_raw_run b_outcome",
    rf"""SELECT *, sha256(source_id || '|' || source_url) AS id,
  sha256(CASE WHEN source_type = 'linkedin_capture_file' THEN 'linkedin:' || lower(company) || '|' || lower(title) ELSE 'url:' || lower(source_url) END) AS hash
FROM (SELECT r.source_id, r.source_type, r.run_id, r.captured_at, r.pos, r.seen_at, {k.ws('r.title')} AS title, {k.ws('r.company')} AS company, r.location, r.posted_at, r.employment_type, r.salary_text,
  {k.ws('r.description')} AS description, regexp_replace(r.url, '[?#].*$', '') AS source_url FROM b_raw_run r JOIN b_outcome o ON o.run_id = r.run_id WHERE o.outcome = 'accept')""",
)
k.cte(
    "b_run_store", "b_run_row",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS rn FROM b_run_row WHERE captured_at < TIMESTAMP '{FIRST_UNTIL}')
 WHERE rn = 1 AND {_AGE.format('seen_at')} < {RUN_DAYS['new']} * 86400000000""",
)
k.cte(
    "b_run_status", "b_run_store",
    """SELECT id AS job_id, CASE n WHEN 0 THEN 'applied' WHEN 1 THEN 'rejected' WHEN 2 THEN 'skip_for_now' ELSE 'viewed' END AS status, 'note ' || n AS notes, seen_at AS at
 FROM (SELECT *, CAST('0x' || id[1:6] AS BIGINT) % 7 AS n FROM b_run_store) WHERE n < 4""",
)
k.cte("b_run_later", "b_run_row", f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS first, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS last FROM b_run_row WHERE captured_at >= TIMESTAMP '{SECOND_FROM}'")
k.cte(
    "b_run_delta", "b_run_later b_run_store",
    f"""SELECT l.id, l.source_id, CASE WHEN s.id IS NULL THEN 'new' WHEN {' AND '.join(f's.{c} IS NOT DISTINCT FROM l.{c}' for c in _SAME)} THEN 'unchanged' ELSE 'updated' END AS delta
 FROM b_run_later l LEFT JOIN b_run_store s ON s.id = l.id WHERE l.first = 1""",
)
k.cte(
    "b_run_merged", "b_run_later b_run_store",
    "SELECT coalesce(l.id, s.id) AS id, l.id IS NOT NULL AS seen, " + ", ".join(f"CASE WHEN l.id IS NULL THEN s.{c} ELSE l.{c} END AS {c}" for c in [*_SAME, "source_id", "seen_at"])
    + " FROM b_run_store s FULL JOIN (SELECT * FROM b_run_later WHERE last = 1) l ON l.id = s.id",
)
k.cte(
    "b_run_all_status", "b_run_merged b_run_status",
    """SELECT *, false AS inherited FROM b_run_status UNION ALL
SELECT m.id, r.status, r.notes, r.at, true FROM b_run_merged m JOIN (SELECT hash, s.*, row_number() OVER (PARTITION BY hash ORDER BY s.at DESC, job_id) AS rn FROM b_run_status s JOIN b_run_merged m ON m.id = s.job_id) r
 ON r.hash = m.hash AND r.rn = 1 WHERE m.id NOT IN (SELECT job_id FROM b_run_status)""",
)
k.cte(
    "b_run_end", "b_run_merged b_run_all_status b_run_status b_run_later",
    f"""SELECT m.*, a.status, a.notes, CASE WHEN NOT seen AND m.source_id IN (SELECT source_id FROM b_run_later) AND coalesce(s.status, 'new') IN ('new', 'viewed') THEN 'absent'
  WHEN {_AGE.format('coalesce(a.at, m.seen_at)')} >= {_TTL.format("coalesce(a.status, 'new')")} * 86400000000 THEN 'expired' END AS why
 FROM b_run_merged m LEFT JOIN b_run_all_status a ON a.job_id = m.id LEFT JOIN b_run_status s ON s.job_id = m.id""",
)


@query(
    "q_run",
    sql("b_run_end", f"SELECT id, source_id, source_url, title, salary_text, {k.iso('seen_at')} AS updated_at, status, notes FROM b_run_end WHERE why IS NULL"),
)
def q_run(spark, sf):
    after = two_runs(spark, sf)
    statuses = after.applications.select(F.col("job_id").alias("id"), "status", "notes")
    kept = after.postings.withColumn("updated_at", iso(F.col("updated_at"))).join(statuses, "id", "left")
    return kept.select("id", "source_id", "source_url", "title", "salary_text", "updated_at", "status", "notes")


@query(
    "q_run_effects",
    sql("b_run_end b_run_delta b_run_later", """SELECT source_id, 'deleted ' || why AS effect, count(*) AS n FROM b_run_end WHERE why IS NOT NULL GROUP BY ALL
UNION ALL SELECT source_id, delta, count(*) FROM b_run_delta GROUP BY ALL
UNION ALL SELECT source_id, 'logged ' || max(run_id), count(DISTINCT id) FROM b_run_later GROUP BY 1"""),
)
def q_run_effects(spark, sf):
    after = two_runs(spark, sf)
    gone = after.deleted.join(after.merged.select("id", "source_id"), "id").select("source_id", F.concat(F.lit("deleted "), "why").alias("effect"))
    counts = gone.unionByName(after.deltas.select("source_id", F.col("delta").alias("effect"))).groupBy("source_id", "effect").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(after.log.select("source_id", F.concat(F.lit("logged "), "run_id").alias("effect"), F.col("imported_count").alias("n")))


# ---- refresh policy -------------------------------------------------------------------------

_RISK = "CASE source_type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in RISK_CLASS.items()) + " ELSE 'public_standard' END"


def _pol(profile, i):
    return "CASE risk_class " + " ".join(f"WHEN '{c}' THEN {v[i]}" for (p, c), v in REFRESH_POLICY.items() if p == profile) + " END"


def _policy_cte(profile):
    return f"SELECT *, {_pol(profile, 0)} AS min_interval, {_pol(profile, 1)} AS daily_cap, {_pol(profile, 2)} AS cooldown FROM (SELECT *, {_RISK} AS risk_class FROM b_refresh)"


k.cte("b_policy_safe", "b_refresh", _policy_cte("safe"))
k.cte("b_policy_probe", "b_refresh", _policy_cte("probe"))
NOW = "2024-01-30 12:00:00"
_NOW = f"epoch_us(CAST('{NOW}' AS TIMESTAMP))"
_D = 86400000000


@query("q_refresh_policy", sql("b_policy_safe b_policy_probe", "SELECT event_id, p.risk_class, p.min_interval, p.daily_cap, p.cooldown, s.min_interval AS safe_interval FROM b_policy_probe p JOIN b_policy_safe s USING (event_id)"))
def q_refresh_policy(spark, sf):
    safe = throttle.with_policy(b.b_refresh(spark, sf), "safe").withColumnRenamed("min_interval", "safe_interval")
    return throttle.with_policy(safe, " Probe").select(
        "event_id", "risk_class", "min_interval", "daily_cap", "cooldown", "safe_interval"
    )


k.cte(
    "b_state", "b_policy_probe",
    f"""SELECT source_id, max(source_type) AS source_type, max(min_interval) AS min_interval, max(daily_cap) AS daily_cap, max(CASE WHEN outcome = 'success' THEN epoch_us(at_ts) END) AS last_live,
 max(CASE WHEN outcome = 'challenge' THEN epoch_us(at_ts) + cooldown::BIGINT * 60000000 END) AS cooldown_until, count(*) FILTER (WHERE epoch_us(at_ts) // {_D} = {_NOW} // {_D}) AS events_today,
 count(*) FILTER (WHERE epoch_us(at_ts) // {_D} = {_NOW} // {_D} AND mode = 'manual') AS manual_today FROM b_policy_probe WHERE epoch_us(at_ts) <= {_NOW} GROUP BY 1""",
)


def state(spark, sf):
    e = b.b_refresh(spark, sf).filter(F.col("at") <= b.ts(NOW))
    return throttle.refresh_state(e, b.ts(NOW), "probe")


@query("q_refresh_state", sql("b_state", "SELECT source_id, last_live, cooldown_until, events_today, manual_today FROM b_state"))
def q_refresh_state(spark, sf):
    return state(spark, sf).drop("source_type")


@query("q_daily_events", sql("b_refresh", "SELECT source_id, CAST(at_ts AS DATE) AS day, mode, count(*) AS n FROM b_refresh GROUP BY ALL"))
def q_daily_events(spark, sf):
    return throttle.daily_events(b.b_refresh(spark, sf))


def _judge(now):
    opens = "last_live + min_interval::BIGINT * 60000000"
    return f"""CASE WHEN cooldown_until > {now} THEN 'cooldown' WHEN events_today >= daily_cap THEN 'daily_cap' WHEN {opens} > {now} THEN 'min_interval' ELSE 'eligible' END AS reason,
 CASE WHEN cooldown_until > {now} THEN cooldown_until WHEN events_today >= daily_cap THEN ({now} // {_D} + 1) * {_D} WHEN {opens} > {now} THEN {opens} END AS next_eligible"""


k.cte("b_eligible", "b_state", f"SELECT *, {_judge(_NOW)} FROM b_state")


@query("q_refresh_eligible", sql("b_eligible", "SELECT source_id, reason, CAST(next_eligible AS BIGINT) AS next_eligible FROM b_eligible"))
def q_refresh_eligible(spark, sf):
    s = throttle.with_policy(state(spark, sf), "probe")
    now = F.unix_micros(b.ts(NOW))
    return throttle.eligibility(s, now).select("source_id", "reason", "next_eligible")


_LABEL = "CASE status_reason " + " ".join(f"WHEN '{a}' THEN '{z}'" for a, z in REFRESH_LABELS.items()) + " ELSE 'cache_only' END"
k.cte(
    "b_decided", "b_eligible",
    f"""SELECT *, {_LABEL} AS status_label, CASE WHEN status_reason IN ('eligible', 'force_refresh') THEN 'live' ELSE 'cache' END AS served_from, CASE WHEN status_reason NOT IN ('eligible', 'force_refresh') THEN next_eligible END AS next_at
FROM (SELECT *, CASE WHEN force = 0 AND CAST(source_id AS INT) % 6 = 0 THEN 'cache_fresh' WHEN reason = 'eligible' THEN CASE force WHEN 0 THEN 'eligible' ELSE 'force_refresh' END
  WHEN reason = 'min_interval' AND force = 1 THEN 'force_refresh' ELSE reason END AS status_reason FROM b_eligible, (VALUES (0), (1)) AS v(force))""",
)


def decided(spark, sf, force):
    s = throttle.with_policy(state(spark, sf), "probe")
    fresh = F.col("source_id").cast("int") % 6 == 0
    return throttle.refresh_decision(throttle.eligibility(s, F.unix_micros(b.ts(NOW))), fresh, force)


@query("q_refresh_decision", sql("b_decided", "SELECT source_id, force, status_reason, status_label, served_from, CAST(next_at AS BIGINT) AS next_eligible FROM b_decided"))
def q_refresh_decision(spark, sf):
    cols = ["source_id", "status_reason", "status_label", "served_from", "next_eligible"]
    a, z = (decided(spark, sf, f).select(*cols, F.lit(int(f)).alias("force")) for f in (False, True))
    return a.unionByName(z)


@query(
    "q_manual_cap",
    sql("b_decided", f"""SELECT source_id, CAST(rem AS BIGINT) AS manual_remaining, CAST(nxt AS BIGINT) AS manual_next, CASE WHEN rem <= 0 THEN 'manual_daily_cap' WHEN next_at IS NOT NULL THEN status_reason END AS manual_blocked, CAST(nxt IS NULL AS INT) AS manual_allowed
FROM (SELECT *, CASE WHEN rem <= 0 THEN ({_NOW} // {_D} + 1) * {_D} ELSE next_at END AS nxt FROM (SELECT *, greatest(0, 3 - manual_today) AS rem FROM b_decided WHERE force = 0))"""),
)
def q_manual_cap(spark, sf):
    m = throttle.manual_refresh(decided(spark, sf, False), F.lit(True), F.unix_micros(b.ts(NOW)))
    return m.select(
        "source_id", "manual_remaining", "manual_next", "manual_blocked",
        F.col("manual_allowed").cast("int").alias("manual_allowed"),
    )


k.cte(
    "b_audit", "b_policy_probe",
    f"""SELECT event_id, source_id, {_judge('us')}, events_today FROM (SELECT *, epoch_us(at_ts) AS us,
  max(CASE WHEN outcome = 'success' THEN epoch_us(at_ts) END) OVER w AS last_live, max(CASE WHEN outcome = 'challenge' THEN epoch_us(at_ts) + cooldown::BIGINT * 60000000 END) OVER w AS cooldown_until,
  count(*) OVER (PARTITION BY source_id, CAST(at_ts AS DATE) ORDER BY at_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS events_today
 FROM b_policy_probe WINDOW w AS (PARTITION BY source_id ORDER BY at_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)


@query("q_refresh_audit", sql("b_audit", "SELECT event_id, source_id, reason, CAST(next_eligible AS BIGINT) AS next_eligible, events_today FROM b_audit"))
def q_refresh_audit(spark, sf):
    return throttle.refresh_audit(b.b_refresh(spark, sf), "probe").select(
        "event_id", "source_id", "reason", "next_eligible", "events_today"
    )


_CH = r"(?i)\b(?:captcha|verify (?:you(?:''|’)re|you are) human|are you human|unusual traffic|bot protection|automated quer(?:y|ies)|access denied|temporarily blocked)\b"


@query(
    "q_challenge",
    sql("b_doc", f"""SELECT doc_id, CASE WHEN regexp_matches(m, '{_CH}') THEN 'challenge' ELSE 'transient_error' END AS outcome
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN description || ' Please complete the CAPTCHA.' WHEN 1 THEN 'Unusual Traffic ' || description WHEN 2 THEN description || ' recaptchas' ELSE description END AS m FROM b_doc)"""),
)
def q_challenge(spark, sf):
    m, d = F.col("doc_id") % 4, F.col("description")
    message = (
        F.when(m == 0, F.concat(d, F.lit(" Please complete the CAPTCHA.")))
        .when(m == 1, F.concat(F.lit("Unusual Traffic "), d))
        .when(m == 2, F.concat(d, F.lit(" recaptchas")))
        .otherwise(d)
    )
    return b.b_doc(spark, sf).select("doc_id", throttle.error_outcome(message).alias("outcome"))


# ---- counters -------------------------------------------------------------------------------


@query("q_event_counters", sql("b_event", "SELECT 'total' AS scope, '' AS name, count(*) AS n FROM b_event UNION ALL SELECT 'event', event, count(*) FROM b_event GROUP BY event UNION ALL SELECT 'channel', channel, count(*) FROM b_event GROUP BY channel"))
def q_event_counters(spark, sf):
    return throttle.event_counters(b.b_event(spark, sf))


@query(
    "q_quota",
    sql("b_event", """SELECT distinct_id, plan, v AS views_today, s AS searches_month, CASE WHEN plan = 'free' THEN greatest(0, 10 - v) END AS views_remaining, CASE WHEN plan = 'free' THEN greatest(0, 30 - s) END AS searches_remaining
FROM (SELECT distinct_id, CASE WHEN CAST(distinct_id AS INT) % 3 = 0 THEN 'pro' ELSE 'free' END AS plan, count(*) FILTER (WHERE event = 'view' AND CAST(occurred_at AS DATE) = DATE '2024-01-30') AS v,
  count(*) FILTER (WHERE event = 'click' AND date_trunc('month', occurred_at) = TIMESTAMP '2024-01-01') AS s FROM b_event GROUP BY 1)"""),
)
def q_quota(spark, sf):
    e = b.b_event(spark, sf)
    plans = e.select("distinct_id").distinct().withColumns(
        {
            "plan": F.when(F.col("distinct_id").cast("int") % 3 == 0, "pro").otherwise("free"),
            "daily_views": F.lit(10), "monthly_searches": F.lit(30),
        }
    )
    return throttle.usage_quota(e, plans, b.ts(NOW)).drop("daily_views", "monthly_searches")
