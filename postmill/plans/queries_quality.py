"""Capture gate, health, contracts, canaries and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.core import iso
from postmill.operators import filters, quality, views
from postmill.operators.identity import normalize_postings, reject_reason, with_identity
from postmill.operators.settle import settle
from postmill.params import SOURCE_KINDS
from postmill.plans import bindings as b
from postmill.plans import queries_score as qs
from postmill.plans import queries_views as qv
from postmill.plans import sqlkit as k
from postmill.plans.catalog import query
from postmill.plans.sqlkit import sql

AS_OF = b.AS_OF_RAW
KEYS = ["source_id", "run_id"]
EXPECTED = 25
_F = {f: c for f, c in quality.FIELD_COLUMNS.items()}


def raw_runs(spark, sf):
    """Raw postings with their weekly run; provenance made from the part key in ``pos``."""
    key = F.substring("pos", 40, 10).cast("bigint") % 4
    return b.b_raw(spark, sf).withColumns(
        {
            "captured_at": F.date_trunc("week", "seen_at"),
            "run_id": F.concat_ws("|", "source_id", F.date_format(F.date_trunc("week", "seen_at"), "yyyy-MM-dd")),
            "description_source": F.when(key == 0, " Detail").when(key == 1, "card")
            .when(key == 2, "fallback_unknown"),
        }
    )


def run_metrics(spark, sf, raw=None):
    raw = raw if raw is not None else raw_runs(spark, sf)
    keys = [*KEYS, "captured_at"]
    runs = raw.select(*keys).distinct().withColumn("expected_count", F.lit(EXPECTED))
    return quality.capture_metrics(raw, keys, runs)


k.cte(
    "b_raw_run", "b_raw",
    """SELECT *, date_trunc('week', seen_at) AS captured_at, source_id || '|' || strftime(date_trunc('week', seen_at), '%Y-%m-%d') AS run_id,
 CASE CAST(substring(pos, 40, 10) AS BIGINT) % 4 WHEN 0 THEN 'detail' WHEN 1 THEN 'card' WHEN 2 THEN 'fallback_unknown' END AS description_source FROM b_raw""",
)
_ROLE = f"{k.ltext('title')} || '|' || {k.ltext('company')} || '|' || {k.ltext('location')}"


def _metrics_sql(keys: str, source: str, expected: str) -> str:
    cov = ", ".join(f"{k.ratio3(f'p_{f} / n')} AS \"cov_{f}\"" for f in _F)
    pres = ", ".join(f"sum(CAST({k.present(c)} AS INT)) AS p_{f}" for f, c in _F.items())
    unk = ", ".join(f'{k.ratio3(f"1 - cov_{f}")} AS "unk_{f}"' for f in quality.OPTIONAL)
    return f"""SELECT *, {unk} FROM (SELECT {keys}, CAST(n AS BIGINT) AS sample_size, CAST({expected} AS BIGINT) AS baseline_count,
 {k.ratio3(f'n / {expected}')} AS baseline_ratio, {k.ratio3('keys / n')} AS unique_ratio, {k.ratio3('valid / n')} AS url_validity, {cov}
FROM (SELECT {keys}, count(*)::DOUBLE AS n, count(DISTINCT coalesce(nullif({k.ltext('url')}, ''), {_ROLE})) AS keys,
  sum(CAST({k.is_http('url')} AS INT)) AS valid, {pres} FROM {source} GROUP BY {keys}))"""


k.cte("b_metrics", "b_raw_run", _metrics_sql("source_id, run_id, captured_at", "b_raw_run", str(EXPECTED)))


def _low(f, lim, words):
    return f"'required field coverage {words}: {f} ' || {k.pct(f'cov_{f}')} || ' < ' || {k.pct(str(lim))}"


def _outcome_sql(source):
    rej = [f"CASE WHEN cov_{f} < 0.2 THEN ['required_coverage_{f}_low', {_low(f, 0.2, 'too low')}] END" for f in ("title", "company", "url")]
    q = [
        f"CASE WHEN baseline_count >= 10 AND baseline_ratio < 0.15 THEN ['baseline_volume_low', 'capture volume below baseline: ' || sample_size || '/' || baseline_count || ' (' || {k.pct('baseline_ratio')} || ') < 15%'] END",
        f"CASE WHEN sample_size >= 8 AND unique_ratio < 0.4 THEN ['duplicate_ratio_low', 'duplicate inflation detected: unique ratio ' || {k.pct('unique_ratio')} || ' < 40%'] END",
        f"CASE WHEN url_validity < 0.7 THEN ['url_validity_low', 'invalid URL rate too high: valid ratio ' || {k.pct('url_validity')} || ' < 70%'] END",
        *[f"CASE WHEN cov_{f} < 0.6 THEN ['required_coverage_{f}_degraded', {_low(f, 0.6, 'degraded')}] END" for f in ("title", "company", "url")],
        "CASE WHEN sample_size >= 8 AND " + " AND ".join(f'"unk_{f}" >= 0.98' for f in quality.OPTIONAL)
        + " THEN ['optional_fields_near_empty', 'all optional fields near-empty (unknown rate >= 98%)'] END",
    ]
    return f"""SELECT *, CASE WHEN len(rej) > 0 THEN 'reject' WHEN len(qua) > 0 THEN 'quarantine' ELSE 'accept' END AS outcome,
  CASE WHEN len(rej) > 0 THEN rej ELSE qua END AS reasons
FROM (SELECT *, list_filter([{', '.join(rej)}], lambda x: x IS NOT NULL) AS rej, list_filter([{', '.join(q)}], lambda x: x IS NOT NULL) AS qua FROM {source})"""


# Thresholds tight enough that all three outcomes occur in the data.
from postmill.params import Thresholds  # noqa: E402

TIGHT = Thresholds(min_baseline_ratio=0.9, min_url_validity=0.9, reject_coverage=0.2)
k.cte("b_outcome", "b_metrics", _outcome_sql("b_metrics").replace("baseline_ratio < 0.15", "baseline_ratio < 0.9").replace("< 15%", "< 90%")
      .replace("url_validity < 0.7", "url_validity < 0.9").replace("|| ' < 70%'", "|| ' < 90%'"))


def outcomes(spark, sf, metrics=None):
    return quality.run_outcome(metrics if metrics is not None else run_metrics(spark, sf), TIGHT)


_MCOLS = ["baseline_ratio", "unique_ratio", "url_validity", *[f"cov_{f}" for f in _F], *[f"unk_{f}" for f in quality.OPTIONAL]]


@query("q_capture_metrics", sql("b_metrics", "SELECT source_id, run_id, sample_size, baseline_count, " + ", ".join(f'"{c}"' for c in _MCOLS) + " FROM b_metrics"))
def q_capture_metrics(spark, sf):
    return run_metrics(spark, sf).select(*KEYS, "sample_size", "baseline_count", *_MCOLS)


@query(
    "q_run_outcome",
    sql("b_outcome", "SELECT source_id, run_id, outcome, array_to_string(list_transform(reasons, lambda r: r[1]), ',') AS codes, array_to_string(list_transform(reasons, lambda r: r[2]), ' / ') AS messages FROM b_outcome"),
)
def q_run_outcome(spark, sf):
    return outcomes(spark, sf).select(
        *KEYS, "outcome",
        F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"),
        F.array_join(F.transform("reasons", lambda r: r["message"]), " / ").alias("messages"),
    )


@query("q_ingest_gate", sql("b_raw_run b_outcome", "SELECT r.pos, r.run_id FROM b_raw_run r JOIN b_outcome o ON o.run_id = r.run_id WHERE o.outcome = 'accept'"))
def q_ingest_gate(spark, sf):
    raw = raw_runs(spark, sf)
    return quality.ingest_gate(raw, outcomes(spark, sf), KEYS).select("pos", "run_id")


@query(
    "q_quarantine",
    sql("b_raw_run b_outcome", """SELECT o.run_id, o.outcome, o.sample_size AS total_jobs, CAST(count(r.pos) AS INT) AS n_sample, CAST(o.sample_size > 20 AS INT) AS truncated, string_agg(r.pos, ',' ORDER BY r.pos) AS sample
FROM b_outcome o JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS rn FROM b_raw_run) r ON r.run_id = o.run_id AND r.rn <= 20 WHERE o.outcome <> 'accept' GROUP BY ALL"""),
)
def q_quarantine(spark, sf):
    raw = raw_runs(spark, sf).select(*KEYS, "pos", "title", "url")
    art = quality.quarantine_artifacts(raw, outcomes(spark, sf), KEYS, "pos", 20)
    return art.select(
        "run_id", "outcome", "total_jobs", F.size("jobs_sample").alias("n_sample"),
        F.col("truncated").cast("int").alias("truncated"),
        F.array_join(F.transform("jobs_sample", lambda j: j["pos"]), ",").alias("sample"),
    )


@query(
    "q_rejects",
    sql("b_raw", "SELECT pos, array_to_string(list_filter([CASE WHEN m % 3 = 0 THEN 'title' END, CASE WHEN m % 2 = 0 THEN 'company' END, CASE WHEN m % 7 = 0 THEN 'url' END], lambda x: x IS NOT NULL), ',') AS reject_reason FROM (SELECT pos, CAST(substring(pos, 10, 12) AS BIGINT) % 42 AS m FROM b_raw) WHERE m % 2 = 0 OR m % 3 = 0 OR m % 7 = 0"),
)
def q_rejects(spark, sf):
    m = F.substring("pos", 10, 12).cast("bigint") % 42
    raw = b.b_raw(spark, sf).withColumns(
        {
            "title": F.when(m % 3 != 0, F.col("title")).otherwise("  "),
            "company": F.when(m % 2 != 0, F.col("company")),
            "url": F.when(m % 7 != 0, F.col("url")).otherwise(" "),
        }
    )
    return quality.rejects(normalize_postings(raw, b.ts(AS_OF))).select("pos", "reject_reason")


# ---- collect, cap, cache ----------------------------------------------------------------


@query("q_collect", sql("b_raw b_filtered", "SELECT r.pos, r.source_type FROM b_raw r JOIN b_filtered f ON f.row_id = r.pos WHERE f.drop_reason IS NULL AND r.source_id <> 'src7'"))
def q_collect(spark, sf):
    from postmill.sources.capture import collect_sources

    raw = b.b_raw(spark, sf)
    http = ["builtin_search", "google_search"]
    frames = [raw.filter(F.col("source_type").isin(http)).drop("summary"), raw.filter(~F.col("source_type").isin(http))]
    got = collect_sources(frames, b.b_source(spark).filter("enabled"), qs.rules(spark))
    return got.select("pos", "source_type")


@query("q_source_cap", sql("b_raw b_source", "SELECT pos, r.source_id FROM (SELECT pos, source_id, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS rn FROM b_raw) r JOIN b_source s ON s.source_id = r.source_id WHERE rn <= max_jobs"))
def q_source_cap(spark, sf):
    raw = b.b_raw(spark, sf).select("source_id", "pos")
    return quality.source_cap(raw, b.b_source(spark)).select("pos", "source_id")


NOW = "2001-11-02 00:00:00"
k.cte("b_capture", "b_raw", "SELECT source_id, CASE source_id WHEN 'src5' THEN max(seen_at) - to_hours(30) ELSE max(seen_at) END AS captured_at, count(*) AS job_count FROM b_raw WHERE source_id <> 'src2' GROUP BY 1")


def captures(spark, sf):
    s = F.col("source_id")
    raw = b.b_raw(spark, sf).filter(s != "src2")
    seen = F.max("seen_at")
    return raw.groupBy("source_id").agg(
        F.when(s == "src5", seen - F.expr("interval 30 hours")).otherwise(seen).alias("captured_at"),
        F.count(F.lit(1)).alias("job_count"),
    )


@query(
    "q_cache_fresh",
    sql("b_raw b_capture b_source", f"""SELECT r.pos, {k.iso('c.captured_at')} AS retrieved_at FROM b_raw r JOIN b_capture c ON c.source_id = r.source_id JOIN b_source s ON s.source_id = r.source_id
WHERE epoch_us(CAST('2001-11-04 18:00:00' AS TIMESTAMP)) - epoch_us(c.captured_at) <= (CASE WHEN s.cache_ttl_hours > 0 THEN s.cache_ttl_hours WHEN s.source_type IN ('builtin_search', 'google_search') THEN 12 ELSE 24 END) * 3600000000"""),
)
def q_cache_fresh(spark, sf):
    raw = b.b_raw(spark, sf).select("source_id", "pos")
    got = quality.cached_rows(raw, captures(spark, sf), b.b_source(spark), b.ts("2001-11-04 18:00:00"))
    return got.select("pos", iso(F.col("retrieved_at")).alias("retrieved_at"))


def capture_files(spark, sf):
    """Captures with a text count and one broken file, as the reader hands them over."""
    s = F.col("source_id")
    return captures(spark, sf).withColumns(
        {
            "expected_count": F.when(s == "src0", "5000.4").when(s == "src1", "-3").when(s == "src3", "many")
            .otherwise("8000"),
            "broken": s == "src6",
        }
    )


def source_paths(spark):
    s = F.col("source_id")
    return b.b_source(spark).withColumn(
        "capture_path", F.when(s == "src4", "").otherwise(F.concat(F.lit("captures/"), s))
    )


k.cte(
    "b_summary", "b_capture b_source",
    """SELECT s.source_id, s.source_type, s.enabled, s.search_url, status, CASE WHEN status = 'ready' THEN captured_at END AS captured_at,
 CASE WHEN status = 'ready' THEN job_count ELSE 0 END AS job_count,
 CASE WHEN status = 'ready' THEN CASE s.source_id WHEN 'src0' THEN 5000 WHEN 'src1' THEN NULL WHEN 'src3' THEN NULL ELSE 8000 END END::BIGINT AS expected_count
FROM (SELECT s.*, c.captured_at, c.job_count, CASE WHEN s.source_id = 'src4' THEN 'no_capture_path' WHEN c.source_id IS NULL THEN 'never_run' WHEN s.source_id = 'src6' THEN 'capture_error' ELSE 'ready' END AS status
 FROM b_source s LEFT JOIN b_capture c ON c.source_id = s.source_id) s""",
)


@query("q_capture_summary", sql("b_summary", f"SELECT source_id, status, {k.iso('captured_at')} AS captured_at, job_count, expected_count FROM b_summary"))
def q_capture_summary(spark, sf):
    s = quality.capture_summary(capture_files(spark, sf), source_paths(spark))
    return s.withColumn("captured_at", iso(F.col("captured_at")))


@query(
    "q_capture_scan",
    sql("b_raw_run", f"""SELECT source_id, {k.iso('captured_at')} AS captured_at, CAST(row_number() OVER (PARTITION BY source_id, captured_at ORDER BY pos) - 1 AS INT) AS pos, external_id, title, company, location,
 posted_at, employment_type, salary_text, description, url, source_id || '/feed' AS page_url FROM b_raw_run"""),
)
def q_capture_scan(spark, sf):
    """Weekly runs recorded as capture payloads, written, scanned and flattened again."""
    from postmill.operators.settle import new_path
    from postmill.sources import capture

    raw = raw_runs(spark, sf)
    heads = raw.select("source_id", "captured_at").distinct().withColumns(
        {"page_url": F.concat("source_id", F.lit("/feed")), "expected_count": F.lit(EXPECTED)}
    )
    path = new_path(spark, "captures")
    capture.write_payloads(capture.capture_payloads(raw, heads), path)
    rows = capture.capture_rows(capture.read_captures(spark, path, lines=True))
    return rows.select(
        "source_id", iso(F.to_timestamp("retrieved_at")).alias("captured_at"), "pos", "external_id", "title", "company", "location", "posted_at",
        "employment_type", "salary_text", "description", "url", "page_url",
    )


k.cte(
    "b_access", "b_summary",
    """SELECT source_id, reason_code, CASE WHEN reason_code IN ('invalid_search_url', 'capture_error') THEN 'fail' WHEN reason_code LIKE 'capture_ok%' THEN 'pass' ELSE 'warn' END AS access_status
FROM (SELECT *, CASE WHEN NOT enabled THEN 'source_disabled' WHEN search_url NOT LIKE 'http%' THEN 'invalid_search_url' WHEN status = 'capture_error' THEN 'capture_error'
 WHEN job_count > 0 THEN 'capture_ok' WHEN source_type NOT IN ('linkedin_capture_file', 'wellfound_search', 'indeed_search', 'ziprecruiter_search', 'remoteok_search') THEN 'probe_skipped' ELSE 'capture_required' END AS reason_code FROM b_summary)""",
)


@query("q_access", sql("b_access", "SELECT * FROM b_access"))
def q_access(spark, sf):
    paths = source_paths(spark)
    return quality.access_status(quality.capture_summary(capture_files(spark, sf), paths), paths)


# ---- funnel -----------------------------------------------------------------------------

_EXP = "CASE source_id WHEN 'src3' THEN NULL ELSE 3000 END"
k.cte(
    "b_funnel", "b_ident b_filtered b_source",
    f"""SELECT *, CASE WHEN import_ratio IS NULL THEN 'unknown' WHEN import_ratio >= 0.7 THEN 'ok' WHEN import_ratio >= 0.4 THEN 'warning' ELSE 'critical' END AS import_status
FROM (SELECT *, greatest(0, captured - kept) AS dropped_filter, greatest(0, kept - deduped) AS dropped_dedupe, floor(deduped / expected_count * 1000 + 0.5) / 1000 AS import_ratio
FROM (SELECT i.source_id, count(*) AS captured, count(*) FILTER (WHERE f.drop_reason IS NULL) AS kept, count(DISTINCT CASE WHEN f.drop_reason IS NULL THEN i.normalized_hash END) AS deduped,
  CAST({_EXP.replace('source_id', 'i.source_id')} AS INT) AS expected_count FROM b_ident i JOIN b_filtered f ON f.row_id = i.pos GROUP BY 1))""",
)


def funnel(spark, sf):
    s = b.b_source(spark).withColumn(
        "expected_count", F.when(F.col("source_id") != "src3", F.lit(3000))
    )
    flt = filters.hard_filter(b.b_raw(spark, sf), qs.rules(spark))
    # A record that normalisation would refuse is captured and perhaps kept, but nothing is imported from it.
    known = with_identity(flt.withColumn("lacking", reject_reason(flt)))
    return quality.capture_funnel(known.withColumn("normalized_hash", F.when(F.col("lacking").isNull(), F.col("normalized_hash"))), s)


@query("q_funnel", sql("b_funnel", "SELECT * FROM b_funnel"))
def q_funnel(spark, sf):
    return funnel(spark, sf)


# ---- history ----------------------------------------------------------------------------


@query(
    "q_keep_newest",
    sql("", f"""SELECT source_id, strftime(captured_at, '%Y-%m-%d') AS captured_at, recorded AS entry, CAST(rank AS INT) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY captured_at DESC) AS rank FROM
  (SELECT 'src' || (o_orderkey % 8) AS source_id, o_orderdate AS captured_at, max(o_orderkey) AS recorded FROM orders GROUP BY 1, 2)) WHERE rank <= 80"""),
)
def q_keep_newest(spark, sf):
    h = b.table(spark, sf, "orders").select(
        F.concat(F.lit("src"), F.col("o_orderkey") % 8).alias("source_id"),
        F.col("o_orderdate").cast("timestamp").alias("captured_at"),
        F.timestamp_seconds("o_orderkey").alias("recorded_at"),
        F.col("o_orderkey").alias("entry"),
    )
    return quality.keep_newest(h, ["source_id"], 80, "captured_at", "recorded_at").select(
        "source_id", F.date_format("captured_at", "yyyy-MM-dd").alias("captured_at"), "entry", "rank"
    )


def _mean(c):
    return f"(CASE WHEN count({c}) > 0 THEN floor(sum({c}) / count({c}) * 1000 + 0.5) / 1000 END)"


k.cte("b_fresh", "b_outcome", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY captured_at DESC, run_id) AS rk FROM b_outcome
 WHERE epoch_us(CAST('{NOW}' AS TIMESTAMP)) - epoch_us(captured_at) <= 30 * 86400000000) WHERE rk <= 3""")
_UNK = quality.OPTIONAL
k.cte(
    "b_health", "b_fresh b_source",
    f"""SELECT s.source_id, coalesce(h.status, 'unknown') AS status, h.score, coalesce(h.reasons, ['no recent runs in source health history']) AS reasons, coalesce(h.samples_used, 0) AS samples_used,
  h.coverage_confidence, h.volume_confidence, h.null_rate_confidence, h.volume_ratio FROM b_source s LEFT JOIN
(SELECT *, CASE WHEN outcome = 'reject' OR score < 0.45 THEN 'failing' WHEN outcome = 'quarantine' OR score < 0.7 OR len(reasons) > 0 THEN 'degraded' ELSE 'ok' END AS status
FROM (SELECT *, floor((coverage_confidence * 0.5 + volume_confidence * 0.25 + null_rate_confidence * 0.25) * 1000 + 0.5) / 1000 AS score,
 list_filter([CASE WHEN coverage_confidence < 0.7 THEN 'required-field confidence below threshold (' || {k.pct('coverage_confidence')} || ')' END,
  CASE WHEN known AND volume_ratio < 0.5 THEN 'volume anomaly detected (latest/previous ratio=' || {k.pct('volume_ratio')} || ')' END,
  CASE WHEN len(spikes) > 0 THEN 'null-rate spike detected for ' || array_to_string(list_transform(spikes, lambda s: s[1]), ', ') END,
  CASE outcome WHEN 'reject' THEN 'latest run marked reject' WHEN 'quarantine' THEN 'latest run marked quarantine' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT *, CASE WHEN volume_ratio IS NULL THEN 1.0 WHEN NOT known THEN volume_ratio WHEN volume_ratio >= 0.8 THEN 1.0 WHEN volume_ratio <= 0.2 THEN 0.0 ELSE floor((volume_ratio - 0.2) / 0.6 * 1000 + 0.5) / 1000 END AS volume_confidence,
  CASE WHEN len(spikes) = 0 THEN 1.0 ELSE floor((1 - least(1.0, greatest(0.0, (CAST(list_max(list_transform(spikes, lambda s: CAST(s[2] AS DOUBLE))) AS DOUBLE) - 0.2) / 0.5))) * 1000 + 0.5) / 1000 END AS null_rate_confidence
FROM (SELECT *, coalesce(prev_size >= 5, false) AS known, CASE WHEN coalesce(prev_size >= 5, false) THEN {k.ratio3('sample_size / prev_size')} ELSE baseline_ratio END AS volume_ratio,
   floor((0.0::DOUBLE + coalesce(cov_title, 0) + coalesce(cov_company, 0) + coalesce(cov_url, 0)) / 3 * 1000 + 0.5) / 1000 AS coverage_confidence,
   list_filter([{', '.join(f"CASE WHEN u_{f} >= 0.85 AND floor((u_{f} - p_{f}) * 1000 + 0.5) / 1000 >= 0.2 THEN ['{f}', CAST(floor((u_{f} - p_{f}) * 1000 + 0.5) / 1000 AS VARCHAR)] END" for f in _UNK)}], lambda x: x IS NOT NULL) AS spikes
FROM (SELECT source_id, count(*) AS samples_used, max(CASE WHEN rk = 1 THEN outcome END) AS outcome, max(CASE WHEN rk = 1 THEN sample_size END) AS sample_size, max(CASE WHEN rk = 1 THEN baseline_ratio END) AS baseline_ratio,
  max(CASE WHEN rk = 1 THEN cov_title END) AS cov_title, max(CASE WHEN rk = 1 THEN cov_company END) AS cov_company, max(CASE WHEN rk = 1 THEN cov_url END) AS cov_url,
  {_mean('CASE WHEN rk > 1 THEN sample_size END')} AS prev_size, {', '.join(f'max(CASE WHEN rk = 1 THEN "unk_{f}" END) AS u_{f}, {_mean(f"""CASE WHEN rk > 1 THEN "unk_{f}" END""")} AS p_{f}' for f in _UNK)}
 FROM b_fresh GROUP BY 1))))) h ON h.source_id = s.source_id""",
)


def health(spark, sf):
    return quality.source_health(outcomes(spark, sf), b.b_source(spark), b.ts(NOW))


@query("q_health", sql("b_health", "SELECT * EXCLUDE (reasons), array_to_string(reasons, ' / ') AS reasons FROM b_health"))
def q_health(spark, sf):
    return health(spark, sf).withColumn("reasons", F.array_join("reasons", " / "))


_C = "count(*) FILTER (WHERE status = '{0}') AS {0}"


@query("q_health_summary", sql("b_health", "SELECT count(*) AS total, " + ", ".join(_C.format(s) for s in ("ok", "degraded", "failing", "unknown")) + " FROM b_health"))
def q_health_summary(spark, sf):
    return quality.health_summary(health(spark, sf))


# ---- contracts --------------------------------------------------------------------------

CONTRACT_COLUMNS = "source_type, source_id, contract_version, last_verified, required, thresholds, rolling_min, detail_min"
CONTRACT_ROWS = """
('linkedin_capture_file', CAST(NULL AS STRING), '1.0.0', TIMESTAMP '2001-10-20 00:00:00', 'title|company|location', '', CAST(NULL AS DOUBLE), 0.1),
('linkedin_capture_file', 'src0', '1.1.0', TIMESTAMP '2001-10-25 00:00:00', 'title|url|salaryText', 'salaryText=0.5', 0.95, CAST(NULL AS DOUBLE)),
('builtin_search', CAST(NULL AS STRING), '1.0.0', TIMESTAMP '2001-06-01 00:00:00', 'title|company', '', CAST(NULL AS DOUBLE), 0.01),
('wellfound_search', CAST(NULL AS STRING), '2.0.0', TIMESTAMP '2001-10-30 00:00:00', 'title|location|postedAt', 'location=0.99', CAST(NULL AS DOUBLE), 0.2),
('ashby_search', CAST(NULL AS STRING), '1.0.0', TIMESTAMP '2001-11-01 00:00:00', 'description|employmentType', '', 0.5, 0.9),
('google_search', CAST(NULL AS STRING), '1.0.0', TIMESTAMP '2001-11-01 00:00:00', 'title', '', CAST(NULL AS DOUBLE), 0.05),
('indeed_search', CAST(NULL AS STRING), '1.0.0', CAST(NULL AS TIMESTAMP), 'title|company', '', CAST(NULL AS DOUBLE), 0.0),
('ziprecruiter_search', CAST(NULL AS STRING), '1.0.0', TIMESTAMP '2001-11-01 00:00:00', 'url', '', CAST(NULL AS DOUBLE), 0.0)
""".strip()
k.cte("b_contract", "", f"SELECT * FROM (VALUES {CONTRACT_ROWS}) AS t({CONTRACT_COLUMNS})")


def contracts(spark):
    c = b.values(spark, CONTRACT_COLUMNS, CONTRACT_ROWS)
    pairs = F.transform(b.terms_of(F.col("thresholds")), lambda p: F.split(p, "="))
    return c.select(
        "source_type", "source_id", "contract_version", "last_verified",
        b.terms_of(F.col("required")).alias("required_fields"),
        F.map_from_arrays(
            F.transform(pairs, lambda p: p[0]), F.transform(pairs, lambda p: p[1].cast("double"))
        ).alias("field_thresholds"),
        "rolling_min", "detail_min",
    )


k.cte(
    "b_run_contract", "b_source b_contract",
    """SELECT s.source_id AS sid, s.source_type AS stype, s.enabled, coalesce(o.contract_version, t.contract_version) AS contract_version,
 CASE WHEN o.source_type IS NOT NULL THEN o.last_verified ELSE t.last_verified END AS last_verified, coalesce(o.required, t.required) AS required, coalesce(o.thresholds, t.thresholds) AS thresholds,
 CASE WHEN o.source_type IS NOT NULL THEN o.rolling_min ELSE t.rolling_min END AS rolling_min, CASE WHEN o.source_type IS NOT NULL THEN o.detail_min ELSE t.detail_min END AS detail_min,
 CASE WHEN o.source_type IS NOT NULL THEN 'source' WHEN t.source_type IS NOT NULL THEN 'type' END AS contract_scope
FROM b_source s LEFT JOIN b_contract o ON o.source_type = s.source_type AND o.source_id = s.source_id LEFT JOIN b_contract t ON t.source_type = s.source_type AND t.source_id IS NULL""",
)


@query("q_contract_resolve", sql("b_raw_run b_run_contract", "SELECT run_id, contract_version, contract_scope FROM (SELECT DISTINCT source_id, run_id FROM b_raw_run) r JOIN b_run_contract c ON c.sid = r.source_id"))
def q_contract_resolve(spark, sf):
    runs = raw_runs(spark, sf).select("source_id", "source_type", "run_id").distinct()
    return quality.resolve_contract(runs, contracts(spark)).select(
        "run_id", "contract_version", "contract_scope"
    )


@query(
    "q_coverage",
    sql("b_metrics b_run_contract", " UNION ALL ".join(
        f"SELECT m.run_id, '{f}' AS field, m.\"cov_{f}\" AS coverage FROM b_metrics m JOIN b_run_contract c ON c.sid = m.source_id WHERE list_contains(string_split(c.required, '|'), '{f}')" for f in _F)),
)
def q_coverage(spark, sf):
    long = quality.coverage_long(run_metrics(spark, sf), KEYS)
    own = quality.resolve_contract(b.b_source(spark).select("source_id", "source_type"), contracts(spark))
    wanted = own.select("source_id", F.explode("required_fields").alias("field"))
    return long.join(F.broadcast(wanted), ["source_id", "field"], "left_semi").select(
        "run_id", "field", "coverage"
    )


k.cte(
    "b_detail", "b_raw_run",
    f"""SELECT *, CASE WHEN detail_sample > 0 THEN {k.ratio3('detail_count / detail_sample')} END AS detail_coverage FROM (SELECT source_id, run_id,
  count(*) FILTER (WHERE description_source IS NOT NULL AND {k.present('description')}) AS detail_sample, count(*) FILTER (WHERE description_source = 'detail' AND {k.present('description')}) AS detail_count FROM b_raw_run GROUP BY 1, 2)""",
)


@query("q_detail_coverage", sql("b_detail", "SELECT * FROM b_detail"))
def q_detail_coverage(spark, sf):
    return quality.detail_coverage(raw_runs(spark, sf), KEYS)


k.cte(
    "b_roll", "b_metrics b_detail b_run_contract",
    f"""SELECT source_id, count(*) AS samples, {', '.join(f'{_mean(f"""cov_{f}""")} AS r_{f}' for f in _F)}, {_mean('detail_coverage')} AS roll_detail
FROM (SELECT m.*, d.detail_coverage, row_number() OVER (PARTITION BY m.source_id ORDER BY captured_at DESC, m.run_id) AS rk FROM b_metrics m JOIN b_detail d ON d.run_id = m.run_id
  JOIN b_run_contract c ON c.sid = m.source_id AND c.contract_version = CASE WHEN m.source_id = 'src4' THEN '0.9.0' WHEN m.source_id = 'src0' THEN '1.1.0' WHEN m.source_id = 'src2' THEN '2.0.0' ELSE '1.0.0' END
  WHERE epoch_us(CAST('{NOW}' AS TIMESTAMP)) - epoch_us(captured_at) <= 30 * 86400000000) WHERE rk <= 3 GROUP BY 1""",
)
_FIELD_CASE = "CASE f " + " ".join(f"WHEN '{f}' THEN r_{f}" for f in _F) + " END"
k.cte(
    "b_drift", "b_roll b_run_contract",
    f"""SELECT sid AS source_id, contract_version, stale, CASE WHEN contract_version IS NULL OR len(low) > 0 OR bad_detail THEN 'error' WHEN stale THEN 'warning' ELSE 'ok' END AS status,
 coalesce(samples, 0) AS rolling_samples, array_to_string(low, ',') AS low_fields, roll_detail,
 array_to_string(list_filter([CASE WHEN contract_version IS NULL THEN 'Missing contract for source type "' || stype || '".' WHEN stale THEN 'Contract lastVerified ' || coalesce(strftime(last_verified, '%Y-%m-%d'), 'unknown') || ' exceeds 30 days.' END,
   CASE WHEN len(low) > 0 THEN 'Rolling coverage below configured threshold(s) for: ' || array_to_string(low, ', ') || '.' END,
   CASE WHEN bad_detail THEN 'Rolling detail-description coverage below threshold (' || {k.pct('roll_detail')} || ' < ' || {k.pct('dmin')} || ').' END], lambda x: x IS NOT NULL), ' / ') AS issues
FROM (SELECT *, coalesce(roll_detail < dmin, false) AS bad_detail, coalesce(epoch_us(CAST('{NOW}' AS TIMESTAMP)) - epoch_us(last_verified) > 30 * 86400000000, true) AS stale,
  coalesce(list_filter(string_split(required, '|'), lambda f: coalesce(({_FIELD_CASE}) < coalesce(TRY_CAST(nullif(regexp_extract(thresholds, f || '=([0-9.]+)', 1), '') AS DOUBLE), floor_), false)), []) AS low
 FROM (SELECT *, coalesce(rolling_min, 0.9) AS floor_, coalesce(detail_min, rolling_min, 0.9) AS dmin FROM b_run_contract c LEFT JOIN b_roll r ON r.source_id = c.sid))""",
)


@query("q_drift", sql("b_drift", "SELECT source_id, contract_version, CAST(stale AS INT) AS stale, status, rolling_samples, low_fields, roll_detail, issues FROM b_drift"))
def q_drift(spark, sf):
    return drift(spark, sf)


def drift(spark, sf):
    raw = raw_runs(spark, sf)
    sid = F.col("source_id")
    history = run_metrics(spark, sf, raw).join(quality.detail_coverage(raw, KEYS), KEYS).withColumn(
        "contract_version",
        F.when(sid == "src4", "0.9.0").when(sid == "src0", "1.1.0").when(sid == "src2", "2.0.0")
        .otherwise("1.0.0"),
    )
    d = quality.contract_drift(history, b.b_source(spark), contracts(spark), b.ts(NOW))
    return d.select(
        "source_id", "contract_version", F.col("stale").cast("int").alias("stale"), "status",
        "rolling_samples", F.array_join("low_fields", ",").alias("low_fields"), "roll_detail",
        F.array_join("issues", " / ").alias("issues"),
    )


@query("q_diagnostics", sql("b_drift", "SELECT source_id, contract_version, status, rolling_samples, issues, '2001-11-05T00-00-00.000Z' AS generated_at FROM b_drift"))
def q_diagnostics(spark, sf):
    """The drift report written at two times, the older one last; the newest is read from its own partition."""
    from postmill.operators.settle import new_path
    from postmill.sources import capture

    path, report = new_path(spark, "diagnostics"), drift(spark, sf)
    capture.write_report(report, path, "2001-11-05T00:00:00.000Z")
    capture.write_report(report.limit(3), path, "2001-10-29T00:00:00.000Z")
    return capture.latest_report(spark, path).select("source_id", "contract_version", "status", "rolling_samples", "issues", "generated_at")


# ---- canaries ---------------------------------------------------------------------------

CHECK_COLUMNS = (
    "source_id, check_id, kind, min, max, fields, match_field, match_equals, match_includes, match_regex, "
    "expected_field, expected_equals, expected_includes, expected_regex"
)
_N = "CAST(NULL AS DOUBLE)"
_S = "CAST(NULL AS STRING)"
CHECK_ROWS = ",\n".join(
    f"('{s}', {i}, '{kind}', {lo}, {hi}, '{fields}', " + ", ".join(_S if x is None else f"'{x}'" for x in rest) + ")"
    for s, i, kind, lo, hi, fields, rest in [
        ("src0", 1, "min_samples", "10.0", _N, "", [None] * 8),
        ("src0", 2, "required_coverage", "0.9", _N, "title|url|salaryText", [None] * 8),
        ("src0", 3, "expected_record", _N, _N, "", ["title", None, "red widget", None, "company", None, "supplier", None]),
        ("src1", 1, "required_coverage", "0.95", _N, "location|salaryText", [None] * 8),
        ("src1", 2, "min_url_validity", "0.99", _N, "", [None] * 8),
        ("src2", 1, "max_unknown_rate", _N, "0.5", "location|postedAt|employmentType", [None] * 8),
        ("src2", 2, "min_unique_ratio", "0.2", _N, "", [None] * 8),
        ("src3", 1, "max_unknown_rate", _N, "0.01", "salaryText|postedAt", [None] * 8),
        ("src3", 2, "expected_record", _N, _N, "", [None, None, None, "p/1[0-9]{2}[?]", "location", "nation_3", None, None]),
        ("src4", 1, "expected_record", _N, _N, "", ["company", "nobody", None, None, "title", "x", None, None]),
        ("src4", 2, "min_samples", "100000000.0", _N, "", [None] * 8),
        ("src5", 1, "future_kind", _N, _N, "", [None] * 8),
    ]
)
k.cte("b_check", "", f"SELECT * FROM (VALUES {CHECK_ROWS}) AS t({CHECK_COLUMNS})")
k.cte("b_source_metrics", "b_raw", _metrics_sql("source_id", "b_raw", "NULL::DOUBLE"))
_COV = "CASE f " + " ".join(f"WHEN '{f}' THEN \"cov_{f}\"" for f in _F) + " END"
_UN = f"(floor((1 - {_COV}) * 1000 + 0.5) / 1000)"
k.cte(
    "b_found", "b_raw b_check",
    f"""SELECT check_key, arg_min(company, pos) AS company, arg_min(location, pos) AS location, arg_min(title, pos) AS title FROM
 (SELECT r.*, c.source_id || c.check_id AS check_key, c.*, CASE coalesce(match_field, 'url') WHEN 'title' THEN title WHEN 'company' THEN company ELSE url END AS v
  FROM b_raw r JOIN b_check c ON c.source_id = r.source_id WHERE kind = 'expected_record')
 WHERE CASE WHEN match_equals IS NOT NULL THEN lower(v) = lower(match_equals) WHEN match_includes IS NOT NULL THEN contains(lower(v), lower(match_includes)) ELSE regexp_matches(v, '(?i)' || match_regex) END GROUP BY 1""",
)


def _desc(p):
    return f"CASE WHEN {p}_equals IS NOT NULL THEN 'equals \"' || {p}_equals || '\"' WHEN {p}_includes IS NOT NULL THEN 'includes \"' || {p}_includes || '\"' WHEN {p}_regex IS NOT NULL THEN 'regex /' || {p}_regex || '/i' ELSE 'unknown expectation' END"


_LIST = "string_split(fields, '|')"
k.cte(
    "b_canary", "b_check b_source_metrics b_found",
    f"""SELECT source_id, check_id, kind, pass, CASE kind
 WHEN 'min_samples' THEN 'sample size ' || n || CASE WHEN pass THEN ' >= ' ELSE ' < ' END || CAST(min AS BIGINT)
 WHEN 'required_coverage' THEN 'required coverage ' || CASE WHEN pass THEN 'pass (' || shown || ')' ELSE 'fail (' || shown || '); below threshold for ' || array_to_string(short, ', ') END
 WHEN 'max_unknown_rate' THEN 'unknown-rate check ' || CASE WHEN pass THEN 'pass (' || shown_u || ')' ELSE 'fail (' || shown_u || '); above threshold for ' || array_to_string(above, ', ') END
 WHEN 'min_url_validity' THEN 'url validity ' || {k.pct('url_validity')} || CASE WHEN pass THEN ' >= ' ELSE ' < ' END || {k.pct('min')}
 WHEN 'min_unique_ratio' THEN 'unique ratio ' || {k.pct('unique_ratio')} || CASE WHEN pass THEN ' >= ' ELSE ' < ' END || {k.pct('min')}
 WHEN 'expected_record' THEN 'expected record ' || CASE WHEN NOT found THEN 'not found for ' || m WHEN pass THEN 'matched for ' || m ELSE 'mismatch for ' || m || ': ' || expected_field || ' expected ' || {_desc('expected')} || ' got ' || coalesce(actual, '(empty)') END
 ELSE 'unsupported canary check kind "' || kind || '" ignored' END AS message
FROM (SELECT *, coalesce(CASE kind WHEN 'min_samples' THEN n >= min WHEN 'required_coverage' THEN len(short) = 0 WHEN 'max_unknown_rate' THEN len(above) = 0 WHEN 'min_url_validity' THEN url_validity >= min
  WHEN 'min_unique_ratio' THEN unique_ratio >= min WHEN 'expected_record' THEN found AND CASE WHEN expected_equals IS NOT NULL THEN lower(coalesce(actual, '')) = lower(expected_equals) ELSE contains(lower(coalesce(actual, '')), lower(expected_includes)) END ELSE true END, false) AS pass
FROM (SELECT c.*, x.check_key IS NOT NULL AS found, CASE expected_field WHEN 'company' THEN x.company WHEN 'location' THEN x.location ELSE x.title END AS actual, s.sample_size AS n, s.url_validity, s.unique_ratio,
  list_filter({_LIST}, lambda f: coalesce(({_COV}) < min, true)) AS short, array_to_string(list_transform({_LIST}, lambda f: f || '=' || {k.pct(f'({_COV})')}), ', ') AS shown,
  list_filter({_LIST}, lambda f: coalesce({_UN} > max, true)) AS above, array_to_string(list_transform({_LIST}, lambda f: f || '=' || {k.pct(_UN)}), ', ') AS shown_u,
  coalesce(match_field, 'url') || ' ' || {_desc('match')} AS m
 FROM b_check c LEFT JOIN b_source_metrics s ON s.source_id = c.source_id LEFT JOIN b_found x ON x.check_key = c.source_id || c.check_id))""",
)


def checks(spark):
    c = b.values(spark, CHECK_COLUMNS, CHECK_ROWS)
    return c.withColumn("fields", b.terms_of(F.col("fields")))


def canary_results(spark, sf):
    raw = b.b_raw(spark, sf)
    metrics = quality.capture_metrics(raw, ["source_id"])
    return quality.run_canaries(metrics, raw, checks(spark))


@query("q_canary", sql("b_canary", "SELECT source_id, check_id, kind, CAST(pass AS INT) AS pass, message FROM b_canary"))
def q_canary(spark, sf):
    return canary_results(spark, sf).withColumn("pass", F.col("pass").cast("int"))


@query(
    "q_canary_status",
    sql("b_canary b_source", """SELECT s.source_id, CASE WHEN count(c.source_id) = 0 THEN 'skipped' WHEN bool_and(pass) THEN 'pass' ELSE 'fail' END AS status,
 CASE WHEN count(c.source_id) = 0 THEN 'no canary configured for source' ELSE coalesce(string_agg(CASE WHEN NOT pass THEN message END, ' / ' ORDER BY check_id), '') END AS reasons FROM b_source s LEFT JOIN b_canary c ON c.source_id = s.source_id GROUP BY 1"""),
)
def q_canary_status(spark, sf):
    s = quality.canary_status(canary_results(spark, sf), b.b_source(spark))
    return s.withColumn("reasons", F.array_join("reasons", " / "))


# ---- dashboard --------------------------------------------------------------------------


def dashboard(spark, sf):
    """Source rows with capture, funnel, access, rollup, health and mean score."""
    sources = source_paths(spark)
    summary = quality.capture_summary(capture_files(spark, sf), sources)
    access = quality.access_status(summary, sources)
    f = funnel(spark, sf).select(
        "source_id", "captured", F.col("dropped_filter").alias("filtered"),
        F.col("dropped_dedupe").alias("deduped"), F.col("deduped").alias("imported"),
    )
    groups = settle(qv.b_group(spark, sf, ["normalized_hash", "status", "bucket", "score", "source_ids"]))
    rollup = views.source_rollup(groups).select("source_id", "total_count", "high_signal_count")
    avg = views.source_average(groups, qv.b_imported(spark, sf)).select("source_id", "avg_score")
    h = health(spark, sf).select("source_id", F.col("status").alias("health"))
    out = sources.select("source_id", "source_name", "source_type", "enabled").join(
        summary.select("source_id", F.col("status").alias("capture_status"), F.col("expected_count").alias("expected")),
        "source_id",
    )
    for part in (access.select("source_id", "access_status"), f, rollup, avg, h):
        out = out.join(part, "source_id", "left")
    return out


k.cte(
    "b_dash", "b_source b_summary b_access b_funnel b_rollup b_avg b_health",
    """SELECT s.source_id, s.source_name, s.source_type, s.enabled, m.status AS capture_status, m.expected_count AS expected, a.access_status,
 f.captured, f.dropped_filter AS filtered, f.dropped_dedupe AS deduped, f.deduped AS imported, r.total_count, r.high_signal_count, v.avg_score, h.status AS health
FROM b_source s JOIN b_summary m USING (source_id) LEFT JOIN b_access a USING (source_id) LEFT JOIN b_funnel f USING (source_id) LEFT JOIN b_rollup r USING (source_id) LEFT JOIN b_avg v USING (source_id) LEFT JOIN b_health h USING (source_id)""",
)


@query("q_source_dashboard", sql("b_dash", "SELECT * EXCLUDE (enabled), CAST(enabled AS INT) AS enabled FROM b_dash"))
def q_source_dashboard(spark, sf):
    return dashboard(spark, sf).withColumn("enabled", F.col("enabled").cast("int"))


_KIND = "CASE source_type " + " ".join(f"WHEN '{t}' THEN '{kd}'" for t, kd, _, _ in SOURCE_KINDS) + " END"
_POS = "CASE source_type " + " ".join(f"WHEN '{t}' THEN {p}" for t, _, _, p in SOURCE_KINDS) + " END"
k.cte(
    "b_search", "b_dash",
    f"""SELECT source_id, {_KIND} AS kind, source_name AS label, {_POS} AS position, CASE WHEN NOT enabled THEN 'disabled' WHEN blocked THEN 'not_authorized' ELSE 'ready' END AS readiness,
 CASE WHEN NOT enabled THEN 'muted' WHEN blocked THEN 'warn' WHEN capture_status = 'capture_error' THEN 'error' ELSE 'ok' END AS tone,
 CASE WHEN NOT enabled THEN 'disabled' WHEN blocked THEN 'not authorized' WHEN capture_status = 'capture_error' THEN 'error' WHEN capture_status = 'ready' THEN 'ready' ELSE 'never run' END AS status_label,
 imported || '/' || coalesce(CAST(expected AS VARCHAR), '?') AS found_label, captured, filtered, deduped, imported, expected, avg_score, enabled
FROM (SELECT *, source_type IN ('linkedin_capture_file', 'wellfound_search', 'indeed_search', 'ziprecruiter_search', 'remoteok_search') AND coalesce(access_status, '') <> 'pass' AND enabled AS blocked FROM b_dash)""",
)


@query("q_search_rows", sql("b_search", "SELECT * EXCLUDE (enabled) FROM b_search"))
def q_search_rows(spark, sf):
    return views.search_rows(dashboard(spark, sf)).drop("enabled")


@query(
    "q_search_totals",
    sql("b_search", f"""SELECT CAST(sum(imported) AS BIGINT) || '/' || CASE WHEN bool_or(expected IS NULL) THEN '?' ELSE CAST(CAST(sum(expected) AS BIGINT) AS VARCHAR) END AS found_label,
 CAST(sum(captured) AS BIGINT) AS captured, CAST(sum(filtered) AS BIGINT) AS filtered, CAST(sum(deduped) AS BIGINT) AS deduped, CAST(sum(imported) AS BIGINT) AS imported,
 {k.half_up('sum(CASE WHEN imported > 0 THEN avg_score * imported END) / sum(CASE WHEN imported > 0 AND avg_score IS NOT NULL THEN imported END)')} AS avg_score FROM b_search WHERE enabled"""),
)
def q_search_totals(spark, sf):
    return views.search_totals(views.search_rows(dashboard(spark, sf)).filter("enabled"))


@query("q_readiness", sql("b_search", "SELECT count(*) FILTER (WHERE readiness = 'ready') AS ready, count(*) FILTER (WHERE readiness = 'not_authorized') AS action_needed, count(*) FILTER (WHERE readiness = 'disabled') AS disabled FROM b_search"))
def q_readiness(spark, sf):
    return views.readiness(views.search_rows(dashboard(spark, sf)))
