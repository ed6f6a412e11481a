"""Quality of captures: metrics, gate, funnel, health over history, contracts, canaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.core import (
    half_up,
    is_present,
    lower_text,
    nonempty,
    percent_text,
    ratio3,
    text,
)
from postmill.functions.url import is_http_url
from postmill.operators.settle import settle
from postmill.operators.skew import SALTS, filter_here, first_per_key, join_one_per_key, order_inputs, top_n_per_key
from postmill.operators.views import AUTH_TYPES
from postmill.params import HTTP_SOURCE_TYPES, Thresholds

# Capture field -> column.
FIELD_COLUMNS = {
    "title": "title", "company": "company", "url": "url", "location": "location",
    "postedAt": "posted_at", "salaryText": "salary_text", "employmentType": "employment_type",
    "description": "description",
}
OPTIONAL = ["location", "postedAt", "salaryText", "employmentType"]


# ---- metrics and gate ---------------------------------------------------------------------

def capture_metrics(raw: DataFrame, keys: list[str], runs: DataFrame | None = None) -> DataFrame:
    """One row per run: sample size, ratios and coverage of every field.

    ``runs`` (keys + expected_count) keeps runs without rows and sets the baseline. All
    measures come from one grouped pass; the distinct count is spread over the keys first.
    """
    role = F.concat_ws(
        "|", lower_text(F.col("title")), lower_text(F.col("company")), lower_text(F.col("location"))
    )
    # The key travels as 128 bits; role texts are only made for rows without a URL.
    staged = raw.withColumn("_url", text(F.col("url"))).select(
        *keys,
        F.unhex(F.md5(F.coalesce(nonempty(F.lower("_url")), role))).alias("_key"),
        (F.col("_url").ilike("http%") & is_http_url(F.col("_url"))).alias("_valid"),
        *[is_present(F.col(c)).alias(f"_p_{f}") for f, c in FIELD_COLUMNS.items()],
    )
    flags = ["_valid", *[f"_p_{f}" for f in FIELD_COLUMNS]]
    # Rows with the same run and key are folded first, so no run meets whole in one task.
    folded = staged.groupBy(*keys, "_key").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c)).alias(c) for c in flags]
    )
    m = folded.groupBy(*keys).agg(
        F.sum("_n").alias("sample_size"),
        F.count(F.lit(1)).alias("_keys"),
        *[F.sum(c).alias(c) for c in flags],
    )
    if runs is not None:
        m = runs.join(m, keys, "left").withColumn(
            "sample_size", F.coalesce("sample_size", F.lit(0))
        )
    n = F.col("sample_size")

    def part(c: str) -> Column:
        return ratio3(F.when(n > 0, F.col(c) / n))

    expected = F.col("expected_count") if runs is not None else F.lit(None).cast("double")
    baseline = F.when(expected >= 0, half_up(expected)).cast("bigint")
    covered = m.select(
        *keys,
        n,
        baseline.alias("baseline_count"),
        ratio3(F.when(expected > 0, n / expected)).alias("baseline_ratio"),
        part("_keys").alias("unique_ratio"),
        part("_valid").alias("url_validity"),
        *[part(f"_p_{f}").alias(f"cov_{f}") for f in FIELD_COLUMNS],
    )
    return covered.withColumns({f"unk_{f}": ratio3(1 - F.col(f"cov_{f}")) for f in OPTIONAL})


def _reason(cond: Column, code: str, message: Column) -> Column:
    return F.when(cond, F.struct(F.lit(code).alias("code"), message.alias("message")))


def run_outcome(metrics: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """Add outcome and ordered reasons (code, message).

    A run with ``payload_error`` set (column optional) is rejected for that reason alone.
    """
    t = t or Thresholds()
    m = metrics
    say = F.concat

    def low(field: str, limit: float, code: str, words: str) -> Column:
        c = F.col(f"cov_{field}")
        return _reason(
            c < limit,
            code,
            say(F.lit(f"required field coverage {words}: {field} "), percent_text(c),
                F.lit(" < "), percent_text(F.lit(limit))),
        )

    required = ["title", "company", "url"]
    reject = [
        low(f, t.reject_coverage, f"required_coverage_{f}_low", "too low") for f in required
    ]
    if "payload_error" in m.columns:
        reject.insert(
            0,
            F.when(
                F.col("payload_error").isNotNull(),
                F.struct(
                    F.col("payload_error").alias("code"),
                    F.when(
                        F.col("payload_error") == "payload_jobs_missing",
                        "capture payload must include a jobs array",
                    ).otherwise("capture payload must be an object").alias("message"),
                ),
            ),
        )
    b, n = F.col("baseline_ratio"), F.col("sample_size")
    u, v = F.col("unique_ratio"), F.col("url_validity")
    empty = F.lit(True)
    for f in OPTIONAL:
        empty = empty & F.coalesce(F.col(f"unk_{f}") >= t.severe_unknown, F.lit(False))
    quarantine = [
        _reason(
            (F.col("baseline_count") >= t.min_expected) & (b < t.min_baseline_ratio),
            "baseline_volume_low",
            say(F.lit("capture volume below baseline: "), n.cast("string"), F.lit("/"),
                F.col("baseline_count").cast("string"), F.lit(" ("), percent_text(b), F.lit(") < "),
                percent_text(F.lit(t.min_baseline_ratio))),
        ),
        _reason(
            (n >= t.min_sample) & (u < t.min_unique_ratio),
            "duplicate_ratio_low",
            say(F.lit("duplicate inflation detected: unique ratio "), percent_text(u), F.lit(" < "),
                percent_text(F.lit(t.min_unique_ratio))),
        ),
        _reason(
            v < t.min_url_validity,
            "url_validity_low",
            say(F.lit("invalid URL rate too high: valid ratio "), percent_text(v), F.lit(" < "),
                percent_text(F.lit(t.min_url_validity))),
        ),
        *[
            low(f, t.quarantine_coverage, f"required_coverage_{f}_degraded", "degraded")
            for f in required
        ],
        _reason(
            empty & (n >= t.min_sample),
            "optional_fields_near_empty",
            say(F.lit("all optional fields near-empty (unknown rate >= "),
                percent_text(F.lit(t.severe_unknown)), F.lit(")")),
        ),
    ]
    staged = m.withColumns(
        {
            "_r": F.array_compact(F.array(*reject)),
            "_q": F.array_compact(F.array(*quarantine)),
        }
    )
    return staged.withColumns(
        {
            "outcome": F.when(F.size("_r") > 0, "reject").when(F.size("_q") > 0, "quarantine")
            .otherwise("accept"),
            "reasons": F.when(F.size("_r") > 0, F.col("_r")).otherwise(F.col("_q")),
        }
    ).drop("_r", "_q")


def ingest_gate(
    raw: DataFrame, outcomes: DataFrame, keys: list[str], allow_quarantined: bool = False
) -> DataFrame:
    """Rows of the runs that may be ingested."""
    ok = ["accept", "quarantine"] if allow_quarantined else ["accept"]
    return raw.join(outcomes.filter(F.col("outcome").isin(ok)).select(*keys), keys, "left_semi")


def quarantine_artifacts(
    raw: DataFrame, outcomes: DataFrame, keys: list[str], pos: str = "pos", sample: int = 200
) -> DataFrame:
    """Evaluation and the first rows of every blocked run, as the artifact record."""
    blocked = outcomes.filter(F.col("outcome") != "accept")
    rows = raw.join(blocked.select(*keys), keys, "left_semi")
    head = top_n_per_key(rows, keys, [F.col(pos)], sample)
    record = F.struct("rank", *[c for c in rows.columns if c not in keys])
    samples = head.groupBy(*keys).agg(F.array_sort(F.collect_list(record)).alias("jobs_sample"))
    return blocked.join(samples, keys, "left").select(
        *keys, "outcome", "reasons", F.col("sample_size").alias("total_jobs"),
        F.coalesce("jobs_sample", F.array()).alias("jobs_sample"),
        (F.col("sample_size") > sample).alias("truncated"),
    )


def rejects(normal: DataFrame) -> DataFrame:
    """Side table of records that lack a required field."""
    return filter_here(normal, F.col("reject_reason").isNotNull())


def gate_sources(normal: DataFrame, on_bad_record: str = "reject_source") -> DataFrame:
    """Valid rows; by default one bad record blocks its whole source run."""
    good = filter_here(normal, F.col("reject_reason").isNull())
    if on_bad_record == "drop":
        return good
    # Written first: the few sources are broadcast, the rows stay where they are.
    bad = settle(normal.filter(F.col("reject_reason").isNotNull()).select("source_id").distinct(), "bad-sources")
    return good.join(bad, "source_id", "left_anti")


# ---- funnel -------------------------------------------------------------------------------

def import_status(expected: Column, imported: Column) -> tuple[Column, Column]:
    """(ratio, status) of imported against expected."""
    r = F.when(expected > 0, half_up(imported / expected * 1000) / 1000)
    return r, (
        F.when(r.isNull(), "unknown").when(r >= 0.7, "ok").when(r >= 0.4, "warning")
        .otherwise("critical")
    )


def imported_hashes(filtered: DataFrame) -> DataFrame:
    """(source_id, normalized_hash) of what a capture imports: kept by the hard filter and usable, once each."""
    kept = filtered.filter(F.col("drop_reason").isNull() & F.col("normalized_hash").isNotNull())
    return kept.select("source_id", "normalized_hash").distinct()


def capture_funnel(filtered: DataFrame, sources: DataFrame) -> DataFrame:
    """Captured -> kept by the hard filter -> distinct hashes (``imported_hashes``), per source.

    ``filtered`` has source_id, drop_reason, normalized_hash (null for unusable records). Configured sources without rows
    count 0; rows of sources that are not configured are counted as well, with nothing expected.
    """
    kept = F.col("drop_reason").isNull()
    by_hash = filtered.groupBy(
        "source_id", F.when(kept, F.col("normalized_hash")).alias("_h")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("k"))
    sums = by_hash.groupBy("source_id").agg(
        F.sum("n").alias("captured"), F.sum("k").alias("kept"), F.count("_h").alias("deduped")
    )
    zero = F.lit(0)
    j = sources.select("source_id", "expected_count").join(sums, "source_id", "full_outer").select(
        "source_id", "expected_count",
        *[F.coalesce(c, zero).alias(c) for c in ("captured", "kept", "deduped")],
    )
    ratio, status = import_status(F.col("expected_count"), F.col("deduped"))
    return j.select(
        "source_id", "captured", "kept", "deduped",
        F.greatest(zero, F.col("captured") - F.col("kept")).alias("dropped_filter"),
        F.greatest(zero, F.col("kept") - F.col("deduped")).alias("dropped_dedupe"),
        "expected_count", ratio.alias("import_ratio"), status.alias("import_status"),
    )


# ---- history and health ---------------------------------------------------------------------

def keep_newest(history: DataFrame, keys: list[str], n: int, captured: str, recorded: str) -> DataFrame:
    """A re-recorded capture replaces the earlier entry; then the newest n per key stay."""
    once = first_per_key(history, [*keys, captured], -F.unix_micros(F.col(recorded)))
    return top_n_per_key(once, keys, [F.col(captured).desc()], n)


def newest_fresh(history: DataFrame, as_of: Column, window: int, stale_days: int) -> DataFrame:
    """Newest ``window`` runs per source that are not older than ``stale_days``."""
    fresh = history.filter(
        F.col("captured_at").isNotNull()
        & (F.unix_micros(as_of) - F.unix_micros("captured_at") <= stale_days * 86400000000)
    )
    return top_n_per_key(fresh, ["source_id"], [F.col("captured_at").desc(), F.col("run_id")], window)


def _mean3(values: Column) -> Column:
    n = F.count(values)
    return F.when(n > 0, half_up(F.sum(values) / n * 1000) / 1000)


def source_health(
    history: DataFrame, sources: DataFrame, as_of: Column, window: int = 3, stale_days: int = 30
) -> DataFrame:
    """Health per source from the newest runs: coverage, volume and unknown-rate confidence."""
    latest, earlier = F.col("rank") == 1, F.col("rank") > 1
    cols = ["sample_size", "baseline_ratio", "outcome", "cov_title", "cov_company", "cov_url"]
    unk = [f"unk_{f}" for f in OPTIONAL]
    per = newest_fresh(history, as_of, window, stale_days).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("samples_used"),
        *[F.max(F.when(latest, F.col(c))).alias(c) for c in cols + unk],
        _mean3(F.when(earlier, F.col("sample_size"))).alias("prev_size"),
        *[_mean3(F.when(earlier, F.col(c))).alias(f"prev_{c}") for c in unk],
    )
    zero = F.lit(0.0)
    cov = sum((F.coalesce(F.col(f"cov_{f}"), zero) for f in ("title", "company", "url")), zero)
    known = F.coalesce(F.col("prev_size") >= 5, F.lit(False))
    ratio = F.when(known, ratio3(F.col("sample_size") / F.col("prev_size"))).otherwise(
        F.col("baseline_ratio")
    )
    staged = per.withColumns(
        {
            "coverage_confidence": half_up(cov / 3 * 1000) / 1000,
            "volume_ratio": ratio,
            "_known": known,
            **{
                f"d_{c}": half_up((F.col(c) - F.col(f"prev_{c}")) * 1000) / 1000 for c in unk
            },
        }
    )
    r = F.col("volume_ratio")
    spikes = [
        F.when((F.col(c) >= 0.85) & (F.col(f"d_{c}") >= 0.2), F.col(f"d_{c}")) for c in unk
    ]
    worst = F.array_max(F.array(*spikes))
    staged = staged.withColumns(
        {
            "volume_confidence": F.when(r.isNull(), 1.0)
            .when(~F.col("_known"), r)
            .when(r >= 0.8, 1.0)
            .when(r <= 0.2, 0.0)
            .otherwise(half_up((r - 0.2) / 0.6 * 1000) / 1000),
            "_anomaly": F.coalesce(F.col("_known") & (r < 0.5), F.lit(False)),
            "null_rate_confidence": F.when(worst.isNull(), 1.0).otherwise(
                half_up((1 - F.least(F.lit(1.0), F.greatest(zero, (worst - 0.2) / 0.5))) * 1000) / 1000
            ),
            "_spikes": F.array_compact(
                F.array(*[F.when(s.isNotNull(), F.lit(f)) for s, f in zip(spikes, OPTIONAL, strict=True)])
            ),
        }
    )
    c = F.col("coverage_confidence")
    score = half_up(
        (c * 0.5 + F.col("volume_confidence") * 0.25 + F.col("null_rate_confidence") * 0.25) * 1000
    ) / 1000
    outcome = F.lower("outcome")
    reasons = F.array_compact(
        F.array(
            F.when(
                c < 0.7,
                F.concat(F.lit("required-field confidence below threshold ("), percent_text(c), F.lit(")")),
            ),
            F.when(
                F.col("_anomaly"),
                F.concat(F.lit("volume anomaly detected (latest/previous ratio="), percent_text(r), F.lit(")")),
            ),
            F.when(
                F.size("_spikes") > 0,
                F.concat(F.lit("null-rate spike detected for "), F.array_join("_spikes", ", ")),
            ),
            F.when(outcome == "reject", "latest run marked reject").when(
                outcome == "quarantine", "latest run marked quarantine"
            ),
        )
    )
    staged = staged.withColumns({"score": score, "reasons": reasons})
    status = (
        F.when((outcome == "reject") | (F.col("score") < 0.45), "failing")
        .when(
            (outcome == "quarantine") | (F.col("score") < 0.7) | (F.size("reasons") > 0), "degraded"
        )
        .otherwise("ok")
    )
    rated = staged.select(
        "source_id", status.alias("status"), "score", "reasons", "samples_used",
        "coverage_confidence", "volume_confidence", "null_rate_confidence", "volume_ratio",
    )
    none = F.array(F.lit("no recent runs in source health history"))
    return sources.select("source_id").join(rated, "source_id", "left").withColumns(
        {
            "status": F.coalesce("status", F.lit("unknown")),
            "reasons": F.coalesce("reasons", none),
            "samples_used": F.coalesce("samples_used", F.lit(0)),
        }
    )


def health_summary(health: DataFrame) -> DataFrame:
    s = F.col("status")
    return health.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(s == v).alias(v) for v in ("ok", "degraded", "failing", "unknown")],
    )


# ---- contracts --------------------------------------------------------------------------

def resolve_contract(df: DataFrame, contracts: DataFrame) -> DataFrame:
    """Attach the contract of a source: its own one wins over the one of its type.

    ``contracts`` has source_type, source_id (null = the whole type) and any payload. Two
    contracts for one key are an error.
    """
    keyed = contracts.groupBy("source_type", "source_id").agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*_payload(contracts))).alias("_c")
    )
    guarded = keyed.withColumn(
        "_c",
        F.when(
            F.col("_n") > 1,
            F.raise_error(F.concat(F.lit("duplicate contract for "), F.col("source_type"))),
        ).otherwise(F.col("_c")),
    )
    own = guarded.filter("source_id IS NOT NULL").select(
        "source_type", "source_id", F.col("_c").alias("_own")
    )
    kind = guarded.filter("source_id IS NULL").select("source_type", F.col("_c").alias("_kind"))
    j = df.join(own, ["source_type", "source_id"], "left").join(kind, "source_type", "left")
    pick = F.coalesce("_own", "_kind")
    return j.select(
        *df.columns, *[pick[c].alias(c) for c in _payload(contracts)],
        F.when(F.col("_own").isNotNull(), "source").when(F.col("_kind").isNotNull(), "type")
        .alias("contract_scope"),
    )


def _payload(contracts: DataFrame) -> list[str]:
    return [c for c in contracts.columns if c not in ("source_type", "source_id")]


def coverage_long(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, coverage) rows of the wide metrics."""
    pairs = [x for f in FIELD_COLUMNS for x in (F.lit(f), F.col(f"cov_{f}"))]
    return metrics.select(*keys, F.stack(F.lit(len(FIELD_COLUMNS)), *pairs).alias("field", "coverage"))


def detail_coverage(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Share of described rows whose description came from the detail page."""
    src = F.lower(F.trim("description_source"))
    counted = is_present(F.col("description")) & src.isin("detail", "card", "fallback_unknown")
    c = raw.groupBy(*keys).agg(
        F.count_if(counted).alias("detail_sample"),
        F.count_if(counted & (src == "detail")).alias("detail_count"),
    )
    return c.withColumn(
        "detail_coverage",
        ratio3(F.when(F.col("detail_sample") > 0, F.col("detail_count") / F.col("detail_sample"))),
    )


def contract_drift(
    history: DataFrame,
    sources: DataFrame,
    contracts: DataFrame,
    as_of: Column,
    window: int = 3,
    stale_days: int = 30,
    min_coverage: float = 0.9,
) -> DataFrame:
    """Rolling coverage of every source against its contract.

    ``contracts`` has contract_version, last_verified, required_fields (array),
    field_thresholds (map), rolling_min, detail_min; ``history`` is the run metrics with
    contract_version, detail_coverage, detail_sample.
    """
    known = resolve_contract(sources.select("source_id", "source_type"), contracts)
    mine = history.join(
        known.select("source_id", "contract_version"), ["source_id", "contract_version"], "left_semi"
    )
    top = newest_fresh(mine, as_of, window, stale_days)
    rolling = top.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("samples"),
        *[_mean3(F.col(f"cov_{f}")).alias(f"roll_{f}") for f in FIELD_COLUMNS],
        _mean3(F.col("detail_coverage")).alias("roll_detail"),
        F.sum("detail_sample").alias("roll_detail_sample"),
    )
    j = known.join(rolling, "source_id", "left")
    by_field = F.create_map(*[x for f in FIELD_COLUMNS for x in (F.lit(f), F.col(f"roll_{f}"))])
    floor = F.coalesce("rolling_min", F.lit(min_coverage))
    staged = j.withColumns(
        {"_roll": by_field, "_floor": floor, "_detail_min": F.coalesce("detail_min", floor)}
    )
    checks = F.transform(
        "required_fields",
        lambda f: F.struct(
            f.alias("field"),
            F.col("_roll")[f].alias("rolling"),
            F.coalesce(F.col("field_thresholds")[f], F.col("_floor")).alias("threshold"),
        ),
    )
    low = F.filter(checks, lambda x: x["rolling"] < x["threshold"])
    stale = F.coalesce(
        F.unix_micros(as_of) - F.unix_micros("last_verified") > stale_days * 86400000000,
        F.lit(True),
    )
    staged = staged.withColumns({"_low": low, "stale": stale}).withColumn(
        "low_fields", F.coalesce(F.transform("_low", lambda x: x["field"]), F.array().cast("array<string>"))
    )
    d, dmin = F.col("roll_detail"), F.col("_detail_min")
    bad_detail = F.coalesce(d < dmin, F.lit(False))
    missing = F.col("contract_version").isNull()
    issues = F.array_compact(
        F.array(
            F.when(
                missing,
                F.concat(F.lit('Missing contract for source type "'), F.col("source_type"), F.lit('".')),
            ).when(
                F.col("stale"),
                F.concat(
                    F.lit("Contract lastVerified "),
                    F.coalesce(F.date_format("last_verified", "yyyy-MM-dd"), F.lit("unknown")),
                    F.lit(f" exceeds {stale_days} days."),
                ),
            ),
            F.when(
                F.size("low_fields") > 0,
                F.concat(
                    F.lit("Rolling coverage below configured threshold(s) for: "),
                    F.array_join("low_fields", ", "), F.lit("."),
                ),
            ),
            F.when(
                bad_detail,
                F.concat(
                    F.lit("Rolling detail-description coverage below threshold ("),
                    percent_text(d), F.lit(" < "), percent_text(dmin), F.lit(")."),
                ),
            ),
        )
    )
    status = (
        F.when(missing | (F.size("low_fields") > 0) | bad_detail, "error")
        .when(F.col("stale"), "warning")
        .otherwise("ok")
    )
    return staged.select(
        "source_id", "source_type", "contract_version", "stale", status.alias("status"),
        F.coalesce("samples", F.lit(0)).alias("rolling_samples"), "low_fields",
        F.col("_low").alias("mismatches"), "roll_detail", issues.alias("issues"),
        (~missing & (F.size("low_fields") == 0) & ~bad_detail).alias("pass_coverage_gate"),
    )


# ---- canaries ---------------------------------------------------------------------------

def _rule_holds(value: Column, equals: Column, includes: Column, regex: Column) -> Column:
    v = F.lower(text(value))
    return F.coalesce(
        F.when(equals.isNotNull(), v == F.lower(equals))
        .when(includes.isNotNull(), F.contains(v, F.lower(includes)))
        .when(regex.isNotNull(), F.regexp_like(text(value), F.concat(F.lit("(?i)"), regex))),
        F.lit(False),
    )


def _describe(equals: Column, includes: Column, regex: Column) -> Column:
    return (
        F.when(equals.isNotNull(), F.concat(F.lit('equals "'), equals, F.lit('"')))
        .when(includes.isNotNull(), F.concat(F.lit('includes "'), includes, F.lit('"')))
        .when(regex.isNotNull(), F.concat(F.lit("regex /"), regex, F.lit("/i")))
        .otherwise("unknown expectation")
    )


def field_value(name: Column) -> Column:
    """Value of the named capture field of a row."""
    pairs = [x for f, c in FIELD_COLUMNS.items() for x in (F.lit(f), F.col(c))]
    return F.element_at(F.create_map(*pairs), name)


def expected_records(raw: DataFrame, checks: DataFrame, pos: str = "pos") -> DataFrame:
    """First row (by position) each expected_record check matches, with its fields.

    The rows are joined to the checks of their source, filtered by the match, and folded to
    the first per check before the exchange.
    """
    wanted = checks.filter("kind = 'expected_record'").select(
        "source_id", "check_id", "match_field", "match_equals", "match_includes", "match_regex"
    )
    hit = _rule_holds(
        field_value(F.coalesce("match_field", F.lit("url"))),
        F.col("match_equals"), F.col("match_includes"), F.col("match_regex"),
    )
    rows = raw.join(wanted, "source_id").filter(hit)
    whole = F.create_map(*[x for f, c in FIELD_COLUMNS.items() for x in (F.lit(f), F.col(c))])
    return rows.groupBy("source_id", "check_id").agg(F.min_by(whole, pos).alias("found"))


def run_canaries(metrics: DataFrame, raw: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per check with pass and message; metrics are per source_id.

    ``checks``: source_id, check_id, kind, min, max, fields (array), match_*, expected_field,
    expected_equals, expected_includes, expected_regex.
    """
    cov = F.create_map(*[x for f in FIELD_COLUMNS for x in (F.lit(f), F.col(f"cov_{f}"))])
    j = (
        checks.join(metrics, "source_id", "left")
        .join(expected_records(raw, checks), ["source_id", "check_id"], "left")
        .withColumns({"_cov": cov, "_n": F.coalesce("sample_size", F.lit(0))})
    )
    kind, lo, hi, fields = F.col("kind"), F.col("min"), F.col("max"), F.col("fields")
    short = F.filter(fields, lambda f: F.coalesce(F.col("_cov")[f] < lo, F.lit(True)))
    shown = F.array_join(
        F.transform(fields, lambda f: F.concat(f, F.lit("="), percent_text(F.col("_cov")[f]))), ", "
    )

    def unknown(f: Column) -> Column:
        return ratio3(1 - F.col("_cov")[f])

    above = F.filter(fields, lambda f: F.coalesce(unknown(f) > hi, F.lit(True)))
    shown_unknown = F.array_join(
        F.transform(fields, lambda f: F.concat(f, F.lit("="), percent_text(unknown(f)))), ", "
    )
    actual = text(F.col("found")[F.col("expected_field")])
    holds = _rule_holds(
        actual, F.col("expected_equals"), F.col("expected_includes"), F.col("expected_regex")
    )
    match = F.concat(
        F.coalesce("match_field", F.lit("url")), F.lit(" "),
        _describe(F.col("match_equals"), F.col("match_includes"), F.col("match_regex")),
    )
    wanted = _describe(
        F.col("expected_equals"), F.col("expected_includes"), F.col("expected_regex")
    )
    staged = j.withColumns(
        {
            "_short": short, "_shown": shown, "_above": above, "_unknown": shown_unknown,
            "_found": F.col("found").isNotNull(), "_holds": holds, "_match": match,
            "_actual": F.coalesce(nonempty(actual), F.lit("(empty)")), "_wanted": wanted,
        }
    )
    url, uniq = F.col("url_validity"), F.col("unique_ratio")
    ok = F.coalesce(
        F.when(kind == "min_samples", F.col("_n") >= lo)
        .when(kind == "required_coverage", F.size("_short") == 0)
        .when(kind == "max_unknown_rate", F.size("_above") == 0)
        .when(kind == "min_url_validity", url >= lo)
        .when(kind == "min_unique_ratio", uniq >= lo)
        .when(kind == "expected_record", F.col("_found") & F.col("_holds"))
        .otherwise(True),
        F.lit(False),
    )
    staged = staged.withColumn("pass", ok)
    p = F.col("pass")
    sign = F.when(p, " >= ").otherwise(" < ")
    say = F.concat
    message = (
        F.when(kind == "min_samples",
               say(F.lit("sample size "), F.col("_n").cast("string"), sign, lo.cast("int").cast("string")))
        .when((kind == "required_coverage") & p, say(F.lit("required coverage pass ("), "_shown", F.lit(")")))
        .when(kind == "required_coverage",
              say(F.lit("required coverage fail ("), "_shown", F.lit("); below threshold for "),
                  F.array_join("_short", ", ")))
        .when((kind == "max_unknown_rate") & p, say(F.lit("unknown-rate check pass ("), "_unknown", F.lit(")")))
        .when(kind == "max_unknown_rate",
              say(F.lit("unknown-rate check fail ("), "_unknown", F.lit("); above threshold for "),
                  F.array_join("_above", ", ")))
        .when(kind == "min_url_validity",
              say(F.lit("url validity "), percent_text(url), sign, percent_text(lo)))
        .when(kind == "min_unique_ratio",
              say(F.lit("unique ratio "), percent_text(uniq), sign, percent_text(lo)))
        .when((kind == "expected_record") & ~F.col("_found"),
              say(F.lit("expected record not found for "), "_match"))
        .when((kind == "expected_record") & p, say(F.lit("expected record matched for "), "_match"))
        .when(kind == "expected_record",
              say(F.lit("expected record mismatch for "), "_match", F.lit(": "), "expected_field",
                  F.lit(" expected "), "_wanted", F.lit(" got "), "_actual"))
        .otherwise(say(F.lit('unsupported canary check kind "'), kind, F.lit('" ignored')))
    )
    return staged.select("source_id", "check_id", "kind", "pass", message.alias("message"))


def canary_status(results: DataFrame, sources: DataFrame) -> DataFrame:
    """pass, fail or skipped per source; reasons are bounded by its number of checks."""
    failed = F.when(~F.col("pass"), F.struct("check_id", "message"))
    s = results.groupBy("source_id").agg(
        F.bool_and("pass").alias("_ok"), F.array_sort(F.collect_list(failed)).alias("_f")
    )
    return sources.select("source_id").join(s, "source_id", "left").select(
        "source_id",
        F.when(F.col("_ok").isNull(), "skipped").when(F.col("_ok"), "pass").otherwise("fail")
        .alias("status"),
        F.coalesce(
            F.transform("_f", lambda x: x["message"]),
            F.array(F.lit("no canary configured for source")),
        ).alias("reasons"),
    )


# ---- captures, cache and access ------------------------------------------------------------

def default_ttl_hours(source_type: Column, configured: Column) -> Column:
    base = F.when(source_type.isin(HTTP_SOURCE_TYPES), 12).otherwise(24)
    return F.when(configured > 0, configured).otherwise(base)


def is_fresh(captured_at: Column, ttl_hours: Column, as_of: Column) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(captured_at)
    return F.coalesce((ttl_hours > 0) & (age <= ttl_hours * 3600000000), F.lit(False))


def cached_rows(raw: DataFrame, captures: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Rows of sources whose capture is younger than its time to live."""
    ttl = default_ttl_hours(F.col("source_type"), F.col("cache_ttl_hours"))
    fresh = captures.join(
        sources.select("source_id", "source_type", "cache_ttl_hours"), "source_id"
    ).filter(is_fresh(F.col("captured_at"), ttl, as_of))
    return raw.join(
        fresh.select("source_id", F.col("captured_at").alias("retrieved_at")), "source_id"
    )


def capture_summary(captures: DataFrame, sources: DataFrame) -> DataFrame:
    """Status, counts and times per configured source.

    ``captures``: source_id, captured_at, job_count, expected_count (text), broken (boolean).
    ``sources``: source_id, capture_path.
    """
    expected = half_up(F.col("expected_count").try_cast("double")).cast("bigint")
    j = sources.select("source_id", "capture_path").join(captures, "source_id", "left")
    no_path = F.coalesce(F.trim("capture_path"), F.lit("")) == ""
    status = (
        F.when(no_path, "no_capture_path")
        .when(F.col("broken").isNull(), "never_run")
        .when(F.col("broken"), "capture_error")
        .otherwise("ready")
    )
    staged = j.withColumns({"status": status, "_e": expected})
    ready = F.col("status") == "ready"
    return staged.select(
        "source_id", "status",
        F.when(ready, F.col("captured_at")).alias("captured_at"),
        F.when(ready, F.col("job_count")).otherwise(0).cast("bigint").alias("job_count"),
        F.when(ready & (F.col("_e") > 0), F.col("_e")).alias("expected_count"),
    )


def access_status(summary: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether a source can be reached, judged by its last capture."""
    j = sources.select(
        "source_id", "source_type", "enabled", "search_url", "capture_path"
    ).join(summary, "source_id", "left")
    has_path = F.coalesce(F.trim("capture_path"), F.lit("")) != ""
    browser = F.col("source_type").isin(AUTH_TYPES)
    reason = (
        F.when(~F.coalesce("enabled", F.lit(False)), "source_disabled")
        .when(~is_http_url(F.col("search_url")), "invalid_search_url")
        .when(F.col("status") == "capture_error", "capture_error")
        .when(has_path & (F.col("job_count") > 0), "capture_ok")
        .when(browser & has_path & F.col("captured_at").isNotNull(), "capture_ok_empty")
        .when(browser, "capture_required")
        .otherwise("probe_skipped")
    )
    r = F.col("reason_code")
    return j.withColumn("reason_code", reason).select(
        "source_id", "reason_code",
        F.when(r.isin("invalid_search_url", "capture_error"), "fail")
        .when(r.isin("capture_ok", "capture_ok_empty"), "pass").otherwise("warn").alias("access_status"),
    )


def source_cap(raw: DataFrame, sources: DataFrame, pos: str = "pos") -> DataFrame:
    """First ``max_jobs`` rows of each source; a source without a limit keeps all of its rows.

    ``raw`` is read once. Rows are ranked in (source, salt) first, so a large source is dealt out, and at most
    ``SALTS * max_jobs`` of its rows are ranked together; rows without a limit stay dealt out.
    """
    limits = sources.select("source_id", F.col("max_jobs").alias("_cap"))
    salt = F.pmod(F.xxhash64(*order_inputs(raw)), F.lit(SALTS))
    free = F.col("_cap").isNull()
    capped = join_one_per_key(raw, limits, "source_id").withColumn("_salt", salt)
    first = W.partitionBy("source_id", "_salt").orderBy(pos)
    last = W.partitionBy("source_id", F.when(free, F.col("_salt"))).orderBy(pos)
    for w in (first, last):
        capped = capped.withColumn("_at", F.row_number().over(w)).filter(free | (F.col("_at") <= F.col("_cap"))).drop("_at")
    return capped.drop("_cap", "_salt")
