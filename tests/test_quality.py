import datetime as dt

import pytest
from pyspark.sql import functions as F

from postmill.operators import quality

RAW = "source_id string, run_id string, pos int, title string, company string, location string, url string, posted_at string, salary_text string, employment_type string, description string"
KEYS = ["source_id", "run_id"]
AS_OF = dt.datetime(2024, 3, 10)


def capture(n, run="r", url=None, **kw):
    return [
        {"source_id": "s", "run_id": run, "pos": i, "title": f"T{i}", "company": "C", "url": url or f"https://x.y/{i}",
         "location": "L", "posted_at": "today", "salary_text": "$1", "employment_type": "F", "description": "d", **kw}
        for i in range(n)
    ]


def outcome(rows, data, expected):
    runs = rows([{"source_id": "s", "run_id": "r", "e": expected}], "source_id string, run_id string, e int").withColumnRenamed("e", "expected_count")
    m = quality.run_outcome(quality.capture_metrics(rows(data, RAW), KEYS, runs)).first()
    return m.outcome, [r["code"] for r in m.reasons], m


def test_outcomes(rows):
    assert outcome(rows, capture(18), 20)[:2] == ("accept", [])
    assert outcome(rows, capture(2), 50)[:2] == ("quarantine", ["baseline_volume_low"])
    assert outcome(rows, capture(12, url="https://x.y/1"), None)[:2] == ("quarantine", ["duplicate_ratio_low"])
    assert outcome(rows, capture(9, company=" Unknown "), None)[:2] == ("reject", ["required_coverage_company_low"])
    got = outcome(rows, capture(9, location=None, posted_at="", salary_text="unknown", employment_type=None), None)
    assert got[1] == ["optional_fields_near_empty"]
    got = outcome(rows, capture(9, url="no url"), None)
    assert got[1] == ["duplicate_ratio_low", "url_validity_low"]
    assert got[2].reasons[1]["message"] == "invalid URL rate too high: valid ratio 0% < 70%"


def test_empty_run_stays_and_payload_errors_reject(rows):
    o, codes, m = outcome(rows, [], 50)
    assert (o, m.sample_size, m.unique_ratio, m.cov_title) == ("quarantine", 0, None, None)
    bad = quality.capture_metrics(rows(capture(3), RAW), KEYS).withColumn("payload_error", F.lit("payload_jobs_missing"))
    r = quality.run_outcome(bad).first()
    assert (r.outcome, r.reasons[0]["code"]) == ("reject", "payload_jobs_missing")


HIST = "source_id string, run_id string, captured_at timestamp, sample_size bigint, baseline_ratio double, outcome string, cov_title double, cov_company double, cov_url double, unk_location double, unk_postedAt double, unk_salaryText double, unk_employmentType double"


def run(day, size, outcome="accept", unk=0.1, cov=1.0, **kw):
    return {"source_id": "s", "run_id": f"r{day}", "captured_at": dt.datetime(2024, 3, day), "sample_size": size, "outcome": outcome,
            "cov_title": cov, "cov_company": cov, "cov_url": cov, "unk_location": unk, "unk_postedAt": unk, "unk_salaryText": unk,
            "unk_employmentType": unk, **kw}


@pytest.mark.parametrize(
    "history,status,words",
    [
        ([run(1, 90), run(2, 88), run(3, 4)], "degraded", "volume anomaly"),
        ([run(1, 90), run(2, 88), run(3, 91)], "ok", None),
        ([run(1, 90), run(2, 90), run(3, 90, unk_salaryText=0.95)], "degraded", "null-rate spike detected for salaryText"),
        ([run(3, 10, outcome="reject")], "failing", "latest run marked reject"),
        ([run(3, 10, cov=None)], "degraded", "required-field confidence below threshold (0%)"),
        ([], "unknown", "no recent runs"),
    ],
)
def test_health(rows, history, status, words):
    s = rows([{"source_id": "s"}], "source_id string")
    r = quality.source_health(rows(history, HIST), s, F.lit(AS_OF)).first()
    assert r.status == status
    assert words is None or any(words in x for x in r.reasons)


def test_old_runs_do_not_count(rows):
    s = rows([{"source_id": "s"}], "source_id string")
    old = run(3, 10)
    old["captured_at"] = dt.datetime(2023, 1, 1)
    assert quality.source_health(rows([old], HIST), s, F.lit(AS_OF)).first().status == "unknown"


def test_duplicate_contracts_are_an_error(rows):
    c = rows([{"source_type": "a", "v": "1"}, {"source_type": "a", "v": "2"}], "source_type string, source_id string, v string")
    df = rows([{"source_type": "a", "source_id": "x"}], "source_type string, source_id string")
    with pytest.raises(Exception, match="duplicate contract"):
        quality.resolve_contract(df, c).collect()


def test_one_bad_record_blocks_its_source(rows):
    n = rows([{"source_id": "a"}, {"source_id": "a", "reject_reason": "title"}, {"source_id": "b"}], "source_id string, reject_reason string")
    assert [r.source_id for r in quality.gate_sources(n).collect()] == ["b"]
    assert quality.gate_sources(n, "drop").count() == 2


def test_keep_newest_replaces_rerecorded(rows):
    t = lambda d, h=0: dt.datetime(2024, 3, d, h)
    h = rows([{"k": "s", "c": t(1), "r": t(1), "v": 1}, {"k": "s", "c": t(1), "r": t(2), "v": 2}, {"k": "s", "c": t(3), "r": t(3), "v": 3}, {"k": "s", "c": t(2), "r": t(3), "v": 4}], "k string, c timestamp, r timestamp, v int")
    assert sorted(r.v for r in quality.keep_newest(h, ["k"], 2, "c", "r").collect()) == [3, 4]
    assert sorted(r.v for r in quality.keep_newest(h, ["k"], 9, "c", "r").collect()) == [2, 3, 4]


def test_source_cap_reads_once_and_keeps_sources_without_a_limit(spark, rows):
    data = [{"source_id": "hot", "pos": i} for i in range(500)] + [{"source_id": "free", "pos": i} for i in range(40)] + [{"source_id": None, "pos": 1}]
    raw = rows(data, "source_id string, pos int")
    sources = rows([{"source_id": "hot", "max_jobs": 7}, {"source_id": "free"}, {"source_id": "idle", "max_jobs": 3}], "source_id string, max_jobs int")
    capped = quality.source_cap(raw, sources)
    got = [(r["source_id"], r["pos"]) for r in capped.collect()]
    assert sorted(p for s, p in got if s == "hot") == list(range(7))
    assert sorted(p for s, p in got if s == "free") == list(range(40)) and (None, 1) in got and len(got) == 48
    assert capped.columns == raw.columns and quality.source_cap(raw.limit(0), sources).count() == 0


def test_every_query_plans_with_the_settings_of_the_session(spark):
    from postmill.plans import queries_quality  # noqa: F401
    from postmill.plans.catalog import QUERIES
    from postmill.session import PLANNING

    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    QUERIES["q_source_cap"](spark, "/root/testdata/sf0.001")
    assert all(spark.conf.get(name).lower() == value.lower() for name, value in PLANNING.items())


def test_funnel_counts_every_row_and_imports_only_usable_ones(rows):
    ddl = "source_id string, drop_reason string, normalized_hash string"
    data = [("a", None, "h"), ("a", None, "h"), ("a", None, None), ("a", "excluded", "i"), ("z", None, "h"), ("z", "excluded", "j")]
    filtered = rows([dict(zip(("source_id", "drop_reason", "normalized_hash"), r)) for r in data], ddl)
    sources = rows([{"source_id": "a", "expected_count": 2}, {"source_id": "b", "expected_count": 5}], "source_id string, expected_count int")
    got = {r.source_id: (r.captured, r.kept, r.deduped, r.dropped_dedupe, r.expected_count, r.import_status) for r in quality.capture_funnel(filtered, sources).collect()}
    # No captured row is left out, also where its source is not configured.
    assert got == {"a": (4, 3, 1, 2, 2, "warning"), "b": (0, 0, 0, 0, 5, "critical"), "z": (2, 1, 1, 0, None, "unknown")}
    assert sorted(map(tuple, quality.imported_hashes(filtered).collect())) == [("a", "h"), ("z", "h")]


def test_funnel_query_imports_nothing_from_records_without_required_fields(spark, monkeypatch, rows):
    from postmill.plans import bindings, queries_quality

    kinds = {"source_id": "src2", "source_type": "wellfound_search", "external_id": None, "location": "Paris", "summary": None, "employment_type": None, "description": "d"}
    raw = [kinds | {"pos": str(i), "title": t, "company": c, "url": u} for i, (t, c, u) in enumerate([("T", "C", "https://x.y/1"), (" ", "C", "https://x.y/2"), ("T", None, "https://x.y/3"), ("T", "C", ""), ("U", "C", "https://x.y/1")])]
    ddl = "source_id string, source_type string, external_id string, location string, summary string, employment_type string, description string, pos string, title string, company string, url string"
    monkeypatch.setattr(bindings, "b_raw", lambda *_: rows(raw, ddl))
    row = queries_quality.funnel(spark, "").filter("source_id = 'src2'").first()
    assert (row.captured, row.kept, row.deduped, row.dropped_dedupe) == (5, 5, 1, 4)
