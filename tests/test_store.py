import datetime as dt

from pyspark.sql import functions as F

from postmill.operators import identity, merge, throttle
from postmill.schemas import POSTING, conform

T0 = dt.datetime(2024, 3, 8, 12)
DDL = (
    "id string, source_id string, source_url string, title string, company string, salary_text string, "
    "missing_required_fields array<string>, created_at timestamp, updated_at timestamp"
)


def post(i, **kw):
    return {"id": f"job-{i}", "source_id": "s", "source_url": f"u{i}", "title": "T", "company": "C", "missing_required_fields": [], "created_at": T0, "updated_at": T0, **kw}


def incoming(rows, *jobs):
    return rows([{**j, "pos": n} for n, j in enumerate(jobs)], DDL + ", pos int")


def test_delta_counts(rows):
    base = rows([post(1), post(2), post(4, missing_required_fields=None)], DDL)
    new = incoming(rows, post(1), post(2, title="Changed"), post(3), post(1, title="again"), post(4), post(9, source_url="u2"))
    got = {r.id: r.delta for r in merge.classify_delta(base, new).collect()}
    assert got == {"job-1": "unchanged", "job-2": "updated", "job-3": "new", "job-4": "updated", "job-9": "unchanged"}
    c = merge.delta_counts(merge.classify_delta(base, new)).first()
    assert (c.new_count, c.updated_count, c.unchanged_count) == (1, 2, 2)


def test_upsert_keeps_identity_and_last_copy_wins(rows):
    later = T0 + dt.timedelta(days=1)
    base = rows([post(1), post(2)], DDL)
    new = incoming(
        rows, post(1, title="a", updated_at=later), post(1, title="b", updated_at=later, created_at=later),
        post(7, source_url="u2", title="rekeyed"), post(3), post(4, source_url="u3", title="same url"),
    )
    m = merge.upsert_postings(base, new)
    got = {r.id: r for r in m.collect()}
    assert set(got) == {"job-1", "job-2", "job-3"}
    assert (got["job-1"].title, got["job-1"].created_at, got["job-1"].updated_at) == ("b", T0, later)
    assert got["job-2"].title == "rekeyed" and got["job-2"].source_url == "u2"
    assert (got["job-3"].title, got["job-3"].change) == ("same url", "inserted")
    c = merge.upsert_counts(m).first()
    assert (c.rows_written, c.inserted, c.updated) == (3, 1, 2)
    again = merge.upsert_postings(m.drop("change"), new)
    assert sorted(map(str, again.drop("change").collect())) == sorted(map(str, m.drop("change").collect()))


def test_upsert_equals_one_row_at_a_time_on_random_chains(rows):
    """Ids and URLs that cross over many rows, copies that come before and after the maker of their id, one hot URL."""
    import random

    rng = random.Random(2)
    base = [post(i, source_url=f"u{i}") for i in range(6)]
    batch = []
    for n in range(400):
        i, u = rng.randrange(80), "hot" if rng.random() < 0.2 else f"u{rng.randrange(80)}"
        batch.append(post(i, source_url=u, source_id=rng.choice(["s", "s", "t"]), title=f"t{n}", created_at=T0 + dt.timedelta(hours=n), updated_at=T0 + dt.timedelta(hours=n)))
    batch += [post(f"c{n}", source_url=f"cu{n // 2}") for n in range(30)] + [post(f"c{(n + 1) // 2 * 2}", source_url=f"cu{n + 40}") for n in range(30)]
    store = {r["id"]: dict(r, change="kept") for r in base}
    urls = {(r["source_id"], r["source_url"]): r["id"] for r in base}
    for r in batch:
        at = r["id"] if r["id"] in store else urls.get((r["source_id"], r["source_url"]))
        if at is None:
            store[r["id"]] = dict(r, change="inserted")
            urls[r["source_id"], r["source_url"]] = r["id"]
        else:
            old = store[at]
            change = "inserted" if old["change"] == "inserted" else "updated"
            store[at] = {**old, **{c: r[c] for c in r if c in merge.UPDATED}, "change": change}
    cols = ["id", "source_id", "source_url", "title", "created_at", "updated_at", "change"]
    want = sorted(tuple(r[c] for c in cols) for r in store.values())
    b, new = rows(base, DDL), incoming(rows, *batch)
    assert sorted(tuple(r[c] for c in cols) for r in merge.upsert_postings(b, new).collect()) == want
    # The same in rounds on Spark, down to the last row.
    resolved = merge.resolve_incoming(b, new, in_one_task=0)
    assert sorted((r["surviving_id"], r["title"], r["source_url"]) for r in resolved.filter("NOT matched").collect()) == sorted((x[0], x[3], x[2]) for x in want if x[6] == "inserted")


def test_prune_spares_rekeyed_seen_and_other_sources(rows):
    base = rows([post(1), post(2), post(3), post(4), post(5, source_id="other")], DDL)
    status = rows([{"job_id": "job-3", "status": "applied"}, {"job_id": "job-4", "status": "viewed"}], "job_id string, status string")
    alive = merge.resolve_incoming(base, incoming(rows, post(7, source_url="u1")))
    gone = merge.prune_absent(base, status, alive, rows([{"source_id": "s"}], "source_id string"))
    assert sorted(r.id for r in gone.collect()) == ["job-2", "job-4"]
    assert [r.job_id for r in merge.drop_dependents(status, gone).collect()] == ["job-3"]


def test_retention_case(rows):
    days = lambda n: T0 - dt.timedelta(days=n)
    cases = [("a", None, 31), ("b", "viewed", 46), ("c", "skip_for_now", 22), ("d", "rejected", 15), ("e", "applied", 365), ("f", None, 5), ("g", "rejected", 14)]
    df = rows([{"id": i, "status": s, "updated_at": days(n), "created_at": days(n)} for i, s, n in cases], "id string, status string, last_action_at timestamp, updated_at timestamp, created_at timestamp")
    m = merge.retention(df, merge.retention_policy_rows(df.sparkSession), F.lit(T0))
    assert sorted(r.id for r in m.filter("expired").collect()) == ["a", "b", "c", "d", "g"]
    s = merge.retention_summary(m).first()
    assert (s.total_deleted, s.deleted_rejected, s.deleted_applied, s.protected_applied) == (5, 2, 0, 1)


def test_status_moves(rows):
    base = rows([{"job_id": "1", "status": "applied", "notes": "", "last_action_at": T0, "submitted_at": T0}, {"job_id": "2", "status": "new", "notes": ""}],
                "job_id string, status string, notes string, last_action_at timestamp, submitted_at timestamp")
    later = T0 + dt.timedelta(days=1)
    up = rows([{"job_id": i, "status": "viewed", "notes": "n", "at": later} for i in "123"], "job_id string, status string, notes string, at timestamp")
    got = {r.job_id: r for r in merge.upsert_status(base, up).collect()}
    assert (got["1"].status, got["1"].submitted_at) == ("viewed", T0)
    guarded = {r.job_id: r.status for r in merge.upsert_status(base, up, only_from="new").collect()}
    assert guarded == {"1": "applied", "2": "viewed", "3": "viewed"}


def test_inheritance_takes_the_latest_action(rows):
    p = rows([{"id": str(i), "normalized_hash": "h" if i < 4 else "x"} for i in range(5)], "id string, normalized_hash string")
    a = rows([{"job_id": "0", "status": "viewed", "last_action_at": T0}, {"job_id": "1", "status": "rejected", "last_action_at": T0 + dt.timedelta(1)}],
             "job_id string, status string, notes string, last_action_at timestamp")
    assert {r.job_id: r.status for r in merge.inherited_status(p, a).collect()} == {"2": "rejected", "3": "rejected"}
    u = rows([{"normalized_hash": "x", "status": "applied", "at": T0}, {"normalized_hash": "gone", "status": "viewed", "at": T0}], "normalized_hash string, status string, notes string, at timestamp")
    assert {r.job_id: r.status for r in merge.propagate_status(p, u).collect()} == {"4": "applied", "gone": "viewed"}


def test_identity_crosses_sources_for_linkedin_and_backfills(rows):
    ddl = "source_id string, source_type string, url string, external_id string, title string, company string, location string"
    li = {"source_type": "linkedin_capture_file", "title": "PM", "company": "Acme", "location": "SF"}
    df = rows([
        {**li, "source_id": "a", "url": "https://www.linkedin.com/jobs/view/1"},
        {**li, "source_id": "b", "url": "https://www.linkedin.com/jobs/search-results/?x"},
        {**li, "source_id": "c", "url": "https://x.y/z", "company": "pm", "location": "Acme"},
        {"source_id": "d", "source_type": "indeed_search", "url": "https://indeed.com/?jk=9", "title": "PM", "company": "Acme"},
    ], ddl)
    got = {r.source_id: r for r in identity.with_identity(df).collect()}
    assert got["a"].normalized_hash == got["b"].normalized_hash == got["c"].normalized_hash != got["d"].normalized_hash
    assert (got["a"].external_id, got["d"].external_id, got["c"].location) == ("1", "9", None)
    assert len({r.id for r in got.values()}) == 4
    stored = identity.with_identity(df).drop("url")
    assert identity.backfill_identity(stored).count() == 0
    assert identity.backfill_identity(stored.withColumn("normalized_hash", F.lit("old"))).count() == 4


def test_conform_adds_typed_nulls(spark):
    df = conform(spark.range(1).select(F.col("id").cast("string").alias("id")), POSTING)
    assert df.dtypes == df.sparkSession.createDataFrame([], POSTING).dtypes and df.first().missing_required_fields is None


def test_eligibility_order_and_mock(rows):
    e = rows([
        {"event_id": 1, "source_id": "s", "source_type": "google_search", "at": T0, "outcome": "success", "mode": "manual"},
        {"event_id": 2, "source_id": "s", "source_type": "google_search", "at": T0 + dt.timedelta(hours=4), "outcome": "challenge", "mode": "scheduled"},
        {"event_id": 3, "source_id": "s", "source_type": "google_search", "at": T0 + dt.timedelta(hours=5), "outcome": "success", "mode": "scheduled"},
    ], "event_id bigint, source_id string, source_type string, at timestamp, outcome string, mode string")
    audit = {r.event_id: r.reason for r in throttle.refresh_audit(e).collect()}
    assert audit == {1: "eligible", 2: "eligible", 3: "cooldown"}
    assert {r.reason for r in throttle.refresh_audit(e, "mock").collect()} == {"mock_profile"}
    st = throttle.with_policy(throttle.refresh_state(e, F.lit(T0)), "safe")
    at = lambda h: F.unix_micros(F.lit(T0 + dt.timedelta(hours=h)))
    for hours, reason in ((6, "cooldown"), (17, "eligible")):
        assert throttle.eligibility(st.withColumn("events_today", F.lit(0)), at(hours)).first().reason == reason
    waiting = throttle.eligibility(st.withColumns({"cooldown_until": F.lit(None).cast("bigint"), "events_today": F.lit(0)}), at(6))
    assert waiting.first().reason == "min_interval"
    forced = throttle.refresh_decision(waiting, F.lit(True), force=True).first()
    assert (forced.served_from, forced.status_reason, forced.status_label) == ("live", "force_refresh", "ready_live")
    assert throttle.refresh_decision(waiting, F.lit(False)).first().status_label == "throttled"


def test_delta_exchanges_signatures_alone(rows, capsys):
    delta = merge.classify_delta(rows([post(1)], DDL), incoming(rows, post(1), post(2)))
    capsys.readouterr()
    delta.explain()
    aggregates = [line for line in capsys.readouterr().out.splitlines() if "min_by" in line]
    assert aggregates and not any("description" in line or "company" in line for line in aggregates)


def test_settled_tables_are_small(spark, tmp_path, monkeypatch):
    from postmill.operators import settle

    monkeypatch.setattr(settle, "new_path", lambda *_: str(tmp_path / "t"))
    assert settle.settle(spark.range(10)).count() == 10
    assert any(f.name.endswith(".zstd.parquet") or ".zstd." in f.name for f in (tmp_path / "t").iterdir())
