"""A whole refresh against its parts, on captured rows of two sources."""

import datetime
import itertools
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postmill.operators import merge
from postmill.operators import run as running
from postmill.operators import settle as settling
from postmill.operators.run import gated, refresh
from postmill.plans import bindings as b
from postmill.plans import queries_quality as qq
from postmill.plans import queries_store as qst

SF = "/root/testdata/sf0.001"
STATUS = "job_id string, status string, notes string, last_action_at timestamp, submitted_at timestamp"


@pytest.fixture(scope="module")
def raw(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = qq.raw_runs(spark, SF).filter("source_id in ('src0', 'src4')").drop("captured_at", "description_source")
    return rows.cache()


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def test_second_run_prunes_only_what_ran_and_nobody_acted_on(spark, raw):
    as_of, none = b.ts(b.AS_OF_RAW), spark.createDataFrame([], STATUS)
    first = refresh(None, none, raw, as_of, on_bad_record="drop")
    every = ids(first.postings)
    assert every and first.log.agg(F.sum("new_count")).first()[0] == first.deltas.filter("delta = 'new'").count()
    half = raw.filter(F.col("source_id") == "src0").filter(F.xxhash64("url") % 2 == 0)
    seen = ids(refresh(None, none, half, as_of, on_bad_record="drop").postings)
    mine = ids(first.postings.filter("source_id = 'src0'"))
    absent = sorted(mine - seen)
    assert seen and len(absent) > 3
    at = "2001-11-01 00:00:00"
    status = spark.createDataFrame([(absent[0], "applied", None, at), (absent[1], "viewed", None, at), (absent[2], "rejected", None, at)], "job_id string, status string, notes string, at string")
    status = status.select("job_id", "status", "notes", F.col("at").cast("timestamp").alias("last_action_at"), F.lit(None).cast("timestamp").alias("submitted_at"))
    second = refresh(first.postings, status, half, as_of, on_bad_record="drop")
    gone = ids(second.deleted)
    # Duplicates of a posting that was acted on inherit its status and stay as well as they can.
    assert absent[0] not in gone and absent[2] not in gone and gone <= mine - seen
    # A row that shared its URL with another one in the first run is new when it comes alone.
    new = ids(second.deltas.filter("delta = 'new'"))
    assert ids(second.postings) == (every | new) - gone and absent[1] in gone and len(new) < 5
    assert second.applications.filter(F.col("job_id") == absent[1]).count() == 0
    counts = second.log.select("source_id", "new_count", "imported_count").collect()
    assert [r["source_id"] for r in counts] == ["src0"] and counts[0]["new_count"] == len(new)


def test_retention_and_rejected_runs(spark, raw):
    none = spark.createDataFrame([], STATUS)
    first = refresh(None, none, raw, b.ts(b.AS_OF_RAW), on_bad_record="drop")
    later = refresh(first.postings, none, raw.limit(0), b.ts("2003-01-01 00:00:00"))
    assert later.postings.count() == 0 and {r["why"] for r in later.deleted.collect()} == {"expired"}
    broken = raw.select("source_id", "run_id").distinct().withColumns({"expected_count": F.lit(10.0), "payload_error": F.lit("payload_jobs_missing")})
    stopped = refresh(first.postings, none, raw, b.ts(b.AS_OF_RAW), runs=broken)
    assert {r["outcome"] for r in stopped.outcomes.collect()} == {"reject"}
    assert ids(stopped.postings) == ids(first.postings) and stopped.log.count() == 0


def one_at_a_time(store, statuses, rows, as_of, days):
    """The store after a run, its statuses, what went and why, and the deltas, with rows taken one by one."""
    store, statuses = {i: dict(r) for i, r in store.items()}, dict(statuses)
    before = {i: dict(r) for i, r in store.items()}
    urls = {(r["source_id"], r["source_url"]): i for i, r in store.items()}
    before_urls, seen, deltas = dict(urls), set(), {}
    signature = [c for c in merge.SIGNATURE if c != "structured_meta"]
    for r in sorted(rows, key=lambda x: x["pos"]):
        place = (r["source_id"], r["source_url"])
        if r["id"] not in deltas:
            old = before.get(r["id"]) or before.get(before_urls.get(place))
            deltas[r["id"]] = "new" if old is None else "unchanged" if all(old[c] == r[c] for c in signature) else "updated"
        at = r["id"] if r["id"] in store else urls.get(place)
        if at is None:
            at = r["id"]
            store[at], urls[place] = dict(r), at
        else:
            store[at].update({c: r[c] for c in merge.UPDATED})
        seen.add(at)
    ran = {r["source_id"] for r in rows}
    gone = {i: "absent" for i, r in store.items() if i not in seen and r["source_id"] in ran and statuses.get(i, ("new",))[0] in ("new", "viewed")}
    groups = {}
    for i, (status, at) in sorted(statuses.items()):
        h = store[i]["normalized_hash"] if i in store else None
        if h and (h not in groups or at > groups[h][1]):
            groups[h] = (status, at)
    for i, r in store.items():
        if i not in statuses and r["normalized_hash"] in groups:
            statuses[i] = groups[r["normalized_hash"]]
    for i, r in store.items():
        status, at = statuses.get(i, ("new", None))
        if status != "applied" and days[status] and as_of - (at or r["updated_at"]) >= datetime.timedelta(days=days[status]):
            gone.setdefault(i, "expired")
    return {i: r for i, r in store.items() if i not in gone}, {i: s for i, s in statuses.items() if i not in gone}, gone, deltas


def test_two_runs_with_chains_of_ids_equal_rows_one_at_a_time(spark):
    """Ids come from board ids and URLs, so rows of one URL have several ids and the other way round."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    days = {"new": 1500, "viewed": 1800, "skip_for_now": 900, "rejected": 700, "applied": None}
    as_of, clock = b.ts(b.AS_OF_RAW), datetime.datetime.fromisoformat(b.AS_OF_RAW)
    few = F.col("source_id").isin("src0", "src2", "src4") & (F.xxhash64("pos") % 2 == 0)
    raw = qq.raw_runs(spark, SF).filter(few).withColumn("retrieved_at", F.col("seen_at"))
    # Few URLs and few ids: each is met in many pairs.
    n = F.xxhash64("pos", F.lit(1))
    raw = raw.withColumns({
        "external_id": F.when(n % 3 != 0, F.concat(F.lit("x"), F.pmod(n, F.lit(60)).cast("string"))),
        "url": F.concat(F.lit("https://jobs.example.com/p/"), F.pmod(F.xxhash64("pos", F.lit(2)), F.lit(90)).cast("string")),
    }).drop("description_source")
    first_rows, later_rows = (raw.filter(c).drop("captured_at") for c in (F.col("captured_at") < b.ts(qst.FIRST_UNTIL), F.col("captured_at") >= b.ts(qst.SECOND_FROM)))
    policy, none = merge.retention_policy_rows(spark, days), spark.createDataFrame([], STATUS)
    collected = [[r.asDict() for r in gated(x, as_of, None, None, "reject_source")[1].collect()] for x in (first_rows, later_rows)]
    assert all(len({r["id"] for r in rows}) > 20 for rows in collected)
    first = refresh(None, none, first_rows, as_of, policy=policy)
    store, statuses, gone, deltas = one_at_a_time({}, {}, collected[0], clock, days)
    check(first, store, statuses, gone, deltas)
    acted = qst.acted_on(first.postings)
    known = {r["job_id"]: (r["status"], r["last_action_at"]) for r in acted.collect()}
    assert len({s for s, _ in known.values()}) == 4
    second = refresh(first.postings, acted, later_rows, as_of, policy=policy)
    store, statuses, gone, deltas = one_at_a_time(store, known, collected[1], clock, days)
    assert set(gone.values()) == {"absent", "expired"} and len(set(deltas.values())) > 1 and len(statuses) > len(known) - len(gone)
    check(second, store, statuses, gone, deltas)


def check(after, store, statuses, gone, deltas):
    fields = [c for c in merge.UPDATED if c != "structured_meta"]
    shown = {r["id"]: {c: r[c] for c in [*fields, "source_id", "source_url"]} for r in after.postings.collect()}
    assert shown == {i: {c: r[c] for c in [*fields, "source_id", "source_url"]} for i, r in store.items()}
    assert {r["job_id"]: (r["status"], r["last_action_at"]) for r in after.applications.collect()} == statuses
    assert {r["id"]: r["why"] for r in after.deleted.collect()} == gone
    assert {r["id"]: r["delta"] for r in after.deltas.collect()} == deltas


def test_slices_equal_rows_one_at_a_time_and_leave_only_what_is_read(spark, monkeypatch, tmp_path):
    """Plain postings go in slices, those with tangled keys or many rows through the general merge."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    number = itertools.count()
    monkeypatch.setattr(settling, "new_path", lambda _, label="settled": str(tmp_path / f"{label}-{next(number)}"))
    monkeypatch.setattr(running, "SLICE_ROWS", 150)
    monkeypatch.setattr(running, "HOT", 9)
    n, hot = F.col("id"), F.col("id") % 13 == 0
    raw = spark.range(420).select(
        F.concat(F.lit("s"), (n % 2).cast("string")).alias("source_id"), F.when(n % 2 == 0, "builtin_search").otherwise("indeed_search").alias("source_type"),
        F.lit("r").alias("run_id"), F.format_string("%04d", n).alias("pos"), F.when(n % 10 == 0, F.concat(F.lit("x"), (n % 7).cast("string"))).alias("external_id"),
        F.concat(F.lit("Title "), (n % 31).cast("string")).alias("title"), F.lit("Acme").alias("company"), F.lit("Paris").alias("location"),
        F.lit("2001-01-01").alias("posted_at"), F.lit("F").alias("employment_type"), F.concat(F.lit("$"), (n % 5 + 1).cast("string"), F.lit("0000")).alias("salary_text"),
        F.lit(None).cast("string").alias("summary"), F.lit("Words").alias("description"),
        F.concat(F.lit("https://jobs.example.com/p/"), F.when(hot, F.lit(1)).otherwise(n * 37 % 101).cast("string")).alias("url"),
        F.timestamp_seconds(F.lit(980000000) + n * 86400).alias("retrieved_at"),
    )
    days = {"new": 200, "viewed": 250, "skip_for_now": 60, "rejected": 40, "applied": None}
    as_of, clock = b.ts(b.AS_OF_RAW), datetime.datetime.fromisoformat(b.AS_OF_RAW)
    policy, none = merge.retention_policy_rows(spark, days), spark.createDataFrame([], STATUS)
    parts = [raw.filter("id < 300"), raw.filter("id >= 260")]
    collected = [[r.asDict() for r in gated(x, as_of, None, None, "reject_source")[1].collect()] for x in parts]
    assert [len(x) for x in collected] == [300, 160]
    first = refresh(None, none, parts[0], as_of, policy=policy)
    store, _, gone, deltas = one_at_a_time({}, {}, collected[0], clock, days)
    check(first, store, {}, gone, deltas)
    acted = settling.settle(qst.acted_on(first.postings), "acted")
    known = {r["job_id"]: (r["status"], r["last_action_at"]) for r in acted.collect()}
    second = refresh(first.postings, acted, parts[1], as_of, policy=policy, spent=(first.table,))
    store, statuses, gone, deltas = one_at_a_time(store, known, collected[1], clock, days)
    assert set(gone.values()) == {"absent", "expired"} and set(deltas.values()) == {"new", "updated", "unchanged"}
    check(second, store, statuses, gone, deltas)
    logged = {r["source_id"]: r["imported_count"] for r in second.log.collect()}
    assert logged == {s: len({r["id"] for r in collected[1] if r["source_id"] == s}) for s in ("s0", "s1")}
    assert len(second.table.settled_paths) > 2 and not any(Path(p).exists() for p in first.table.settled_paths)
    labels = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert not labels & {"run-pairs", "run-tangled", "run-knots", "run-old"}


def test_packed_text_comes_back(rows):
    from postmill.functions.core import packed, unpacked

    texts = ["", "ab", "AB", "abc", "0aff", "é", "x1", "00", None, "\x00"]
    got = rows([{"t": t} for t in texts], "t string").select("t", packed(F.col("t")).alias("p")).select("t", "p", unpacked(F.col("p")).alias("u")).collect()
    assert all(r.t == r.u for r in got) and len({bytes(r.p) for r in got if r.p is not None}) == 9 and {len(r.p) for r in got if r.t == "0aff"} == {3}
