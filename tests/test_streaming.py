import datetime as dt

from pyspark.sql import functions as F

from postmill.operators import quality, throttle
from postmill.operators.bucketed import manifest, read_store, write_store
from postmill.operators.run import refresh
from postmill.plans import bindings as b
from postmill.plans import queries_quality as qq
from postmill.streaming import jobs

SF = "/root/testdata/sf0.001"
STATUS = "job_id string, status string, notes string, last_action_at timestamp, submitted_at timestamp"


def parts(df, path, order, n=3):
    """Write a table as n files in time order, oldest first."""
    cut = [df.approxQuantile(order, [i / n for i in range(1, n)], 0.0)]
    edges = [float("-inf"), *cut[0], float("inf")]
    for i in range(n):
        part = df.filter((F.col(order) > edges[i]) & (F.col(order) <= edges[i + 1]))
        part.drop(order).coalesce(1).write.mode("append").parquet(path)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_counters_equal_batch(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = b.b_event(spark, SF).withColumn("_o", F.unix_micros("occurred_at").cast("double"))
    parts(e, str(tmp_path / "in"), "_o")
    s = jobs.file_stream(spark, str(tmp_path / "in"), e.drop("_o").schema)
    q = jobs.live_event_counters(s).writeStream.outputMode("complete").format("memory").queryName("ctr").start()
    drain(q)
    live = spark.table("ctr").groupBy("event", "channel").agg(F.sum("n").alias("n"))
    batch = e.groupBy("event", "channel").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


EVENT = "event_id long, source_id string, source_type string, at timestamp, outcome string, mode string"


def audited(spark, path, ddl, ck, lateness, name):
    s = jobs.file_stream(spark, path, spark.createDataFrame([], ddl).schema)
    q = jobs.throttle_stream(s, "probe", lateness).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", ck).start()
    q.processAllAvailable()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    return {r.event_id: (r.reason, r.next_eligible, r.events_today) for r in spark.table(name).collect()}, kept


def test_throttle_equals_audit_for_batches_out_of_order(spark, tmp_path):
    e = b.b_refresh(spark, SF).cache()
    ddl, path = ", ".join(f"{n} {t}" for n, t in e.dtypes), str(tmp_path / "in")
    for i in (2, 0, 1):  # every batch has events of all times
        e.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    last = e.limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "source_id": F.lit("far"), "at": F.lit("2040-01-01 00:00:00").cast("timestamp")})
    last.coalesce(1).write.mode("append").parquet(path)
    got, kept = audited(spark, path, ddl, str(tmp_path / "ck"), "900 days", "thr")
    want = {r.event_id: (r.reason, r.next_eligible, r.events_today) for r in throttle.refresh_audit(e, "probe").collect()}
    assert got == want and len({v[0] for v in want.values()}) >= 3
    assert kept == 1  # all sources but the far one have been quiet for long and lost their state


def test_throttle_drops_what_is_later_than_the_watermark(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    event = lambda n, m, outcome="success", s="a": (n, s, "indeed_search", at(m), outcome, "manual")
    path, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    batches = [[event(2, 12), event(1, 5, "challenge")], [event(3, 60)], [event(4, 61), event(5, 1)], [event(6, 300, s="b")]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(path)
    got, kept = audited(spark, path, EVENT, ck, "10 minutes", "late")
    # Event 5 is 60 minutes older than the newest; event 6 still waits for the watermark.
    on_time = spark.createDataFrame([r for batch in batches for r in batch if r[0] not in (5, 6)], EVENT)
    assert got == {r.event_id: (r.reason, r.next_eligible, r.events_today) for r in throttle.refresh_audit(on_time, "probe").collect()}
    assert kept == 2


def test_a_capture_recorded_again_replaces_the_first(spark, tmp_path):
    hour = lambda h: dt.datetime(2024, 1, 1, h)
    ddl = "source_id string, captured_at timestamp, recorded_at timestamp, n int, note string"
    batches = [
        [("a", hour(1), hour(2), 1, None), ("b", hour(1), hour(2), 5, "x")],
        [("a", hour(1), hour(3), 2, "again"), ("b", hour(1), hour(3), 5, "x")],  # b is a replay
        [("a", hour(1), hour(2), 9, "older record")],
        [("c", hour(9), hour(9), 7, None), ("c", hour(9), hour(10), 8, None)],
        [("c", hour(9), hour(10), 8, None)],  # what is late is judged by the watermark of the batch before
        [("a", hour(1), hour(11), 3, "too late")],
    ]
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = jobs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], ddl).schema)
    q = jobs.latest_captures(s).writeStream.outputMode("append").format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    log = spark.table("versions")
    assert sorted((r.source_id, r.version, r.op, r.n) for r in log.collect()) == [("a", 1, "insert", 1), ("a", 2, "replace", 2), ("b", 1, "insert", 5), ("c", 1, "insert", 7), ("c", 2, "replace", 8)]
    assert sorted((r.source_id, r.n, r.note) for r in jobs.current_captures(log).collect()) == [("a", 2, "again"), ("b", 5, "x"), ("c", 8, None)]
    assert kept == 1  # a and b are behind the watermark


def test_ingest_equals_batch(spark, tmp_path):
    raw = qq.raw_runs(spark, SF).filter("source_id in ('src0', 'src4')").drop("captured_at", "description_source")
    as_of, none = b.ts(b.AS_OF_RAW), spark.createDataFrame([], STATUS)
    # Cut between weekly runs: a run that is split would be judged twice.
    week = F.unix_micros(F.date_trunc("week", "seen_at")).cast("double")
    dated = raw.withColumn("_o", week)
    parts(dated, str(tmp_path / "in"), "_o", 2)
    s = jobs.file_stream(spark, str(tmp_path / "in"), raw.schema)
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    run = lambda ck: jobs.ingest_batches(spark, s, store, log, none, as_of, str(tmp_path / ck), on_bad_record="drop").awaitTermination()
    run("ck")
    cut = dated.approxQuantile("_o", [0.5], 0.0)[0]
    want = None
    for part in (dated.filter(F.col("_o") <= cut), dated.filter(F.col("_o") > cut)):
        want = refresh(want and want.postings, none, part.drop("_o"), as_of, on_bad_record="drop")
    cols = ["id", "title", "salary_text", "normalized_hash", "posted_at", "source_url", "structured_meta"]
    last = read_store(spark, store, 1)
    assert last.count() and sorted(map(str, last.select(*cols).collect())) == sorted(map(str, want.postings.select(*cols).collect()))
    # A new checkpoint reads everything again and goes on from the latest version.
    run("other")
    versions = sorted((r["number"], r["version"]) for r in spark.read.parquet(f"{log}/versions").collect())
    assert versions == [(0, 0), (0, 2), (1, 1), (1, 3)]
    assert spark.read.parquet(f"{log}/runs/v=3").agg(F.sum("new_count")).first()[0] == 0 or read_store(spark, store, 3).count() == last.count()


def test_a_run_recorded_again_replaces_the_earlier_record(spark, tmp_path):
    runs = qq.outcomes(spark, SF).select("source_id", "run_id", "captured_at", "sample_size", "baseline_ratio", "outcome", "cov_title", "cov_company", "cov_url",
                                         *[f"unk_{f}" for f in quality.OPTIONAL])
    one = runs.filter("source_id = 'src0'").orderBy("run_id").limit(6)
    one.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    one.withColumn("sample_size", F.lit(77).cast(dict(one.dtypes)["sample_size"])).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    s = jobs.file_stream(spark, str(tmp_path / "in/*"), runs.schema)
    jobs.health_batches(spark, s, b.b_source(spark), str(tmp_path / "h"), str(tmp_path / "r"), b.ts(qq.NOW), str(tmp_path / "ck"), keep=4).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "h/v=1")).collect()
    assert len(kept) == 4 and {r["sample_size"] for r in kept} == {77}
    # A new checkpoint starts at batch 0 again, but not at the first version.
    jobs.health_batches(spark, s, b.b_source(spark), str(tmp_path / "h"), str(tmp_path / "r"), b.ts(qq.NOW), str(tmp_path / "other"), keep=4).awaitTermination()
    assert sorted(r["version"] for r in spark.read.parquet(str(tmp_path / "h/versions")).collect()) == [0, 1, 2, 3]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "h/v=3")).collect())) == sorted(map(str, kept))


def test_health_over_batches(spark, tmp_path):
    runs = qq.outcomes(spark, SF).select("source_id", "run_id", "captured_at", "sample_size", "baseline_ratio", "outcome", "cov_title", "cov_company", "cov_url",
                                         *[f"unk_{f}" for f in quality.OPTIONAL])
    parts(runs.withColumn("_o", F.unix_micros("captured_at").cast("double")), str(tmp_path / "in"), "_o", 2)
    s = jobs.file_stream(spark, str(tmp_path / "in"), runs.schema)
    sources, now = b.b_source(spark), b.ts(qq.NOW)
    jobs.health_batches(spark, s, sources, str(tmp_path / "h"), str(tmp_path / "r"), now, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "r/v=1")).select("source_id", "status", "score")
    want = quality.source_health(runs, sources, now).select("source_id", "status", "score")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_new_version_rewrites_only_buckets_that_changed(spark, tmp_path):
    store = str(tmp_path / "store")
    row = lambda i, t="x": (f"id{i}", t, [f"m{i % 3}"])
    make = lambda rows: spark.createDataFrame(rows, "id string, title string, missing array<string>")
    first = [row(i) for i in range(200)]
    assert write_store(make(first), store, 0, buckets=16) == 16
    paths = lambda v: {r["bucket"]: r["path"] for r in manifest(spark, store, v).collect()}
    second = [row(7, "changed"), *first[:7], *first[8:-1], row(500)]
    touched = {r["b"] for r in make([first[7], first[-1], row(500)]).select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).collect()}
    assert write_store(make(second).repartition(3), store, 1, 0, buckets=16) == len(touched) < 16
    before, after = paths(0), paths(1)
    assert {b for b in after if after[b] != before.get(b)} == touched
    assert sorted(map(tuple, read_store(spark, store, 1).collect())) == sorted((a, b, c) for a, b, c in second)
    # A version that was written but not committed, and then again: the ones before stay as they are.
    write_store(make(first[:3]), store, 2, 1, buckets=16)
    write_store(make(first[:5]), store, 2, 1, buckets=16)
    assert read_store(spark, store, 2).count() == 5 and read_store(spark, store, 1).count() == len(second) and read_store(spark, store, 0).count() == 200
    write_store(make([]), store, 3, 2, buckets=16)
    assert read_store(spark, store, 3).count() == 0 and write_store(make(first), store, 4, 1, buckets=16) == len(touched)
