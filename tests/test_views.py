import datetime as dt

from pyspark.sql import functions as F

from postmill.operators import views

T0 = dt.datetime(2024, 3, 8)


def salaries(rows, *values):
    return rows([{"v": float(v)} for v in values], "v double").withColumnRenamed("v", "salary_value")


def test_salary_numbers(rows):
    df = salaries(rows, 100000, 150000, 220000, 260000, 0)
    s = views.salary_summary(df).first()
    assert (s["min"], s["avg"], s["max"], s.p75, s.above_avg, s.min_to_avg, s.top_band, s.with_salary) == (100000, 182500, 260000, 220000, 2, 2, 1, 4)
    assert {r.key: r.n for r in views.salary_matrix(df).collect()} == {"has_salary": 4, "min_to_avg": 2, "above_avg": 2, "best_paying": 1}
    empty = views.salary_summary(salaries(rows, 0)).first()
    assert (empty.avg, empty.p75, empty.with_salary, empty.top_band) == (None, None, 0, 0)


def test_histogram(rows):
    h = views.histogram(salaries(rows, 100000, 150000, 220000, 260000), "salary_value", 4).orderBy("bucket").collect()
    assert sum(r.n for r in h) == 4 and len(h) == 4
    assert (h[0].lo, h[-1].hi, h[-1].n) == (100000, 260000, 2)
    assert views.histogram(salaries(rows, 5, 5), "salary_value", 4).collect()[0].n == 2
    assert views.histogram(salaries(rows), "salary_value", 4).count() == 0


def test_search_totals(rows):
    ddl = "captured bigint, filtered bigint, deduped bigint, imported bigint, expected bigint, avg_score bigint"
    df = rows([{"captured": 9, "filtered": 3, "deduped": 1, "imported": 5, "expected": 6, "avg_score": 70}, {"captured": 7, "filtered": 2, "deduped": 2, "imported": 3, "expected": 4, "avg_score": 78}], ddl)
    t = views.search_totals(df).first()
    assert (t.found_label, t.filtered, t.deduped, t.imported, t.avg_score) == ("8/10", 5, 3, 8, 73)
    assert views.search_totals(df.withColumn("expected", F.lit(None).cast("bigint"))).first().found_label == "8/?"


JOIN = ("id string, normalized_hash string, source_id string, source_url string, external_id string, title string, company string, location string, posted_at timestamp, "
        "updated_at timestamp, created_at timestamp, salary_text string, score int, bucket string, summary string, confidence int, reasons array<string>, status string, notes string, last_action_at timestamp")


def member(i, day, **kw):
    return {"id": i, "normalized_hash": "h", "source_id": "a", "source_url": f"https://x/{i}", "title": f"T{i}", "company": "C", "created_at": T0 + dt.timedelta(day), "status": "new", "notes": "", "reasons": [], **kw}


def test_group_takes_newest_scalars_and_first_seen_order(rows):
    data = [
        member("1", 1, source_id="b", reasons=["x", "y"], status="viewed"),
        member("2", 3, source_id="a", reasons=["y", "z"], source_url="https://www.linkedin.com/jobs/search-results/?q"),
        member("3", 2, source_id="b", reasons=["x"], status="drafted", notes=" hi "),
        member("9", 9, normalized_hash=None, status="rejected"),
    ]
    got = {r.id: r for r in views.group_postings(rows(data, JOIN)).collect()}
    g = got["h"]
    assert (g.primary_job_id, g.title, g.duplicate_count, g.status, g.notes) == ("2", "T2", 3, "viewed", "hi")
    assert (g.source_ids, g.reasons) == (["a", "b"], ["y", "z", "x"])
    assert (g.review_target.url, g.review_target.mode) == ("https://x/3", "direct")
    assert got["9"].duplicate_count == 1
    assert [r.id for r in views.group_postings(rows(data, JOIN), include_rejected=False).collect()] == ["h"]
    for columns in (["normalized_hash", "score", "source_ids"], ["review_target"], ["id", "reasons", "status"]):
        few = views.group_postings(rows(data, JOIN), columns=columns)
        assert few.columns == [c for c in views.group_postings(rows(data, JOIN)).columns if c in columns]
        assert sorted(map(str, few.collect())) == sorted(str(r) for r in views.group_postings(rows(data, JOIN)).select(few.columns).collect())


def test_only_columns_asked_for_are_exchanged(rows):
    data = [member(str(i), i, source_id="ab"[i % 2], reasons=[str(i)], score=i) for i in range(4)]
    few = views.group_postings(rows(data, JOIN), include_rejected=False, columns=["score", "source_ids"])
    assert [(r.score, r.source_ids) for r in few.collect()] == [(3, ["b", "a"])]
    plan = few._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert not any(c in plan for c in ("title#", "company#", "reasons#", "salary_text#", "source_url#"))


def test_pages(rows):
    ddl = "id string, title string, score int, posted_at timestamp, updated_at timestamp, salary_value double"
    df = rows([{"id": str(i), "title": f"t{i:02d}", "score": i % 5, "updated_at": T0, "salary_value": 0.0} for i in range(23)], ddl)
    order = sorted(range(23), key=lambda i: (-(i % 5), i))
    p = views.page(df, 2, 10).orderBy("position").collect()
    assert [int(r.id) for r in p] == order[10:20] and p[0].total_pages == 3
    assert [int(r.id) for r in views.page(df, 99, 10).orderBy("position").collect()] == order[20:]
    for i in (0, 7, 22):
        assert views.page_of(df, F.lit(str(i)), 10).first().page == order.index(i) // 10 + 1


def test_deep_pages_sort_one_range(spark):
    n = 5000
    df = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("title"), (F.col("id") % 3).cast("int").alias("score"),
        F.timestamp_seconds(F.col("id") % 40 * 86400).alias("posted_at"), F.lit(None).cast("timestamp").alias("updated_at"), (F.col("id") % 11).cast("double").alias("salary_value"),
    ).repartition(5)
    for sort in ("score", "date", "salary"):
        want = [r.id for r in views.sort_groups(df, sort).select("id").collect()]
        for start in (0, 990, 1660, 2500, 4990):  # within a key, over the edge of one, the last
            got = views.places(df, views.sort_keys(sort), start, start + 10, n, in_one_task=30).orderBy("position").collect()
            assert [r.id for r in got] == want[start:start + 10] and [r.position for r in got] == list(range(start + 1, start + 11))
    assert views.page(df.limit(0), 5, 10).collect() == []
    plan = views.places(df, views.sort_keys("date"), 2500, 2510, n, in_one_task=30)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" in plan and int(plan.split("GlobalLimit ")[1].split()[0]) < 200  # rows of one day, not 2510
