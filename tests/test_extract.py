import json

from pyspark.sql import functions as F

from postmill.operators import extract
from postmill.sources import capture

LD = {
    "@context": "x",
    "@graph": [{"deep": {"item": {"@type": ["Thing", "JobPosting"], "title": "Data Engineer", "hiringOrganization": {"name": "Acme"}, "url": "/jobs/123-x",
        "jobLocation": [{"address": {"addressLocality": "Paris", "addressCountry": "FR"}}], "employmentType": ["FULL_TIME", "REMOTE"],
        "baseSalary": {"value": {"minValue": 90000, "maxValue": 120000, "unitText": "YEAR"}}, "description": {"a": "Build", "b": ["big", "tables"]}, "datePosted": "2024-01-02", "identifier": {"value": "77"}}}},
        {"@type": "JobPosting", "name": "No company"}],
}


def pages(spark, *html):
    return spark.createDataFrame([(i, "https://b.org/list?p=1", h) for i, h in enumerate(html)], "page_id int, url string, html string")


def test_jsonld_walk(spark):
    body = f'<script type="application/ld+json">{json.dumps(LD)}</script><script type="application/ld+json">broken</script>'
    r = extract.jsonld_postings(pages(spark, body), ["page_id"]).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.title, r.company, r.location, r.external_id, r.posted_at) == ("Data Engineer", "Acme", "Paris, FR", "77", "2024-01-02")
    assert (r.salary_text, r.employment_type, r.target) == ("$90,000 - $120,000 YEAR", "FULL_TIME · REMOTE", "https://b.org/jobs/123-x")
    assert r.description == "Build big tables"


def test_best_jsonld_keeps_the_longest_description(spark):
    two = [{"@type": "jobposting", "title": f"T {n}", "companyName": "C", "url": f"/{n}", "description": "d" * n} for n in (3, 9, 5)]
    df = extract.jsonld_postings(pages(spark, f'<script type="application/ld+json">{json.dumps(two)}</script>'), ["page_id"])
    assert extract.best_jsonld(df, "page_id").first().title == "T 9"


def test_state_walk_first_wins_and_falls_back_to_page_company(spark):
    state = {"a": {"jobs": [{"title": "Sales Lead", "slug": "x1", "location": {"name": "Rome"}, "id": "5"}, {"title": "Sales Lead", "slug": "x1", "companyName": "Late"}, {"title": "Home", "url": "/h"}]}}
    body = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script>'
    r = extract.state_postings(pages(spark, body), ["page_id"], F.lit("Acme")).collect()
    assert [(x.title, x.company, x.location, x.external_id, x.target) for x in r] == [("Sales Lead", "Acme", "Rome", "5", "https://b.org/x1")]


def test_search_result_links(spark):
    body = (
        '<a href="/url?q=https%3A%2F%2Fboards.acme-labs.com%2Fjobs%2F1"><b>Product Manager</b></a> San Francisco 2 days ago'
        '<a href="https://www.google.com/jobs/x">Google own link</a><a href="https://x.y/about">About us</a>'
        '<a href="https://boards.acme-labs.com/jobs/1">Product Manager</a>'
    )
    p = spark.createDataFrame([(1, "https://www.google.com/search?q=x", body)], "page_id int, url string, html string")
    r = extract.search_result_postings(p, ["page_id"]).collect()
    assert [(x.title, x.target, x.company, x.location, x.posted_at) for x in r] == [
        ("Product Manager", "https://boards.acme-labs.com/jobs/1", "acme labs", "San Francisco", "2 days ago")
    ]


def test_boards(spark):
    body = '<a href="/url?q=https://jobs.ashbyhq.com/acme/123">a</a><a href="https://jobs.ashbyhq.com/acme?x">b</a><a href="https://jobs.ashbyhq.com/">c</a>'
    p = spark.createDataFrame([(1, "https://www.google.com/search", body)], "page_id int, url string, html string")
    # The root of the jobs host counts as a board of its own.
    assert sorted(r.board_url for r in extract.board_urls(p).collect()) == ["https://jobs.ashbyhq.com/", "https://jobs.ashbyhq.com/acme"]


def test_boards_off_the_jobs_host_and_malformed_links(spark):
    body = '<a href="/url?q=https%3A%2F%2Fjobs.ashbyhq.com%2F%2Fzed&amp;sa=U">a</a><a href="https://app.ashbyhq.com/x?y">b</a><a href="https://jobs.ashbyhq.com">c</a><a href="http://evil.org/ashbyhq.com">d</a><a href="/url?q=%zz">e</a>'
    got = extract.board_urls(spark.createDataFrame([("", body), ("", None)], "url string, html string")).collect()
    assert sorted(r.board_url for r in got) == ["https://app.ashbyhq.com/", "https://jobs.ashbyhq.com/", "https://jobs.ashbyhq.com/zed"]


def test_context_is_the_text_around_each_link(spark):
    body = "x" * 700 + '<a href="/1">same</a>' + "y" * 5 + '<a href="/1">same</a>' + "z" * 900
    got = extract.anchors(pages(spark, body), ["page_id"], 600).orderBy("pos").collect()
    tag = '<a href="/1">same</a>'
    for r, at in zip(got, (700, 705 + len(tag)), strict=True):
        assert r.context == body[max(0, at - 600) : at + len(tag) + 600]


def test_query_match(spark):
    df = spark.createDataFrame([("Senior Product Manager", "ai in fintech"), ("Product Manager", "x")], "title string, description string")
    hit = lambda q: [r.title for r in df.filter(extract.matches_query(q, ["title", "description"])).collect()]
    assert hit('site:x "product manager" and fintech ai banking') == ["Senior Product Manager"]
    assert len(hit("product manager")) == 2 and len(hit("site:x")) == 2


def test_enrich_keeps_card_values_and_records_where_from(rows, spark):
    card = "source_id string, source_type string, pos int, url string, posted_at string, salary_text string, employment_type string, location string, description string"
    c = rows([
        {"source_id": "s", "source_type": "indeed_search", "pos": 1, "url": "https://a.b/1?x", "location": "Rome", "salary_text": "unknown", "description": "long enough description here"},
        {"source_id": "s", "source_type": "indeed_search", "pos": 2, "url": "https://a.b/2"},
        {"source_id": "w", "source_type": "wellfound_search", "pos": 3, "url": "https://a.b/1"},
    ], card)
    d = rows([{"url": "https://a.b/1", "salary_text": "$5", "location": "Oslo", "description": "detail"}], "url string, posted_at string, salary_text string, employment_type string, location string, description string")
    got = {r.pos: r for r in extract.enrich(c, d).collect()}
    assert (got[1].location, got[1].salary_text, got[1].provenance["salary_text"], got[1].provenance["location"]) == ("Rome", "$5", "detail", "card")
    assert got[2].provenance["salary_text"] == "fallback_unknown" and got[3].salary_text is None
    assert {r.pos: r for r in extract.enrich(c, d, limit=1).collect()}[1].salary_text == "$5"


def test_merge_later_wins_but_text_stays(rows):
    ddl = "page_id int, pos int, external_id string, url string, title string, location string, description string, summary string"
    a = rows([{"page_id": 1, "pos": 0, "external_id": "X", "title": "a", "location": "L", "description": "first"}], ddl)
    z = rows([{"page_id": 1, "pos": 0, "external_id": "x", "title": "z", "description": "late", "summary": "s"}], ddl)
    r = extract.merge_outputs([a, z], ["page_id"]).first()
    assert (r.title, r.location, r.description, r.summary) == ("z", None, "first", "s")


def test_outputs_of_the_same_rows_merge_as_frames_do(rows, spark, monkeypatch):
    ddl = "source_id string, pos int, external_id string, url string, title string, location string, description string"
    data = [("s", 1, "X", "u", "a", "L", ""), ("s", 2, "x", "v", "b", None, "d2"), ("s", 3, "", "U", "c", "L", None), (None, 4, None, "u", "d", "L", "d4"),
            ("t", 5, None, None, "e", None, "d5"), ("t", 6, None, None, "f", "M", "d6"), ("t", 7, "", None, None, "M", None)]
    raw = spark.createDataFrame(data, ddl)
    none = F.lit(None).cast("string")
    outputs = [extract.Output(F.lit(True), {"title": F.col("title"), "description": F.col("description"), "summary": none}),
               extract.Output(F.col("location") == "L", {"title": F.upper("title"), "description": F.lit("late"), "summary": F.concat(F.lit("s"), "title")})]
    frames = [raw.filter(o.when).withColumns(o.columns).select("source_id", "pos", "external_id", "url", "title", "description", "summary") for o in outputs]
    got = {}
    for hot in (extract.HOT, 1):  # with 1, keys of two rows are hot
        monkeypatch.setattr(extract, "HOT", hot)
        for name, merged in (("frames", extract.merge_outputs(frames, ["source_id"])), ("rows", extract.merge_outputs(outputs, ["source_id"], raw))):
            got[name, hot] = sorted(map(str, merged.select("source_id", "external_id", "url", "title", "description", "summary").collect()))
    assert len(got["rows", 1]) == 4 and all(g == got["frames", extract.HOT] for g in got.values())
    assert any("title='A', description='d2', summary='sa'" in r for r in got["rows", 1])
    monkeypatch.undo()
    plan = extract.merge_outputs(outputs, ["source_id"], raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("pos#") > 0 and "Union" not in plan
    assert extract.merge_outputs(outputs, ["source_id"], raw.limit(0)).count() == 0


def test_two_key_first_wins_lets_dropped_rows_block_nothing(rows):
    ddl = "page int, pos int, external_id string, title string, company string, location string"
    data = [("1", "a"), ("1", "b"), ("2", "b"), (None, "a"), (None, "c")]
    df = rows([{"page": 1, "pos": i, "external_id": e, "title": t} for i, (e, t) in enumerate(data)], ddl)
    assert sorted(r.pos for r in extract.first_wins_two_keys(df, ["page"]).collect()) == [0, 2, 4]


def test_two_key_rounds_equal_the_sequential_rule(rows):
    import random

    rng = random.Random(5)
    data = []
    for i in range(600):  # a third of page 1 has one id, chains cross pages, positions tie never
        data.append({"page": rng.choice([1, 1, 2]), "pos": i, "external_id": rng.choice([None, "", "hot", str(rng.randrange(60))]), "title": f"T{rng.randrange(90)}"})
    data += [{"page": 9, "pos": i, "external_id": f"c{i // 2}", "title": f"C{(i + 1) // 2}"} for i in range(60)]  # one chain
    df = rows(data, "page int, pos int, external_id string, title string, company string, location string")
    want, seen = set(), set()
    for r in sorted(data, key=lambda r: r["pos"]):
        marks = {(r["page"], "r", r["title"].lower())} | ({(r["page"], "i", r["external_id"])} if r["external_id"] else set())
        if not marks & seen:
            seen |= marks
            want.add((r["page"], r["pos"]))
    for bound in (10_000, 100):
        assert {(r.page, r.pos) for r in extract.first_wins_two_keys(df, ["page"], in_one_task=bound).collect()} == want
    assert extract.first_wins_two_keys(df.limit(0), ["page"]).count() == 0


def test_startup_links_by_the_markup_around(spark):
    far = "x" * 900
    body = (
        '<a href="/jobs/7-a">No company near</a>' + far + '<div data-testid="startup-name">Acme &amp; Co</div><a class="c" href="/jobs/8-b"><b>Data</b> Lead</a>'
        '<div data-test="location">Paris</div> 3 weeks ago <a href="/jobs/9">abc</a><a href="/jobs/8-b">Later text</a>' + far + '<span class="company name">Late</span><a href="/jobs/7-a">Again</a>'
    )
    p = spark.createDataFrame([(1, "https://w.org/l", "wellfound_search", body), (2, "https://w.org/l", "indeed_search", body), (3, "u", "wellfound_search", None)], "page_id int, url string, source_type string, html string")
    got = [(r.page_id, r.pos, r.external_id, r.title, r.company, r.location, r.posted_at, r.target, r.summary) for r in extract.anchor_postings(p, ["page_id"]).collect()]
    # The first link to a target decides, and the first of /jobs/7-a has no company near it.
    assert got == [(1, 1, "8", "Data Lead", "Acme & Co", "Paris", "3 weeks ago", "https://w.org/jobs/8-b", "Data Lead at Acme & Co")]


def test_board_links_take_the_company_of_the_page(spark):
    body = (
        '<title>Careers at Acme</title><a href="/acme/12345?x#y">Data Lead</a> Remote in Europe<br>yesterday<a href="jobs.html">Not inside</a>'
        '<a href="https://jobs.ashbyhq.com/acme/12345">data lead</a><a href="./b">View all</a><a href="./abcdefabcdefabcdefabcdef">Team lead</a>'
    )
    p = spark.createDataFrame([(1, "https://jobs.ashbyhq.com/acme", body), (2, "https://jobs.ashbyhq.com/acme", body.replace("Careers at Acme", " "))], "page_id int, url string, html string")
    got = sorted((r.page_id, r.title, r.external_id, r.company, r.location, r.posted_at, r.target) for r in extract.anchor_postings(p, ["page_id"], F.lit("ashby_search")).collect())
    assert got == [
        (1, "Data Lead", "12345", "Acme", "Remote in Europe", "yesterday", "https://jobs.ashbyhq.com/acme/12345"),
        (1, "Team lead", "abcdefabcdefabcdefabcdef", "Acme", "Remote in Europe", "yesterday", "https://jobs.ashbyhq.com/./abcdefabcdefabcdefabcdef"),
    ]


def test_plans_of_the_extractors_stay_small(spark):
    """Entity decoding names its input once, so no plan grows with the number of entities or steps."""
    p = spark.createDataFrame([(1, "https://b.org/l", "<a>", "ashby_search")], "page_id int, url string, html string, source_type string")
    found = {
        "search": extract.search_result_postings(p, ["page_id"]), "boards": extract.board_urls(p), "links": extract.anchor_postings(p, ["page_id"]), "titles": extract.title_anchors(p, ["page_id"]),
        "json": extract.jsonld_postings(p, ["page_id"]), "state": extract.state_postings(p, ["page_id"]), "cards": extract.cards(p, ["page_id"]), "facts": extract.detail_facts(p, "page_id"),
    }
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    sizes = {n: len(df._jdf.queryExecution().optimizedPlan().toString()) for n, df in found.items()}
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert {n: s for n, s in sizes.items() if s > 400_000} == {}
    from postmill.functions.html import decode_entities

    once = spark.range(1).select(decode_entities(F.upper(F.concat(F.lit("mark"), F.col("id").cast("string")))).alias("x"))
    assert once._jdf.queryExecution().analyzed().toString().lower().count("upper(") == 1


SNAP = """- main [ref=e0]:
  - button "PM Dismiss PM job" [ref=e1] [cursor=pointer]:
    - generic [ref=e2]: Product Manager (Verified job)
    - paragraph [ref=e3]: Product Manager
    - generic [ref=e4]: Acme

      - text: ·
    - text: Paris (Remote)
    - paragraph [ref=e5]: $120k/yr · 401k benefits
    - text: Posted on March 3, 2026
    - text: Easy Apply
  - text: outside
  - button "Dismiss other job" [ref=e9] [cursor=pointer]:
    - text: Never
"""


def test_snapshot(spark):
    df = spark.createDataFrame([("f", SNAP)], "file string, text string")
    r = capture.snapshot_blocks(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.title, r.company, r.location, r.posted_at, r.easy_apply) == ("Product Manager", "Acme", "Paris (Remote)", "March 3, 2026", True)
    assert r.salary_text == "$120k/yr · 401k benefits" and r.summary == "PM Dismiss PM job"


def test_snapshot_is_read_in_place(spark):
    """Several blocks, one inside another, a repeated screen; lines are neither exchanged nor sorted."""
    line = lambda n, s: " " * n + "- " + s
    two = "\n".join([
        line(0, "text: before"), line(2, 'button "A Dismiss A" [ref=e1] [cursor=pointer]:'), line(4, "text: Lead (Verified job)"), line(4, "text: Lead"), "", line(4, "text: Acme"),
        line(4, "text: Posted on May 1"), line(4, 'button "B Dismiss B" [ref=e2] [cursor=pointer]:'), line(6, "generic [ref=e3]: Cook"), line(6, "text: Viewed"), line(6, "text: Bistro"), line(6, "text: Rome"),
        line(6, "text: $5/hr"), line(4, "text: outside"), line(6, "text: Easy Apply"), line(2, 'button "Dismiss C" [ref=e4] [cursor=pointer]:'),
    ])
    df = spark.createDataFrame([("f", two), ("f", two), ("g", None), ("h", ""), (None, SNAP)], "file string, text string")
    s = capture.snapshot_blocks(df)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1
    got = {(r.file, r.block): (r.title, r.company, r.location, r.summary, r.salary_text, r.posted_at, r.easy_apply) for r in s.collect()}
    assert s.count() == 3 and got.pop((None, next(b for f, b in got if f is None)))[:2] == ("Product Manager", "Acme")
    assert got == {
        ("f", 1): ("Lead", "Acme", None, "A Dismiss A", None, "May 1", False), ("f", 7): ("Cook", "Bistro", "Rome", "B Dismiss B", "$5/hr", None, False)}


def test_capture_files(spark, tmp_path):
    ok = {"sourceId": "a", "capturedAt": "2024-01-02T00:00:00.000Z", "expectedCount": 20, "captureFunnel": {"availableCount": "7.6", "importedCount": -1},
          "pageUrl": "https://p", "jobs": [{"title": "T", "externalId": "1", "extractorProvenance": {"description": "detail"}}, {"title": "U"}]}
    (tmp_path / "a.json").write_text(json.dumps(ok, indent=1))
    (tmp_path / "b.json").write_text('{"sourceId": "b", "jobs": null}')
    (tmp_path / "c.json").write_text("{broken")
    caps = capture.read_captures(spark, str(tmp_path))
    assert sorted((r.sourceId or "?", r.payload_error or "") for r in caps.collect()) == [("?", "payload_invalid_object"), ("a", ""), ("b", "payload_jobs_missing")]
    got = capture.capture_rows(caps).orderBy("pos").collect()
    assert [(r.source_id, r.pos, r.title, r.external_id, r.retrieved_at, r.page_url) for r in got] == [
        ("a", 0, "T", "1", "2024-01-02T00:00:00.000Z", "https://p"), ("a", 1, "U", None, "2024-01-02T00:00:00.000Z", "https://p")]
    head = {r.source_id: r for r in capture.capture_heads(caps).collect()}["a"]
    assert (head.job_count, head.available_count, head.imported_count) == (2, 8, None)


def test_unknown_source_type_fails_that_source_only(rows):
    df = rows([{"source_id": "s", "source_type": "mystery", "title": "t", "company": "c", "description": "d"}, {"source_id": "k", "source_type": "google_search", "title": "t", "company": "c", "description": "d"}], "source_id string, source_type string, title string, company string, description string")
    rule = rows([], "source_id string, required array<string>, required_any array<string>, exclude_any array<string>, fields array<string>, enforce boolean")
    assert [r["source_id"] for r in capture.collect_sources([df], df.select("source_id"), rule).collect()] == ["k"]
    assert [tuple(r) for r in capture.unsupported([df]).collect()] == [("s", "mystery", 1, "unsupported source type: mystery")]


def test_large_captures_are_recorded_in_parts(spark, tmp_path):
    n = 2500
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    raw = spark.range(n).select(F.lit("s").alias("source_id"), at.alias("captured_at"), (n - F.col("id")).alias("pos"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"))
    small = spark.createDataFrame([("t", 1, "one"), ("t", 2, "two")], "source_id string, pos long, title string").withColumn("captured_at", at)
    heads = spark.createDataFrame([("s", "p", None), ("t", "p", 7.0), ("none", "p", None)], "source_id string, page_url string, expected_count double").withColumn("captured_at", at)
    payloads = capture.capture_payloads(raw.unionByName(small), heads, part_rows=400).cache()
    assert payloads.agg(F.max(F.size("jobs"))).first()[0] == 400 and payloads.filter("sourceId = 's'").count() == 7
    capture.write_payloads(payloads, str(tmp_path / "c"))
    caps = capture.read_captures(spark, str(tmp_path / "c"), lines=True)
    types = spark.createDataFrame([("s", "indeed_search"), ("t", "google_search")], "source_id string, source_type string")
    got = {(r.source_id, r.pos): (r.title, r.source_type) for r in capture.capture_rows(caps, types).collect()}
    assert got == {("s", i): (f"T{n - 1 - i}", "indeed_search") for i in range(n)} | {("t", 0): ("one", "google_search"), ("t", 1): ("two", "google_search")}
    assert sorted((r.source_id, r.job_count) for r in capture.capture_heads(caps).collect()) == [("none", 0), ("s", n), ("t", 2)]


def test_latest_report_opens_one_partition(spark, tmp_path):
    path = str(tmp_path / "reports")
    assert capture.latest_report(spark, path) is None
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    for time, n in (("2024-01-02T00:00:00Z", 1), ("2024-01-10T00:00:00Z", 2), ("2024-01-03T00:00:00Z", 3), ("2024-01-10T00:00:00Z", 4)):
        capture.write_report(one(n), path, time)
    got = capture.latest_report(spark, path)
    assert [tuple(r) for r in got.collect()] == [(4, "2024-01-10T00-00-00Z")] and all("2024-01-10" in f for f in got.inputFiles())
    assert len(capture.report_times(spark, path)) == 3


def test_fixture_arrays_and_report_sinks(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps([{"title": "A", "externalId": "1"}, {"title": "B"}], indent=1))
    assert sorted((r.title, r.external_id) for r in capture.read_posting_array(spark, str(tmp_path / "jobs.json")).collect()) == [("A", "1"), ("B", None)]
    bad = spark.createDataFrame([("s", "reject", "r1"), ("t", "quarantine", "r2")], "source_id string, outcome string, run_id string")
    capture.write_quarantine(bad, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).filter("source_id = 's' AND outcome = 'reject'").first().run_id == "r1"
    top = spark.createDataFrame([(2, "b"), (1, "a")], "line int, text string")
    capture.write_shortlist(top, str(tmp_path / "md"))
    capture.write_shortlist(top, str(tmp_path / "json"), as_json=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["a", "b"] and spark.read.json(str(tmp_path / "json")).count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, n int")
    capture.write_captures(df, str(tmp_path / "c"))
    capture.write_log(df, str(tmp_path / "l"))
    capture.write_log(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2 and spark.read.json(str(tmp_path / "l")).count() == 4


def test_inference_marks_survive_enrichment(rows):
    from postmill.operators import extract

    src = rows([{"source_id": "s", "search_url": "https://www.google.com/search?q=x&tbs=qdr:w"}], "source_id string, search_url string")
    cards = rows(
        [{"source_id": "s", "source_type": "google_search", "pos": 1, "url": "https://x.com/j/1", "provenance": {"location": "card", "other": "kept"}}],
        "source_id string, source_type string, pos int, url string, location string, salary_text string, posted_at string, employment_type string, description string, provenance map<string,string>",
    )
    inferred = extract.infer_from_search(cards, src).drop("inferred", "search_url")
    assert inferred.first()["provenance"] == {"location": "card", "other": "kept", "posted_at": "inferred_search_filter"}
    detail = rows([{"url": "https://x.com/j/1", "salary_text": "$5", "posted_at": "today"}], "url string, posted_at string, salary_text string, employment_type string, location string, description string")
    got = extract.enrich(inferred, detail).first()
    assert got["provenance"]["posted_at"] == "inferred_search_filter" and got["posted_at"].startswith("within 7")
    assert got["provenance"]["salary_text"] == "detail" and got["provenance"]["location"] == "card"


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.splitlines()


def test_filters_do_not_cut_pages_again(spark, capsys):
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    card = '<main><div id="job-card-7"><a data-id="company-title" href="/c">C</a><a href="/job/7" data-id="job-card-title">Some title</a></main>'
    state = '<script id="__NEXT_DATA__" type="application/json">{"jobs":[{"title":"Some title","jobUrl":"/j/1","companyName":"C"}]}</script>'
    # A literal would be folded.
    pages = spark.createDataFrame([(1, "https://x.y/l", card), (2, "https://x.y/l", state), (3, "https://x.y/l", None)], "id long, url string, html string")
    for found, target in ((extract.cards(pages, ["id"]), "https://x.y/job/7"), (extract.state_postings(pages, ["id"]), "https://x.y/j/1")):
        filters = [line for line in _plan(found, capsys) if "Filter" in line]
        assert filters and not any("regexp" in line or "RLIKE" in line for line in filters)
        assert [(r.title, r.company, r.target) for r in found.collect()] == [("Some title", "C", target)]


def test_marks_of_two_keys_are_short(rows, monkeypatch):
    seen, settle = {}, extract.settle
    monkeypatch.setattr(extract, "settle", lambda df, label="settled": seen.setdefault(label, settle(df, label)))
    page = rows([{"s": "a", "pos": i, "external_id": str(i), "title": f"t{i}"} for i in range(3)], "s string, pos int, external_id string, title string, company string, location string")
    assert extract.first_wins_two_keys(page, ["s"]).count() == 3
    assert {len(r[c]) for r in seen["two-keys-marks"].collect() for c in "ab"} == {24}


def test_two_keys_fold_equal_marks_and_delete_the_tables_of_rounds(spark, rows, monkeypatch, tmp_path):
    from postmill.operators import conflicts
    from postmill.operators import settle as settling

    monkeypatch.setattr(settling, "new_path", lambda _, label="settled": str(tmp_path / f"{label}-{len(list(tmp_path.iterdir()))}"))
    data = [{"s": "a", "pos": i, "external_id": None if i % 3 == 0 else str(i % 3), "title": f"t{i % 4}"} for i in range(60)]
    page = rows(data, "s string, pos int, external_id string, title string, company string, location string")
    assert sorted(r.pos for r in extract.first_wins_two_keys(page, ["s"], in_one_task=1).collect()) == [0, 1, 2, 3]
    assert sum(spark.read.parquet(str(p)).count() for p in tmp_path.glob("two-keys-marks*")) == 12
    kept = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "conflicts-round" not in kept and len([*tmp_path.glob("conflicts-open*")]) == 1 and conflicts.SEQUENTIAL_ROWS == 10_000


def test_recorded_captures_are_compressed(spark, tmp_path):
    path = str(tmp_path / "c")
    payloads = spark.createDataFrame([("s", [("t",)])], "sourceId string, jobs array<struct<title: string>>")
    capture.write_payloads(payloads, path)
    assert all(f.name.endswith(".json.gz") for f in (tmp_path / "c").iterdir() if f.name.startswith("part-"))
    assert [r.title for r in capture.capture_rows(capture.read_captures(spark, path, lines=True)).collect()] == ["t"]


def test_first_wins_query_moves_what_it_returns(spark, capsys):
    from postmill.plans import queries_extract

    aggregates = [line for line in _plan(queries_extract.q_first_wins(spark, "/root/testdata/sf0.001"), capsys) if "min_by" in line]
    assert aggregates and not any("salary_text" in line or "description" in line for line in aggregates)
