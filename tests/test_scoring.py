import datetime as dt

from pyspark.sql import functions as F

from postmill.operators import filters, scoring
from postmill.params import Criteria, Profile

NOW = F.lit
DDL = (
    "id string, title string, company string, location string, description string, "
    "employment_type string, salary_text string, posted_at timestamp, updated_at timestamp, "
    "source_type string, status string"
)
AS_OF = dt.datetime(2024, 3, 10)


def job(**kw):
    base = dict(id="1", title="Senior Product Manager", company="Acme", location="San Francisco, CA", description="AI platform roadmap", source_type="indeed_search")
    return {**base, **kw}


def score(rows, c, *jobs):
    return {r.id: r for r in scoring.score_criteria(rows(list(jobs), DDL), c, F.lit(AS_OF)).collect()}


def test_partial_match_scores_75(rows):
    c = Criteria(title="product manager", keywords="ai", location="san francisco", min_salary=195000, date_posted="1w")
    r = score(rows, c, job())["1"]
    assert (r.score, r.bucket, r.hard_filtered) == (75, "high_signal", False)
    assert r.reasons == ["title matched", "keywords matched all (1/1)", "location matched", "salary unavailable", "freshness unavailable"]
    assert r.summary == "Score 75: title matched, keywords matched all (1/1), location matched"


def test_title_miss_caps_the_score(rows):
    c = Criteria(title="designer", location="san francisco", min_salary=100000)
    r = score(rows, c, job(salary_text="$200,000"))["1"]
    assert (r.score, r.reasons[0]) == (25, "title did not match")


def test_and_partial_gets_half_of_its_share(rows):
    r = score(rows, Criteria(keywords="roadmap, fintech"), job())["1"]
    assert (r.score, r.reasons) == (25, ["keywords partially matched in AND mode (1/2)"])
    assert score(rows, Criteria(keywords="roadmap, fintech", keyword_mode="or"), job())["1"].score == 100


def test_hard_terms_are_plain_substrings(rows):
    a, b_ = job(), job(id="2", description="maintain things")
    got = score(rows, Criteria(keywords="roadmap", hard_exclude=("ai",)), a, b_)
    assert all(got[i].hard_filtered and got[i].reasons == ['hard filter hit: exclude term "ai"'] for i in "12")
    got = score(rows, Criteria(hard_include=("platform", "gaming")), a)["1"]
    assert got.summary == "Score 0: hard filter hit: missing required terms (gaming)"
    got = score(rows, Criteria(hard_include=("platform", "gaming"), hard_include_mode="OR"), a)["1"]
    assert not got.hard_filtered


def test_detail_description_is_evaluated(rows):
    df = rows([job(description="short")], DDL).withColumns(
        {"meta_description": F.lit("Long text about fintech"), "description_source": F.lit("detail")}
    )
    r = scoring.score_criteria(df, Criteria(keywords="fintech"), F.lit(AS_OF)).first()
    assert (r.score, r.content_path, r.detail_fetch) == (100, "detail_description", "detail_success")
    low = df.withColumn("description_source", F.lit("card"))
    r = scoring.score_criteria(low, Criteria(keywords="fintech"), F.lit(AS_OF)).first()
    assert (r.score, r.content_path) == (0, "snippet_description")
    assert r.content_rationale.endswith("(source=card)")


def test_profile_components(rows):
    p = Profile(
        target_titles=("product manager",), target_locations=("san francisco",), seniority_levels=("senior",),
        salary_floor=150000, remote_preference="remote_only", include_keywords=("ai",), target_companies=("acme",),
    )
    r = scoring.score_profile(rows([job(salary_text="$140,000")], DDL), p, F.lit(AS_OF)).first()
    # 35 title + 12 seniority + 12 place + 15 company + 7 keyword - 10 salary - 40 remote, confidence in between
    assert r.score == 31 and r.bucket == "reject" and r.confidence == 69
    assert "remote requirement not satisfied" in r.reasons
    blocked = scoring.score_profile(rows([job()], DDL), Profile(exclude_keywords=("roadmap",)), F.lit(AS_OF)).first()
    assert (blocked.score, blocked.hard_filtered) == (0, True)
    assert blocked.summary == 'Score 0: hard filter hit: exclude keyword "roadmap"'


def test_learning_moves_the_score_within_bounds(rows):
    jobs = [job(id=str(i), status="applied") for i in range(6)] + [job(id="9", company="Other", status="rejected")]
    df = rows(jobs, DDL)
    scored = scoring.score_profile(df, Profile(target_titles=("product manager",)), F.lit(AS_OF))
    before = {r.id: r.score for r in scored.collect()}
    after = {r.id: r for r in scoring.apply_learning(scored, scoring.company_history(df)).collect()}
    assert after["0"].score == before["0"] + 12
    assert after["0"].reasons[-1] == 'historical positive signal at "acme" (+12)'
    assert after["9"].score == before["9"] - 2


def test_fallback_profile_without_signal(rows):
    c = Criteria(exclude=("junior",))
    assert not scoring.has_signal(c) and scoring.has_signal(Criteria(date_posted="1w"))
    assert scoring.profile_from_criteria(c).target_titles == ("product manager",)
    assert scoring.score_postings(rows([job()], DDL), c, F.lit(AS_OF)).first().score > 0


RULE = "source_id string, required array<string>, required_any array<string>, exclude_any array<string>, fields array<string>, enforce boolean"
RAW = "source_id string, title string, company string, description string"


def hard(rows, rule, *jobs):
    r = rows([{"source_id": "s", "required": [], "required_any": [], "exclude_any": [], "fields": [], **rule}], RULE)
    got = filters.hard_filter(rows([{"source_id": "s", **j} for j in jobs], RAW), r)
    return [(x.drop_reason, x.deferred_checks) for x in got.collect()]


def test_hard_filter_defers_content_on_snippets(rows):
    rule = {"required": ["product manager", "ai"], "required_any": ["fintech"], "exclude_any": ["intern"]}
    short = {"title": "PM, Growth", "company": "A", "description": "short"}
    long = {**short, "description": "payments " * 40}
    assert hard(rows, rule, short) == [(None, 2)]
    assert hard(rows, rule, long) == [("required_content", 0)]
    assert hard(rows, {**rule, "enforce": True}, short) == [("required_content", 0)]
    assert hard(rows, rule, {**short, "title": "Designer"}) == [("required_title", 0)]
    assert hard(rows, rule, {**short, "description": "intern role"}) == [("excluded", 2)]
    assert hard(rows, {"exclude_any": ["a"], "fields": ["company"]}, short) == [("excluded", 0)]


def test_sources_without_a_rule_keep_their_rows(rows):
    r = rows([], RULE)
    assert filters.hard_filter(rows([{"source_id": "x", "title": "t"}], RAW), r).first().drop_reason is None


def test_criteria_sets_equal_one_set_at_a_time(rows, spark, monkeypatch):
    """Random sets and postings: every rank equals the score of the set compiled alone, for closed and open sets, in one tile or many."""
    import dataclasses
    import random

    from postmill.operators import criteria_sets

    rng = random.Random(11)
    words = ["senior", "product manager", "pm", "ai", "ml engineer", "data", "x", "go", "lead", "llm", "remote", "berlin"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    jobs = [
        job(id=f"{i:03d}", title=some(4), location=rng.choice(["Berlin, DE", "Berlin", "Paris", "", None]), description=some(9), salary_text=rng.choice(["$150,000", "$90,000", None]),
            posted_at=AS_OF - dt.timedelta(days=rng.randrange(60)))
        for i in range(60)
    ]
    sets = [Criteria(), Criteria(location="berlin"), Criteria(min_salary=100000, date_posted="2w"), Criteria(title="zzz", min_salary=100000), Criteria(hard_include=("nowhere",), min_salary=1)]
    for _ in range(25):
        pick = lambda k: tuple(rng.sample(words, rng.randrange(k)))
        sets.append(Criteria(
            title=rng.choice(["", "product manager", "senior pm", "ml engineer", "data and ai"]), keywords=", ".join(pick(4)), keyword_mode=rng.choice(["", "or"]), hard_include=pick(2),
            hard_include_mode=rng.choice(["", "or"]), exclude=pick(2), location=rng.choice(["", "berlin", "greater berlin, de"]), date_posted=rng.choice(["any", "1m"]), min_salary=rng.choice([None, 100000.0]),
        ))
    df = rows(jobs, DDL)
    fields = [f.name for f in dataclasses.fields(Criteria)]
    lists = {"hard_include", "hard_exclude", "score_keywords", "include", "exclude"}
    ddl = "user_id int, " + ", ".join(f"{f} {'array<string>' if f in lists else 'double' if f == 'min_salary' else 'string'}" for f in fields)
    data = [(i, *[list(getattr(c, f)) if f in lists else getattr(c, f) if f != "min_salary" or c.min_salary is None else float(c.min_salary) for f in fields]) for i, c in enumerate([*sets, sets[1]])]
    users = spark.createDataFrame(data, ddl)
    want = {}
    for i, c in enumerate([*sets, sets[1]]):
        if i == len(sets):
            want |= {(i, r): v for (u, r), v in want.items() if u == 1}
            continue
        scored = sorted((-r.score, r.id) for r in scoring.score_criteria(df, c, F.lit(AS_OF)).select("id", "score").collect())
        want |= {(i, k): (x[1], -x[0]) for k, x in enumerate(scored[:4], 1)}
    got = {(r.user_id, r["rank"]): (r.id, r.score) for r in criteria_sets.best_for_users(df, users, F.lit(AS_OF), 4).collect()}
    assert got == want
    monkeypatch.setattr(criteria_sets, "POSTINGS_PER_TILE", 7)
    monkeypatch.setattr(criteria_sets, "SETS_PER_TILE", 4)
    got = {(r.user_id, r["rank"]): (r.id, r.score) for r in criteria_sets.best_for_users(df, users, F.lit(AS_OF), 4).collect()}
    assert got == want


def test_postings_that_no_set_tells_apart_meet_no_set(rows, spark, monkeypatch):
    """Of 240 postings with the same terms only those in front are compared with the sets; results are those of each set alone."""
    from postmill.operators import criteria_sets

    jobs = [
        job(id=f"{i:03d}", title=["Senior Cook", "Data Lead"][i % 2], location="Berlin", description="knives", salary_text=f"${60 + i * 37 % 100},000", posted_at=AS_OF - dt.timedelta(days=i * 7 % 40))
        for i in range(240)
    ]
    df = rows(jobs, DDL)
    sets = [Criteria(title="cook", min_salary=100000.0, date_posted="2w"), Criteria(keywords="data", location="berlin", min_salary=155000.0)]
    users = spark.createDataFrame([(i, c.title, c.keywords, c.location, c.min_salary, c.date_posted) for i, c in enumerate(sets)], "user_id int, title string, keywords string, location string, min_salary double, date_posted string")
    want = {}
    for i, c in enumerate(sets):
        scored = sorted((-r.score, r.id) for r in scoring.score_criteria(df, c, F.lit(AS_OF)).select("id", "score").collect())
        want |= {(i, k): (x[1], -x[0]) for k, x in enumerate(scored[:3], 1)}
    compared, tiles = [], criteria_sets._tiles
    monkeypatch.setattr(criteria_sets, "_tiles", lambda posts, *a: compared.append(posts.count()) or tiles(posts, *a))
    for per_joined in (100, 0):  # all in tiles; pairs with common terms first
        monkeypatch.setattr(criteria_sets, "PER_JOINED", per_joined, raising=False)
        assert {(r.user_id, r["rank"]): (r.id, r.score) for r in criteria_sets.best_for_users(df, users, F.lit(AS_OF), 3).collect()} == want
    assert max(compared) < 80
