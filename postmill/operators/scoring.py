"""Scores of postings: by search criteria, by profile, and learned from history."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.core import (
    clamp_score,
    half_up,
    join_text,
    lower_text,
    nonempty,
    text,
)
from postmill.functions.dates import (
    DATE_POSTED_DAYS,
    freshness_days,
    freshness_label,
    freshness_points,
)
from postmill.functions.salary import salary_floor
from postmill.functions.terms import (
    SENIORITY,
    all_of,
    any_of,
    count_matches,
    matched_literals,
    split_text,
    strongest,
    term_list,
    term_matches,
    title_tokens,
    unique,
    work_types,
)
from postmill.operators.skew import join_one_per_key, top_n_per_key
from postmill.params import CRITERIA_WEIGHTS, SOURCE_POINTS, Criteria, Profile


# ---- criteria resolved on the driver --------------------------------------------------

def scoring_terms(c: Criteria) -> list[str]:
    return unique(term_list(c.score_keywords) + split_text(c.keywords) + term_list(c.include))


def exclude_terms(c: Criteria) -> list[str]:
    return unique(term_list(c.hard_exclude) + term_list(c.exclude))


def mode(value: str) -> str:
    return "or" if (value or "").strip().lower() == "or" else "and"


def target_days(c: Criteria) -> int | None:
    return DATE_POSTED_DAYS.get((c.date_posted or "").strip().lower())


def target_salary(c: Criteria) -> int:
    return int((c.min_salary or 0) + 0.5) if (c.min_salary or 0) > 0 else 0


def has_signal(c: Criteria) -> bool:
    return bool(
        c.title.strip()
        or scoring_terms(c)
        or term_list(c.hard_include)
        or c.location.strip()
        or target_salary(c)
        or target_days(c) is not None
    )


def profile_from_criteria(c: Criteria) -> Profile:
    title, location = c.title.strip().lower(), c.location.strip().lower()
    floor = target_salary(c)
    return Profile(
        target_titles=(title or "product manager",),
        target_locations=(location,) if location else (),
        salary_floor=floor,
        seniority_levels=tuple(SENIORITY),
        include_keywords=tuple(scoring_terms(c)),
        exclude_keywords=tuple(exclude_terms(c)),
        deal_salary_minimum=floor,
    )


# ---- text and facts every score needs -------------------------------------------------

def with_content_path(df: DataFrame) -> DataFrame:
    """Which description is evaluated: the fetched detail page or the card snippet.

    Reads description and, when present, meta_description and description_source.
    """
    for c in ("meta_description", "description_source"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    named = lower_text(F.col("description_source"))
    staged = df.withColumns(
        {
            "_src": F.when(named.isin("detail", "card", "fallback_unknown"), named).otherwise(
                "unknown"
            ),
            "_snippet": lower_text(F.col("description")),
            "_detail": lower_text(F.col("meta_description")),
        }
    )
    use = (F.col("_src") == "detail") & (F.col("_detail") != "")
    return staged.withColumns(
        {
            "eval_description": F.when(use, F.col("_detail")).otherwise(
                F.coalesce(nonempty(F.col("_snippet")), F.col("_detail"))
            ),
            "content_path": F.when(use, "detail_description").otherwise("snippet_description"),
            "detail_fetch": F.when(use, "detail_success").otherwise("snippet_fallback"),
            "content_rationale": F.when(
                use, "detail provenance available; evaluated against full description"
            ).otherwise(
                F.concat(
                    F.lit("detail unavailable; evaluated against snippet fallback (source="),
                    F.col("_src"),
                    F.lit(")"),
                )
            ),
            "description_source": F.col("_src"),
        }
    ).drop("_src", "_snippet", "_detail")


def with_facts(df: DataFrame, as_of: Column) -> DataFrame:
    """Stage lower text, work types, salary floor, freshness and confidence (``f_*``)."""
    if "eval_description" not in df.columns:
        df = df.withColumn("eval_description", lower_text(F.col("description")))
    base = df.withColumns(
        {
            "f_title": lower_text(F.col("title")),
            "f_company": lower_text(F.col("company")),
            "f_location": lower_text(F.col("location")),
            "f_employment": lower_text(F.col("employment_type")),
            "f_salary": salary_floor(F.col("salary_text")),
            "f_days": freshness_days(F.col("posted_at"), F.col("updated_at"), as_of),
            "f_length": F.length(text(F.col("description"))),
        }
    ).withColumn(
        "f_text", F.concat_ws(" ", "f_title", "f_location", "f_employment", "eval_description")
    )
    typed = base.withColumn("f_work", work_types(F.col("f_text")))
    points = [
        F.when(F.col("f_title") != "", 8),
        F.when(F.col("f_company") != "", 8),
        F.when(F.col("f_location") != "", 8),
        F.when(F.col("f_employment") != "", 8),
        F.when(text(F.col("salary_text")) != "", 10),
        F.when(F.col("posted_at").isNotNull(), 10),
        F.when(F.size("f_work") > 0, 6),
        F.when(F.col("f_length") >= 500, 12)
        .when(F.col("f_length") >= 220, 8)
        .when(F.col("f_length") >= 120, 4),
    ]
    total = reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), points, F.lit(35))
    return typed.withColumn("confidence", F.least(F.lit(100), total).cast("int"))


def bucket_of(score: Column) -> Column:
    return (
        F.when(score >= 70, "high_signal").when(score >= 40, "review_later").otherwise("reject")
    )


def summary_of(score: Column, reasons: Column, otherwise: str) -> Column:
    head = F.concat(F.lit("Score "), score.cast("string"), F.lit(": "))
    return F.concat(
        head,
        F.when(F.size(reasons) > 0, join_text(F.slice(reasons, 1, 3))).otherwise(otherwise),
    )


_FACTS = [
    "f_title", "f_company", "f_location", "f_employment", "f_salary", "f_days", "f_length",
    "f_text", "f_work",
]


def _reasons(*items: Column) -> Column:
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


# ---- criteria score --------------------------------------------------------------------

def hard_block(c: Criteria, t: Column) -> Column:
    """Reason a posting is excluded outright, null when it passes."""
    include, exclude = term_list(c.hard_include), exclude_terms(c)
    blocked = F.lit(None).cast("string")
    if include:
        hits = [t.contains(x) for x in include]
        if mode(c.hard_include_mode) == "or":
            miss = F.concat(
                F.lit("hard filter hit: none of required terms matched ("),
                F.lit(", ".join(include)),
                F.lit(")"),
            )
            blocked = F.when(~any_of(hits), miss)
        else:
            absent = join_text(
                F.array_compact(F.array(*[F.when(~t.contains(x), F.lit(x)) for x in include]))
            )
            miss = F.concat(F.lit("hard filter hit: missing required terms ("), absent, F.lit(")"))
            blocked = F.when(~all_of(hits), miss)
    if exclude:
        blocked = F.coalesce(
            blocked,
            F.concat(F.lit('hard filter hit: exclude term "'), strongest(exclude, t), F.lit('"')),
        )
    return blocked


def title_matches(criteria_title: str, title: Column) -> Column:
    tokens = title_tokens(criteria_title)
    whole = term_matches(criteria_title, title)
    each = all_of([term_matches(x, title) for x in tokens]) if tokens else F.lit(False)
    return (title != "") & (whole | each)


def criteria_parts(c: Criteria) -> list[tuple[int, Column, Column]]:
    """(weight, matched weight, reason) of every criterion that was given."""
    w, parts = CRITERIA_WEIGHTS, []
    title, location = c.title.strip().lower(), c.location.strip().lower()
    keywords, min_salary, days = scoring_terms(c), target_salary(c), target_days(c)
    if title:
        hit = F.col("_title_hit")
        parts.append(
            (
                w["title"],
                F.when(hit, w["title"]).otherwise(0),
                F.when(hit, "title matched").otherwise("title did not match"),
            )
        )
    if keywords:
        n, size = F.col("_kw"), len(keywords)
        tally = F.concat(F.lit(" ("), n.cast("string"), F.lit(f"/{size})"))
        if mode(c.score_keyword_mode or c.keyword_mode) == "or":
            parts.append(
                (
                    w["keywords"],
                    F.when(n > 0, w["keywords"]).otherwise(0),
                    F.when(n > 0, F.concat(F.lit("keywords matched in OR mode"), tally)).otherwise(
                        "keywords did not match in OR mode"
                    ),
                )
            )
        else:
            parts.append(
                (
                    w["keywords"],
                    F.when(n >= size, F.lit(float(w["keywords"]))).otherwise(
                        F.lit(float(w["keywords"])) * (n / F.lit(size)) * 0.5
                    ),
                    F.when(n >= size, F.concat(F.lit("keywords matched all"), tally))
                    .when(n > 0, F.concat(F.lit("keywords partially matched in AND mode"), tally))
                    .otherwise("keywords did not match in AND mode"),
                )
            )
    if location:
        own = F.col("f_location")
        hit = (own != "") & (own.contains(location) | F.contains(F.lit(location), own))
        parts.append(
            (
                w["location"],
                F.when(hit, w["location"]).otherwise(0),
                F.when(hit, "location matched").otherwise("location did not match"),
            )
        )
    if min_salary:
        s = F.col("f_salary")
        parts.append(
            (
                w["salary"],
                F.when(s >= min_salary, w["salary"]).otherwise(0),
                F.when(s.isNull(), "salary unavailable")
                .when(s >= min_salary, "salary matched")
                .otherwise("salary below target"),
            )
        )
    if days is not None:
        d = F.col("f_days")
        parts.append(
            (
                w["freshness"],
                F.when(d <= days, w["freshness"]).otherwise(0),
                F.when(d.isNull(), "freshness unavailable")
                .when(d <= days, "freshness matched")
                .otherwise("freshness outside target"),
            )
        )
    return parts


def score_criteria(postings: DataFrame, c: Criteria, as_of: Column) -> DataFrame:
    """Add score, bucket, summary, reasons, confidence, freshness_days, hard_filtered.

    The criteria are compiled to literals, so the whole score is one projection without a
    join, and every test runs in generated code.
    """
    title, keywords = c.title.strip().lower(), scoring_terms(c)
    t = F.col("f_text")
    staged = with_facts(with_content_path(postings), as_of).withColumns(
        {
            "_block": hard_block(c, t),
            "_title_hit": title_matches(title, F.col("f_title")) if title else F.lit(True),
            "_kw": count_matches([term_matches(x, t) for x in keywords]),
        }
    )
    parts = criteria_parts(c)
    total = sum(p[0] for p in parts)
    matched = reduce(lambda a, b: a + b, [p[1] for p in parts], F.lit(0.0))
    staged = staged.withColumns(
        {
            "_score": clamp_score(matched / total * 100) if total else F.lit(0),
            "_why": _reasons(*[p[2] for p in parts]),
        }
    )
    capped = (
        F.when(F.col("_title_hit"), F.col("_score")).otherwise(F.least("_score", F.lit(25)))
        if title
        else F.col("_score")
    )
    blocked = F.col("_block").isNotNull()
    scored = staged.withColumns(
        {
            "score": F.when(blocked, 0).otherwise(capped).cast("int"),
            "reasons": F.when(blocked, F.array("_block")).otherwise(F.col("_why")),
            "freshness_days": F.col("f_days"),
            "hard_filtered": blocked,
        }
    )
    return scored.withColumns(
        {
            "bucket": bucket_of(F.col("score")),
            "summary": summary_of(F.col("score"), F.col("reasons"), "no criteria provided"),
        }
    ).drop(*_FACTS, "_block", "_title_hit", "_kw", "_score", "_why", "eval_description")


def _with_score(staged: DataFrame, c: Criteria, name: str) -> DataFrame:
    """Add the score of one criteria set to postings with facts."""
    title, keywords = c.title.strip().lower(), scoring_terms(c)
    t = F.col("f_text")
    staged = staged.withColumns(
        {
            "_title_hit": title_matches(title, F.col("f_title")) if title else F.lit(True),
            "_kw": count_matches([term_matches(x, t) for x in keywords]),
        }
    )
    parts = criteria_parts(c)
    total = sum(p[0] for p in parts)
    matched = reduce(lambda a, b: a + b, [p[1] for p in parts], F.lit(0.0))
    raw = clamp_score(matched / total * 100) if total else F.lit(0)
    capped = F.when(F.col("_title_hit"), raw).otherwise(F.least(raw, F.lit(25)))
    return staged.withColumn(name, F.when(hard_block(c, t).isNotNull(), 0).otherwise(capped).cast("int"))


def score_many(postings: DataFrame, criteria: dict[str, Criteria], as_of: Column) -> DataFrame:
    """Bucket counts and mean score per criteria set, one scan for all of them.

    Each set is compiled to its own score column and counted in the same aggregation, so
    postings are neither copied per user nor joined to the users.
    """
    staged = with_facts(with_content_path(postings), as_of)
    scores = {}
    for i, c in enumerate(criteria.values()):
        staged = _with_score(staged, c, f"_s{i}")
        scores[f"_s{i}"] = None
    aggs = []
    for s in scores:
        aggs += [
            F.count_if(F.col(s) >= 70).alias(f"{s}_high"),
            F.count_if(F.col(s).between(40, 69)).alias(f"{s}_later"),
            F.count_if(F.col(s) < 40).alias(f"{s}_reject"),
            F.sum(s).alias(f"{s}_sum"),
            F.count(s).alias(f"{s}_n"),
        ]
    one = staged.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("criteria_id"),
                F.col(f"{s}_high").alias("high_signal"),
                F.col(f"{s}_later").alias("review_later"),
                F.col(f"{s}_reject").alias("reject"),
                half_up(F.col(f"{s}_sum") / F.col(f"{s}_n")).alias("mean_score"),
            )
            for name, s in zip(criteria, scores, strict=True)
        ]
    )
    return one.select(F.inline(rows))


# ---- profile score --------------------------------------------------------------------

def _signal(name: str, terms: tuple[str, ...], each: int, cap: int, label: str):
    hits = matched_literals(list(terms), F.col("f_text"))
    return name, hits, each, cap, label


def deal_breakers(p: Profile) -> Column:
    """Array of the reasons that block a posting outright."""
    items = []
    if p.exclude_keywords:
        items.append(
            F.concat(
                F.lit('hard filter hit: exclude keyword "'),
                strongest(list(p.exclude_keywords), F.col("f_text")),
                F.lit('"'),
            )
        )
    if p.deal_salary_minimum > 0:
        items.append(
            F.when(
                F.col("f_salary") < p.deal_salary_minimum,
                "hard filter hit: salary below deal-breaker minimum",
            )
        )
    if p.deal_work_types:
        wanted = F.array(*[F.lit(x.lower().strip()) for x in p.deal_work_types])
        items.append(
            F.when(
                (F.size("f_work") > 0) & ~F.arrays_overlap("f_work", wanted),
                "hard filter hit: work type outside deal-breaker range ("
                + ", ".join(p.deal_work_types)
                + ")",
            )
        )
    return _reasons(*items)


def score_profile(postings: DataFrame, p: Profile, as_of: Column) -> DataFrame:
    """Additive profile score; every component is a column of its own until the sum."""
    df = postings.withColumn("eval_description", lower_text(F.col("description")))
    df = with_facts(df, as_of)
    levels = list(p.seniority_levels)
    allowed = [x for x in SENIORITY if x in levels]
    barred = [x for x in SENIORITY if x not in levels]
    signals = [
        _signal("_industry", p.industries, 6, 12, "industry signal"),
        _signal("_model", p.business_models, 5, 10, "business model signal"),
        _signal("_maturity", p.company_maturity, 4, 8, "company maturity signal"),
        _signal("_keyword", p.include_keywords, 7, 14, "specialty signal"),
    ]
    text_, loc = F.col("f_text"), F.col("f_location")
    remote = (
        loc.contains("remote")
        | F.col("eval_description").contains("remote")
        | F.array_contains("f_work", "remote")
    )
    df = df.withColumns(
        {
            "_title": strongest(list(p.target_titles), F.col("f_title")),
            "_allowed": strongest(allowed, F.col("f_title")),
            "_barred": strongest(barred, F.col("f_title")),
            "_place": strongest(list(p.target_locations), loc),
            "_employer": strongest(list(p.target_companies), F.col("f_company")),
            "_remote": remote,
            "_deal": deal_breakers(p),
            **{name: hits for name, hits, *_ in signals},
        }
    )

    def named(label: str, c: Column) -> Column:
        return F.concat(F.lit(f'{label} "'), c, F.lit('"'))

    points: list[Column] = []
    why: list[Column] = []

    def add(value: Column, reason: Column) -> None:
        points.append(F.coalesce(value, F.lit(0)))
        why.append(reason)

    hit = F.col("_title").isNotNull()
    add(
        F.when(hit, 35).otherwise(-25),
        F.when(hit, named("title family matches", F.col("_title"))).otherwise(
            "title family not in preferred set"
        ),
    )
    add(
        F.when(F.col("_allowed").isNotNull(), 12).when(F.col("_barred").isNotNull(), -18),
        F.coalesce(
            named("seniority aligns with", F.col("_allowed")),
            named("seniority outside range", F.col("_barred")),
        ),
    )
    add(
        F.when(F.col("_place").isNotNull(), 12), named("location aligns with", F.col("_place"))
    )
    add(
        F.when(F.col("_employer").isNotNull(), 15),
        named("target company match", F.col("_employer")),
    )
    for name, _, each, cap, label in signals:
        c = F.col(name)
        add(
            F.least(F.lit(cap), F.size(c) * each),
            F.when(F.size(c) > 0, named(label, F.array_join(F.slice(c, 1, 2), '", "'))),
        )
    s = F.col("f_salary")
    add(
        F.when(s >= p.salary_floor, 8).when(s < p.salary_floor, -10),
        F.when(s >= p.salary_floor, "salary floor met").when(
            s < p.salary_floor, "salary floor missed"
        ),
    )
    if p.remote_preference == "remote_only":
        add(
            F.when(F.col("_remote"), 15).otherwise(-40),
            F.when(F.col("_remote"), "remote requirement satisfied").otherwise(
                "remote requirement not satisfied"
            ),
        )
    elif p.remote_preference == "remote_friendly":
        add(F.when(F.col("_remote"), 8), F.when(F.col("_remote"), "remote-friendly signal"))
    if p.work_type_preferences:
        wanted = F.array(*[F.lit(x.lower().strip()) for x in p.work_type_preferences])
        fits = F.arrays_overlap("f_work", wanted)
        add(F.when(fits, 8), F.when(fits, "work type preference matched"))
    source = F.col("source_type")
    bonus = F.lit(None).cast("int")
    for kind, value in SOURCE_POINTS.items():
        bonus = F.when(source == kind, value).otherwise(bonus)
    add(bonus, F.concat(F.lit("source quality bonus +"), bonus.cast("string")))
    add(freshness_points(F.col("f_days")), freshness_label(F.col("f_days")))
    conf = F.col("confidence")
    add(
        F.when(conf < 45, -8).when(conf >= 80, 2),
        F.when(conf < 45, F.concat(F.lit("low data confidence ("), conf.cast("string"), F.lit(")")))
        .when(conf >= 80, F.concat(F.lit("high data confidence ("), conf.cast("string"), F.lit(")"))),
    )
    df = df.withColumns(
        {
            "_points": reduce(lambda a, b: a + b, points),
            "reasons": F.concat(_reasons(*why), "_deal"),
            "hard_filtered": F.size("_deal") > 0,
            "freshness_days": F.col("f_days"),
        }
    )
    blocked = F.col("hard_filtered")
    df = df.withColumn("score", F.when(blocked, 0).otherwise(clamp_score(F.col("_points"))))
    df = df.withColumns(
        {
            "bucket": bucket_of(F.col("score")),
            "summary": F.when(
                blocked, F.concat(F.lit("Score 0: "), F.get(F.col("_deal"), F.lit(0)))
            ).otherwise(
                summary_of(F.col("score"), F.col("reasons"), "no strong matching signals found")
            ),
        }
    )
    return df.drop(
        *_FACTS, "eval_description", "_points", "_title", "_allowed", "_barred", "_place",
        "_employer", "_remote", "_deal", *[n for n, *_ in signals],
    )


# ---- learning --------------------------------------------------------------------------

def company_history(postings: DataFrame) -> DataFrame:
    """Applied, rejected and skipped counts per lower-case company."""
    return (
        postings.withColumn("company_key", lower_text(F.col("company")))
        .filter(F.col("company_key") != "")
        .groupBy("company_key")
        .agg(
            F.count_if(F.col("status") == "applied").alias("applied"),
            F.count_if(F.col("status") == "rejected").alias("rejected"),
            F.count_if(F.col("status") == "skip_for_now").alias("skipped"),
        )
    )


def apply_learning(scored: DataFrame, history: DataFrame) -> DataFrame:
    """Move scores by what happened at the same company before."""
    delta = F.greatest(
        F.lit(-12),
        F.least(F.lit(12), F.col("applied") * 3 - F.col("rejected") * 2 - F.col("skipped")),
    )
    model = history.select("company_key", delta.cast("int").alias("delta")).filter("delta <> 0")
    keyed = scored.withColumn("company_key", lower_text(F.col("company")))
    j = join_one_per_key(keyed, model, "company_key")
    d = F.col("delta")
    applies = d.isNotNull() & ~F.col("hard_filtered")
    sign = F.when(d > 0, F.concat(F.lit("+"), d.cast("string"))).otherwise(d.cast("string"))
    reason = F.concat(
        F.when(d > 0, "historical positive signal at ").otherwise("historical negative signal at "),
        F.lit('"'), F.col("company_key"), F.lit('" ('), sign, F.lit(")"),
    )
    moved = j.withColumns(
        {
            "score": F.when(applies, clamp_score(F.col("score") + d)).otherwise(F.col("score")),
            "reasons": F.when(applies, F.concat("reasons", F.array(reason))).otherwise(
                F.col("reasons")
            ),
            "_moved": applies,
        }
    )
    return moved.withColumns(
        {
            "bucket": F.when(F.col("_moved"), bucket_of(F.col("score"))).otherwise(F.col("bucket")),
            "summary": F.when(
                F.col("_moved"),
                summary_of(F.col("score"), F.col("reasons"), "no strong matching signals found"),
            ).otherwise(F.col("summary")),
        }
    ).drop("_moved", "company_key", "delta")


def score_postings(postings: DataFrame, c: Criteria, as_of: Column) -> DataFrame:
    """Criteria score, or the default profile with learning when the criteria say nothing."""
    if has_signal(c):
        return score_criteria(postings, c, as_of)
    scored = score_profile(postings, profile_from_criteria(c), as_of)
    return apply_learning(scored, company_history(postings))
