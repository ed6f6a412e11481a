"""Profiles, criteria, required terms and event envelopes as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.core import lower_text, nonempty, text, word
from postmill.functions.terms import AI_PATTERN
from postmill.functions.url import QUERY, param

# Accepted channels and identity modes, and the known product events.
CHANNELS = ["terminal", "dashboard", "codex", "claude"]
IDENTITY_MODES = ["machine_hash", "anonymous_session"]


def remote_preference(work_types: Column) -> Column:
    low = F.transform(work_types, F.lower)

    def has(*names: str) -> Column:
        return F.arrays_overlap(low, F.array(*[F.lit(n) for n in names]))

    remote, hybrid = has("remote"), has("hybrid")
    in_person = has("in-person", "in person", "onsite")
    return (
        F.when(remote & ~hybrid & ~in_person, "remote_only")
        .when(remote, "remote_friendly")
        .otherwise("onsite_ok")
    )


def _or_fallback(first: Column, fallback: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(
        F.coalesce(fallback, F.array().cast("array<string>"))
    )


def profiles_from_goals(goals: DataFrame) -> DataFrame:
    """One profile row per goals row; ``fb_*`` columns are the fallback profile."""
    keywords = F.array_distinct(F.concat("include_keywords", "business_models"))
    floor = (
        F.when(F.col("deal_salary_minimum") > 0, F.col("deal_salary_minimum"))
        .when(F.col("minimum_salary").isNotNull(), F.col("minimum_salary"))
        .otherwise(F.coalesce("fb_salary_floor", F.lit(0)))
    )
    return goals.select(
        "user_id",
        _or_fallback(F.col("target_titles"), F.col("fb_target_titles")).alias("target_titles"),
        _or_fallback(F.col("preferred_cities"), F.col("fb_target_locations")).alias(
            "target_locations"
        ),
        remote_preference(F.col("work_type")).alias("remote_preference"),
        floor.cast("bigint").alias("salary_floor"),
        _or_fallback(keywords, F.col("fb_include_keywords")).alias("include_keywords"),
        F.col("work_type").alias("work_type_preferences"),
    )


def effective_criteria(
    per_source: DataFrame, global_row: dict[str, object], keys: list[str]
) -> DataFrame:
    """A source's own criteria win key by key over the global ones."""
    return per_source.withColumns(
        {k: F.coalesce(F.col(k), F.lit(global_row.get(k))) for k in keys}
    )


def _infer(intent: Column) -> Column:
    t = lower_text(intent)
    product = word(r"product\s+manager", r"product\s+management")
    program = word(r"program\s+manager", r"program\s+management")
    return F.array_compact(
        F.array(
            F.when(t.rlike(product), "product manager").when(t.rlike(program), "program manager"),
            F.when(t.rlike(AI_PATTERN), "ai"),
        )
    )


def unique_terms(terms: Column) -> Column:
    cleaned = F.transform(terms, lambda t: lower_text(t))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


def required_terms(
    explicit: Column, required_all: Column, keywords: Column, search_url: Column, name: Column
) -> Column:
    """Explicit terms, else the hard-filter list, else what the source's own texts ask for."""
    q = F.regexp_extract(search_url, QUERY, 1)
    inferred = F.array_distinct(
        F.concat(
            _infer(keywords),
            _infer(param(q, "keywords")),
            _infer(param(q, "q")),
            _infer(param(q, "search")),
            _infer(name),
        )
    )
    own, listed = unique_terms(explicit), unique_terms(required_all)
    return F.when(F.size(own) > 0, own).when(F.size(listed) > 0, listed).otherwise(inferred)


def machine_id(hostname: Column) -> Column:
    return F.concat(
        F.lit("machine:"), F.substring(F.sha2(F.lower(F.trim(hostname)), 256), 1, 16)
    )


def event_envelopes(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Known events only; channel, mode and distinct id normalised."""
    channel = F.lower(F.trim("channel"))
    mode = F.lower(F.trim("identity_mode"))
    known = events.join(F.broadcast(registry.select("event").distinct()), "event", "left_semi")
    return known.select(
        "event_id",
        "event",
        "occurred_at",
        F.when(channel.isin(CHANNELS), channel).otherwise("terminal").alias("channel"),
        F.when(mode.isin(IDENTITY_MODES), mode).otherwise("machine_hash").alias("identity_mode"),
        F.coalesce(
            nonempty(text(F.col("distinct_id"))), machine_id(F.col("host"))
        ).alias("distinct_id"),
        F.col("props").alias("properties"),
    )
