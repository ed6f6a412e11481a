"""Refresh policy over the event log: state, eligibility, decisions and the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.core import word
from postmill.params import MANUAL_DAILY_CAP, REFRESH_LABELS, REFRESH_POLICY, RISK_CLASS

MINUTE = 60_000_000
DAY = 86_400_000_000


def minutes(c: Column) -> Column:
    return c.cast("bigint") * MINUTE


# Wording of pages that ask for a human.
CHALLENGE = [
    r"captcha", r"verify (?:you(?:'|\x{2019})re|you are) human", r"are you human", r"unusual traffic",
    r"bot protection", r"automated quer(?:y|ies)", r"access denied", r"temporarily blocked",
]


def error_outcome(message: Column) -> Column:
    hit = F.coalesce(message, F.lit("")).rlike("(?i)" + word(*CHALLENGE))
    return F.when(hit, "challenge").otherwise("transient_error")


# ---- policy ---------------------------------------------------------------------------------

def normalize_profile(value: str | None) -> str:
    v = (value or "").strip().lower()
    return v if v in ("safe", "probe", "mock") else "safe"


def risk_class(source_type: Column) -> Column:
    out = F.lit("public_standard")
    for t, c in RISK_CLASS.items():
        out = F.when(source_type == t, c).otherwise(out)
    return out


def with_policy(df: DataFrame, profile: str | None = None) -> DataFrame:
    """Add risk_class, live_enabled, min_interval, daily_cap, cooldown (minutes)."""
    name = normalize_profile(profile)
    risk = risk_class(F.trim("source_type"))
    if name == "mock":
        return df.withColumns(
            {
                "risk_class": risk, "live_enabled": F.lit(False),
                "min_interval": F.lit(None).cast("int"), "daily_cap": F.lit(0), "cooldown": F.lit(0),
            }
        )

    def value(i: int) -> Column:
        out = F.lit(REFRESH_POLICY[(name, "public_standard")][i])
        for c in ("auth_high", "public_challenge"):
            out = F.when(F.col("risk_class") == c, REFRESH_POLICY[(name, c)][i]).otherwise(out)
        return out

    return df.withColumn("risk_class", risk).withColumns(
        {
            "live_enabled": F.lit(True), "min_interval": value(0), "daily_cap": value(1),
            "cooldown": value(2),
        }
    )


# ---- state ------------------------------------------------------------------------------------

def refresh_state(events: DataFrame, as_of: Column, profile: str | None = None) -> DataFrame:
    """Last success, cooldown end and today's counts per source (micros since epoch)."""
    at = F.unix_micros("at")
    day = F.floor(F.unix_micros(as_of) / DAY)
    today = F.floor(at / DAY) == day
    p = with_policy(events, profile)
    return p.groupBy("source_id").agg(
        F.first("source_type").alias("source_type"),
        F.max(F.when(F.col("outcome") == "success", at)).alias("last_live"),
        F.max(F.when(F.col("outcome") == "challenge", at + minutes(F.col("cooldown")))).alias(
            "cooldown_until"
        ),
        F.count_if(today).alias("events_today"),
        F.count_if(today & (F.col("mode") == "manual")).alias("manual_today"),
    )


def daily_events(events: DataFrame) -> DataFrame:
    return events.groupBy(
        "source_id", F.date_trunc("day", "at").cast("date").alias("day"), "mode"
    ).agg(F.count(F.lit(1)).alias("n"))


def eligibility(state: DataFrame, now: Column) -> DataFrame:
    """Add reason and next_eligible; ``now`` and the state's times are micros.

    Needs live_enabled, cooldown_until, events_today, daily_cap, last_live, min_interval.
    """
    cooling = F.col("cooldown_until") > now
    capped = F.col("events_today") >= F.col("daily_cap")
    opens = F.col("last_live") + minutes(F.col("min_interval"))
    waiting = (F.col("min_interval") > 0) & (opens > now)
    tomorrow = (F.floor(now / DAY) + 1) * F.lit(DAY).cast("bigint")
    reason = (
        F.when(~F.col("live_enabled"), "mock_profile")
        .when(cooling, "cooldown")
        .when(capped, "daily_cap")
        .when(waiting, "min_interval")
        .otherwise("eligible")
    )
    until = (
        F.when(F.col("reason") == "cooldown", F.col("cooldown_until"))
        .when(F.col("reason") == "daily_cap", tomorrow)
        .when(F.col("reason") == "min_interval", opens)
    )
    return state.withColumn("reason", reason).withColumn("next_eligible", until.cast("bigint"))


def refresh_decision(eligible: DataFrame, cache_fresh: Column, force: bool = False) -> DataFrame:
    """Serve from cache or live, with the status label."""
    r = F.col("reason")
    live = (r == "eligible") | ((r == "min_interval") & F.lit(force))
    from_cache = cache_fresh & ~F.lit(force)
    why = (
        F.when(from_cache, "cache_fresh")
        .when(live, "force_refresh" if force else "eligible")
        .otherwise(r)
    )
    nxt = F.when(live & ~from_cache, F.lit(None)).otherwise(F.col("next_eligible")).cast("bigint")
    out = eligible.withColumns(
        {
            "served_from": F.when(live & ~from_cache, "live").otherwise("cache"),
            "next_eligible": nxt,
            "status_reason": why,
        }
    )
    label = F.lit("cache_only")
    for k, v in REFRESH_LABELS.items():
        label = F.when(F.col("status_reason") == k, v).otherwise(label)
    return out.withColumn("status_label", label).drop("reason")


def manual_refresh(decided: DataFrame, enabled: Column, now: Column) -> DataFrame:
    """Remaining manual refreshes of the day and what blocks the next one."""
    left = F.greatest(F.lit(0), F.lit(MANUAL_DAILY_CAP) - F.col("manual_today"))
    tomorrow = (F.floor(now / DAY) + 1) * F.lit(DAY).cast("bigint")
    nxt = F.when(left <= 0, tomorrow).otherwise(F.col("next_eligible")).cast("bigint")
    blocked = F.when(left <= 0, "manual_daily_cap").when(
        F.col("next_eligible").isNotNull(), F.col("status_reason")
    )
    return decided.withColumns(
        {
            "manual_remaining": left,
            "manual_next": nxt,
            "manual_blocked": blocked,
            "manual_allowed": F.coalesce(enabled, F.lit(False)) & nxt.isNull(),
        }
    )


# ---- audit ------------------------------------------------------------------------------------

def refresh_audit(events: DataFrame, profile: str | None = None) -> DataFrame:
    """For every event: would a live run have been allowed at that moment?

    A running aggregate in two levels, so that a busy source is not one task: inside each
    hour of a source by window, and over the short table of hours for what came before.
    """
    at = F.unix_micros("at")
    p = with_policy(events, profile).withColumns(
        {"_at": at, "_hour": F.floor(at / (60 * MINUTE)), "_day": F.floor(at / DAY)}
    )
    success = F.when(F.col("outcome") == "success", F.col("_at"))
    cool = F.when(F.col("outcome") == "challenge", F.col("_at") + minutes(F.col("cooldown")))
    p = p.withColumns({"_ok": success, "_cool": cool})
    hours = p.groupBy("source_id", "_day", "_hour").agg(
        F.max("_ok").alias("ok"), F.max("_cool").alias("cool"), F.count(F.lit(1)).alias("n")
    )
    before = W.partitionBy("source_id").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    same_day = W.partitionBy("source_id", "_day").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    carry = hours.select(
        "source_id", "_hour",
        F.max("ok").over(before).alias("c_ok"),
        F.max("cool").over(before).alias("c_cool"),
        F.coalesce(F.sum("n").over(same_day), F.lit(0)).alias("c_n"),
    )
    inside = W.partitionBy("source_id", "_hour").orderBy("_at", "event_id").rowsBetween(
        W.unboundedPreceding, -1
    )
    local = p.withColumns(
        {
            "l_ok": F.max("_ok").over(inside),
            "l_cool": F.max("_cool").over(inside),
            "l_n": F.count(F.lit(1)).over(inside),
        }
    )
    state = local.join(carry, ["source_id", "_hour"]).withColumns(
        {
            "last_live": F.greatest("c_ok", "l_ok"),
            "cooldown_until": F.greatest("c_cool", "l_cool"),
            "events_today": F.col("c_n") + F.col("l_n"),
        }
    )
    judged = eligibility(state, F.col("_at"))
    return judged.select(
        "event_id", "source_id", "at", "outcome", "mode", "reason",
        (F.col("reason") == "eligible").alias("allowed"), "next_eligible", "events_today",
    )


# ---- event counters ---------------------------------------------------------------------------

def event_counters(events: DataFrame) -> DataFrame:
    """Total, per event and per channel in one pass."""
    by = events.groupingSets([["event"], ["channel"], []], "event", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("event").alias("ge"), F.grouping("channel").alias("gc")
    )
    scope = F.when(F.col("ge") == 0, "event").when(F.col("gc") == 0, "channel").otherwise("total")
    return by.select(scope.alias("scope"), F.coalesce("event", "channel", F.lit("")).alias("name"), "n")


def usage_quota(
    events: DataFrame, plans: DataFrame, as_of: Column, view: str = "view", search: str = "click"
) -> DataFrame:
    """Usage of the day and month against each user's plan; only free plans are limited."""
    day, month = F.date_trunc("day", as_of), F.date_trunc("month", as_of)
    on_day = (F.date_trunc("day", "occurred_at") == day) & (F.col("event") == view)
    in_month = (F.date_trunc("month", "occurred_at") == month) & (F.col("event") == search)
    used = events.groupBy("distinct_id").agg(
        F.count_if(on_day).alias("views_today"), F.count_if(in_month).alias("searches_month")
    )
    j = plans.join(used, "distinct_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("views_today", "searches_month")}
    )
    free = F.col("plan") == "free"
    zero = F.lit(0)
    return j.withColumns(
        {
            "views_remaining": F.when(free, F.greatest(zero, F.col("daily_views") - F.col("views_today"))),
            "searches_remaining": F.when(
                free, F.greatest(zero, F.col("monthly_searches") - F.col("searches_month"))
            ),
        }
    )
