"""Term lists and the two ways a term can match text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.core import B, W, collapse, word

# Word lists.
AI_TERMS = ["ai", "ml", "llm", "genai"]
AI_WORDS = ["ai", "genai", "gen ai", "llm", "ml", "machine learning", "artificial intelligence"]
SENIORITY = [
    "intern", "associate", "junior", "mid", "senior", "staff", "lead",
    "principal", "group", "director", "head", "vp", "vice president", "chief",
]
SKILLS = [
    "ai", "machine learning", "llm", "python", "sql", "product management",
    "data infrastructure", "distributed systems",
]
WORK_TYPES = {
    "remote": ["remote", "work from home", "wfh", "anywhere"],
    "hybrid": ["hybrid", "flexible location"],
    "in-person": ["onsite", "on-site", "in office", "in-office", "office"],
}
TITLE_WORDS = [
    "manager", "engineer", "designer", "analyst", "scientist", "developer", "owner",
    "director", "head", "lead", "chief", "vp",
]
# The dotted form ends in a full stop, so its boundary needs a word character behind it.
AI_PATTERN = rf"{word(*AI_WORDS)}|(?<!{W})a\.i\.(?={W})"


# ---- criteria text on the driver -------------------------------------------------

def unique(terms: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(t for t in terms if t))


def split_text(value: str | None) -> list[str]:
    """Split on comma, semicolon and the word 'and'."""
    pieces = re.split(r"[;,]|(?i:\band\b)", value or "", flags=re.ASCII)
    return [p.strip().lower() for p in pieces if p.strip()]


def term_list(value) -> list[str]:
    if isinstance(value, (list, tuple)):
        return unique(str(t or "").strip().lower() for t in value)
    return split_text(value)


def comma_list(value: str | None) -> list[str]:
    return unique(p.strip().lower() for p in (value or "").split(","))


def title_tokens(value: str) -> list[str]:
    tokens = re.sub(r"[^a-z0-9\s]", " ", value.lower()).split()
    return [{"pm": "product manager"}.get(t, t) for t in tokens if t not in ("and", "or")]


# ---- the same on columns ---------------------------------------------------------

def split_terms(c: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?i){B}and{B}", ";"), "[;,]")
    return F.filter(F.transform(parts, lambda p: F.lower(collapse(p))), lambda p: p != "")


def comma_terms(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), ",")
    trimmed = F.transform(parts, lambda p: F.lower(F.trim(p)))
    return F.array_distinct(F.filter(trimmed, lambda p: p != ""))


# ---- matching ----------------------------------------------------------------------

def ai_flag(haystack: Column) -> Column:
    return haystack.rlike(AI_PATTERN)


def pm_flag(haystack: Column) -> Column:
    return haystack.rlike(word("product manager", "pm"))


def term_matches(term: str, haystack: Column) -> Column:
    """Literal term against lower text, with the synonym rules."""
    if not term:
        return F.lit(True)
    if term in AI_TERMS:
        return ai_flag(haystack)
    if term == "product manager":
        return pm_flag(haystack)
    return haystack.contains(term)


def term_matches_col(term: Column, haystack: Column, ai: Column, pm: Column) -> Column:
    """Same for terms that come from a table; ai and pm are flags of the haystack."""
    return (
        F.when(haystack == "", F.lit(False))
        .when(term.isin(AI_TERMS), ai)
        .when(term == "product manager", pm)
        .otherwise(F.contains(haystack, term))
    )


def matched_literals(terms: list[str], haystack: Column) -> Column:
    """Array of the listed terms contained in the text, list order kept."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(haystack.contains(t), F.lit(t)) for t in terms])
    )


def strongest(terms: list[str], haystack: Column) -> Column:
    """Longest contained term, the earlier one on a tie; null without a hit."""
    ordered = sorted(terms, key=lambda t: -len(t))
    if not ordered:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(haystack.contains(t), F.lit(t)) for t in ordered])


def count_matches(conditions: list[Column]) -> Column:
    if not conditions:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def is_title_term(term: Column) -> Column:
    return term.rlike(word(*TITLE_WORDS))


def work_types(haystack: Column) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(any_of([haystack.contains(t) for t in tokens]), F.lit(kind))
                for kind, tokens in WORK_TYPES.items()
            ]
        )
    )


def work_model(hay: Column) -> Column:
    """Lower text of location and description -> hybrid, remote or on-site."""
    return (
        F.when(hay.rlike(word("hybrid")), "hybrid")
        .when(hay.rlike(word("remote")), "remote")
        .when(hay.rlike(word(r"on[\s-]?site", r"in[\s-]?office")), "on-site")
    )


def top_skills(low: Column) -> Column:
    return matched_literals(SKILLS, low)


def seniority_terms(low: Column) -> Column:
    return matched_literals(SENIORITY, low)
