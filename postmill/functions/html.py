"""HTML text as columns: tags, entities, hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.core import W, nonempty, text

# A link with its target and text, and one whose target is a posting path.
ANCHOR = r'(?i)<a[^>]*href="([^"]+)"[^>]*>([\s\S]*?)</a>'
JOB_ANCHOR = r'(?i)<a[^>]*href="([^"]*/jobs/[^"]*)"[^>]*>([\s\S]*?)</a>'


# Numeric entities, first the hexadecimal, then the decimal ones: how they begin, the numbers of the
# two halves of a character beyond the first plane, any number, and its base.
_ENTITIES = (
    (r"&#[xX]0{0,9}", "[dD][89abAB][0-9a-fA-F]{2}", "[dD][c-fC-F][0-9a-fA-F]{2}", "[0-9a-fA-F]{1,6}", 16),
    (r"&#0{0,9}", r"55(?:29[6-9]|[3-9]\d{2})|56(?:[0-2]\d{2}|30\d|31\d)", r"56(?:3[2-9]\d|[4-9]\d{2})|57(?:[0-2]\d{2}|3[0-3]\d|34[0-3])", r"\d{1,7}", 10),
)
# Named entities in the order they are replaced.
_NAMED = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))


def _numbers_sql(text_: str, begin: str, high: str, low: str, any_: str, base: int) -> str:
    """SQL that cuts a text in front of every entity of one kind, maps each piece once, and joins them."""
    pattern = f"{begin}(?:({high});{begin}({low})|({any_}));"
    second_half = f"(?<={begin}(?:{high});){begin}(?:{low});"
    number = lambda i: f"CAST(conv(regexp_extract(p, r'^{pattern}', {i}), {base}, 10) AS BIGINT)"
    point = f"coalesce({number(3)}, ({number(1)} - 55296) * 1024 + {number(2)} - 56320 + 65536)"
    char = f"CASE WHEN startswith(p, '&#') AND p RLIKE r'^{pattern}' THEN decode(unhex(lpad(hex(CASE WHEN {point} <= 1114111 THEN {point} END), 8, '0')), 'UTF-32') END"
    return f"array_join(transform(split({text_}, r'(?={pattern})(?!{second_half})', -1), p -> coalesce({char} || regexp_replace(p, r'^{pattern}', ''), p)), '')"


def _decode_sql() -> str:
    """A lambda over one text; the column functions would make some hundred calls to the JVM for it."""
    numeric = "t"
    for kind in _ENTITIES:
        numeric = _numbers_sql(numeric, *kind)
    out = f"CASE WHEN contains(t, '&#') THEN {numeric} ELSE t END"
    for entity, char in _NAMED:
        out = f"replace({out}, '{entity}', '{char}')"
    return f"t -> CASE WHEN contains(t, '&') THEN {out} ELSE t END"


def decode_entities(c: Column) -> Column:
    """Numeric entities (hexadecimal, then decimal), then the named ones; text without any is left alone.

    Numbers with more digits than a code point can have stay as they are. The input is named once in the
    expression, so decoding does not grow with the expression it is applied to.
    """
    return F.element_at(F.call_function("transform", F.array(c), F.expr(_decode_sql())), 1)


def strip_tags(c: Column) -> Column:
    return decode_entities(F.regexp_replace(c, "<[^>]+>", " "))


def plain_text(c: Column) -> Column:
    return text(strip_tags(c))


# What detail text is searched for.
POSTED = (
    r"(?i)(\d+\s+(?:hour|day|week|month|year)s?\s+ago|today|yesterday|just posted|"
    r"posted(?:\s+on)?\s+[a-z]{3,9}\s+\d{1,2},?\s+\d{2,4})"
)
SALARY = (
    r"(?i)(?:[$€£]\s*\d[\d,]*(?:\.\d+)?(?:[kKmM])?(?:\s*[-–]\s*[$€£]?\s*\d[\d,]*(?:\.\d+)?(?:[kKmM])?)?|"
    r"(?:\d{2,3}\s*[Kk]\s*[-–]\s*\d{2,3}\s*[Kk]))"
    r"(?:\s*(?:annually|yearly|monthly|weekly|hourly|per\s+(?:year|yr|hour|hr)|/(?:year|yr|hour|hr)))?"
)
EMPLOYMENT = r"full[- ]?time|part[- ]?time|contract|temporary|internship|freelance|apprenticeship"
LOCATION = (
    r"remote|hybrid|on-site|onsite|in-office|san francisco(?:,\s*ca)?|new york(?:,\s*ny)?|"
    r"seattle(?:,\s*wa)?|austin(?:,\s*tx)?|los angeles(?:,\s*ca)?|california|united states"
)
# Dates and places near a link.
ANCHOR_POSTED = r"(?i)(\d+\s+(?:hour|day|week|month|year)s?\s+ago|today|yesterday)"
BLOCK_POSTED = (r"(?i)(\d+\s+(?:hour|day|week|month|year)s?\s+ago)", r"(?i)(?<![A-Za-z0-9_])(today|yesterday)(?![A-Za-z0-9_])")
BOARD_PLACE = r"(?i)(?:location|office|remote)[^<]{0,80}"
STARTUP_NAME = (
    r'(?i)data-test(?:id)?="(?:startup|company)[^"]*name[^"]*"[^>]*>([\s\S]*?)</(?:a|span|div)>',
    r'(?i)class="[^"]*(?:startup|company)[^"]*name[^"]*"[^>]*>([\s\S]*?)</(?:a|span|div)>',
)
STARTUP_PLACE = (
    r'(?i)data-test(?:id)?="[^"]*location[^"]*"[^>]*>([\s\S]*?)</(?:a|span|div)>',
    r'(?i)class="[^"]*location[^"]*"[^>]*>([\s\S]*?)</(?:a|span|div)>',
)
ANCHOR_LOCATION = "san francisco|new york|remote|seattle|austin|los angeles|california"


def bounded(pattern: str) -> str:
    return rf"(?i)(?<!{W})({pattern})(?!{W})"


def text_hints(t: Column) -> dict[str, Column]:
    """Hints of stripped, normalised text; empty when nothing is found."""
    return {
        "posted_at": F.regexp_extract(t, POSTED, 1),
        "salary_text": F.regexp_extract(t, SALARY, 0),
        "employment_type": F.regexp_extract(t, bounded(EMPLOYMENT), 1),
        "location": F.regexp_extract(t, bounded(LOCATION), 1),
    }


# Link texts that are never a job title.
BLOCKED_TITLES = [
    "home", "about", "teams", "benefits", "locations", "privacy policy", "terms", "apply",
    "learn more", "view all", "all jobs", "careers",
]


def looks_like_title(t: Column) -> Column:
    low = F.lower(t)
    return (
        F.length(t).between(4, 180) & ~low.isin(BLOCKED_TITLES) & low.rlike("[a-z]") & t.rlike(r"\s")
    )


def page_company(html: Column) -> Column:
    """Company named by the page title."""
    title = plain_text(F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1))
    return title


# Forms of a page title that name the company, tried in this order.
TITLE_COMPANY = (
    r"(?i)^jobs at (.+)$", r"(?i)^open roles at (.+)$", r"(?i)^careers at (.+)$", r"(?i)^(.+?) careers$", r"(?i)^(.+?) jobs$",
)
TITLE_NOISE = "open roles|jobs|careers"


def company_of_title(t: Column) -> Column:
    named = [nonempty(F.regexp_extract(t, p, 1)) for p in TITLE_COMPANY]
    rest = text(F.regexp_replace(F.split_part(t, F.lit("|"), F.lit(1)), bounded(TITLE_NOISE), ""))
    return F.coalesce(*named, rest)


# How a page announces its number of results.
TOTALS = (
    r"(?i)showing\s+\d+\s*[-–]\s*\d+\s+of\s+([\d,]+)\s+jobs?", r"(?i)([\d,]+)\s+jobs?\s+(?:available|found|open)", r"(?i)([\d,]+)\s+results?",
)


def expected_total(t: Column) -> Column:
    """Number of results a page announces, from its whole text."""
    found = [
        nonempty(F.replace(F.regexp_extract(t, p, 1), F.lit(","), F.lit(""))).try_cast("bigint")
        for p in TOTALS
    ]
    return F.coalesce(*[F.when(n > 0, n) for n in found])
