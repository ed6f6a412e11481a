"""Parameters of the operators; every default is a fixed value of the domain."""

from __future__ import annotations

from dataclasses import dataclass, field

SOURCE_TYPES = [
    "linkedin_capture_file", "builtin_search", "wellfound_search", "ashby_search",
    "google_search", "indeed_search", "ziprecruiter_search", "remoteok_search",
]
STATUSES = ["new", "viewed", "applied", "skip_for_now", "rejected"]
BUCKETS = ["high_signal", "review_later", "reject"]

# Source type -> short kind, label and list position.
SOURCE_KINDS = [
    ("linkedin_capture_file", "li", "LinkedIn", 0),
    ("builtin_search", "bi", "Built In", 1),
    ("ashby_search", "ah", "Ashby", 2),
    ("indeed_search", "id", "Indeed", 3),
    ("ziprecruiter_search", "zr", "ZipRecruiter", 4),
    ("google_search", "gg", "Google", 5),
    ("wellfound_search", "wf", "Wellfound", 6),
    ("remoteok_search", "ro", "RemoteOK", 7),
]
# Types whose pages are fetched over plain HTTP keep a 12 hour cache.
HTTP_SOURCE_TYPES = ["builtin_search", "google_search"]
SOURCE_POINTS = {
    "builtin_search": 3, "wellfound_search": 2, "ashby_search": 2, "linkedin_capture_file": 2,
}
RISK_CLASS = {
    "linkedin_capture_file": "auth_high",
    "wellfound_search": "auth_high",
    "google_search": "public_challenge",
    "ashby_search": "public_challenge",
}
# Fixed values: (profile, risk class) -> minutes between runs, runs per day, cooldown minutes.
REFRESH_POLICY = {
    ("safe", "auth_high"): (720, 4, 720),
    ("safe", "public_challenge"): (180, 8, 720),
    ("safe", "public_standard"): (60, 12, 240),
    ("probe", "auth_high"): (90, 10, 240),
    ("probe", "public_challenge"): (20, 20, 180),
    ("probe", "public_standard"): (10, 30, 120),
}
REFRESH_LABELS = {
    "eligible": "ready_live", "force_refresh": "ready_live", "cache_fresh": "cache_fresh",
    "cooldown": "cooldown", "min_interval": "throttled", "daily_cap": "daily_cap",
    "mock_profile": "cache_only",
}
MANUAL_DAILY_CAP = 3
RETENTION_DAYS = {"new": 30, "viewed": 45, "skip_for_now": 21, "rejected": 14, "applied": None}
CRITERIA_WEIGHTS = {"title": 35, "keywords": 25, "location": 15, "salary": 15, "freshness": 10}
DETAIL_TYPES = [
    "linkedin_capture_file", "builtin_search", "ashby_search",
    "google_search", "indeed_search", "ziprecruiter_search",
]


@dataclass(frozen=True)
class Thresholds:
    min_expected: int = 10
    min_baseline_ratio: float = 0.15
    reject_coverage: float = 0.2
    quarantine_coverage: float = 0.6
    min_url_validity: float = 0.7
    min_unique_ratio: float = 0.4
    min_sample: int = 8
    severe_unknown: float = 0.98


@dataclass(frozen=True)
class Criteria:
    title: str = ""
    keywords: str = ""
    keyword_mode: str = ""
    hard_include: tuple[str, ...] | str = ()
    hard_include_mode: str = ""
    hard_exclude: tuple[str, ...] | str = ()
    score_keywords: tuple[str, ...] | str = ()
    score_keyword_mode: str = ""
    include: tuple[str, ...] | str = ()
    exclude: tuple[str, ...] | str = ()
    location: str = ""
    date_posted: str = "any"
    min_salary: float | None = None


@dataclass(frozen=True)
class Profile:
    target_titles: tuple[str, ...] = ()
    target_locations: tuple[str, ...] = ()
    remote_preference: str = "onsite_ok"
    work_type_preferences: tuple[str, ...] = ()
    salary_floor: int = 0
    seniority_levels: tuple[str, ...] = ()
    industries: tuple[str, ...] = ()
    business_models: tuple[str, ...] = ()
    company_maturity: tuple[str, ...] = ()
    target_companies: tuple[str, ...] = ()
    include_keywords: tuple[str, ...] = ()
    exclude_keywords: tuple[str, ...] = ()
    deal_salary_minimum: int = 0
    deal_work_types: tuple[str, ...] = field(default_factory=tuple)
