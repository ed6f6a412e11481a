"""Hard filters of sources and the predicates of the views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.core import lower_text, nonempty, text
from postmill.functions.dates import in_posted_window
from postmill.functions.terms import AI_TERMS, ai_flag, is_title_term, pm_flag, term_matches_col
from postmill.operators.skew import filter_here

# Fields a source may search.
SEARCH_FIELDS = ["title", "summary", "description", "company", "employmentType"]
DEFAULT_FIELDS = ["title", "summary", "description"]
FIELD_COLUMN = {"employmentType": "employment_type"}


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Split every rule's terms by scope once, on the rule table.

    Needs source_id, required (array), required_any, exclude_any, fields, enforce.
    """
    def known(f: Column) -> Column:
        return f.isin(SEARCH_FIELDS)

    fields = F.array_distinct(F.filter("fields", known))
    default = F.array(*[F.lit(f) for f in DEFAULT_FIELDS])
    names = F.array(*[F.lit(f) for f in SEARCH_FIELDS])
    chosen = F.when(F.size(fields) > 0, fields).otherwise(default)
    every = F.concat("required", "required_any", "exclude_any")
    return rules.select(
        "source_id",
        F.filter("required", is_title_term).alias("all_title"),
        F.filter("required", lambda t: ~is_title_term(t)).alias("all_content"),
        F.filter("required_any", is_title_term).alias("any_title"),
        F.filter("required_any", lambda t: ~is_title_term(t)).alias("any_content"),
        F.col("exclude_any"),
        F.transform(chosen, lambda f: (F.array_position(names, f) - 1).cast("int")).alias("slots"),
        F.coalesce("enforce", F.lit(False)).alias("enforce"),
        F.arrays_overlap(every, F.array(*[F.lit(t) for t in AI_TERMS])).alias("wants_ai"),
        F.array_contains(every, "product manager").alias("wants_pm"),
    )


def hard_filter(postings: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``drop_reason`` (null = kept) and ``deferred_checks``.

    The rule table has one row per configured source; Spark broadcasts it while its size is
    below the broadcast threshold. Content terms only count when there is enough text, and a
    deferred check is counted only when the tests before it passed.
    """
    for c in ("summary", "employment_type"):
        if c not in postings.columns:
            postings = postings.withColumn(c, F.lit(None).cast("string"))
    j = postings.join(prepare_rules(rules), "source_id", "left")

    searchable = [
        nonempty(F.trim(F.col(FIELD_COLUMN.get(f, f)))) for f in SEARCH_FIELDS
    ]
    plain = F.concat_ws(" ", "title", "summary", "description")
    staged = j.withColumns({"_fields": F.array(*searchable), "_all": text(plain)})
    picked = F.array_join(F.transform("slots", lambda i: F.get("_fields", i)), " ")
    lengths = staged.withColumns(
        {
            "_title": lower_text(F.col("title")),
            "_text": lower_text(F.coalesce(picked, F.col("_all"))),
            "_d": F.length(text(F.col("description"))),
            "_s": F.length(text(F.col("summary"))),
        }
    )
    words = F.when(F.col("_all") == "", 0).otherwise(F.size(F.split("_all", " ")))
    flags = lengths.withColumns(
        {
            "_enough": F.coalesce("enforce", F.lit(False))
            | (F.col("_d") >= 260)
            | (F.col("_s") >= 180)
            | (words >= 60),
            # Synonym patterns only run for rules that have such a term.
            "_title_ai": F.when(F.col("wants_ai"), ai_flag(F.col("_title"))),
            "_title_pm": F.when(F.col("wants_pm"), pm_flag(F.col("_title"))),
            "_text_ai": F.when(F.col("wants_ai"), ai_flag(F.col("_text"))),
            "_text_pm": F.when(F.col("wants_pm"), pm_flag(F.col("_text"))),
        }
    )

    def hit(scope: str):
        return lambda t: term_matches_col(
            t, F.col(f"_{scope}"), F.col(f"_{scope}_ai"), F.col(f"_{scope}_pm")
        )

    def none(name: str) -> Column:
        return F.coalesce(F.size(name), F.lit(0)) == 0

    enough = F.col("_enough")
    reason = (
        F.when(~F.forall("all_title", hit("title")), "required_title")
        .when(enough & ~F.forall("all_content", hit("text")), "required_content")
        .when(~none("any_title") & ~F.exists("any_title", hit("title")), "any_title")
        .when(
            enough & ~none("any_content") & ~F.exists("any_content", hit("text")), "any_content"
        )
        .when(F.exists("exclude_any", hit("text")), "excluded")
    )
    first_deferred = ~enough & ~none("all_content")
    second_deferred = ~enough & ~none("any_content")
    staged = flags.withColumn("drop_reason", reason)
    past_first = F.coalesce(F.col("drop_reason") != "required_title", F.lit(True))
    past_second = F.coalesce(
        ~F.col("drop_reason").isin("required_title", "required_content", "any_title"), F.lit(True)
    )
    deferred = F.when(first_deferred & past_first, 1).otherwise(0) + F.when(
        second_deferred & past_second, 1
    ).otherwise(0)
    return staged.withColumn("deferred_checks", deferred).select(
        *postings.columns, "drop_reason", "deferred_checks"
    )


def passing(postings: DataFrame, rules: DataFrame) -> DataFrame:
    """The postings the hard filter keeps."""
    out = filter_here(hard_filter(postings, rules), F.col("drop_reason").isNull())
    return out.drop("drop_reason", "deferred_checks")


# ---- views -------------------------------------------------------------------------

ACTIVE = ["new", "viewed"]
# Names of the views.
VIEWS = ["all", "new", "best_match", "applied", "skipped", "rejected"]


def view_predicate(view: str, scope: str = "active") -> Column:
    """Rows of a view; ``scope='all'`` lets best_match take every row not rejected."""
    status = F.col("status")
    active = status.isin(ACTIVE)
    best = F.col("bucket") == "high_signal"
    table = {
        "all": active,
        "new": status == "new",
        "best_match": best & (active if scope == "active" else status != "rejected"),
        "applied": status == "applied",
        "skipped": status == "skip_for_now",
        "rejected": status == "rejected",
    }
    return F.coalesce(table.get((view or "").strip().lower(), active), F.lit(False))


def filter_by_source(groups: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """Groups with at least one source of the kind; 'all' keeps everything."""
    wanted = (kind or "all").strip().lower() or "all"
    if wanted == "all":
        return groups
    ids = sources.filter(F.col("kind") == wanted).agg(F.collect_set("source_id").alias("x"))
    return groups.filter(F.arrays_overlap("source_ids", ids.scalar()))


def filter_visible(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Groups without sources, or with at least one source that is not disabled."""
    off = sources.filter(~F.col("enabled")).agg(F.collect_set("source_id").alias("x")).scalar()
    return groups.filter(
        (F.size("source_ids") == 0) | (F.size(F.array_except("source_ids", off)) > 0)
    )


def facet_chain(
    groups: DataFrame,
    as_of: Column,
    posted: str = "all",
    salary: str = "all",
    salary_between: tuple[float, float] | None = None,
    title: str | None = None,
    keyword: str | None = None,
) -> DataFrame:
    """All facet filters together. Needs posted_at, salary_value, title, haystack."""
    out = groups.filter(in_posted_window(F.col("posted_at"), posted, as_of))
    if salary == "has_salary":
        out = out.filter(F.col("salary_value") > 0)
    elif salary == "missing_salary":
        out = out.filter(F.col("salary_value") <= 0)
    if salary_between:
        out = out.filter(F.col("salary_value").between(*salary_between))
    if title:
        out = out.filter(F.coalesce(nonempty(F.trim("title")), F.lit("Unknown")) == title)
    if keyword:
        out = out.filter(F.col("haystack").contains(keyword.lower()))
    return out
