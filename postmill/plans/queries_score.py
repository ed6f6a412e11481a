"""Filtering and scoring of postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.core import iso
from postmill.operators import filters, profiles, quality, scoring, views
from postmill.operators.criteria_sets import best_for_users
from postmill.params import Criteria, Profile
from postmill.plans import bindings as b
from postmill.plans import sqlkit as k
from postmill.plans import sqlscore as ss
from postmill.plans.catalog import query
from postmill.plans.sqlkit import sql

CRITERIA = {
    "all_fields": Criteria(
        title="machinery high", keywords="urgent; machinery and nation_1", location="Nation_1",
        min_salary=200000, date_posted="1m", hard_exclude=("low",), score_keyword_mode="and",
    ),
    "or_mode": Criteria(
        keywords="urgent, ai", score_keywords=("building", "automobile"), keyword_mode="or",
        hard_include=("building", "nation_2"), hard_include_mode="or", date_posted="2w",
    ),
    "and_include": Criteria(
        title="furniture", hard_include=("furniture", "nation_1"), exclude=("urgent", "not specified"),
        min_salary=100000,
    ),
    "exclude_only": Criteria(exclude=("low", "not specified")),
}
PROFILE = Profile(
    target_titles=("machinery", "building 1-urgent"), target_locations=("nation_1", "nation_12"),
    remote_preference="remote_friendly", work_type_preferences=("remote",), salary_floor=200000,
    seniority_levels=("senior", "staff"), industries=("furniture", "household", "machinery"),
    business_models=("nation_2",), company_maturity=("medium",), target_companies=("customer#00000001",),
    include_keywords=("high", "urgent"), exclude_keywords=("low",), deal_salary_minimum=60000,
    deal_work_types=("remote",),
)
AS_OF = b.AS_OF_POSTING

k.cte("b_facts", "b_posting", ss.facts("b_posting", AS_OF))
for _name, _c in CRITERIA.items():
    k.cte(f"b_score_{_name}", "b_facts", ss.criteria(_c, "b_facts"))
# Stored evaluations: what the views join to.
k.cte("b_eval", "b_score_all_fields", "SELECT id AS job_id, score, bucket, summary, reasons, confidence, freshness_days, hard_filtered FROM b_score_all_fields WHERE num % 13 <> 0")
k.cte("b_profile", "b_facts", ss.profile(PROFILE, "b_facts"))
k.cte("b_joined", "b_posting b_status", "SELECT p.*, coalesce(s.status, 'new') AS status FROM b_posting p LEFT JOIN b_status s ON s.job_id = p.id")


def b_eval(spark, sf):
    # Some postings have no evaluation yet.
    known = b.b_posting(spark, sf).filter("num % 13 <> 0")
    scored = scoring.score_criteria(known, CRITERIA["all_fields"], b.ts(AS_OF))
    return scored.select(
        F.col("id").alias("job_id"), "score", "bucket", "summary", "reasons", "confidence",
        "freshness_days", "hard_filtered",
    )


def b_joined(spark, sf):
    s = b.b_status(spark, sf).select(F.col("job_id").alias("id"), "status")
    return b.b_posting(spark, sf).join(s, "id", "left").withColumn(
        "status", F.coalesce("status", F.lit("new"))
    )


OUT = "id, score, bucket, summary, array_to_string(reasons, ' / ') AS reasons, confidence, freshness_days, CAST(hard_filtered AS INT) AS hard_filtered"


def out(df):
    return df.select(
        "id", "score", "bucket", "summary", F.array_join("reasons", " / ").alias("reasons"),
        "confidence", "freshness_days", F.col("hard_filtered").cast("int").alias("hard_filtered"),
    )


@query("q_score_criteria", sql("b_score_all_fields", f"SELECT {OUT} FROM b_score_all_fields"))
def q_score_criteria(spark, sf):
    return out(
        scoring.score_criteria(b.b_posting(spark, sf), CRITERIA["all_fields"], b.ts(AS_OF))
    )


@query("q_score_criteria_or", sql("b_score_or_mode", f"SELECT {OUT} FROM b_score_or_mode"))
def q_score_criteria_or(spark, sf):
    return out(scoring.score_criteria(b.b_posting(spark, sf), CRITERIA["or_mode"], b.ts(AS_OF)))


@query("q_score_criteria_hard", sql("b_score_and_include", f"SELECT {OUT} FROM b_score_and_include"))
def q_score_criteria_hard(spark, sf):
    return out(
        scoring.score_criteria(b.b_posting(spark, sf), CRITERIA["and_include"], b.ts(AS_OF))
    )


@query("q_score_profile", sql("b_profile", f"SELECT {OUT} FROM b_profile"))
def q_score_profile(spark, sf):
    return out(scoring.score_profile(b.b_posting(spark, sf), PROFILE, b.ts(AS_OF)))


k.cte("b_learned", "b_profile b_joined", ss.learned("b_profile", "b_joined"))


@query("q_learning", sql("b_learned", f"SELECT {OUT} FROM b_learned"))
def q_learning(spark, sf):
    joined = b_joined(spark, sf)
    scored = scoring.score_profile(joined, PROFILE, b.ts(AS_OF))
    return out(scoring.apply_learning(scored, scoring.company_history(joined)))


_FALL = scoring.profile_from_criteria(CRITERIA["exclude_only"])
k.cte("b_fall", "b_facts", ss.profile(_FALL, "b_facts"))
k.cte("b_fallback", "b_fall b_joined", ss.learned("b_fall", "b_joined"))


@query("q_score_fallback", sql("b_fallback", f"SELECT {OUT} FROM b_fallback"))
def q_score_fallback(spark, sf):
    return out(
        scoring.score_postings(b_joined(spark, sf), CRITERIA["exclude_only"], b.ts(AS_OF))
    )


_MULTI = " UNION ALL ".join(
    f"""SELECT '{n}' AS criteria_id, count(*) FILTER (WHERE score >= 70) AS high_signal, count(*) FILTER (WHERE score BETWEEN 40 AND 69) AS review_later,
 count(*) FILTER (WHERE score < 40) AS reject, CAST(floor(sum(score) / count(*) + 0.5) AS BIGINT) AS mean_score FROM b_score_{n}"""
    for n in CRITERIA
)


@query("q_score_multi", sql(" ".join(f"b_score_{n}" for n in CRITERIA), _MULTI))
def q_score_multi(spark, sf):
    return scoring.score_many(b.b_posting(spark, sf), CRITERIA, b.ts(AS_OF))


# Every customer has criteria of their own; a few are equal.
_WORDS = ("urgent; high", "low", "specified, not", "medium and 3; pm", "")


def criteria_of_customers(spark, sf):
    n = F.col("c_custkey")
    words = F.element_at(F.array(*[F.lit(x) for x in _WORDS]), (n % len(_WORDS) + 1).cast("int"))
    return b.table(spark, sf, "customer").select(
        n.alias("user_id"), F.when(n % 4 != 0, F.lower("c_mktsegment")).otherwise("").alias("title"), words.alias("keywords"), F.when(n % 3 == 0, "or").alias("keyword_mode"),
        F.when(n % 6 == 0, "nation_3").when(n % 6 == 1, "NATION_7, east").alias("location"), F.when(n % 5 == 0, F.array(F.lit("nation_2"), F.lit("4-"))).alias("exclude"),
        F.when(n % 7 == 0, "urgent").alias("hard_include"), F.when(n % 8 != 0, (n % 89 + 20) * 1000.0).alias("min_salary"), F.when(n % 2 == 0, "1m").otherwise("any").alias("date_posted"),
    )


_KW = "CASE c_custkey % 5 WHEN 0 THEN ['urgent', 'high'] WHEN 1 THEN ['low'] WHEN 2 THEN ['specified', 'not'] WHEN 3 THEN ['medium', '3', 'pm'] ELSE [] END"


@query(
    "q_score_users",
    sql(
        "b_facts",
        f"""SELECT user_id, CAST(rank AS INT) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rank FROM (
SELECT user_id, id, CAST(CASE WHEN blocked THEN 0 WHEN title <> '' AND NOT th THEN least(raw, 25) ELSE raw END AS INT) AS score FROM (
SELECT *, CASE WHEN total = 0 THEN 0 ELSE least(100, floor((CASE WHEN title <> '' AND th THEN 35 ELSE 0 END
   + CASE WHEN len(kws) = 0 THEN 0.0::DOUBLE WHEN any_kw THEN CASE WHEN kw > 0 THEN 25.0::DOUBLE ELSE 0 END WHEN kw >= len(kws) THEN 25.0::DOUBLE ELSE 25.0::DOUBLE * (kw::DOUBLE / len(kws)) * 0.5 END
   + CASE WHEN loc <> '' AND fl <> '' AND (contains(fl, loc) OR contains(loc, fl)) THEN 15 ELSE 0 END + CASE WHEN sal > 0 AND fs >= sal THEN 15 ELSE 0 END
   + CASE WHEN fd <= days THEN 10 ELSE 0 END)::DOUBLE / total * 100 + 0.5)) END AS raw
FROM (SELECT u.*, f.id, f.ft, f.fl, f.fs, f.fd, f.ft <> '' AND contains(f.ft, u.title) AS th, len(list_filter(u.kws, lambda x: contains(f.tx, x))) AS kw,
   (u.exc AND (contains(f.tx, 'nation_2') OR contains(f.tx, '4-'))) OR (u.inc AND NOT contains(f.tx, 'urgent')) AS blocked
 FROM b_facts f, (SELECT *, CASE WHEN title <> '' THEN 35 ELSE 0 END + CASE WHEN len(kws) > 0 THEN 25 ELSE 0 END + CASE WHEN loc <> '' THEN 15 ELSE 0 END + CASE WHEN sal > 0 THEN 15 ELSE 0 END + CASE WHEN days IS NOT NULL THEN 10 ELSE 0 END AS total
   FROM (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 <> 0 THEN lower(c_mktsegment) ELSE '' END AS title, CAST({_KW} AS VARCHAR[]) AS kws, c_custkey % 3 = 0 AS any_kw,
     CASE c_custkey % 6 WHEN 0 THEN 'nation_3' WHEN 1 THEN 'nation_7, east' ELSE '' END AS loc, c_custkey % 5 = 0 AS exc, c_custkey % 7 = 0 AS inc,
     CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey % 89 + 20) * 1000 ELSE 0 END AS sal, CASE WHEN c_custkey % 2 = 0 THEN 30 END AS days FROM customer)) u)))) WHERE rank <= 3""",
    ),
)
def q_score_users(spark, sf):
    return best_for_users(b.b_posting(spark, sf), criteria_of_customers(spark, sf), b.ts(AS_OF), 3)


@query(
    "q_bucket_counts",
    sql(
        "b_eval",
        """SELECT v.bucket, count(e.job_id) AS n FROM (VALUES ('high_signal'), ('review_later'), ('reject')) AS v(bucket)
LEFT JOIN b_eval e ON e.bucket = v.bucket GROUP BY 1""",
    ),
)
def q_bucket_counts(spark, sf):
    return views.bucket_counts(b_eval(spark, sf))


@query(
    "q_confidence",
    sql("b_facts", "SELECT id, confidence, array_to_string(fw, ',') AS work_types, fs AS salary_floor FROM b_facts"),
)
def q_confidence(spark, sf):
    return scoring.with_facts(b.b_posting(spark, sf), b.ts(AS_OF)).select(
        "id", "confidence", F.array_join("f_work", ",").alias("work_types"),
        F.col("f_salary").alias("salary_floor"),
    )


k.cte("b_doc_facts", "b_doc", ss.facts(
    "(SELECT *, CAST(NULL AS TIMESTAMP) AS posted_at, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS VARCHAR) AS salary_text, CAST(NULL AS VARCHAR) AS employment_type FROM b_doc)", AS_OF))


@query(
    "q_confidence_text",
    sql("b_doc_facts", "SELECT doc_id, confidence, array_to_string(fw, ',') AS work_types FROM b_doc_facts"),
)
def q_confidence_text(spark, sf):
    null = F.lit(None)
    docs = b.b_doc(spark, sf).withColumns(
        {
            "posted_at": null.cast("timestamp"), "updated_at": null.cast("timestamp"),
            "salary_text": null.cast("string"), "employment_type": null.cast("string"),
        }
    )
    return scoring.with_facts(docs, b.ts(AS_OF)).select(
        "doc_id", "confidence", F.array_join("f_work", ",").alias("work_types")
    )


@query(
    "q_content_path",
    sql(
        "b_doc",
        f"""SELECT doc_id, CASE WHEN u THEN 'detail_description' ELSE 'snippet_description' END AS content_path,
 CASE WHEN u THEN 'detail_success' ELSE 'snippet_fallback' END AS detail_fetch, s AS description_source,
 CASE WHEN u THEN 'detail provenance available; evaluated against full description' ELSE 'detail unavailable; evaluated against snippet fallback (source=' || s || ')' END AS content_rationale,
 length(CASE WHEN u THEN d WHEN t <> '' THEN t ELSE d END) AS n_chars
FROM (SELECT *, s = 'detail' AND d <> '' AS u FROM (SELECT doc_id, {k.ltext('title')} AS t, {k.ltext('description')} AS d,
  CASE doc_id % 4 WHEN 0 THEN 'detail' WHEN 1 THEN 'card' WHEN 2 THEN 'unknown' ELSE 'fallback_unknown' END AS s FROM b_doc))""",
    ),
)
def q_content_path(spark, sf):
    m = F.col("doc_id") % 4
    docs = b.b_doc(spark, sf).select(
        "doc_id",
        F.col("title").alias("description"),
        F.col("description").alias("meta_description"),
        F.when(m == 0, " Detail").when(m == 1, "card").when(m == 3, "fallback_unknown")
        .otherwise("other").alias("description_source"),
    )
    return scoring.with_content_path(docs).select(
        "doc_id", "content_path", "detail_fetch", "description_source", "content_rationale",
        F.length("eval_description").cast("bigint").alias("n_chars"),
    )


# ---- hard filter -----------------------------------------------------------------------

def rules(spark):
    s = b.b_source(spark)
    return s.select(
        "source_id",
        profiles.required_terms(
            b.terms_of(F.col("required_terms")), b.terms_of(F.col("required_all")),
            F.col("keywords"), F.col("search_url"), F.col("source_name"),
        ).alias("required"),
        b.terms_of(F.col("required_any")).alias("required_any"),
        b.terms_of(F.col("exclude_any")).alias("exclude_any"),
        b.terms_of(F.col("fields")).alias("fields"),
        F.col("enforce_content").alias("enforce"),
    )


# Required terms of the rule rows, worked out by hand: src1 and src2 are inferred.
_REQ = "CASE source_id WHEN 'src0' THEN ['ring', 'brand'] WHEN 'src1' THEN ['product manager', 'ai'] WHEN 'src2' THEN ['ai'] WHEN 'src3' THEN ['plate'] WHEN 'src5' THEN ['red'] ELSE CAST([] AS VARCHAR[]) END"
_TW = r"\b(manager|engineer|designer|analyst|scientist|developer|owner|director|head|lead|chief|vp)\b"
k.cte(
    "b_rule", "b_source",
    f"""SELECT source_id, list_filter(req, lambda t: regexp_matches(t, {k.q(_TW)})) AS all_title, list_filter(req, lambda t: NOT regexp_matches(t, {k.q(_TW)})) AS all_content,
 list_filter(ra, lambda t: regexp_matches(t, {k.q(_TW)})) AS any_title, list_filter(ra, lambda t: NOT regexp_matches(t, {k.q(_TW)})) AS any_content,
 ex AS exclude_any, fields, enforce_content AS enforce
FROM (SELECT *, {_REQ} AS req, {k.terms_of('required_any')} AS ra, {k.terms_of('exclude_any')} AS ex FROM b_source)""",
)
_HIT = lambda t, x: (
    f"CASE WHEN {x} = '' THEN false WHEN {t} IN ('ai', 'ml', 'llm', 'genai') THEN {x}_ai WHEN {t} = 'product manager' THEN {x}_pm ELSE contains({x}, {t}) END"
)
k.cte(
    "b_filter_in", "b_raw b_doc",
    """SELECT pos AS row_id, source_id, title, company, summary, description, employment_type FROM b_raw
 UNION ALL SELECT 'doc' || doc_id, source_id, title, company, CAST(NULL AS VARCHAR), description, CAST(NULL AS VARCHAR) FROM b_doc""",
)
k.cte(
    "b_filtered", "b_filter_in b_rule",
    rf"""SELECT row_id, source_id, reason AS drop_reason, CAST(CASE WHEN NOT enough AND len(all_content) > 0 AND coalesce(reason <> 'required_title', true) THEN 1 ELSE 0 END
  + CASE WHEN NOT enough AND len(any_content) > 0 AND coalesce(reason NOT IN ('required_title', 'required_content', 'any_title'), true) THEN 1 ELSE 0 END AS INT) AS deferred_checks
FROM (SELECT *, CASE WHEN len(list_filter(all_title, lambda t: NOT ({_HIT('t', 'tt')}))) > 0 THEN 'required_title'
  WHEN enough AND len(list_filter(all_content, lambda t: NOT ({_HIT('t', 'st')}))) > 0 THEN 'required_content'
  WHEN len(any_title) > 0 AND len(list_filter(any_title, lambda t: {_HIT('t', 'tt')})) = 0 THEN 'any_title'
  WHEN enough AND len(any_content) > 0 AND len(list_filter(any_content, lambda t: {_HIT('t', 'st')})) = 0 THEN 'any_content'
  WHEN len(list_filter(exclude_any, lambda t: {_HIT('t', 'st')})) > 0 THEN 'excluded' END AS reason
FROM (SELECT *, regexp_matches(tt, {k.q(ss.AI)}) AS tt_ai, regexp_matches(tt, '\bproduct manager\b|\bpm\b') AS tt_pm,
  regexp_matches(st, {k.q(ss.AI)}) AS st_ai, regexp_matches(st, '\bproduct manager\b|\bpm\b') AS st_pm,
  coalesce(enforce, false) OR length({k.text('description')}) >= 260 OR
    len(string_split({k.text("concat_ws(' ', title, summary, description)")}, ' ')) >= 60 AS enough
FROM (SELECT f.*, r.* EXCLUDE (source_id), {k.ltext('title')} AS tt,
  CASE WHEN fields = 'title|company' THEN {k.ltext("concat_ws(' ', title, company)")} ELSE {k.ltext("concat_ws(' ', title, summary, description)")} END AS st
 FROM b_filter_in f LEFT JOIN b_rule r ON r.source_id = f.source_id)))""",
)


def filter_input(spark, sf):
    cols = ["source_id", "title", "company", "summary", "description", "employment_type"]
    raw = b.b_raw(spark, sf).select(F.col("pos").alias("row_id"), *cols)
    docs = b.b_doc(spark, sf).select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("row_id"), "source_id", "title", "company",
        F.lit(None).cast("string").alias("summary"), "description",
        F.lit(None).cast("string").alias("employment_type"),
    )
    return raw.unionByName(docs)


@query("q_hard_filter", sql("b_filtered", "SELECT row_id, source_id, drop_reason, deferred_checks FROM b_filtered"))
def q_hard_filter(spark, sf):
    return filters.hard_filter(filter_input(spark, sf), rules(spark)).select(
        "row_id", "source_id", "drop_reason", "deferred_checks"
    )


# ---- flagship --------------------------------------------------------------------------

_FLAG = Criteria(
    title="red widget", keywords="ring; widget and large", location="nation_1", min_salary=300000,
    date_posted="1m", hard_exclude=("small",),
)
k.cte("b_raw_ts", "b_ident b_filtered",
      "SELECT i.*, CAST(NULL AS TIMESTAMP) AS updated_at0 FROM b_ident i JOIN b_filtered f ON f.row_id = i.pos WHERE f.drop_reason IS NULL")
k.cte("b_flag_facts", "b_raw_ts", ss.facts(
    f"(SELECT * EXCLUDE (posted_at), seen_at AS posted_at, CAST('{b.AS_OF_RAW}' AS TIMESTAMP) AS updated_at FROM b_raw_ts)", b.AS_OF_RAW))
k.cte("b_flag", "b_flag_facts", ss.criteria(_FLAG, "b_flag_facts"))


@query(
    "q_flagship",
    sql(
        "b_flag",
        f"""SELECT normalized_hash, {k.iso('posted_at')} AS posted_at, score, bucket, title, company, duplicate_count, source_ids FROM
 (SELECT normalized_hash, arg_min(struct_pack(t := title, c := company, s := score, b := bucket, p := posted_at), struct_pack(a := -coalesce(score, -1), b := -coalesce(epoch_us(posted_at), -4611686018427387904), c := pos)) AS r,
   count(*) AS duplicate_count, array_to_string(list_sort(list_distinct(list(source_id))), ',') AS source_ids
  FROM b_flag GROUP BY 1) , LATERAL (SELECT r.t AS title, r.c AS company, r.s AS score, r.b AS bucket, r.p AS posted_at)
ORDER BY score DESC, posted_at DESC, normalized_hash LIMIT 50""",
    ),
)
def q_flagship(spark, sf):
    """Top 50 groups: identity -> hard filter -> score -> group by hash -> top-k."""
    from postmill.operators.identity import normalize_postings

    kept = filters.passing(b.b_raw(spark, sf), rules(spark))
    normal = quality.gate_sources(normalize_postings(kept, b.ts(b.AS_OF_RAW)), "drop")
    scored = scoring.score_criteria(normal, _FLAG, b.ts(b.AS_OF_RAW))
    top = views.top_groups(scored, 50)
    return top.select(
        "normalized_hash", "title", "company", "score", "bucket",
        iso(F.col("posted_at")).alias("posted_at"), "duplicate_count",
        F.array_join(F.array_sort("source_ids"), ",").alias("source_ids"),
    )
