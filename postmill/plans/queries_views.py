"""Read-side queries: groups, facets, histograms, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.core import iso
from postmill.functions.salary import salary_max
from postmill.operators import filters, views
from postmill.operators.settle import settle
from postmill.params import SOURCE_KINDS
from postmill.plans import bindings as b
from postmill.plans import queries_score as qs
from postmill.plans import sqlkit as k
from postmill.plans.catalog import query
from postmill.plans.sqlkit import sql

AS_OF = b.AS_OF_POSTING

k.cte(
    "b_all", "b_posting b_eval b_status",
    """SELECT p.*, e.score, e.bucket, e.summary, e.reasons, e.confidence, coalesce(s.status, 'new') AS status,
  coalesce(s.notes, '') AS notes, s.last_action_at
FROM b_posting p LEFT JOIN b_eval e ON e.job_id = p.id LEFT JOIN b_status s ON s.job_id = p.id""",
)
_TGT_URL = "CASE WHEN external_id IS NOT NULL THEN 'https://www.linkedin.com/jobs/view/' || external_id || '/' ELSE source_url END"
k.cte("b_rank", "b_all", "SELECT *, row_number() OVER (PARTITION BY normalized_hash ORDER BY coalesce(last_action_at, created_at) DESC, id) AS rn FROM b_all")
k.cte(
    "b_group", "b_rank",
    f"""SELECT f.normalized_hash AS id, f.id AS primary_job_id, f.title, f.company, f.location, f.posted_at, f.updated_at, f.salary_text,
  f.score, f.bucket, f.summary, f.confidence, f.normalized_hash, g.status, coalesce(g.notes, '') AS notes,
  g.duplicate_count, s.source_ids, r.reasons,
  {_TGT_URL.replace('external_id', 'f.external_id').replace('source_url', 'f.source_url')} AS target_url, 'direct' AS target_mode,
  coalesce(TRY_CAST(substring(f.salary_text, 2) AS DOUBLE), 0.0) AS salary_value,
  lower(concat_ws(' ', f.title, f.summary, nullif(array_to_string(r.reasons, ' '), ''), f.location, f.company)) AS haystack
FROM b_rank f JOIN (SELECT normalized_hash, count(*) AS duplicate_count, arg_min(nullif(trim(notes), ''), rn) AS notes,
   ['applied', 'rejected', 'skip_for_now', 'viewed', 'new'][CAST(min(list_position(['applied', 'rejected', 'skip_for_now', 'viewed', 'new'], status)) AS INT)] AS status
  FROM b_rank GROUP BY 1) g USING (normalized_hash)
JOIN (SELECT normalized_hash, list(source_id ORDER BY o) AS source_ids FROM (SELECT normalized_hash, source_id, min(rn) AS o FROM b_rank GROUP BY 1, 2) GROUP BY 1) s USING (normalized_hash)
LEFT JOIN (SELECT normalized_hash, list(reason ORDER BY o) AS reasons FROM (SELECT normalized_hash, reason, min(rn * 100 + i) AS o
   FROM (SELECT normalized_hash, rn, unnest(reasons) AS reason, generate_subscripts(reasons, 1) AS i FROM b_rank) GROUP BY 1, 2) GROUP BY 1) r USING (normalized_hash)
WHERE f.rn = 1""",
)
k.cte("b_pairs", "b_group", "SELECT id, normalized_hash, status, bucket, score, unnest(source_ids) AS source_id FROM b_group")
k.cte(
    "b_kind", "b_source",
    "SELECT s.*, v.kind, v.label, v.position FROM b_source s JOIN (VALUES "
    + ", ".join(f"('{t}', '{kind}', '{label}', {pos})" for t, kind, label, pos in SOURCE_KINDS)
    + ") AS v(source_type, kind, label, position) USING (source_type)",
)


def b_all(spark, sf):
    return views.join_status(b.b_posting(spark, sf), qs.b_eval(spark, sf), b.b_status(spark, sf))


def b_group(spark, sf, columns=None):
    """The grouped table; with ``columns`` only these are folded."""
    g = views.group_postings(b_all(spark, sf), columns=columns)
    return g if columns else g.withColumns(
        {"salary_value": salary_max(F.col("salary_text")), "haystack": views.haystack()}
    )


def b_settled(spark, sf):
    """The grouped table, written once for the views that read it more than once."""
    return settle(b_group(spark, sf))


def b_source(spark):
    return b.b_source(spark).withColumn("kind", views.kind_of(F.col("source_type")))


@query(
    "q_jobs_status",
    sql("b_all", f"SELECT id, score, bucket, status, notes, {k.iso('coalesce(posted_at, created_at)')} AS listed_at FROM b_all"),
)
def q_jobs_status(spark, sf):
    return b_all(spark, sf).select(
        "id", "score", "bucket", "status", "notes",
        iso(F.coalesce("posted_at", "created_at")).alias("listed_at"),
    )


@query(
    "q_top_jobs",
    sql("b_all", f"SELECT id, score, status, {k.iso('posted_at')} AS posted_at FROM b_all ORDER BY coalesce(score, -1) DESC, coalesce(b_all.posted_at, created_at) DESC, id LIMIT 100"),
)
def q_top_jobs(spark, sf):
    return views.top_jobs(b_all(spark, sf), 100).select(
        "id", "score", "status", iso(F.col("posted_at")).alias("posted_at")
    )


@query(
    "q_recent_jobs",
    sql("b_all", f"SELECT id, status, {k.iso('coalesce(b_all.posted_at, created_at)')} AS listed_at FROM b_all ORDER BY coalesce(b_all.posted_at, created_at) DESC, created_at DESC, id LIMIT 200"),
)
def q_recent_jobs(spark, sf):
    return views.recent_jobs(b_all(spark, sf), 200).select("id", "status", iso(F.coalesce("posted_at", "created_at")).alias("listed_at"))


@query(
    "q_recent_actions",
    sql("b_all", f"SELECT id, status, {k.iso('coalesce(last_action_at, created_at)')} AS acted_at FROM b_all ORDER BY coalesce(last_action_at, created_at) DESC, id LIMIT 100"),
)
def q_recent_actions(spark, sf):
    return views.recent_actions(b_all(spark, sf), 100).select("id", "status", iso(F.coalesce("last_action_at", "created_at")).alias("acted_at"))


@query(
    "q_group",
    sql(
        "b_group",
        f"""SELECT id, primary_job_id, title, company, location, {k.iso('posted_at')} AS posted_at, score, bucket, status, notes, CAST(duplicate_count AS BIGINT) AS duplicate_count,
  array_to_string(source_ids, ',') AS source_ids, coalesce(array_to_string(reasons, ' / '), '') AS reasons, target_url, target_mode FROM b_group""",
    ),
)
def q_group(spark, sf):
    return b_group(spark, sf).select(
        "id", "primary_job_id", "title", "company", "location", iso(F.col("posted_at")).alias("posted_at"),
        "score", "bucket", "status", "notes", "duplicate_count",
        F.array_join("source_ids", ",").alias("source_ids"),
        F.array_join("reasons", " / ").alias("reasons"),
        F.col("review_target.url").alias("target_url"),
        F.col("review_target.mode").alias("target_mode"),
    )


@query(
    "q_group_count",
    sql("b_posting", "SELECT count(DISTINCT normalized_hash) AS n_groups, count(*) AS n_postings FROM b_posting"),
)
def q_group_count(spark, sf):
    hashes = b.b_posting(spark, sf).groupBy("normalized_hash").agg(F.count(F.lit(1)).alias("n"))
    return hashes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_postings")
    )


@query(
    "q_review_target",
    sql(
        "b_posting",
        r"""SELECT id, CASE WHEN m = 0 THEN u WHEN m = 1 THEN u WHEN external_id IS NOT NULL THEN 'https://www.linkedin.com/jobs/view/' || external_id || '/'
   WHEN m = 2 OR m = 3 THEN 'https://www.linkedin.com/jobs/search-results/?keywords=' || replace(replace(title || ' ' || company, ' ', '+'), '#', '%23') ELSE u END AS url,
  CASE WHEN m = 0 THEN 'search' WHEN m = 1 THEN 'direct' WHEN external_id IS NOT NULL THEN 'direct' WHEN m IN (2, 3) THEN 'search' ELSE 'direct' END AS mode
FROM (SELECT *, num % 5 AS m, CASE num % 5 WHEN 0 THEN 'https://www.linkedin.com/jobs/search-results/?x=' || num WHEN 1 THEN 'https://www.linkedin.com/jobs/view/' || num
  WHEN 2 THEN 'https://www.linkedin.com/jobs/view/role-' || num WHEN 3 THEN '' ELSE source_url END AS u FROM b_posting)""",
    ),
)
def q_review_target(spark, sf):
    m, n = F.col("num") % 5, F.col("num").cast("string")
    u = (
        F.when(m == 0, F.concat(F.lit("https://www.linkedin.com/jobs/search-results/?x="), n))
        .when(m == 1, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), n))
        .when(m == 2, F.concat(F.lit("https://www.linkedin.com/jobs/view/role-"), n))
        .when(m == 3, F.lit(""))
        .otherwise(F.col("source_url"))
    )
    p = b.b_posting(spark, sf).withColumn("u", u)
    t = views.review_target(F.col("u"), F.col("external_id"), F.col("title"), F.col("company"))
    return p.withColumn("t", t).select("id", "t.url", "t.mode")


@query(
    "q_views",
    sql(
        "b_group",
        """SELECT v.view, CAST(sum(CASE v.view WHEN 'all' THEN CAST(status IN ('new', 'viewed') AS INT) WHEN 'new' THEN CAST(status = 'new' AS INT)
  WHEN 'best_match' THEN CAST(status IN ('new', 'viewed') AND coalesce(bucket = 'high_signal', false) AS INT) WHEN 'applied' THEN CAST(status = 'applied' AS INT)
  WHEN 'skipped' THEN CAST(status = 'skip_for_now' AS INT) ELSE CAST(status = 'rejected' AS INT) END) AS BIGINT) AS n
FROM b_group CROSS JOIN (VALUES ('all'), ('new'), ('best_match'), ('applied'), ('skipped'), ('rejected')) AS v(view) GROUP BY 1""",
    ),
)
def q_views(spark, sf):
    return views.view_counts(b_group(spark, sf))


_RECENT = "coalesce(posted_at, updated_at) DESC, id"


@query(
    "q_view_queues",
    sql(
        "b_group",
        f"""SELECT queue, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY {_RECENT}) AS rank
FROM (SELECT *, CASE status WHEN 'applied' THEN 'applied' WHEN 'skip_for_now' THEN 'skipped' WHEN 'rejected' THEN 'rejected' ELSE 'queue' END AS queue FROM b_group)) WHERE rank <= 200""",
    ),
)
def q_view_queues(spark, sf):
    order = [F.coalesce("posted_at", "updated_at").desc(), F.col("id")]
    return views.view_queues(b_group(spark, sf), 200, order).select("queue", "id", "rank")


@query(
    "q_union_queues",
    sql("b_group", "SELECT id, CASE WHEN status IN ('new', 'viewed') THEN 'queue' WHEN bucket = 'high_signal' THEN 'best' ELSE status END AS queue FROM b_group WHERE status IN ('new', 'viewed', 'applied', 'rejected') OR bucket = 'high_signal'"),
)
def q_union_queues(spark, sf):
    g = b_settled(spark, sf).select("id", "status", "bucket")

    def part(name, cond):
        return g.filter(cond).select("id", F.lit(name).alias("queue"))

    s = F.col("status")
    return views.union_queues(
        [
            part("queue", s.isin("new", "viewed")), part("best", F.col("bucket") == "high_signal"),
            part("applied", s == "applied"), part("rejected", s == "rejected"),
        ]
    )


@query(
    "q_status_counts",
    sql("b_all", """SELECT v.status, count(a.id) AS n FROM (VALUES ('new'), ('viewed'), ('applied'), ('skip_for_now'), ('rejected')) AS v(status)
LEFT JOIN b_all a ON a.status = v.status GROUP BY 1"""),
)
def q_status_counts(spark, sf):
    return views.status_counts(b_all(spark, sf))


@query("q_last_seen", sql("b_posting", f"SELECT source_id, {k.iso('max(updated_at)')} AS last_seen_at FROM b_posting GROUP BY 1"))
def q_last_seen(spark, sf):
    seen = views.last_seen(b.b_posting(spark, sf))
    return seen.withColumn("last_seen_at", iso(F.col("last_seen_at")))


_CI = "count(*) FILTER (WHERE {})"
k.cte(
    "b_rollup", "b_pairs",
    f"""SELECT source_id, count(*) AS total_count, {_CI.format("status IN ('new', 'viewed')")} AS active_count, {_CI.format("status = 'applied'")} AS applied_count,
 {_CI.format("status = 'skip_for_now'")} AS skipped_count, {_CI.format("status = 'rejected'")} AS rejected_count, {_CI.format("bucket = 'high_signal'")} AS high_signal_count,
 count(score) AS scored_count, CAST(coalesce(sum(score), 0) AS BIGINT) AS score_total FROM b_pairs GROUP BY 1""",
)


@query("q_source_rollup", sql("b_rollup", "SELECT * FROM b_rollup"))
def q_source_rollup(spark, sf):
    return views.source_rollup(b_group(spark, sf, ["status", "bucket", "score", "source_ids"]))


k.cte("b_imported", "b_posting", "SELECT DISTINCT source_id, normalized_hash FROM b_posting WHERE num % 16 < 4")
k.cte(
    "b_avg", "b_pairs b_imported",
    f"""SELECT source_id, n_in AS imported_scored, {k.half_up('CASE WHEN n_in > 0 THEN s_in / n_in ELSE s_all / n_all END')} AS avg_score
FROM (SELECT p.source_id, count(CASE WHEN i.source_id IS NOT NULL THEN score END) AS n_in, sum(CASE WHEN i.source_id IS NOT NULL THEN score END) AS s_in,
  count(score) AS n_all, sum(score) AS s_all FROM b_pairs p LEFT JOIN b_imported i ON i.source_id = p.source_id AND i.normalized_hash = p.normalized_hash
  WHERE score IS NOT NULL GROUP BY 1)""",
)


def b_imported(spark, sf):
    return b.b_posting(spark, sf).filter("num % 16 < 4").select("source_id", "normalized_hash").distinct()


@query("q_source_avg_score", sql("b_avg", "SELECT * FROM b_avg"))
def q_source_avg_score(spark, sf):
    # Read once, so not written.
    return views.source_average(b_group(spark, sf, ["normalized_hash", "score", "source_ids"]), b_imported(spark, sf))


@query(
    "q_facet_kind",
    sql("b_pairs b_kind", """SELECT k.kind, k.label, k.position, count(DISTINCT p.id) AS n FROM b_kind k LEFT JOIN b_pairs p ON p.source_id = k.source_id GROUP BY 1, 2, 3"""),
)
def q_facet_kind(spark, sf):
    return views.facet_kind(b_group(spark, sf, ["id", "source_ids"]), b_source(spark))


@query(
    "q_facet_source",
    sql("b_pairs b_source", "SELECT p.source_id, s.source_name AS label, count(*) AS n FROM b_pairs p JOIN b_source s ON s.source_id = p.source_id GROUP BY 1, 2"),
)
def q_facet_source(spark, sf):
    return views.facet_source(b_group(spark, sf, ["source_ids"]), b_source(spark))


_AGE = k.days("posted_at", AS_OF)


@query(
    "q_facet_posted",
    sql("b_group", " UNION ALL ".join(
        f"SELECT '{w}' AS \"window\", count(*) FILTER (WHERE {'true' if d is None else f'coalesce({_AGE} <= {d}, false)'}) AS n FROM b_group"
        for w, d in [("all", None), ("24h", 1), ("3d", 3), ("1w", 7), ("2w", 14), ("1m", 30)])),
)
def q_facet_posted(spark, sf):
    return views.facet_posted(b_group(spark, sf, ["posted_at"]), b.ts(AS_OF))


@query("q_title_breakdown", sql("b_group", "SELECT title AS label, count(*) AS n FROM b_group GROUP BY 1 ORDER BY n DESC, label LIMIT 5"))
def q_title_breakdown(spark, sf):
    return views.title_breakdown(b_group(spark, sf, ["title"]), 5)


_TERMS = ["urgent", "NATION_1", "title matched", "customer#0000000", "salary below", "absent term"]


@query(
    "q_keyword_hits",
    sql("b_group", " UNION ALL ".join(
        f"SELECT {k.q(t.lower())} AS term, count(*) FILTER (WHERE contains(haystack, {k.q(t.lower())})) AS n FROM b_group" for t in _TERMS)),
)
def q_keyword_hits(spark, sf):
    return views.keyword_hits(b_group(spark, sf), _TERMS)


@query(
    "q_attribution",
    sql("b_group b_kind", """SELECT g.id, array_to_string(list_transform(g.source_ids, lambda s: m[s][1]), ', ') AS names,
 CASE WHEN len(list_distinct(list_transform(g.source_ids, lambda s: m[s][2]))) > 1 THEN 'Multiple' ELSE m[g.source_ids[1]][2] END AS kind_label
FROM b_group g, (SELECT map_from_entries(list((source_id, [source_name, label]))) AS m FROM b_kind)"""),
)
def q_attribution(spark, sf):
    return views.attribution(b_group(spark, sf), b_source(spark)).withColumn(
        "names", F.array_join("names", ", ")
    )


@query("q_filter_source", sql("b_group", "SELECT id FROM b_group WHERE list_contains(source_ids, 'src3')"))
def q_filter_source(spark, sf):
    return filters.filter_by_source(b_group(spark, sf), b_source(spark), "ah").select("id")


@query("q_visible", sql("b_group", "SELECT id FROM b_group WHERE len(list_filter(source_ids, lambda s: s <> 'src7')) > 0"))
def q_visible(spark, sf):
    return filters.filter_visible(b_group(spark, sf), b_source(spark)).select("id")


@query(
    "q_facet_chain",
    sql("b_group", f"""SELECT id, salary_value FROM b_group WHERE {k.days('posted_at', '2001-06-01 00:00:00')} <= 30 AND salary_value > 0
 AND salary_value BETWEEN 100000 AND 400000 AND contains(haystack, 'nation_1')"""),
)
def q_facet_chain(spark, sf):
    return filters.facet_chain(
        b_group(spark, sf), b.ts("2001-06-01 00:00:00"), "1m", "has_salary", (100000, 400000),
        None, "Nation_1",
    ).select("id", "salary_value")


_V = "SELECT salary_value AS v FROM b_group WHERE salary_value > 0"
k.cte(
    "b_pay_summary", "b_group",
    f"""SELECT min(v) AS "min", avg, max(v) AS "max", max(CASE WHEN rn = CAST(floor((n - 1) * 0.75) AS BIGINT) + 1 THEN v END) AS p75,
  count(*) FILTER (WHERE v > avg) AS above_avg, count(*) FILTER (WHERE v <= avg) AS min_to_avg, count(*) AS with_salary, count(*) FILTER (WHERE v >= band) AS top_band
FROM (SELECT *, max(CASE WHEN rn = n - greatest(1, CAST(ceil(n * 0.25) AS BIGINT)) + 1 THEN v END) OVER () AS band
 FROM (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n, sum(v) OVER () / count(*) OVER () AS avg FROM ({_V}))) GROUP BY avg""",
)


@query("q_salary_summary", sql("b_pay_summary", "SELECT * FROM b_pay_summary"))
def q_salary_summary(spark, sf):
    return views.salary_summary(b_group(spark, sf))


@query(
    "q_salary_matrix",
    sql("b_pay_summary", "SELECT 'has_salary' AS key, with_salary AS n FROM b_pay_summary UNION ALL SELECT 'min_to_avg', min_to_avg FROM b_pay_summary UNION ALL SELECT 'above_avg', above_avg FROM b_pay_summary UNION ALL SELECT 'best_paying', top_band FROM b_pay_summary"),
)
def q_salary_matrix(spark, sf):
    return views.salary_matrix(b_group(spark, sf))


def _hist(values: str, n: int) -> str:
    return f"""SELECT CAST(i AS INT) AS bucket, CASE WHEN i = 0 THEN lo ELSE floor(lo + (hi - lo) / {n} * i + 0.5) END AS lo,
  CASE WHEN i = {n - 1} THEN hi ELSE floor(lo + (hi - lo) / {n} * (i + 1) + 0.5) END AS hi,
  (SELECT count(*) FROM ({values}) x WHERE least({n - 1}, floor((x.v - lo) / ((hi - lo) / {n}))) = i) AS n
FROM (SELECT min(v) AS lo, max(v) AS hi FROM ({values})), range({n}) AS r(i)"""


@query("q_salary_hist", sql("b_group", _hist(_V, 10)))
def q_salary_hist(spark, sf):
    g = b_settled(spark, sf).filter("salary_value > 0")
    return views.histogram(g, "salary_value", 10)


@query("q_score_hist", sql("b_group", _hist("SELECT CAST(score AS DOUBLE) AS v FROM b_group WHERE score IS NOT NULL", 8)))
def q_score_hist(spark, sf):
    return views.histogram(b_settled(spark, sf), "score", 8)


@query(
    "q_range_counts",
    sql("b_group", """SELECT count(*) FILTER (WHERE salary_value > 0 AND salary_value BETWEEN 100000 AND 200000) AS in_salary_range, count(*) FILTER (WHERE score BETWEEN 25 AND 60) AS in_score_range,
 count(*) FILTER (WHERE salary_value > 0) AS with_salary, count(*) FILTER (WHERE salary_value <= 0) AS missing_salary, sum(score)::DOUBLE / count(score) AS mean_score FROM b_group"""),
)
def q_range_counts(spark, sf):
    return views.range_counts(b_group(spark, sf), (100000, 200000), (25, 60))


_SORTS = {
    "score": "coalesce(score, -1) DESC, coalesce(posted_at, updated_at) DESC",
    "date": "coalesce(posted_at, updated_at) DESC, coalesce(score, -1) DESC",
    "salary": "salary_value DESC, coalesce(score, -1) DESC, coalesce(posted_at, updated_at) DESC",
}


@query(
    "q_sorted_views",
    sql("b_group", " UNION ALL ".join(
        f"SELECT '{s}' AS sort, id, CAST(p AS INT) AS position FROM (SELECT id, row_number() OVER (ORDER BY {o}, lower(title), title, id) AS p FROM b_group) WHERE p <= 100"
        for s, o in _SORTS.items())),
)
def q_sorted_views(spark, sf):
    g = b_settled(spark, sf)
    parts = []
    for s in _SORTS:
        p = views.page(g, 1, 100, s)
        parts.append(p.select(F.lit(s).alias("sort"), "id", "position"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "q_page",
    sql("b_group", f"""SELECT CAST(p AS INT) AS position, id, title, 3 AS page, CAST(ceil(n / 10) AS INT) AS total_pages
FROM (SELECT id, title, row_number() OVER (ORDER BY {_SORTS['score']}, lower(title), title, id) AS p, count(*) OVER () AS n FROM b_group) WHERE p > 20 AND p <= 30"""),
)
def q_page(spark, sf):
    return views.page(b_settled(spark, sf), 3, 10, "score")


@query(
    "q_page_of",
    sql("b_group", f"""SELECT CAST(floor((p - 1) / 10) + 1 AS INT) AS page FROM (SELECT primary_job_id, id, row_number() OVER (ORDER BY {_SORTS['date']}, lower(title), title, id) AS p FROM b_group)
 WHERE id = (SELECT max(normalized_hash) FROM b_posting)"""),
)
def q_page_of(spark, sf):
    last = b.b_posting(spark, sf).agg(F.max("normalized_hash").alias("h")).select("h").scalar()
    return views.page_of(b_settled(spark, sf), last, 10, "date")


@query(
    "q_shortlist",
    sql("b_all", """SELECT line, text FROM (SELECT CAST(p AS INT) AS line, '| ' || score || ' | ' || title || ' | ' || company || ' | ' || coalesce(location, '') || ' |' AS text
 FROM (SELECT *, row_number() OVER (ORDER BY coalesce(score, -1) DESC, coalesce(posted_at, created_at) DESC, id) AS p FROM b_all) WHERE p <= 50)
UNION ALL SELECT -1, '| Score | Title | Company | Location |' UNION ALL SELECT 0, '| --- | --- | --- | --- |'"""),
)
def q_shortlist(spark, sf):
    from pyspark.sql import Window as W

    top = views.top_jobs(b_all(spark, sf), 50)
    w = W.orderBy(
        F.coalesce("score", F.lit(-1)).desc(), F.coalesce("posted_at", "created_at").desc(), "id"
    )
    return views.shortlist_markdown(top.withColumn("position", F.row_number().over(w)))
