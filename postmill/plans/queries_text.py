"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import dates, salary, terms, url
from postmill.functions.core import is_present, iso, lower_text, text
from postmill.operators import profiles
from postmill.operators.identity import missing_fields, normalize_postings, quality_score
from postmill.plans import bindings as b
from postmill.plans import sqlkit as k
from postmill.plans.catalog import query
from postmill.plans.sqlkit import sql

# ---- text --------------------------------------------------------------------------


@query(
    "q_normalize",
    sql(
        "b_doc",
        f"""SELECT doc_id, {k.text('title')} AS title, sha256({k.text('description')}) AS description_sha,
  CAST(length({k.text('description')}) AS BIGINT) AS n_chars,
  CAST({k.present('title')} AS INT) AS has_title FROM b_doc""",
    ),
)
def q_normalize(spark, sf):
    return b.b_doc(spark, sf).select(
        "doc_id", text(F.col("title")).alias("title"), text(F.col("description")).alias("d")
    ).select(
        "doc_id",
        "title",
        F.sha2("d", 256).alias("description_sha"),
        F.length("d").cast("bigint").alias("n_chars"),
        is_present(F.col("title")).cast("int").alias("has_title"),
    )


# URL shapes of the boards, made from the order keys.
def _links(spark, sf):
    key = F.col("o_orderkey").cast("string")
    m = F.col("o_orderkey") % 9
    shape = (
        F.when(m == 0, F.concat(F.lit("https://www.LinkedIn.com/jobs/view/"), key, F.lit("/?trk=x")))
        .when(m == 1, F.concat(F.lit("https://www.indeed.com/rc/clk?jk=a+"), key, F.lit("&from=serp")))
        .when(m == 2, F.concat(F.lit("https://www.google.com/search?q=x&docid="), key, F.lit("%3D%3D")))
        .when(m == 3, F.concat(F.lit("https://www.google.com/search?q=jobs#vhid=abc%2Fdocid%3D"), key))
        .when(m == 4, F.concat(F.lit("  https://wellfound.com:443/jobs/"), key, F.lit("-role?ref=a#top ")))
        .when(m == 5, F.concat(F.lit("http://jobs.ashbyhq.com:8080/acme/12345"), key))
        .when(m == 6, F.concat(F.lit("https://linkedin.com/jobs/search-results/?currentJobId="), key))
        .when(m == 7, F.concat(F.lit("https://example.org?x="), key))
        .otherwise(F.concat(F.lit("not a url "), key))
    )
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("link_id"), shape.alias("url"),
        b.source_type_of(F.col("o_orderkey")).alias("source_type"),
    )


k.cte(
    "b_link", "",
    f"""SELECT o_orderkey AS link_id, {k.TYPE_LIST}[CAST(o_orderkey % 8 + 1 AS INT)] AS source_type,
 CASE o_orderkey % 9
 WHEN 0 THEN 'https://www.LinkedIn.com/jobs/view/' || o_orderkey || '/?trk=x'
 WHEN 1 THEN 'https://www.indeed.com/rc/clk?jk=a+' || o_orderkey || '&from=serp'
 WHEN 2 THEN 'https://www.google.com/search?q=x&docid=' || o_orderkey || '%3D%3D'
 WHEN 3 THEN 'https://www.google.com/search?q=jobs#vhid=abc%2Fdocid%3D' || o_orderkey
 WHEN 4 THEN '  https://wellfound.com:443/jobs/' || o_orderkey || '-role?ref=a#top '
 WHEN 5 THEN 'http://jobs.ashbyhq.com:8080/acme/12345' || o_orderkey
 WHEN 6 THEN 'https://linkedin.com/jobs/search-results/?currentJobId=' || o_orderkey
 WHEN 7 THEN 'https://example.org?x=' || o_orderkey
 ELSE 'not a url ' || o_orderkey END AS url FROM orders""",
)
k.cte(
    "b_link_parts", "b_link",
    r"""SELECT *, regexp_matches(u, '^(?i)https?://[^/?#:@\s]+(:\d*)?([/?#].*)?$') AS ok,
  lower(regexp_extract(u, '^(?i)https?://([^/?#:@\s]+)', 1)) AS host,
  regexp_extract(u, '^(?i)https?://[^/?#]+([^?#]*)', 1) AS path0,
  regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(u, '^[^#]*#(.*)$', 1) AS frag
FROM (SELECT *, trim(url) AS u FROM b_link)""",
)
k.cte(
    "b_link_ids", "b_link_parts",
    r"""SELECT *,
  CASE WHEN ok AND regexp_extract(path0, '(?i)/jobs/view/(\d+)', 1) <> '' THEN regexp_extract(path0, '(?i)/jobs/view/(\d+)', 1)
       WHEN ok THEN regexp_extract(query, '(?:^|&)currentJobId=(\d+)(?:&|$)', 1) ELSE '' END AS linkedin_id,
  CASE WHEN host LIKE '%indeed.com' THEN replace(regexp_extract(query, '(?:^|&)jk=([^&]*)', 1), '+', ' ') ELSE '' END AS indeed_id,
  CASE WHEN host LIKE '%google.com' THEN
    CASE WHEN regexp_extract(query, '(?:^|&)docid=([^&]*)', 1) <> '' THEN url_decode(regexp_extract(query, '(?:^|&)docid=([^&]*)', 1))
         ELSE regexp_extract(url_decode(frag), 'docid=([^&/]+)', 1) END ELSE '' END AS google_id
FROM b_link_parts""",
)


@query(
    "q_external_id",
    sql(
        "b_link_ids",
        r"""SELECT link_id, linkedin_id, indeed_id, google_id,
  regexp_extract(path0, '(?i)/jobs/(\d+)', 1) AS wellfound_id,
  regexp_extract(u, '(?i)/([a-f0-9]{24,}|[0-9]{5,})(?:[/?#]|$)', 1) AS ashby_id,
  CASE source_type WHEN 'linkedin_capture_file' THEN nullif(linkedin_id, '') WHEN 'indeed_search' THEN nullif(indeed_id, '')
       WHEN 'google_search' THEN nullif(google_id, '') END AS inferred_id
FROM b_link_ids""",
    ),
)
def q_external_id(spark, sf):
    u = F.col("_u")
    return url.with_board_ids(url.with_url(_links(spark, sf), F.col("url"))).select(
        "link_id",
        F.col("_u_linkedin").alias("linkedin_id"),
        F.col("_u_indeed").alias("indeed_id"),
        F.col("_u_google").alias("google_id"),
        url.wellfound_id(u).alias("wellfound_id"),
        url.ashby_id(u).alias("ashby_id"),
        url.infer_external_id(F.lit(None).cast("string"), F.col("source_type")).alias(
            "inferred_id"
        ),
    )


@query(
    "q_canonical_url",
    sql(
        "b_link_ids",
        r"""SELECT link_id, CASE WHEN NOT ok THEN u
  WHEN host LIKE '%linkedin.com' AND linkedin_id <> '' THEN 'https://www.linkedin.com/jobs/view/' || linkedin_id || '/'
  WHEN indeed_id <> '' THEN 'https://www.indeed.com/viewjob?jk=' || replace(indeed_id, ' ', '%20')
  WHEN google_id <> '' THEN 'https://www.google.com/search?docid=' || replace(google_id, '=', '%3D')
  ELSE lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) || '://' || host
    || CASE WHEN u LIKE '%:8080/%' THEN ':8080' ELSE '' END
    || CASE WHEN path0 = '' THEN '/' ELSE path0 END END AS canonical_url
FROM b_link_ids""",
    ),
)
def q_canonical_url(spark, sf):
    return url.with_board_ids(url.with_url(_links(spark, sf), F.col("url"))).select(
        "link_id", url.canonical_url().alias("canonical_url")
    )


# ---- identity ----------------------------------------------------------------------

k.cte(
    "b_ident", "b_raw",
    rf"""SELECT * EXCLUDE (id_key, seed), sha256(source_id || '|' || id_key) AS id, sha256(seed) AS normalized_hash
FROM (SELECT *, coalesce('external:' || external_id, canonical) AS id_key,
  CASE WHEN source_type = 'linkedin_capture_file' THEN 'linkedin:' || lower({k.ws('company')}) || '|' || lower({k.ws('title')})
       WHEN external_id IS NOT NULL THEN source_type || ':external:' || lower(external_id)
       ELSE 'url:' || lower(canonical) END AS seed
 FROM (SELECT *, regexp_replace(url, '[?#].*$', '') AS canonical FROM b_raw))""",
)


@query(
    "q_identity",
    sql("b_ident", "SELECT pos, id, normalized_hash, external_id, canonical AS source_url, company, location FROM b_ident"),
)
def q_identity(spark, sf):
    from postmill.operators.identity import with_identity

    return with_identity(b.b_raw(spark, sf)).select(
        "pos", "id", "normalized_hash", "external_id", "source_url", "company", "location"
    )


# ---- dates -------------------------------------------------------------------------

k.cte(
    "b_when", "b_raw",
    r"""SELECT pos, seen_at, CASE n % 9
  WHEN 0 THEN strftime(seen_at, '%Y-%m-%dT%H:%M:%S.000Z') WHEN 1 THEN strftime(seen_at, '%b %-d, %Y')
  WHEN 2 THEN 'Posted on ' || strftime(seen_at, '%B %-d, %Y') WHEN 3 THEN strftime(seen_at, '%m/%d/%Y')
  WHEN 4 THEN (n % 40) || ' days ago' WHEN 5 THEN (n % 7 + 1) || CASE WHEN n % 7 = 0 THEN ' Month ago' ELSE ' months ago' END
  WHEN 6 THEN (n % 90) || ' hours  ago' WHEN 7 THEN CASE WHEN n % 2 = 0 THEN 'Today' ELSE ' yesterday' END
  ELSE CASE WHEN n % 2 = 0 THEN 'soon' END END AS posted_text
FROM (SELECT *, CAST(substring(pos, 10, 12) AS BIGINT) AS n FROM b_raw)""",
)


def _when(spark, sf):
    n, seen = F.col("n"), F.col("seen_at")
    m = n % 9
    shape = (
        F.when(m == 0, F.date_format(seen, "yyyy-MM-dd'T'HH:mm:ss.'000Z'"))
        .when(m == 1, F.date_format(seen, "MMM d, yyyy"))
        .when(m == 2, F.concat(F.lit("Posted on "), F.date_format(seen, "MMMM d, yyyy")))
        .when(m == 3, F.date_format(seen, "MM/dd/yyyy"))
        .when(m == 4, F.concat((n % 40).cast("string"), F.lit(" days ago")))
        .when(
            m == 5,
            F.concat(
                (n % 7 + 1).cast("string"),
                F.when(n % 7 == 0, " Month ago").otherwise(" months ago"),
            ),
        )
        .when(m == 6, F.concat((n % 90).cast("string"), F.lit(" hours  ago")))
        .when(m == 7, F.when(n % 2 == 0, "Today").otherwise(" yesterday"))
        .otherwise(F.when(n % 2 == 0, "soon"))
    )
    raw = b.b_raw(spark, sf).select("pos", "seen_at")
    return raw.withColumn("n", F.substring("pos", 10, 12).cast("bigint")).select(
        "pos", "seen_at", shape.alias("posted_text")
    )


_REL = r"^(\d+) (hour|day|week|month|year)s? ago$"
_A = f"CAST('{b.AS_OF_RAW}' AS TIMESTAMP)"
k.cte(
    "b_when_ts", "b_when",
    rf"""SELECT *, CASE WHEN regexp_matches(t, '^\d{{4}}-') THEN CAST(replace(replace(t, 't', ' '), 'z', '') AS TIMESTAMP)
  WHEN regexp_matches(t, '^\d+/') THEN strptime(t, '%m/%d/%Y')
  WHEN regexp_matches(t, '^[a-z]+ \d+, \d+$') AND length(split_part(t, ' ', 1)) = 3 THEN strptime(t, '%b %d, %Y')
  WHEN regexp_matches(t, '^[a-z]+ \d+, \d+$') THEN strptime(t, '%B %d, %Y')
  WHEN u = 'hour' THEN {_A} - to_hours(n) WHEN u = 'day' THEN {_A} - to_days(n) WHEN u = 'month' THEN {_A} - to_months(n)
  WHEN t = 'today' THEN {_A} WHEN t = 'yesterday' THEN {_A} - to_days(1) END AS posted_ts,
 CASE u WHEN 'hour' THEN CAST(floor(n / 24) AS BIGINT) WHEN 'day' THEN n WHEN 'month' THEN n * 30 ELSE
  CASE t WHEN 'today' THEN 0 WHEN 'yesterday' THEN 1 END END AS rel
FROM (SELECT pos, t, TRY_CAST(regexp_extract(t, '{_REL}', 1) AS INT) AS n, regexp_extract(t, '{_REL}', 2) AS u
 FROM (SELECT pos, regexp_replace({k.ltext('posted_text')}, '^posted on\s+', '') AS t FROM b_when))""",
)


@query(
    "q_posted_at",
    sql(
        "b_when_ts",
        f"""SELECT pos, {k.iso('posted_ts')} AS posted_ts,
 CASE WHEN posted_ts IS NULL THEN rel ELSE greatest(0, {k.days('posted_ts', b.AS_OF_RAW)}) END AS relative_days
FROM b_when_ts""",
    ),
)
def q_posted_at(spark, sf):
    dated = dates.with_posted(_when(spark, sf), F.col("posted_text"), b.ts(b.AS_OF_RAW))
    return dated.select("pos", iso(F.col("posted_ts")).alias("posted_ts"), "relative_days")


@query(
    "q_freshness",
    sql(
        "b_posting",
        f"""SELECT id, fd AS freshness_days, CAST(CASE WHEN fd IS NULL THEN 0 WHEN fd <= 3 THEN 10 WHEN fd <= 7 THEN 6 WHEN fd <= 14 THEN 2
  WHEN fd <= 30 THEN -4 WHEN fd <= 45 THEN -8 ELSE -12 END AS INT) AS points
FROM (SELECT id, CASE WHEN d >= 0 THEN d END AS fd FROM
 (SELECT id, {k.days('posted_at', '2001-07-20 00:00:00')} AS d FROM b_posting))""",
    ),
)
def q_freshness(spark, sf):
    # A clock inside the data, so that future postings occur too.
    days = dates.freshness_days(F.col("posted_at"), F.col("updated_at"), b.ts("2001-07-20 00:00:00"))
    return b.b_posting(spark, sf).select(
        "id", days.alias("freshness_days"), dates.freshness_points(days).cast("int").alias("points")
    )


# ---- salary ------------------------------------------------------------------------

k.cte(
    "b_pay", "b_raw",
    r"""SELECT pos, CASE n % 6 WHEN 0 THEN salary_text
  WHEN 1 THEN '$' || (n % 300) || 'k - $' || (n % 300 + 40) || 'K per year'
  WHEN 2 THEN '$' || (n % 400 + 1) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') || '-' || (n % 9) || '.5m'
  WHEN 3 THEN 'from 1.234.567 or ' || (n % 90) WHEN 4 THEN 'competitive' ELSE '' END AS pay
FROM (SELECT *, CAST(substring(pos, 10, 12) AS BIGINT) AS n FROM b_raw)""",
)


def _pay(spark, sf):
    n = F.col("n")
    s = lambda c: c.cast("string")
    m = n % 6
    shape = (
        F.when(m == 0, F.col("salary_text"))
        .when(m == 1, F.concat(F.lit("$"), s(n % 300), F.lit("k - $"), s(n % 300 + 40), F.lit("K per year")))
        .when(m == 2, F.concat(F.lit("$"), s(n % 400 + 1), F.lit(","), F.lpad(s(n % 1000), 3, "0"),
                               F.lit("-"), s(n % 9), F.lit(".5m")))
        .when(m == 3, F.concat(F.lit("from 1.234.567 or "), s(n % 90)))
        .when(m == 4, F.lit("competitive"))
        .otherwise(F.lit(""))
    )
    return (
        b.b_raw(spark, sf).select("pos", "salary_text")
        .withColumn("n", F.substring("pos", 10, 12).cast("bigint"))
        .select("pos", shape.alias("pay"))
    )


_RANGE = (
    "list_filter(list_transform(regexp_extract_all(coalesce(pay, ''), '" + salary.RANGE_PATTERN + "'), "
    "lambda p: CAST(floor(TRY_CAST(regexp_replace(p, '[^0-9.]', '', 'g') AS DOUBLE) * "
    "CASE WHEN lower(p) LIKE '%k' THEN 1000 WHEN lower(p) LIKE '%m' THEN 1000000 ELSE 1 END + 0.5) AS BIGINT)), lambda v: v > 0)"
)
_MAX = (
    "coalesce(list_max(list_filter(list_transform(regexp_extract_all(lower(coalesce(pay, '')), '"
    + salary.MAX_PATTERN
    + "'), lambda p: TRY_CAST(regexp_replace(p, '[,\\sk]', '', 'g') AS DOUBLE) * CASE WHEN p LIKE '%k' THEN 1000 ELSE 1 END), "
    "lambda v: v > 0)), 0.0)"
)


@query(
    "q_salary",
    sql(
        "b_pay",
        rf"""SELECT pos, list_min({_RANGE}) AS min_annual_usd, list_max({_RANGE}) AS max_annual_usd,
  CASE WHEN f < 1000 THEN f * 1000 ELSE f END AS salary_floor, {_MAX} AS salary_max
FROM (SELECT *, TRY_CAST(regexp_replace(regexp_extract(pay, '\$?(\d{{2,3}})(?:,\d{{3}})?', 0), '[^0-9]', '', 'g') AS BIGINT) AS f FROM b_pay)""",
    ),
)
def q_salary(spark, sf):
    r = salary.salary_range(text(F.col("pay")))
    return _pay(spark, sf).withColumn("r", r).select(
        "pos",
        F.col("r.annual_usd.lo").alias("min_annual_usd"),
        F.col("r.annual_usd.hi").alias("max_annual_usd"),
        salary.salary_floor(F.col("pay")).alias("salary_floor"),
        salary.salary_max(F.col("pay")).cast("double").alias("salary_max"),
    )


@query(
    "q_salary_bucket",
    sql(
        "b_posting",
        "SELECT salary_bucket, count(*) AS n FROM (SELECT CASE WHEN v > 0 THEN CASE "
        + " ".join(f"WHEN v <= {t} THEN '{c}'" for t, c in salary.SALARY_STEPS)
        + " ELSE '9' END END AS salary_bucket FROM (SELECT TRY_CAST(substring(salary_text, 2) AS BIGINT) AS v FROM b_posting)) GROUP BY 1",
    ),
)
def q_salary_bucket(spark, sf):
    amount = salary.salary_max(F.col("salary_text"))
    return (
        b.b_posting(spark, sf)
        .select(salary.salary_bucket(amount).alias("salary_bucket"))
        .groupBy("salary_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- features and terms ------------------------------------------------------------

_AI = r"\b(ai|a\.i\.|genai|gen ai|llm|ml|machine learning|artificial intelligence)\b"


def _sql_list(names, hay):
    return "array_to_string(list_filter([" + ", ".join(k.q(n) for n in names) + f"], lambda t: contains({hay}, t)), ',')"


def _sql_work_types(hay):
    parts = [
        "CASE WHEN " + " OR ".join(f"contains({hay}, {k.q(t)})" for t in ts) + f" THEN '{kind}' END"
        for kind, ts in terms.WORK_TYPES.items()
    ]
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda t: t IS NOT NULL), ',')"


@query(
    "q_text_features",
    sql(
        "b_doc",
        rf"""SELECT doc_id, CASE WHEN regexp_matches(h, '\bhybrid\b') THEN 'hybrid' WHEN regexp_matches(h, '\bremote\b') THEN 'remote'
  WHEN regexp_matches(h, '\bon[\s-]?site\b|\bin[\s-]?office\b') THEN 'on-site' END AS work_model,
  {_sql_list(terms.SKILLS, 'd')} AS skills, {_sql_list(terms.SENIORITY, 'd')} AS seniority, {_sql_work_types('d')} AS work_types
FROM (SELECT doc_id, {k.ltext('description')} AS d, lower({k.text('location')} || ' ' || {k.text('description')}) AS h FROM b_doc)""",
    ),
)
def q_text_features(spark, sf):
    d, h = F.col("d"), F.col("h")
    staged = (
        b.b_doc(spark, sf)
        .select("doc_id", text(F.col("location")).alias("l"), lower_text(F.col("description")).alias("d"))
        .withColumn("h", F.concat_ws(" ", F.lower("l"), "d"))
    )
    return staged.select(
        "doc_id",
        terms.work_model(h).alias("work_model"),
        F.array_join(terms.top_skills(d), ",").alias("skills"),
        F.array_join(terms.seniority_terms(d), ",").alias("seniority"),
        F.array_join(terms.work_types(d), ",").alias("work_types"),
    )


_QUOTED = "title || ' AND ' || coalesce(location, '') || '; Sand, ' || company || ',' || upper(company)"


@query(
    "q_terms",
    sql(
        "b_raw",
        rf"""SELECT pos, array_to_string(split_terms, '/') AS split_terms, array_to_string(comma_terms, '/') AS comma_terms,
  (SELECT string_agg(t, '/' ORDER BY i) FROM (SELECT t, min(i) AS i FROM
     (SELECT unnest(list_concat(split_terms, comma_terms)) AS t, generate_subscripts(list_concat(split_terms, comma_terms), 1) AS i) GROUP BY t)) AS merged
FROM (SELECT pos,
  list_filter(list_transform(string_split(regexp_replace(replace(c, ';', ','), '(?i)\band\b', ',', 'g'), ','), lambda t: lower({k.ws('t')})), lambda t: t <> '') AS split_terms,
  [t for t in [lower(trim(c1)), lower(trim(c2))] if t <> ''] AS comma_terms
 FROM (SELECT pos, c, split_part(c, ',', 1) AS c1, split_part(c, ',', 2) AS c2 FROM (SELECT pos, {_QUOTED} AS c FROM b_raw)))""",
    ),
)
def q_terms(spark, sf):
    c = F.concat(
        F.col("title"), F.lit(" AND "), F.coalesce("location", F.lit("")), F.lit("; Sand, "),
        F.col("company"), F.lit(","), F.upper("company"),
    )
    staged = b.b_raw(spark, sf).select(
        "pos", terms.split_terms(c).alias("s"), terms.comma_terms(c).alias("m")
    )
    return staged.select(
        "pos",
        F.array_join("s", "/").alias("split_terms"),
        F.array_join("m", "/").alias("comma_terms"),
        F.array_join(F.array_distinct(F.concat("s", "m")), "/").alias("merged"),
    )


_MATCH_TERMS = ["ai", "product manager", "the", "und", "eau", "theand"]


@query(
    "q_term_match",
    sql(
        "b_doc",
        rf"""SELECT doc_id, CAST(regexp_matches(h, '{_AI}') AS INT) AS m_ai,
  CAST(regexp_matches(h, '\bproduct manager\b|\bpm\b') AS INT) AS m_pm, CAST(contains(h, 'the') AS INT) AS m_the,
  {_sql_list(_MATCH_TERMS, 'h')} AS plain_hits,
  list_filter(['product manager', 'theand', 'the', 'und', 'eau', 'ai'], lambda t: contains(h, t))[1] AS strongest
FROM (SELECT doc_id, {k.ltext('description')} AS h FROM b_doc)""",
    ),
)
def q_term_match(spark, sf):
    h = F.col("h")
    return b.b_doc(spark, sf).select("doc_id", lower_text(F.col("description")).alias("h")).select(
        "doc_id",
        terms.term_matches("ai", h).cast("int").alias("m_ai"),
        terms.term_matches("product manager", h).cast("int").alias("m_pm"),
        terms.term_matches("the", h).cast("int").alias("m_the"),
        F.array_join(terms.matched_literals(_MATCH_TERMS, h), ",").alias("plain_hits"),
        terms.strongest(_MATCH_TERMS, h).alias("strongest"),
    )


@query(
    "q_meta_quality",
    sql(
        "b_ident",
        """SELECT pos, array_to_string(m, ',') AS missing, CAST(floor((6 - len(m)) / 6 * 100 + 0.5) AS BIGINT) AS quality
FROM (SELECT pos, list_filter([CASE WHEN location IS NULL THEN 'location' END, CASE WHEN salary_text IS NULL THEN 'salary' END,
  CASE WHEN posted_at IS NULL THEN 'freshness' END, CASE WHEN employment_type IS NULL THEN 'employmentType' END], lambda t: t IS NOT NULL) AS m FROM b_ident)""",
    ),
)
def q_meta_quality(spark, sf):
    missing = missing_fields(*[text(F.col(c)) for c in ("location", "salary_text", "posted_at", "employment_type")])
    return b.b_raw(spark, sf).withColumn("m", missing).select(
        "pos", F.array_join("m", ",").alias("missing"), quality_score(F.col("m")).alias("quality")
    )


@query(
    "q_structured_meta",
    sql(
        "b_ident",
        f"""SELECT pos, coalesce(location, 'unknown') AS meta_location, {k.days('seen_at', b.AS_OF_RAW)} AS meta_days,
  TRY_CAST(substring(salary_text, 2) AS BIGINT) AS meta_min, TRY_CAST(substring(salary_text, 2) AS BIGINT) AS meta_max,
  coalesce(salary_text, 'unknown') AS meta_salary, coalesce(employment_type, 'unknown') AS meta_employment, id,
  {k.ws('description')} AS description FROM b_ident""",
    ),
)
def q_structured_meta(spark, sf):
    m = F.col("structured_meta")
    return normalize_postings(b.b_raw(spark, sf), b.ts(b.AS_OF_RAW)).select(
        "pos", "id", "description",
        m["location"].alias("meta_location"),
        m["freshness"]["relative_days"].alias("meta_days"),
        m["salary"]["annual_usd"]["lo"].alias("meta_min"),
        m["salary"]["annual_usd"]["hi"].alias("meta_max"),
        m["salary"]["raw_text"].alias("meta_salary"),
        m["employment_type"].alias("meta_employment"),
    )


# ---- rows that describe sources, users and events ---------------------------------------


@query(
    "q_required_terms",
    sql(
        "",
        rf"""SELECT p_partkey, array_to_string(CASE WHEN x <> '' THEN [lower(x)] ELSE list_distinct_ordered END, ',') AS required_terms
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '' END AS x,
  list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'product manager' WHEN p_partkey % 3 = 1 THEN 'program manager' END,
               CASE WHEN p_partkey % 2 = 0 THEN 'ai' END], lambda t: t IS NOT NULL) AS list_distinct_ordered FROM part)""",
    ),
)
def q_required_terms(spark, sf):
    key = F.col("p_partkey")
    role = (
        F.when(key % 3 == 0, "Product+Manager").when(key % 3 == 1, "program%20%20management")
        .otherwise("products+managers")
    )
    search = F.concat(
        F.lit("https://www.linkedin.com/jobs/search/?f=1&keywords="), role, F.lit("&search="),
        F.regexp_replace("p_name", " ", "+"),
    )
    name = F.concat_ws(" ", "p_name", F.when(key % 2 == 0, "Gen AI roles").otherwise("retail aim"))
    none = F.array().cast("array<string>")
    return b.table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(
            profiles.required_terms(
                none, F.array(F.when(key % 5 == 0, F.upper("p_name")).otherwise("")),
                F.lit(None).cast("string"), search, name,
            ), ",",
        ).alias("required_terms"),
    )


@query(
    "q_goals_profile",
    sql(
        "",
        """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'product manager' ELSE lower(c_mktsegment) END AS target_titles,
  CASE WHEN c_custkey % 4 = 0 THEN 'anywhere' ELSE 'nation_' || c_nationkey END AS target_locations,
  CASE c_custkey % 5 WHEN 0 THEN 'remote_only' WHEN 1 THEN 'remote_friendly' WHEN 2 THEN 'remote_friendly' ELSE 'onsite_ok' END AS remote_preference,
  CASE WHEN c_acctbal > 5000 THEN CAST(floor(c_acctbal) AS BIGINT) WHEN c_custkey % 2 = 0 THEN 1000 ELSE 500 END AS salary_floor,
  CASE WHEN c_custkey % 2 = 0 THEN 'b2b,saas' ELSE 'saas,b2b' END AS include_keywords FROM customer""",
    ),
)
def q_goals_profile(spark, sf):
    key = F.col("c_custkey")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    goals = b.table(spark, sf, "customer").select(
        key.alias("user_id"),
        F.when(key % 3 != 0, F.array(F.lower("c_mktsegment"))).otherwise(none).alias("target_titles"),
        F.when(key % 4 != 0, F.array(F.concat(F.lit("nation_"), F.col("c_nationkey")))).otherwise(none)
        .alias("preferred_cities"),
        F.when(key % 5 == 0, arr("Remote")).when(key % 5 == 1, arr("remote", "hybrid"))
        .when(key % 5 == 2, arr("onsite", "remote")).when(key % 5 == 3, arr("hybrid")).otherwise(none)
        .alias("work_type"),
        F.when(F.col("c_acctbal") > 5000, F.floor("c_acctbal")).alias("deal_salary_minimum"),
        F.when(key % 2 == 0, F.lit(1000)).alias("minimum_salary"),
        F.when(key % 2 == 0, arr("b2b", "saas")).otherwise(arr("saas")).alias("include_keywords"),
        arr("saas", "b2b").alias("business_models"),
        arr("product manager").alias("fb_target_titles"),
        arr("anywhere").alias("fb_target_locations"),
        F.lit(500).alias("fb_salary_floor"),
        none.alias("fb_include_keywords"),
    )
    p = profiles.profiles_from_goals(goals)
    return p.select(
        "user_id", "remote_preference", "salary_floor",
        *[F.array_join(c, ",").alias(c) for c in ("target_titles", "target_locations", "include_keywords")],
    )


@query(
    "q_effective_criteria",
    sql(
        "",
        """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'product manager' END AS title,
 CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal) AS BIGINT) ELSE 150000 END AS min_salary, '1w' AS date_posted FROM supplier""",
    ),
)
def q_effective_criteria(spark, sf):
    own = b.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("title"),
        F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal")).alias("min_salary"),
        F.lit(None).cast("string").alias("date_posted"),
    )
    return profiles.effective_criteria(
        own, {"title": "product manager", "min_salary": 150000, "date_posted": "1w"},
        ["title", "min_salary", "date_posted"],
    )


@query(
    "q_event_envelope",
    sql(
        "b_event",
        """SELECT event_id, event, CASE WHEN lower(trim(channel)) IN ('terminal', 'dashboard', 'codex', 'claude') THEN lower(trim(channel)) ELSE 'terminal' END AS channel,
 'machine_hash' AS identity_mode,
 CASE WHEN event_id % 4 = 0 THEN 'machine:' || substring(sha256('host-' || distinct_id), 1, 16) ELSE distinct_id END AS distinct_id, props AS properties
FROM b_event WHERE event IN ('signup', 'click', 'view')""",
    ),
)
def q_event_envelope(spark, sf):
    known = b.values(spark, "event", "('signup'), ('click'), ('view')")
    events = b.b_event(spark, sf).withColumns(
        {
            "host": F.concat(F.lit(" HOST-"), F.col("distinct_id")),
            "distinct_id": F.when(F.col("event_id") % 4 != 0, F.col("distinct_id")),
        }
    )
    return profiles.event_envelopes(events, known).drop("occurred_at")


@query(
    "q_json_tolerant",
    sql(
        "b_event",
        r"""SELECT event_id, CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT) AS k,
 CASE event_id % 4 WHEN 0 THEN event || '/k' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '' END AS reasons FROM b_event""",
    ),
)
def q_json_tolerant(spark, sf):
    from postmill.functions.jsontext import parse_reasons

    m = F.col("event_id") % 4
    raw = (
        F.when(m == 0, F.concat(F.lit('["'), F.col("event"), F.lit('", "  ", "k"]')))
        .when(m == 1, F.lit('["broken'))
        .when(m == 2, F.col("props"))
    )
    return b.b_event(spark, sf).select(
        "event_id",
        F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"),
        F.array_join(parse_reasons(raw), "/").alias("reasons"),
    )

