"""Read side: joined lists, groups of duplicates, facets, rollups and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postmill.functions.core import half_up, lower_text, nonempty
from postmill.functions.dates import POSTED_WINDOWS, in_posted_window
from postmill.functions.url import encode_component
from postmill.operators.filters import VIEWS, view_predicate
from postmill.operators.settle import settle
from postmill.operators.skew import cumulative, first_per_key, top_n_per_key
from postmill.params import BUCKETS, SOURCE_KINDS, STATUSES

# ---- joined lists ----------------------------------------------------------------------


def normalize_status(c: Column) -> Column:
    return (
        F.when(c.isin("reviewed", "drafted"), "viewed")
        .when(c.isin("applied", "rejected", "viewed", "skip_for_now"), c)
        .otherwise("new")
    )


def join_status(postings: DataFrame, evaluations: DataFrame, applications: DataFrame) -> DataFrame:
    """Postings with their evaluation and status; both sides are unique per posting."""
    e = evaluations.withColumnRenamed("job_id", "id")
    a = applications.select(
        F.col("job_id").alias("id"), F.col("status").alias("_status"), "notes", "last_action_at"
    )
    joined = postings.join(e, "id", "left").join(a, "id", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("_status", F.lit("new")),
            "notes": F.coalesce("notes", F.lit("")),
        }
    ).drop("_status")


def top_jobs(joined: DataFrame, n: int) -> DataFrame:
    """Best n by score, then posting date; a top-k, never a full sort."""
    return joined.orderBy(
        F.coalesce("score", F.lit(-1)).desc(),
        F.coalesce("posted_at", "created_at").desc(),
        F.col("id"),
    ).limit(n)


def recent_jobs(joined: DataFrame, n: int) -> DataFrame:
    """Newest n by posting date, else creation; then by creation and id."""
    return joined.orderBy(F.coalesce("posted_at", "created_at").desc(), F.col("created_at").desc(), F.col("id")).limit(n)


def recent_actions(joined: DataFrame, n: int) -> DataFrame:
    """The n postings acted on last, those never acted on by creation; then by id."""
    return joined.orderBy(F.coalesce("last_action_at", "created_at").desc(), F.col("id")).limit(n)


def review_target(url: Column, external_id: Column, title: Column, company: Column) -> Column:
    """struct(url, mode): where a reviewer is sent, directly or through a search."""
    u = F.coalesce(url, F.lit(""))
    query = F.concat_ws(" ", nonempty(title), nonempty(company))
    search = F.concat(
        F.lit("https://www.linkedin.com/jobs/search-results/?keywords="),
        F.replace(encode_component(query), F.lit("%20"), F.lit("+")),
    )
    view = r"(?i)^https://www\.linkedin\.com/jobs/view/\d+/?$"
    opened = u.startswith("https://www.linkedin.com/jobs/search-results/")
    direct_view = u.rlike(view)
    numeric = F.coalesce(external_id, F.lit("")).rlike(r"^\d+$")
    other_view = u.startswith("https://www.linkedin.com/jobs/view/")
    target = (
        F.when(opened | direct_view, u)
        .when(
            numeric,
            F.concat(F.lit("https://www.linkedin.com/jobs/view/"), external_id, F.lit("/")),
        )
        .when(other_view | (u == ""), search)
        .otherwise(u)
    )
    mode = (
        F.when(opened, "search")
        .when(direct_view | numeric, "direct")
        .when(other_view | (u == ""), "search")
        .otherwise("direct")
    )
    return F.struct(target.alias("url"), mode.alias("mode"))


# ---- groups ----------------------------------------------------------------------------

# The status a group takes, strongest first.
STATUS_RANK = ["applied", "rejected", "skip_for_now", "viewed", "new"]


HEAD = [
    "primary_job_id", "title", "company", "location", "posted_at", "updated_at",
    "salary_text", "score", "bucket", "summary", "confidence", "normalized_hash",
]


def group_postings(joined: DataFrame, include_rejected: bool = True, columns: list[str] | None = None) -> DataFrame:
    """One row per duplicate group, newest member first.

    Two aggregations: members that share group, source and reasons are folded before the
    exchange, then the few folded rows of a group are put in first-seen order. The arrays
    are bounded by the number of sources and of distinct reason lists, not by group size.
    Only the ``columns`` asked for (all by default) are folded and exchanged; the rows are the same.
    """
    wanted = lambda c: columns is None or c in columns
    heads = [c for c in HEAD if wanted(c)] or ["primary_job_id"]
    status = normalize_status(F.col("status"))
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_RANK]), status)
    rows = joined.withColumns(
        {
            "_group": F.coalesce(nonempty(F.col("normalized_hash")), F.col("id")),
            "_ord": F.struct(
                (-F.unix_micros(F.coalesce("last_action_at", "created_at"))).alias("t"),
                F.col("id").alias("i"),
            ),
            "_rank": rank,
            "_note": nonempty(F.trim("notes")),
            "_target": review_target(
                F.col("source_url"), F.col("external_id"), F.col("title"), F.col("company")
            ),
        }
    )
    head = F.struct(
        *[F.col("id").alias(c) if c == "primary_job_id" else F.col(c) for c in heads],
        *(["_target"] if wanted("review_target") else []),
    )
    direct = F.when(F.col("_target.mode") == "direct", F.col("_ord"))
    noted = F.when(F.col("_note").isNotNull(), F.col("_ord"))
    # Without the reasons of a group, members of a source need not be told apart by theirs.
    parts = ["source_id", "reasons"] if wanted("reasons") else ["source_id"]
    folded = rows.groupBy("_group", *parts).agg(
        F.min("_ord").alias("o"),
        F.min_by(head, "_ord").alias("h"),
        F.min("_rank").alias("r"),
        F.count(F.lit(1)).alias("n"),
        F.min(noted).alias("no"),
        F.min_by("_note", noted).alias("nv"),
        F.min(direct).alias("do"),
        F.min_by("_target", direct).alias("dv"),
    )
    seen = F.struct("o", *parts)
    groups = folded.groupBy("_group").agg(
        F.min_by("h", "o").alias("h"),
        F.min("r").alias("r"),
        F.sum("n").alias("duplicate_count"),
        F.min_by("nv", "no").alias("notes"),
        F.min_by("dv", "do").alias("dv"),
        F.array_sort(F.collect_list(seen)).alias("seen"),
    )
    ordered = F.col("seen")
    out = {
        "id": F.col("_group"),
        **{c: F.col(f"h.{c}") for c in heads},
        "status": F.element_at(F.array(*[F.lit(s) for s in STATUS_RANK]), F.col("r").cast("int")),
        "notes": F.coalesce("notes", F.lit("")),
        "review_target": F.coalesce("dv", "h._target") if wanted("review_target") else None,
        "duplicate_count": F.col("duplicate_count"),
        "source_ids": F.array_distinct(
            F.filter(F.transform(ordered, lambda x: x["source_id"]), lambda s: s.isNotNull())
        ),
        "reasons": F.array_distinct(
            F.flatten(
                F.filter(F.transform(ordered, lambda x: x["reasons"]), lambda a: a.isNotNull())
            )
        ) if wanted("reasons") else None,
    }
    if not include_rejected:
        groups = groups.filter(out["status"] != "rejected")
    return groups.select(*[value.alias(c) for c, value in out.items() if wanted(c)])


def top_groups(scored: DataFrame, n: int) -> DataFrame:
    """Best ``n`` groups by score, then posting date; sources of a group are a bounded set."""
    # Nulls come first in a struct: an unscored or undated member must not stand for its group.
    last = F.lit(-(1 << 62)).cast("bigint")
    dated = F.coalesce(F.unix_micros("posted_at"), last)
    order = F.struct(-F.coalesce(F.col("score"), F.lit(-1)), -dated, F.col("pos"))
    row = F.struct("title", "company", "score", "bucket", "posted_at")
    grouped = scored.groupBy("normalized_hash").agg(
        F.min_by(row, order).alias("r"),
        F.count(F.lit(1)).alias("duplicate_count"),
        F.collect_set("source_id").alias("source_ids"),
    )
    flat = grouped.select("normalized_hash", "r.*", "duplicate_count", "source_ids")
    return flat.orderBy(
        F.col("score").desc(), F.col("posted_at").desc(), F.col("normalized_hash")
    ).limit(n)


def union_queues(queues: list[DataFrame]) -> DataFrame:
    """Queues one after another, the first row per id kept."""
    ranked = [q.withColumn("_q", F.lit(i)) for i, q in enumerate(queues)]
    return first_per_key(reduce(DataFrame.unionByName, ranked), ["id"], F.col("_q")).drop("_q")


# ---- counts ------------------------------------------------------------------------------

def unpivot_counts(one: DataFrame, names: list[str], label: str) -> DataFrame:
    """One wide row of counts -> one row per name; names without rows stay with zero."""
    pairs = [x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]
    return one.select(F.stack(F.lit(len(names)), *pairs).alias(label, "n"))


def bucket_counts(evaluations: DataFrame) -> DataFrame:
    one = evaluations.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    return unpivot_counts(one, BUCKETS, "bucket")


def status_counts(joined: DataFrame) -> DataFrame:
    one = joined.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return unpivot_counts(one, STATUSES, "status")


def view_counts(groups: DataFrame, scope: str = "active") -> DataFrame:
    one = groups.agg(*[F.count_if(view_predicate(v, scope)).alias(v) for v in VIEWS])
    return unpivot_counts(one, VIEWS, "view")


def view_queues(groups: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The four status queues, each cut to its first ``limit`` rows."""
    queue = (
        F.when(F.col("status").isin("new", "viewed"), "queue")
        .when(F.col("status") == "applied", "applied")
        .when(F.col("status") == "skip_for_now", "skipped")
        .otherwise("rejected")
    )
    return top_n_per_key(groups.withColumn("queue", queue), ["queue"], order, limit)


def last_seen(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source_id").agg(F.max("updated_at").alias("last_seen_at"))


def source_rollup(groups: DataFrame) -> DataFrame:
    """Counts and score sums per source over the sources of each group."""
    s = F.col("status")
    return (
        groups.select("status", "bucket", "score", F.explode("source_ids").alias("source_id"))
        .groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count_if(s.isin("new", "viewed")).alias("active_count"),
            F.count_if(s == "applied").alias("applied_count"),
            F.count_if(s == "skip_for_now").alias("skipped_count"),
            F.count_if(s == "rejected").alias("rejected_count"),
            F.count_if(F.col("bucket") == "high_signal").alias("high_signal_count"),
            F.count("score").alias("scored_count"),
            F.coalesce(F.sum("score"), F.lit(0)).alias("score_total"),
        )
    )


def source_average(groups: DataFrame, imported: DataFrame) -> DataFrame:
    """Mean score per source: over imported hashes with a score, else over all its groups.

    ``imported`` is distinct (source_id, normalized_hash). Unscored rows count as unknown.
    """
    pairs = groups.filter(F.col("score").isNotNull()).select(
        F.explode("source_ids").alias("source_id"), "normalized_hash", "score"
    )
    marked = pairs.join(
        imported.withColumn("_in", F.lit(True)), ["source_id", "normalized_hash"], "left"
    )
    got = F.when(F.col("_in"), F.col("score"))
    sums = marked.groupBy("source_id").agg(
        F.count(got).alias("n_in"), F.sum(got).alias("s_in"),
        F.count("score").alias("n_all"), F.sum("score").alias("s_all"),
    )
    mean = F.when(F.col("n_in") > 0, F.col("s_in") / F.col("n_in")).otherwise(
        F.col("s_all") / F.col("n_all")
    )
    return sums.select(
        "source_id", F.col("n_in").alias("imported_scored"), half_up(mean).alias("avg_score")
    )


# ---- facets ------------------------------------------------------------------------------

def kind_of(source_type: Column) -> Column:
    out = F.lit("unknown")
    for t, kind, _, _ in SOURCE_KINDS:
        out = F.when(source_type == t, kind).otherwise(out)
    return out


def kind_label(kind: Column) -> Column:
    out = F.when(kind == "mixed", "Multiple").otherwise("Unknown")
    for _, k, label, _ in SOURCE_KINDS:
        out = F.when(kind == k, label).otherwise(out)
    return out


def kind_position(kind: Column) -> Column:
    out = F.lit(8)
    for _, k, _, pos in SOURCE_KINDS:
        out = F.when(kind == k, pos).otherwise(out)
    return out


def facet_kind(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Groups per source kind, a group once per kind; configured kinds without hits stay."""
    kinds = sources.select("source_id", kind_of(F.col("source_type")).alias("kind"))
    hits = (
        groups.select("id", F.explode("source_ids").alias("source_id"))
        .join(kinds, "source_id")
        .select("id", "kind")
        .distinct()
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        kinds.select("kind").distinct().join(hits, "kind", "left")
        .select(
            "kind", kind_label(F.col("kind")).alias("label"),
            kind_position(F.col("kind")).alias("position"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def facet_source(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Groups per source, only sources with hits, most first."""
    hits = (
        groups.select(F.explode("source_ids").alias("source_id"))
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        hits.join(sources, "source_id")
        .select("source_id", F.col("source_name").alias("label"), "n")
        .orderBy(F.col("n").desc(), "label")
    )


def facet_posted(groups: DataFrame, as_of: Column) -> DataFrame:
    """Cumulative posting-age windows, all in one pass."""
    names = ["all", *POSTED_WINDOWS]
    one = groups.agg(
        *[F.count_if(in_posted_window(F.col("posted_at"), w, as_of)).alias(w) for w in names]
    )
    return unpivot_counts(one, names, "window")


def title_key(c: Column) -> Column:
    return F.coalesce(nonempty(F.trim(c)), F.lit("Unknown"))


def title_breakdown(groups: DataFrame, n: int = 5) -> DataFrame:
    return (
        groups.groupBy(title_key(F.col("title")).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "label")
        .limit(n)
    )


def haystack() -> Column:
    """Lower text a view keyword is looked up in."""
    parts = [F.col("title"), F.col("summary"), F.array_join("reasons", " "), F.col("location"),
             F.col("company")]
    return F.lower(F.concat_ws(" ", *[nonempty(p) for p in parts]))


def keyword_hits(groups: DataFrame, terms: list[str]) -> DataFrame:
    """Groups that contain each term, all terms counted in one pass."""
    low = [t.lower() for t in terms if t]
    staged = groups.select(haystack().alias("h"))
    one = staged.agg(*[F.count_if(F.col("h").contains(t)).alias(t) for t in low])
    return unpivot_counts(one, low, "term")


def attribution(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Source names and the common kind label of every group."""
    s = sources.select(
        "source_id", F.col("source_name").alias("name"), kind_of(F.col("source_type")).alias("kind")
    )
    long = groups.select("id", F.posexplode_outer("source_ids").alias("p", "source_id")).join(
        s, "source_id", "left"
    )
    found = F.when(F.col("kind").isNotNull(), F.struct("p", "name", "kind"))
    agg = long.groupBy("id").agg(F.array_sort(F.collect_list(found)).alias("f"))
    kinds = F.array_distinct(F.transform("f", lambda x: x["kind"]))
    label = (
        F.when(F.size(kinds) == 0, "Unknown")
        .when(F.size(kinds) > 1, kind_label(F.lit("mixed")))
        .otherwise(kind_label(F.get(kinds, F.lit(0))))
    )
    return agg.select(
        "id", F.transform("f", lambda x: x["name"]).alias("names"), label.alias("kind_label")
    )


# ---- numbers ------------------------------------------------------------------------------

def value_counts(values: DataFrame, value: str) -> DataFrame:
    return values.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def salary_summary(values: DataFrame, value: str = "salary_value") -> DataFrame:
    """min, avg, max, p75 by index, above-average and top-band counts of positive values.

    Works on the table of distinct values with counts, so the order statistics need no sort
    of the rows; see ``skew.cumulative``.
    """
    counts = settle(value_counts(values.filter(F.col(value) > 0), value))
    totals = counts.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col(value)).alias("s"),
    )
    n = totals.select("n").scalar()
    avg = totals.select(F.col("s") / F.col("n")).scalar()
    ranked = cumulative(counts, value)
    p75 = F.floor((n - 1) * 0.75) + 1
    band = n - F.greatest(F.lit(1), F.ceil(n * 0.25)) + 1
    v, c = F.col(value), F.col("n")
    picks = ranked.agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.min(F.when(F.col("upto") >= p75, v)).alias("p75"),
        F.coalesce(F.sum(F.when(v > avg, c)), F.lit(0)).alias("above_avg"),
        F.coalesce(F.sum(F.when(v <= avg, c)), F.lit(0)).alias("min_to_avg"),
        F.coalesce(F.sum(c), F.lit(0)).alias("with_salary"),
        # Rows at or above the band's value: every distinct value that reaches its rank.
        F.coalesce(F.sum(F.when(F.col("upto") >= band, c)), F.lit(0)).alias("top_band"),
    )
    return picks.withColumn("avg", avg)


def salary_matrix(values: DataFrame, value: str = "salary_value") -> DataFrame:
    s = salary_summary(values, value)
    cells = [
        ("has_salary", "with_salary"), ("min_to_avg", "min_to_avg"),
        ("above_avg", "above_avg"), ("best_paying", "top_band"),
    ]
    pairs = [x for key, c in cells for x in (F.lit(key), F.coalesce(F.col(c), F.lit(0)))]
    return s.select(F.stack(F.lit(len(cells)), *pairs).alias("key", "n"))


def histogram(values: DataFrame, value: str, buckets: int = 8) -> DataFrame:
    """Equal-width buckets over [min, max]; the last is closed, one bucket when min = max."""
    v = values.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / buckets
    index = F.when(hi > lo, F.least(F.lit(buckets - 1), F.floor((F.col("v") - lo) / width))).otherwise(0)
    counts = v.groupBy(index.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    frame = ends.filter("lo IS NOT NULL").select(
        "lo", "hi",
        F.explode(
            F.when(
                F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(buckets - 1))
            ).otherwise(F.array(F.lit(0)))
        ).alias("bucket"),
    )
    step = (F.col("hi") - F.col("lo")) / buckets
    last = F.when(F.col("hi") > F.col("lo"), F.lit(buckets - 1)).otherwise(0)
    return frame.join(counts, "bucket", "left").select(
        "bucket",
        F.when(F.col("bucket") == 0, F.col("lo"))
        .otherwise(half_up(F.col("lo") + step * F.col("bucket")).cast("double")).alias("lo"),
        F.when(F.col("bucket") == last, F.col("hi"))
        .otherwise(half_up(F.col("lo") + step * (F.col("bucket") + 1)).cast("double")).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def range_counts(
    groups: DataFrame, salary: tuple[float, float] | None, score: tuple[float, float] | None
) -> DataFrame:
    """Rows inside the ranges, with and without salary, mean score of scored rows."""
    s, k = F.col("salary_value"), F.col("score")
    in_salary = (s > 0) & (s.between(*salary) if salary else F.lit(True))
    in_score = k.isNotNull() & (k.between(*score) if score else F.lit(True))
    return groups.agg(
        F.count_if(in_salary).alias("in_salary_range"),
        F.count_if(in_score).alias("in_score_range"),
        F.count_if(s > 0).alias("with_salary"),
        F.count_if(~(s > 0)).alias("missing_salary"),
        (F.sum(F.when(k >= 0, k)) / F.count(F.when(k >= 0, k))).alias("mean_score"),
    )


# ---- order and pages ----------------------------------------------------------------------

def sort_keys(sort: str) -> list[tuple[Column, bool]]:
    """(column, descending) of a view sort; unknown names sort by score."""
    score = (F.coalesce("score", F.lit(-1)), True)
    date = (F.coalesce(F.unix_micros(F.coalesce("posted_at", "updated_at")), F.lit(0)), True)
    salary = (F.col("salary_value"), True)
    first = {"date": [date, score], "salary": [salary, score, date]}.get(sort, [score, date])
    return [*first, (lower_text(F.col("title")), False), (F.col("title"), False), (F.col("id"), False)]


def sort_groups(groups: DataFrame, sort: str = "score") -> DataFrame:
    return groups.orderBy(*[c.desc() if d else c.asc() for c, d in sort_keys(sort)])


def places(rows: DataFrame, order: list[tuple[Column, bool]], start: int, stop: int, n: int, in_one_task: int = 100_000) -> DataFrame:
    """Rows at places ``start`` to ``stop`` - 1 (from 0) of ``n`` in order, with ``position`` from 1.

    Sketched quantiles of the first sort key around the two places, confirmed (or widened) by exact counts below them,
    leave the one range that holds them; where all its rows are equal in that key, the next numeric key narrows it
    further. Only the range is sorted.
    """
    keyed = rows.withColumns({f"k{i}_": (-c if desc else c) for i, (c, desc) in enumerate(order)})
    names = [f"k{i}_" for i in range(len(order))]
    low, high, before, size = start, stop - 1, 0, n
    for key in names:
        if size <= in_one_task or dict(keyed.dtypes)[key] == "string":
            break
        slack = 0.0005
        while True:
            at = [max(0.0, low / size - slack), min(1.0, (high + 1) / size + slack)]
            ends = F.array(F.min(key), F.max(key)) if slack >= 1 else F.percentile_approx(key, at, 10_000)
            a, b = keyed.agg(ends.alias("q")).first()["q"]
            below, upto = keyed.agg(F.count_if(F.col(key) < F.lit(a)), F.count_if(F.col(key) <= F.lit(b))).first()
            if below <= low and high < upto:
                break
            slack *= 16
        keyed = keyed.filter(F.col(key).between(F.lit(a), F.lit(b)))
        low, high, before, size = low - below, high - below, before + below, upto - below
        if a != b:  # the places lie in several values of this key, so the next key does not order them
            break
    head = keyed.orderBy(*names).limit(high + 1)
    placed = head.withColumn("position", (F.row_number().over(W.orderBy(*names)) + before).cast("int"))
    return placed.filter(F.col("position") > start).drop(*names)


def page(groups: DataFrame, number: int, size: int, sort: str = "score") -> DataFrame:
    """One page with its totals; the page number is clamped to the pages there are. A deep page sorts its own range."""
    n = groups.count()
    pages = max(1, -(-n // size))
    current = max(1, min(pages, number))
    found = places(groups, sort_keys(sort), (current - 1) * size, min(n, current * size), n)
    return found.select("position", "id", "title", F.lit(current).alias("page"), F.lit(pages).alias("total_pages"))


def page_of(groups: DataFrame, selected: Column, size: int, sort: str = "score") -> DataFrame:
    """Page a group is on: rows that sort before it are counted, nothing is sorted."""
    place = F.struct(
        *[(-c if desc else c).alias(f"k{i}") for i, (c, desc) in enumerate(sort_keys(sort))]
    )
    staged = groups.select("id", place.alias("place"))
    mine = staged.filter(F.col("id") == selected).select("place").scalar()
    index = staged.agg(F.count_if(F.col("place") < mine).alias("i"))
    return index.select((F.floor(F.col("i") / size) + 1).cast("int").alias("page"))


def shortlist_markdown(top: DataFrame) -> DataFrame:
    """Shortlist rows as lines of a Markdown table, header first."""
    rows = top.select(
        F.col("position").alias("line"),
        F.format_string(
            "| %s | %s | %s | %s |", F.col("score").cast("string"), "title", "company",
            F.coalesce("location", F.lit("")),
        ).alias("text"),
    )
    spark = top.sparkSession
    head = spark.sql(
        "SELECT * FROM VALUES (-1, '| Score | Title | Company | Location |'), "
        "(0, '| --- | --- | --- | --- |') AS t(line, text)"
    )
    return head.unionByName(rows)


# ---- searches -----------------------------------------------------------------------------

def search_totals(rows: DataFrame) -> DataFrame:
    """Totals over search rows: sums, weighted score, and the found label."""
    weighted = F.sum(F.when(F.col("imported") > 0, F.col("avg_score") * F.col("imported")))
    weight = F.sum(
        F.when((F.col("imported") > 0) & F.col("avg_score").isNotNull(), F.col("imported"))
    )
    t = rows.agg(
        F.sum("captured").alias("captured"), F.sum("filtered").alias("filtered"),
        F.sum("deduped").alias("deduped"), F.sum("imported").alias("imported"),
        F.sum("expected").alias("expected"), F.bool_or(F.col("expected").isNull()).alias("unknown"),
        half_up(weighted / weight).alias("avg_score"),
    )
    known = F.when(F.col("unknown"), "?").otherwise(F.col("expected").cast("string"))
    return t.select(
        F.concat_ws("/", F.col("imported").cast("string"), known).alias("found_label"),
        "captured", "filtered", "deduped", "imported", "avg_score",
    )


AUTH_TYPES = [
    "linkedin_capture_file", "wellfound_search", "indeed_search", "ziprecruiter_search",
    "remoteok_search",
]


def search_rows(dashboard: DataFrame) -> DataFrame:
    """Label, tone and found label per source.

    Needs source_id, source_name, source_type, enabled, capture_status, access_status,
    captured, filtered, deduped, imported, expected, avg_score.
    """
    auth = F.col("source_type").isin(AUTH_TYPES)
    enabled = F.coalesce("enabled", F.lit(False))
    blocked = enabled & auth & ~F.coalesce(F.lower("access_status") == "pass", F.lit(False))
    status = F.col("capture_status")
    plain = (
        F.when(status == "ready", "ready")
        .when(status == "live_source", "live source")
        .otherwise("never run")
    )
    kind = kind_of(F.col("source_type"))
    return dashboard.select(
        "source_id",
        kind.alias("kind"),
        F.coalesce(nonempty(F.col("source_name")), kind_label(kind)).alias("label"),
        kind_position(kind).alias("position"),
        F.when(~enabled, "disabled").when(blocked, "not_authorized").otherwise("ready").alias(
            "readiness"
        ),
        F.when(~enabled, "muted").when(blocked, "warn")
        .when(status == "capture_error", "error").otherwise("ok").alias("tone"),
        F.when(~enabled, "disabled").when(blocked, "not authorized")
        .when(status == "capture_error", "error").otherwise(plain).alias("status_label"),
        F.concat_ws(
            "/", F.col("imported").cast("string"),
            F.coalesce(F.col("expected").cast("string"), F.lit("?")),
        ).alias("found_label"),
        "captured", "filtered", "deduped", "imported", "expected", "avg_score", "enabled",
    )


def readiness(rows: DataFrame) -> DataFrame:
    r = F.col("readiness")
    return rows.agg(
        F.count_if(r == "ready").alias("ready"),
        F.count_if(r == "not_authorized").alias("action_needed"),
        F.count_if(r == "disabled").alias("disabled"),
    )
