"""URL parts, canonical posting URLs and board-specific ids.

``with_url`` cuts a URL once into a struct column and ``with_board_ids`` adds the ids of the
big boards; the other helpers only read those columns, so each regular expression runs once
per row and the generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.core import column_text, first_present, nonempty, text

HTTP = r"(?i)^(https?)://(?:[^/?#@\s]*@)?[^/?#:@\s]+(?::\d*)?(?:[/?#].*)?$"
HEAD = r"(?i)^(https?)://(?:[^/?#@\s]*@)?([^/?#:@\s]+)(?::(\d*))?"
PATH = r"(?i)^https?://[^/?#]+/([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
FRAGMENT = r"^[^#]*#(.*)$"

# Printable ASCII with neither user, port nor fragment: all patterns above cut it at the same plain letters.
PLAIN = r"(?i)^https?://[!-~&&[^/?#:@]]+(?:/[!-~&&[^?#]]*)?(?:\?[!-~&&[^#]]*)?\z"


def is_http_url(c: Column) -> Column:
    return F.coalesce(text(c).rlike(HTTP), F.lit(False))


def split_url(t: Column) -> Column:
    """struct(ok, text, scheme, host, port, path, query, fragment) of normalised text."""
    scheme = F.lower(F.regexp_extract(t, HEAD, 1))
    return F.struct(
        F.coalesce(t.rlike(HTTP), F.lit(False)).alias("ok"),
        t.alias("text"),
        scheme.alias("scheme"),
        F.lower(F.regexp_extract(t, HEAD, 2)).alias("host"),
        # Only a colon behind that of the scheme can start a port.
        F.when(
            F.locate(":", t, 7) > 0,
            F.regexp_replace(
                F.concat(scheme, F.lit(":"), F.regexp_extract(t, HEAD, 3)),
                "^(?:https:443$|http:80$|[a-z]*:)",
                "",
            ),
        ).otherwise("").alias("port"),
        F.concat(F.lit("/"), F.regexp_extract(t, PATH, 1)).alias("path"),
        F.when(t.contains("?"), F.regexp_extract(t, QUERY, 1)).otherwise("").alias("query"),
        F.when(t.contains("#"), F.regexp_extract(t, FRAGMENT, 1)).otherwise("").alias("fragment"),
    )


def split_plain(t: Column, head: Column, origin: Column) -> Column:
    """``split_url`` of a text like ``PLAIN``; ``head`` is its part before the query, ``origin`` that before the path."""
    after = lambda c, start: F.substring(c, F.length(start) + 2, F.length(c))
    return F.struct(
        F.lit(True).alias("ok"),
        t.alias("text"),
        F.lower(F.substring_index(t, ":", 1)).alias("scheme"),
        F.lower(F.substring_index(origin, "/", -1)).alias("host"),
        F.lit("").alias("port"),
        F.concat(F.lit("/"), after(head, origin)).alias("path"),
        after(t, head).alias("query"),
        F.lit("").alias("fragment"),
    )


def with_url(df: DataFrame, url: Column, out: str = "_u") -> DataFrame:
    """Stage the split URL, so that no later expression repeats the cutting.

    One test tells plain URLs, which are cut at fixed letters; the others are cut by patterns.
    """
    t, head = F.col(f"{out}_text"), F.col(f"{out}_head")
    plain = F.when(F.coalesce(t.rlike(PLAIN), F.lit(False)), F.substring_index(t, "?", 1))
    # Written as a column first: the tests of its text name it several times.
    staged = df.withColumn(f"{out}_given", url).withColumn(f"{out}_text", column_text(f"{out}_given")).withColumn(f"{out}_head", plain)
    return staged.withColumn(
        out, F.when(head.isNotNull(), split_plain(t, head, F.substring_index(head, "/", 3))).otherwise(split_url(t))
    ).drop(f"{out}_given", f"{out}_text", f"{out}_head")


def decode_component(c: Column, plus: str = " ") -> Column:
    """Percent decoding; a stray percent sign stands for itself."""
    escaped = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.regexp_replace(escaped, r"\+", plus))


def encode_component(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def param(query_text: Column, name: str) -> Column:
    """First value of a query parameter, decoded; empty when absent."""
    return decode_component(F.regexp_extract(query_text, rf"(?:^|&)(?:{name})=([^&]*)", 1))


def host_in(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def linkedin_path_id(u: Column) -> Column:
    return F.regexp_extract(u["path"], r"(?i)/jobs/view/(\d+)", 1)


def with_board_ids(df: DataFrame, u: str = "_u") -> DataFrame:
    """Stage the ids that LinkedIn, Indeed and Google URLs carry (empty when absent).

    Each is cut out only where the host, and the name of the parameter, allow it.
    """
    c = F.col(u)
    q, h = c["query"], c["fragment"]
    indeed, from_google = host_in(c["host"], "indeed.com"), host_in(c["host"], "google.com")
    by_query = F.when(q.contains("obId="), F.regexp_extract(q, r"(?:^|&)(?:currentJobId|jobId)=(\d+)(?:&|$)", 1))
    staged = df.withColumns(
        {
            f"{u}_path_id": linkedin_path_id(c),
            f"{u}_query_id": by_query,
            f"{u}_jk": F.when(indeed, F.regexp_extract(q, r"(?:^|&)(?:jk|vjk)=([^&]+)", 1)),
            f"{u}_docid": F.when(from_google, text(param(q, "docid"))),
            f"{u}_vhid": F.when(from_google, F.regexp_extract(param(h, "vhid"), r"(?i)(?:^|/)docid=([^&/]+)", 1)),
            f"{u}_hash": F.when(
                from_google, F.regexp_extract(decode_component(h, "%2B"), r"(?i)(?:^|[/?&])docid=([^&/]+)", 1)
            ),
        }
    )
    google = first_present(
        F.col(f"{u}_docid"), text(F.col(f"{u}_vhid")), text(F.col(f"{u}_hash")), F.lit("")
    )
    empty = F.lit("")
    return staged.withColumns(
        {
            f"{u}_linkedin": F.when(
                c["ok"], first_present(F.col(f"{u}_path_id"), F.col(f"{u}_query_id"))
            ),
            f"{u}_indeed": F.when(
                indeed, text(decode_component(F.col(f"{u}_jk")))
            ),
            f"{u}_google": F.when(from_google, google),
        }
    ).withColumns(
        {f"{u}_{n}": F.coalesce(F.col(f"{u}_{n}"), empty) for n in ("linkedin", "indeed", "google")}
    ).drop(*[f"{u}_{n}" for n in ("path_id", "query_id", "jk", "docid", "vhid", "hash")])


def wellfound_id(u: Column) -> Column:
    return F.regexp_extract(u["path"], r"(?i)/jobs/(\d+)", 1)


def ashby_id(u: Column) -> Column:
    """Long hexadecimal or numeric path segment."""
    return F.regexp_extract(u["text"], r"(?i)/([a-f0-9]{24,}|[0-9]{5,})(?:[/?#]|$)", 1)


def origin(u: Column) -> Column:
    return F.concat(
        u["scheme"],
        F.lit("://"),
        u["host"],
        F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(F.lit("")),
    )


def canonical_url(name: str = "_u") -> Column:
    """One URL per posting: board rule where there is one, else no query and hash.

    Reads what ``with_url`` and ``with_board_ids`` staged under ``name``.
    """
    u = F.col(name)
    li, ind, goo = (F.col(f"{name}_{n}") for n in ("linkedin", "indeed", "google"))
    return (
        F.when(~u["ok"], u["text"])
        .when(
            host_in(u["host"], "linkedin.com") & (li != ""),
            F.concat(F.lit("https://www.linkedin.com/jobs/view/"), li, F.lit("/")),
        )
        .when(
            ind != "", F.concat(F.lit("https://www.indeed.com/viewjob?jk="), encode_component(ind))
        )
        .when(
            (u["path"] == "/search") & (goo != ""),
            F.concat(F.lit("https://www.google.com/search?docid="), encode_component(goo)),
        )
        .otherwise(F.concat(origin(u), u["path"]))
    )


def infer_external_id(given: Column, source_type: Column, name: str = "_u") -> Column:
    """Given id, else the id the canonical URL of the board would still carry."""
    u = F.col(name)
    linkedin = F.when(host_in(u["host"], "linkedin.com"), F.col(f"{name}_linkedin")).otherwise(
        linkedin_path_id(u)
    )
    return F.coalesce(
        nonempty(given),
        nonempty(
            F.when(source_type == "linkedin_capture_file", linkedin)
            .when(source_type == "indeed_search", F.col(f"{name}_indeed"))
            .when(
                (source_type == "google_search") & (u["path"] == "/search"),
                F.col(f"{name}_google"),
            )
        ),
    )


def absolute_url(href: Column, page: Column) -> Column:
    """Resolve an href against the split URL of its page."""
    h = text(href)
    folder = F.regexp_extract(page["path"], r"^(.*/)", 1)
    return (
        F.when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(page["scheme"], F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin(page), h))
        .when(h == "", page["text"])
        .when(h.startswith("#"), F.concat(F.regexp_extract(page["text"], r"^([^#]*)", 1), h))
        .when(h.startswith("?"), F.concat(origin(page), page["path"], h))
        .otherwise(F.concat(origin(page), folder, h))
    )


def host_company(u: Column) -> Column:
    """Label before the top-level domain, dashes as spaces; empty without a host."""
    labels = F.filter(
        F.split(F.regexp_replace(u["host"], r"^www\.", ""), r"\."), lambda p: p != ""
    )
    label = F.coalesce(F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(1)))
    return text(F.regexp_replace(label, "[-_]+", " "))


def is_job_url(c: Column) -> Column:
    low = F.lower(c)
    return low.rlike(r"/jobs?/") | low.rlike(
        r"jobid=|gh_jid=|jk=|lever\.co|greenhouse\.io|ashbyhq\.com"
    )


def is_google_host(u: Column) -> Column:
    return u["host"].rlike(r"(?:^|\.)google\.")


def unwrap_redirect(u: Column) -> Column:
    """Target of a search-engine redirect link, otherwise the URL itself."""
    target = F.coalesce(nonempty(param(u["query"], "q")), nonempty(param(u["query"], "url")))
    decoded = decode_component(target, "%2B")
    return F.when(is_google_host(u) & target.isNotNull(), decoded).otherwise(u["text"])
