"""ANSI SQL twins of the bindings and helpers, used only to check results."""

from __future__ import annotations

from postmill.functions.core import WS_CLASS
from postmill.params import SOURCE_TYPES
from postmill.plans.bindings import SOURCE_COLUMNS, SOURCE_ROWS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS_CLASS}]+', ' ', 'g'))"


def text(x: str) -> str:
    return f"coalesce({ws(x)}, '')"


def ltext(x: str) -> str:
    return f"lower({text(x)})"


def half_up(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def ratio3(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(1.0, greatest(0.0, floor(({x}) * 1000 + 0.5) / 1000)) END)"


def pct(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN 'n/a' ELSE CAST({half_up(f'({x}) * 100')} AS VARCHAR) || '%' END)"


def iso(x: str) -> str:
    return f"strftime(CAST({x} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%gZ')"


def arr(x: str, sep: str = ", ") -> str:
    return f"array_to_string({x}, {q(sep)})"


def present(x: str) -> str:
    return f"({ltext(x)} NOT IN ('', 'unknown'))"


def days(ts: str, as_of: str) -> str:
    return (
        f"CAST(floor((epoch_us(CAST('{as_of}' AS TIMESTAMP)) - epoch_us({ts})) / 86400000000.0) AS BIGINT)"
    )


TYPE_LIST = "[" + ", ".join(q(t) for t in SOURCE_TYPES) + "]"
HTTP = r"(?i)^(https?)://(?:[^/?#@\s]*@)?[^/?#:@\s]+(?::\d*)?(?:[/?#].*)?$"


def is_http(x: str) -> str:
    return f"coalesce(regexp_matches({text(x)}, {q(HTTP)}), false)"


def terms_of(x: str) -> str:
    return f"list_filter(string_split({x}, '|'), lambda t: t <> '')"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "b_source": ((), f"SELECT * FROM (VALUES {SOURCE_ROWS}) AS t({SOURCE_COLUMNS})"),
    "b_raw": (
        (),
        f"""SELECT 'src' || (l_orderkey % 8) AS source_id,
  {TYPE_LIST}[CAST(l_orderkey % 8 + 1 AS INT)] AS source_type,
  strftime(l_shipdate, '%Y%m%d') || '|' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '|' || l_linenumber
    || '|' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0')
    || '|' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') || '|' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS pos,
  CASE WHEN l_partkey % 5 <> 0 THEN l_orderkey || '-' || l_linenumber END AS external_id,
  p_name || ' ' || p_type AS title, s_name AS company,
  CASE WHEN l_linenumber <> 7 THEN n_name END AS location,
  strftime(l_shipdate, '%Y-%m-%d') AS posted_at,
  CASE WHEN NOT (l_linestatus = 'O' AND l_quantity < 10) THEN l_linestatus END AS employment_type,
  CASE WHEN l_discount <> 0 THEN '$' || CAST(floor(l_extendedprice) AS BIGINT) END AS salary_text,
  CAST(NULL AS VARCHAR) AS summary,
  p_name || ' ' || p_brand || ' ' || p_type AS description,
  CASE WHEN l_tax = 0 AND l_partkey % 3 = 0 THEN 'posting ' || l_partkey
       ELSE 'https://jobs.example.com/p/' || l_partkey || '?s=' || l_suppkey END AS url,
  CAST(l_shipdate AS TIMESTAMP) AS seen_at
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "b_posting": (
        (),
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS num,
  'src' || (o_orderkey % 8) AS source_id, {TYPE_LIST}[CAST(o_orderkey % 8 + 1 AS INT)] AS source_type,
  'https://jobs.example.com/o/' || o_orderkey AS source_url,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS external_id,
  c_mktsegment || ' ' || o_orderpriority AS title, c_name AS company, n_name AS location,
  CAST(o_orderdate AS TIMESTAMP) AS posted_at, o_orderstatus AS employment_type,
  (o_orderkey % 2 = 0) AS easy_apply,
  CASE WHEN o_orderkey % 11 <> 0 THEN '$' || CAST(floor(o_totalprice) AS BIGINT) END AS salary_text,
  c_mktsegment || ' ' || o_orderpriority || ' ' || n_name || ' ' || o_orderstatus AS description,
  sha256(lower(c_name) || '|' || lower(c_mktsegment || ' ' || o_orderpriority)) AS normalized_hash,
  '{{"title":"' || c_mktsegment || ' ' || o_orderpriority || '"}}' AS structured_meta,
  CASE WHEN o_orderkey % 11 <> 0 THEN 100 ELSE 83 END::BIGINT AS metadata_quality_score,
  CASE WHEN o_orderkey % 11 <> 0 THEN []::VARCHAR[] ELSE ['salary'] END AS missing_required_fields,
  CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "b_status": (
        (),
        """SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'applied' WHEN 1 THEN 'rejected' WHEN 2 THEN 'skip_for_now' ELSE 'viewed' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'note ' || (o_orderkey % 3) ELSE '' END AS notes,
  CAST(o_orderdate AS TIMESTAMP) AS last_action_at,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS submitted_at
FROM orders WHERE o_orderkey % 7 < 4""",
    ),
    "b_doc": (
        (),
        """SELECT d.doc_id, source AS source_id, lang AS location,
  regexp_extract(text, '^([^\\n]*)', 1) AS title, 'Company ' || lang AS company,
  text AS description,
  CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'applied' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "b_page": ((), "SELECT 'src' || (page_id % 8) AS source_id, page_id, url, html FROM pages"),
    "b_refresh": (
        (),
        f"""SELECT event_id, CAST(user_id AS VARCHAR) AS source_id,
  {TYPE_LIST}[CAST(user_id % 8 + 1 AS INT)] AS source_type, CAST(ts AS TIMESTAMP) AS at_ts,
  CASE event_type WHEN 'error' THEN 'transient_error' WHEN 'purchase' THEN 'challenge' ELSE 'success' END AS outcome,
  CASE WHEN CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) % 2 = 0 THEN 'manual' ELSE 'scheduled' END AS mode
FROM events""",
    ),
    "b_event": (
        (),
        """SELECT event_id, event_type AS event,
  CASE user_id % 4 WHEN 0 THEN 'CLI ' WHEN 1 THEN 'dashboard' WHEN 2 THEN 'npm' ELSE 'other' END AS channel,
  CASE user_id % 3 WHEN 0 THEN 'authenticated' WHEN 1 THEN 'x' END AS identity_mode,
  CAST(user_id AS VARCHAR) AS distinct_id, CAST(ts AS TIMESTAMP) AS occurred_at, props FROM events""",
    ),
}


def cte(name: str, deps: str, body: str) -> None:
    CTES[name] = (tuple(deps.split()), body)


def sql(needs: str, body: str):
    """SELECT with the named definitions, and what they need, in front; put together on call."""

    def build() -> str:
        done: list[str] = []

        def visit(name: str) -> None:
            if name in done:
                return
            for d in CTES[name][0]:
                visit(d)
            done.append(name)

        for n in needs.split():
            visit(n)
        head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
        return f"WITH {head}\n{body}" if head else body

    return build
