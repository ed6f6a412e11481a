"""SQL twins of the scores."""

from __future__ import annotations

from postmill.functions import terms
from postmill.operators.scoring import (
    exclude_terms,
    mode,
    scoring_terms,
    target_days,
    target_salary,
)
from postmill.params import SOURCE_POINTS, Criteria, Profile
from postmill.plans import sqlkit as k
from postmill.plans.sqlkit import q

AI = r"\b(ai|a\.i\.|genai|gen ai|llm|ml|machine learning|artificial intelligence)\b"


def match(term: str, t: str) -> str:
    if term in terms.AI_TERMS:
        return f"regexp_matches({t}, {q(AI)})"
    if term == "product manager":
        return rf"regexp_matches({t}, '\bproduct manager\b|\bpm\b')"
    return f"contains({t}, {q(term)})"


def hits(names, t: str) -> str:
    """SQL list of the contained terms, in order."""
    if not names:
        return "CAST([] AS VARCHAR[])"
    return f"list_filter([{', '.join(q(n) for n in names)}], lambda x: contains({t}, x))"


def longest(names, t: str) -> str:
    ordered = sorted(names, key=lambda n: -len(n))
    return f"{hits(ordered, t)}[1]" if names else "CAST(NULL AS VARCHAR)"


def work_types(t: str) -> str:
    parts = [
        "CASE WHEN " + " OR ".join(f"contains({t}, {q(x)})" for x in xs) + f" THEN '{kind}' END"
        for kind, xs in terms.WORK_TYPES.items()
    ]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def facts(source: str, as_of: str) -> str:
    return rf"""SELECT *, CAST(least(100, 35 + CASE WHEN ft <> '' THEN 8 ELSE 0 END + CASE WHEN fc <> '' THEN 8 ELSE 0 END
  + CASE WHEN fl <> '' THEN 8 ELSE 0 END + CASE WHEN fe <> '' THEN 8 ELSE 0 END + CASE WHEN {k.text('salary_text')} <> '' THEN 10 ELSE 0 END
  + CASE WHEN posted_at IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN len(fw) > 0 THEN 6 ELSE 0 END
  + CASE WHEN flen >= 500 THEN 12 WHEN flen >= 220 THEN 8 WHEN flen >= 120 THEN 4 ELSE 0 END) AS INT) AS confidence
FROM (SELECT *, {work_types('tx')} AS fw, CASE WHEN fd0 >= 0 THEN fd0 END AS fd, CASE WHEN sf0 < 1000 THEN sf0 * 1000 ELSE sf0 END AS fs
FROM (SELECT *, ft || ' ' || fl || ' ' || fe || ' ' || {k.ltext('description')} AS tx
FROM (SELECT *, {k.ltext('title')} AS ft, {k.ltext('company')} AS fc, {k.ltext('location')} AS fl, {k.ltext('employment_type')} AS fe,
  length({k.text('description')}) AS flen, {k.days('coalesce(posted_at, updated_at)', as_of)} AS fd0,
  TRY_CAST(regexp_replace(regexp_extract(salary_text, '\$?(\d{{2,3}})(?:,\d{{3}})?', 0), '[^0-9]', '', 'g') AS BIGINT) AS sf0 FROM {source})))"""


def bucket(s: str) -> str:
    return f"CASE WHEN {s} >= 70 THEN 'high_signal' WHEN {s} >= 40 THEN 'review_later' ELSE 'reject' END"


def summary(score: str, reasons: str, otherwise: str) -> str:
    return (
        f"'Score ' || {score} || ': ' || CASE WHEN len({reasons}) > 0 THEN "
        f"array_to_string({reasons}[1:3], ', ') ELSE {q(otherwise)} END"
    )


def title_hit(title: str) -> str:
    toks = terms.title_tokens(title)
    each = " AND ".join(match(x, "ft") for x in toks) if toks else "false"
    return f"(ft <> '' AND ({match(title, 'ft')} OR ({each})))"


def criteria(c: Criteria, source: str) -> str:
    """Score columns next to everything in ``source`` (a facts CTE)."""
    title, loc = c.title.strip().lower(), c.location.strip().lower()
    kws, sal, days = scoring_terms(c), target_salary(c), target_days(c)
    inc, exc = terms.term_list(c.hard_include), exclude_terms(c)
    block = ["NULL"]
    if inc and mode(c.hard_include_mode) == "or":
        block.insert(0, f"CASE WHEN len({hits(inc, 'tx')}) = 0 THEN 'hard filter hit: none of required terms matched ({', '.join(inc)})' END")
    elif inc:
        missing = f"list_filter([{', '.join(q(x) for x in inc)}], lambda x: NOT contains(tx, x))"
        block.insert(0, f"CASE WHEN len({missing}) > 0 THEN 'hard filter hit: missing required terms (' || array_to_string({missing}, ', ') || ')' END")
    if exc:
        block.insert(-1, f"'hard filter hit: exclude term \"' || {longest(exc, 'tx')} || '\"'")
    total, got, why = 0, [], []
    if title:
        total += 35
        got.append("CASE WHEN th THEN 35 ELSE 0 END")
        why.append("CASE WHEN th THEN 'title matched' ELSE 'title did not match' END")
    if kws:
        total += 25
        n = len(kws)
        if mode(c.score_keyword_mode or c.keyword_mode) == "or":
            got.append("CASE WHEN kw > 0 THEN 25 ELSE 0 END")
            why.append(f"CASE WHEN kw > 0 THEN 'keywords matched in OR mode (' || kw || '/{n})' ELSE 'keywords did not match in OR mode' END")
        else:
            got.append(f"CASE WHEN kw >= {n} THEN 25.0::DOUBLE ELSE 25.0::DOUBLE * (kw::DOUBLE / {n}) * 0.5 END")
            why.append(f"CASE WHEN kw >= {n} THEN 'keywords matched all (' || kw || '/{n})' WHEN kw > 0 THEN 'keywords partially matched in AND mode (' || kw || '/{n})' ELSE 'keywords did not match in AND mode' END")
    if loc:
        total += 15
        hit = f"(fl <> '' AND (contains(fl, {q(loc)}) OR contains({q(loc)}, fl)))"
        got.append(f"CASE WHEN {hit} THEN 15 ELSE 0 END")
        why.append(f"CASE WHEN {hit} THEN 'location matched' ELSE 'location did not match' END")
    if sal:
        total += 15
        got.append(f"CASE WHEN fs >= {sal} THEN 15 ELSE 0 END")
        why.append(f"CASE WHEN fs IS NULL THEN 'salary unavailable' WHEN fs >= {sal} THEN 'salary matched' ELSE 'salary below target' END")
    if days is not None:
        total += 10
        got.append(f"CASE WHEN fd <= {days} THEN 10 ELSE 0 END")
        why.append(f"CASE WHEN fd IS NULL THEN 'freshness unavailable' WHEN fd <= {days} THEN 'freshness matched' ELSE 'freshness outside target' END")
    kw = " + ".join(f"CAST({match(x, 'tx')} AS INT)" for x in kws) or "0"
    raw = f"least(100, greatest(0, CAST(floor((({' + '.join(got) or '0'})::DOUBLE) / {total} * 100 + 0.5) AS INT)))" if total else "0"
    capped = f"CASE WHEN th THEN {raw} ELSE least({raw}, 25) END" if title else raw
    return f"""SELECT *, {bucket('score')} AS bucket, {summary('score', 'reasons', 'no criteria provided')} AS summary
FROM (SELECT *, CAST(CASE WHEN block IS NOT NULL THEN 0 ELSE {capped} END AS INT) AS score, fd AS freshness_days, block IS NOT NULL AS hard_filtered,
  CASE WHEN block IS NOT NULL THEN [block] ELSE [{', '.join(why)}] END AS reasons
FROM (SELECT *, coalesce({', '.join(block)}) AS block, {title_hit(title) if title else 'true'} AS th, {kw} AS kw FROM {source}))"""


def profile(p: Profile, source: str) -> str:
    levels = list(p.seniority_levels)
    allowed = [x for x in terms.SENIORITY if x in levels]
    barred = [x for x in terms.SENIORITY if x not in levels]
    pts, why = [], []

    def add(points: str, reason: str) -> None:
        pts.append(f"coalesce({points}, 0)")
        why.append(reason)

    def quoted(label: str, x: str) -> str:
        return f"'{label} \"' || {x} || '\"'"

    add("CASE WHEN ptitle IS NOT NULL THEN 35 ELSE -25 END",
        f"coalesce({quoted('title family matches', 'ptitle')}, 'title family not in preferred set')")
    add("CASE WHEN pallow IS NOT NULL THEN 12 WHEN pbar IS NOT NULL THEN -18 END",
        f"coalesce({quoted('seniority aligns with', 'pallow')}, {quoted('seniority outside range', 'pbar')})")
    add("CASE WHEN pplace IS NOT NULL THEN 12 END", quoted("location aligns with", "pplace"))
    add("CASE WHEN pemp IS NOT NULL THEN 15 END", quoted("target company match", "pemp"))
    groups = [(p.industries, 6, 12, "industry signal"), (p.business_models, 5, 10, "business model signal"),
              (p.company_maturity, 4, 8, "company maturity signal"), (p.include_keywords, 7, 14, "specialty signal")]
    for names, each, cap, label in groups:
        h = hits(names, "tx")
        add(f"least({cap}, len({h}) * {each})",
            f"CASE WHEN len({h}) > 0 THEN '{label} \"' || array_to_string({h}[1:2], '\", \"') || '\"' END")
    add(f"CASE WHEN fs >= {p.salary_floor} THEN 8 WHEN fs < {p.salary_floor} THEN -10 END",
        f"CASE WHEN fs >= {p.salary_floor} THEN 'salary floor met' WHEN fs < {p.salary_floor} THEN 'salary floor missed' END")
    remote = f"(contains(fl, 'remote') OR contains({k.ltext('description')}, 'remote') OR list_contains(fw, 'remote'))"
    if p.remote_preference == "remote_only":
        add(f"CASE WHEN {remote} THEN 15 ELSE -40 END",
            f"CASE WHEN {remote} THEN 'remote requirement satisfied' ELSE 'remote requirement not satisfied' END")
    elif p.remote_preference == "remote_friendly":
        add(f"CASE WHEN {remote} THEN 8 END", f"CASE WHEN {remote} THEN 'remote-friendly signal' END")
    if p.work_type_preferences:
        fit = f"list_has_any(fw, [{', '.join(q(x) for x in p.work_type_preferences)}])"
        add(f"CASE WHEN {fit} THEN 8 END", f"CASE WHEN {fit} THEN 'work type preference matched' END")
    src = "CASE source_type " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in SOURCE_POINTS.items()) + " END"
    add(src, f"'source quality bonus +' || ({src})")
    add("CASE WHEN fd IS NULL THEN 0 WHEN fd <= 3 THEN 10 WHEN fd <= 7 THEN 6 WHEN fd <= 14 THEN 2 WHEN fd <= 30 THEN -4 WHEN fd <= 45 THEN -8 ELSE -12 END",
        "CASE WHEN fd IS NULL THEN 'freshness unknown' WHEN fd <= 3 THEN 'very fresh posting' WHEN fd <= 7 THEN 'fresh posting' WHEN fd <= 14 THEN 'recent posting' "
        "WHEN fd <= 30 THEN 'older posting' WHEN fd <= 45 THEN 'stale posting' ELSE 'very stale posting' END")
    add("CASE WHEN confidence < 45 THEN -8 WHEN confidence >= 80 THEN 2 END",
        "CASE WHEN confidence < 45 THEN 'low data confidence (' || confidence || ')' WHEN confidence >= 80 THEN 'high data confidence (' || confidence || ')' END")
    deal = []
    if p.exclude_keywords:
        deal.append(f"'hard filter hit: exclude keyword \"' || {longest(p.exclude_keywords, 'tx')} || '\"'")
    if p.deal_salary_minimum > 0:
        deal.append(f"CASE WHEN fs < {p.deal_salary_minimum} THEN 'hard filter hit: salary below deal-breaker minimum' END")
    if p.deal_work_types:
        w = ", ".join(p.deal_work_types)
        deal.append(f"CASE WHEN len(fw) > 0 AND NOT list_has_any(fw, [{', '.join(q(x) for x in p.deal_work_types)}]) THEN 'hard filter hit: work type outside deal-breaker range ({w})' END")
    deals = f"list_filter([{', '.join(deal)}], lambda x: x IS NOT NULL)" if deal else "CAST([] AS VARCHAR[])"
    return f"""SELECT *, {bucket('score')} AS bucket,
  CASE WHEN hard_filtered THEN 'Score 0: ' || deals[1] ELSE {summary('score', 'reasons', 'no strong matching signals found')} END AS summary
FROM (SELECT *, len(deals) > 0 AS hard_filtered, fd AS freshness_days,
  CAST(CASE WHEN len(deals) > 0 THEN 0 ELSE least(100, greatest(0, {' + '.join(pts)})) END AS INT) AS score,
  list_concat(list_filter([{', '.join(why)}], lambda x: x IS NOT NULL), deals) AS reasons
FROM (SELECT *, {longest(p.target_titles, 'ft')} AS ptitle, {longest(allowed, 'ft')} AS pallow, {longest(barred, 'ft')} AS pbar,
  {longest(p.target_locations, 'fl')} AS pplace, {longest(p.target_companies, 'fc')} AS pemp, {deals} AS deals FROM {source}))"""


def learned(scored: str, base: str) -> str:
    """Learning on top of a scored CTE; history from ``base`` with a status column."""
    return f"""SELECT * EXCLUDE (score, bucket, reasons, summary, delta, company_key),
  score2 AS score, CASE WHEN moved THEN {bucket('score2')} ELSE bucket END AS bucket,
  reasons2 AS reasons, CASE WHEN moved THEN {summary('score2', 'reasons2', 'no strong matching signals found')} ELSE summary END AS summary
FROM (SELECT *, CAST(CASE WHEN moved THEN least(100, greatest(0, score + delta)) ELSE score END AS INT) AS score2,
  CASE WHEN moved THEN list_append(reasons, CASE WHEN delta > 0 THEN 'historical positive signal at "' || company_key || '" (+' || delta || ')'
    ELSE 'historical negative signal at "' || company_key || '" (' || delta || ')' END) ELSE reasons END AS reasons2
FROM (SELECT s.*, h.delta, h.company_key, coalesce(h.delta, 0) <> 0 AND NOT hard_filtered AS moved FROM {scored} s LEFT JOIN
 (SELECT {k.ltext('company')} AS company_key, greatest(-12, least(12, sum(CASE status WHEN 'applied' THEN 3 WHEN 'rejected' THEN -2 WHEN 'skip_for_now' THEN -1 ELSE 0 END))) AS delta
  FROM {base} GROUP BY 1) h ON h.company_key = {k.ltext('s.company')} AND h.company_key <> ''))"""
