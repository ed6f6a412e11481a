"""Secret scan: base rules by regular expression, and high entropy by a sliding window.

The window runs over candidate strings, once per character class, and keeps its Shannon entropy by
incremental counts: with S the sum of c * log2(c) over the counts c of the window's characters, the
entropy of a window of n characters is log2(n) - S / n, and sliding by one changes two counts.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.words import replacing

# The base rules: fixed values. Letters of the first group in either case, and ASCII only.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST, ACCESS_LEAST, ASSIGN_LEAST = 24, 20, 6
KINDS = ("assign", "access", "hex")
# HEX with a lower bound matches the same runs: a run is taken from its start.
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)


class Window(NamedTuple):
    """A character class: its runs, the window's length, the least entropy in bits per character."""

    kind: str
    runs: re.Pattern
    length: int
    bits: float


CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOWS = (
    Window("entropy_hex", re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.1),
    Window("entropy_base62", re.compile(r"[0-9A-Za-z]{20,}"), 20, 3.9),
    Window("entropy_base64", re.compile(r"[0-9A-Za-z+/_=-]{24,}"), 24, 4.1),
)
# Strings that look random and are none.
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),  # UUIDs
    re.compile(r"(?i)sha(?:1|224|256|384|512)[-:=][A-Za-z0-9+/=]+"),  # integrity digests
    re.compile(r"(?i)[a-z0-9_+/=-]*(?:example|sample|dummy|placeholder|changeme)[a-z0-9_+/=-]*"),
    re.compile(r"(?i)0123456789|abcdefghij|qwertyuiop"),
    re.compile(r"[0-9]+"),  # plain numbers, when they make up the whole run
)
X_LOG_X = [0.0] + [c * math.log2(c) for c in range(1, 257)]


def _dense(run: str, length: int, bits: float) -> list[tuple[int, int, float]]:
    """Maximal stretches covered by windows of at least ``bits`` bits: start, end, highest entropy."""
    counts: dict[str, int] = {}
    total, most = 0.0, (math.log2(length) - bits) * length + 1e-9
    found: list[tuple[int, int, float]] = []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += X_LOG_X[c + 1] - X_LOG_X[c]
        if i >= length:
            old = run[i - length]
            c = counts[old]
            counts[old] = c - 1
            total += X_LOG_X[c - 1] - X_LOG_X[c]
        if i >= length - 1 and total <= most:
            start, h = i - length + 1, math.log2(length) - total / length
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1, max(h, found[-1][2]))
            else:
                found.append((start, i + 1, h))
    return found


def _entropy_spans(text: str) -> list[tuple[str, int, int, float]]:
    out = []
    for m in CANDIDATE.finditer(text):
        word, base = m.group(), m.start()
        if word.isalpha() or not any(ch.isdigit() for ch in word):
            continue
        allowed = [a.span() for p in ALLOWED[:-1] for a in p.finditer(word)]
        for w in WINDOWS:
            for r in w.runs.finditer(word):
                run = r.group()
                if ALLOWED[-1].fullmatch(run) or run.isalpha():
                    continue
                for a, b, h in _dense(run, w.length, w.bits):
                    a, b = a + r.start(), b + r.start()
                    if not any(x < b and a < y for x, y in allowed):
                        out.append((w.kind, base + a, base + b, h))
    return out


def scan(text: str | None) -> list[dict]:
    """Spans of one text in order of start, then kind; entropy is null for base rules.

    An entropy span inside another span adds nothing and is left out.
    """
    if not text:
        return []
    found: list[tuple[str, int, int, float | None]] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LEAST]
    found += [("hex", *m.span(), None) for m in LONG_HEX.finditer(text)]
    for s in _entropy_spans(text):
        if not any(x[1] <= s[1] and s[2] <= x[2] for x in found):
            found.append(s)
    rank = {k: i for i, k in enumerate([*KINDS, *(w.kind for w in WINDOWS)])}
    found.sort(key=lambda s: (s[1], rank[s[0]]))
    return [{"kind": k, "start": a, "end": b, "entropy": h, "value": text[a:b]} for k, a, b, h in found]


SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("entropy", T.DoubleType()), T.StructField("value", T.StringType()),
]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entropy", pa.float64()), ("value", pa.string())]))


@F.arrow_udf(SPAN)
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([scan(t.as_py()) for t in texts], _ARROW)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns plus ``secrets``: array of (kind, start, end, entropy, value), code points, end exclusive.

    Base kinds are assign, access and hex; entropy_hex, entropy_base62 and entropy_base64 come from the
    window. Null and empty texts have none. Repeated rows are scanned alike; an empty table gives an
    empty result; an input column named secrets is replaced.
    """
    return replacing(docs.withColumn("_secrets", _scan(F.col(text))), "secrets").withColumnRenamed("_secrets", "secrets")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )
