"""Quality rules with cutoffs whose false rejections are held below a limit, proven on labelled holdouts.

Every whole text is measured once. A rule rejects what lies above its cutoff; cutoffs are chosen per stratum (language):

1. Candidates: quantiles of the rule's value among labelled documents of the fitting fold, good and bad alike.
2. Test: on the holdout fold, the number k of rejected among n good documents is binomial. A candidate is certified if
   P(X <= k) under the limit's rate is at most the level (an exact binomial test: the Clopper-Pearson upper bound of the
   rejection rate lies below the limit). Candidates of a rule are tested from the mildest on, up to the first that fails,
   so they share one level (fixed sequence); over rules and strata the level is divided (Bonferroni).
3. Choice: of the certified cutoffs the one that is best on the fitting fold, where rejecting a good document costs as
   much as catching ``COST`` bad ones is worth; none if no cutoff is worth it.

Each of R rules may reject at most limit / R of the good documents, so all together at most the limit, in every stratum
at once with probability 1 - level. A stratum with too few labelled documents to prove anything gets no cutoff.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators.settle import settle

LIMIT, LEVEL = 0.1, 0.05  # share of good documents rejected at most, and the probability of breaking it
COST = 20.0
STEPS = 32  # candidates from each of the two labels
SYMBOLS = b"#*$%&|<>"
FEW_STRATA = 10_000
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(128, 192))  # UTF-8 bytes that begin no character
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punctuation", "n_plain_ends"]
_MEASURED = T.StructType([T.StructField(n, T.LongType()) for n in MEASURES])


def repeated_words(found: list[bytes], window: int = 3) -> int:
    """Words that lie in a run of ``window`` words found twice or more, the first included."""
    if len(found) <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
    runs = ids
    for i in range(1, window):  # number the runs of i + 1 words
        runs = np.unique(runs[: len(found) - i] * len(known) + ids[i:], return_inverse=True)[1].astype(np.int64)
    again = np.bincount(runs)[runs] > 1
    covered = np.zeros(len(found), bool)
    for i in range(window):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def measured(text: bytes) -> tuple[int, ...]:
    """The measures of one text; words are runs of non-blank characters, lines end at line feeds."""
    found = text.split()
    blanks = sum(text.count(b) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    chars = len(text.translate(None, _INNER))
    lines = [x for x in text.split(b"\n") if x.strip()]
    rest = lambda drop: len(text) - len(text.translate(None, drop))
    ends = sum(1 for w in found if w[-1:].isalnum() or w[-1] >= 128)
    return (
        len(found), chars - blanks, rest(SYMBOLS), len(lines) - len(set(lines)), repeated_words(found), len(lines), rest(_UPPER), rest(_PUNCTUATION), ends,
    )


@F.pandas_udf(_MEASURED)
def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measured(t) for t in texts], columns=MEASURES)


# A rule's value of a measured text; the higher, the worse.
RULES = {
    "symbols": "try_divide(n_symbols, word_chars)", "same_lines": "try_divide(n_dup_lines, n_lines)", "repeats": "try_divide(n_repeat_words, n_words)",
    "upper": "try_divide(n_upper, word_chars)", "punctuation": "try_divide(n_punctuation, word_chars)", "long_words": "try_divide(word_chars, n_words)",
    "short_words": "-try_divide(word_chars, n_words)", "odd_ends": "1D - try_divide(n_plain_ends, n_words)",
}


def rule_values() -> dict[str, Column]:
    return {r: F.expr(f"coalesce(CAST({v} AS DOUBLE), 0D)") for r, v in RULES.items()}


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X with n trials of probability p, summed term by term from the largest down."""
    if n <= 0 or k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if k >= n * p:  # far above the level already
        return 1.0 - math.fsum(math.exp(log(i)) for i in range(k + 1, min(n, k + 1 + int(60 * math.sqrt(n * p) + 60)) + 1))
    total, i = 0.0, k
    while i >= 0:
        term = math.exp(log(i))
        total += term
        if term < total * 1e-17:
            break
        i -= 1
    return min(1.0, total)


def chosen_cutoff(cuts: list[float], counts: dict[tuple[bool, int], np.ndarray], limit: float, level: float, cost: float = COST) -> dict:
    """The cutoff of one rule in one stratum, with its proof; ``counts[holdout, label][i]`` documents have i cuts below their value."""
    rejected = {key: np.concatenate([np.cumsum(c[::-1])[::-1][1:], [0]])[: len(cuts)] for key, c in counts.items()}  # by cut: documents above it
    n = {key: int(c.sum()) for key, c in counts.items()}
    best = {"cutoff": None, "n_good": n[True, 1], "n_rejected": None, "p_value": None, "worth": 0.0}
    for i in range(len(cuts) - 1, -1, -1):  # the mildest first
        k = int(rejected[True, 1][i])
        p = at_most(k, n[True, 1], limit)
        if p > level:
            break
        worth = rejected[False, 0][i] / max(1, n[False, 0]) - cost * rejected[False, 1][i] / max(1, n[False, 1])
        if worth > best["worth"]:
            best.update(cutoff=float(cuts[i]), n_rejected=k, p_value=p, worth=float(worth))
    return best


def thresholds(rows: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """stratum, rule, cutoff (null: none), n_good, n_rejected, p_value of the labelled ``rows``: stratum, holdout, label, rules."""
    at = [i / STEPS for i in range(STEPS)] + [0.99, 0.999, 1.0]
    fitting = rows.filter("NOT holdout")
    quantiles = fitting.groupBy("stratum", "label").agg(*[F.percentile_approx(r, at, 10_000).alias(r) for r in RULES])
    cuts = quantiles.groupBy("stratum").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(r)))).alias(f"{r}_cuts") for r in RULES])
    cuts = settle(cuts, "rule-cuts")
    tested = rows.join(cuts, "stratum")
    above = [F.struct(F.lit(r).alias("rule"), F.size(F.filter(f"{r}_cuts", lambda c: c < F.col(r))).alias("below")).alias(r) for r in RULES]  # noqa: B023
    bins = tested.select("stratum", "holdout", "label", F.explode(F.array(*above)).alias("x")).groupBy("stratum", "holdout", "label", "x.rule", "x.below").count()
    # Per stratum and rule at most 4 * (2 * STEPS + 7) rows.
    per_rule = settle(bins.join(cuts.select("stratum", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(f"{r}_cuts"))])).alias("rule", "cuts")), ["stratum", "rule"]), "rule-bins")
    tests = max(1, per_rule.filter("holdout AND label = 1").select("stratum", "rule").distinct().count())
    each = level / tests

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        cuts = list(rows["cuts"].iloc[0])
        counts = {(h, y): np.zeros(len(cuts) + 1, np.int64) for h in (False, True) for y in (0, 1)}
        for r in rows.itertuples():
            counts[bool(r.holdout), int(r.label)][r.below] += r.count_
        found = chosen_cutoff(cuts, counts, limit / len(RULES), each)
        return pd.DataFrame([{"stratum": rows["stratum"].iloc[0], "rule": rows["rule"].iloc[0], **{c: found[c] for c in ("cutoff", "n_good", "n_rejected", "p_value")}}])

    out = "stratum string, rule string, cutoff double, n_good long, n_rejected double, p_value double"
    return settle(per_rule.withColumnRenamed("count", "count_").groupBy("stratum", "rule").applyInPandas(choose, out), "rule-thresholds")


def quality_rules(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the measures, base_failed, failed (rules above their cutoff) and kept of every row of ``docs``.

    Base: fewer than 50 words, or more than half of them in repeated runs of three. Labels are rows of doc_id and
    quality; an id whose labels disagree or are null has none, an id counts once (its smallest measures) however often
    it occurs. Fold and holdout follow from the id's CRC-32. A null or empty text has no words and fails the base; a null
    stratum counts as ''; a stratum that no label reaches keeps all that pass the base. Repeated rows are judged one by
    one. An empty table gives no rows, empty labels no cutoffs. Other columns are not read.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), measure(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("m"))
    found = found.select("doc_id", "stratum", "m.*")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = settle(found.withColumn("base_failed", base), "rule-measures")

    given = labels.select(F.col("doc_id").alias("id_"), F.col("quality").alias("label")).groupBy("id_").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    given = given.filter("label = most AND label IN (0, 1)").drop("most")
    once = rows.filter("NOT base_failed AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("stratum", *MEASURES)).alias("m"))
    labelled = once.join(given, F.col("doc_id") == F.col("id_")).select("doc_id", "label", "m.*")
    holdout = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 1
    labelled = settle(labelled.select("stratum", holdout.alias("holdout"), "label", *[v.alias(r) for r, v in rule_values().items()]), "rule-labelled")
    proven = thresholds(labelled, limit, level).filter("cutoff IS NOT NULL")
    limits = proven.groupBy(F.col("stratum").alias("stratum_")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cut") for r in RULES])
    if proven.select("stratum").distinct().count() <= FEW_STRATA:
        limits = F.broadcast(limits)
    judged = rows.withColumns(rule_values()).join(limits, F.col("stratum") == F.col("stratum_"), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"{r}_cut"), F.lit(r)) for r in RULES]))
    return judged.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select(
        "doc_id", "stratum", *MEASURES, "base_failed", "failed", "kept"
    )
