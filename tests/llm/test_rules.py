import math
import random
import re
import zlib

import numpy as np

from postmill.llm import rules
from tests.llm import helpers as h


def plain(text):
    text = text or ""
    w = h.WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + j for i, x in enumerate(windows) if x in twice for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if h.WORD.search(line):
            dup += line in seen
            seen.add(line)
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), base


CASES = [
    None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a", "a a a a", "x y z\n x y z\nx y z\n\n\n", "é ü 𝛼x <b> & |", "a\x0bb\x0cc\rd", "one two three four two three four five " * 20,
    "l1 l1\n" * 40 + "#" * 9, " ".join(h.words(30_000, 2, 50)), "x" * 70_000,
]


def test_measures_equal_the_plain_rule(spark):
    r = random.Random(1)
    cases = CASES + ["".join(r.choice("ab \n#é") for _ in range(r.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(cases)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in rules.quality_rules(df, labels).collect()}
    for i, t in enumerate(cases):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == plain(t), t and t[:40]
        assert x["kept"] == (not x["base_failed"])  # no labels, no cutoffs


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.3), (20, 0.05), (300, 0.01), (300, 0.4)):
        for k in {0, 1, n // 50, n // 10, n // 2, n - 1, n}:
            want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(rules.at_most(k, n, p), want, rel_tol=1e-9, abs_tol=1e-12)
    assert rules.at_most(100, 10**6, 0.01) < 1e-300 and rules.at_most(0, 0, 0.1) == 1.0


def test_cutoff_is_the_best_certified_one():
    cuts = [1.0, 2.0, 3.0]
    good = np.array([400, 90, 8, 2])  # 10 of 500 above 2, 2 above 3
    bad = np.array([10, 10, 40, 40])
    counts = {(True, 1): good, (False, 1): good, (True, 0): bad, (False, 0): bad}
    limit, level = 0.05, 0.01
    certified = [c for c, k in ((3.0, 2), (2.0, 10)) if rules.at_most(k, 500, limit) <= level]
    assert certified == [3.0, 2.0] and rules.at_most(100, 500, limit) > level
    assert rules.chosen_cutoff(cuts, counts, limit, level, cost=1)["cutoff"] == 2.0
    assert rules.chosen_cutoff(cuts, counts, limit, level, cost=30)["cutoff"] == 3.0  # the stricter one costs more than it is worth
    assert rules.chosen_cutoff(cuts, counts, 0.004, level)["cutoff"] is None  # the mildest fails already
    few = {**counts, (True, 1): np.array([20, 0, 0, 0])}
    assert rules.chosen_cutoff(cuts, few, limit, level)["cutoff"] is None  # too few to prove anything


def labelled_tables(spark, n, seed):
    """Good documents of plain words and bad ones of symbols, in three strata, one of them small."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad, lang = i % 5 == 0, ("en", "en", "fr", None)[i % 4] if i % 100 else "xx"
        docs.append((i, " ".join(w + ("&&" if bad and r.random() < 0.8 else "&" if r.random() < 0.01 else "") for w in h.words(80, i, 5000)), lang))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_false_rejections_stay_below_the_limit_and_bad_documents_go(spark):
    docs, labels = labelled_tables(spark, 6000, 7)
    fresh, truth = labelled_tables(spark, 3000, 8)
    fresh = [(i + 10_000, t, lang) for i, t, lang in fresh]
    df = spark.createDataFrame(docs + fresh, "doc_id long, text string, lang string")
    out = {x["doc_id"]: x for x in rules.quality_rules(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for lang in ("en", "fr", ""):
        good = [out[i + 10_000]["kept"] for (i, y), (_, _, g) in zip(truth, fresh) if y and (g or "") == lang]
        bad = [out[i + 10_000]["kept"] for (i, y), (_, _, g) in zip(truth, fresh) if not y and (g or "") == lang]
        assert sum(good) >= (1 - rules.LIMIT) * len(good) and (not bad or sum(bad) < 0.1 * len(bad)), lang
    assert all(out[i + 10_000]["kept"] for (i, _), (_, _, g) in zip(truth, fresh) if g == "xx")  # nothing can be proven there


def test_thresholds_equal_a_plain_search(spark):
    """Every candidate's exact test and worth, counted document by document."""
    docs, labels = labelled_tables(spark, 3000, 9)
    r = random.Random(2)
    rows = [("en", bool(zlib.crc32(str(i).encode()) % 2), y, *[float(r.randrange(20) + (8 if y == 0 and j < 2 else 0)) for j in range(len(rules.RULES))]) for i, y in labels]
    ddl = "stratum string, holdout boolean, label int, " + ", ".join(f"{n} double" for n in rules.RULES)
    got = {x["rule"]: x for x in rules.thresholds(spark.createDataFrame(rows, ddl)).collect()}
    assert set(got) == set(rules.RULES)
    limit, level = rules.LIMIT / len(rules.RULES), rules.LEVEL / len(rules.RULES)
    for j, rule in enumerate(rules.RULES):
        values = {(hold, y): [x[3 + j] for x in rows if x[1] == hold and x[2] == y] for hold in (True, False) for y in (0, 1)}
        cuts = sorted(set(values[False, 0]) | set(values[False, 1]))
        best, worth = None, 0.0
        for c in reversed(cuts):
            above = {k: sum(v > c for v in vs) for k, vs in values.items()}
            if rules.at_most(above[True, 1], len(values[True, 1]), limit) > level:
                break
            w = above[False, 0] / len(values[False, 0]) - rules.COST * above[False, 1] / len(values[False, 1])
            if w > worth:
                best, worth = c, w
        assert got[rule]["cutoff"] == best and got[rule]["n_good"] == len(values[True, 1])
    assert got["symbols"]["cutoff"] is not None


def test_hostile_and_empty_tables(spark):
    df = h.hostile(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (8, 1), (8, 1)], "doc_id long, quality int")
    out = rules.quality_rules(df, labels).collect()
    assert sorted((str(x["doc_id"]), x["n_words"]) for x in out) == sorted((str(r["doc_id"]), plain(r["text"])[0]) for r in df.collect())
    assert rules.quality_rules(h.empty(spark), labels).count() == 0
    clash = df.withColumnsRenamed({"size": "n_words", "score": "stratum", "n_chars": "kept"})
    assert sorted(map(str, rules.quality_rules(clash, labels).collect())) == sorted(map(str, out))
