import random
import re
from collections import Counter, defaultdict

import numpy as np

from postmill.llm import divergence
from tests.llm import helpers as h

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, top):
    """rows: (text, lang, source). The contract, term by term."""
    groups, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        groups[lang, source].update(found)
        langs[lang].update(found)
        docs[lang].update(set(found))
    out = set()
    for (lang, source), counts in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = share(counts), share(langs[lang])
        weight = lambda a, b: (a - b) ** 2 // b
        terms = sorted(((t, weight(p[t], q[t])) for t in kept if counts[t] and p[t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
        pairs = []
        for (l2, s2), c2 in groups.items():
            if l2 == lang and s2 != source:
                other = share(c2)
                pairs.append((s2, sum(weight(p[t], other[t]) for t in kept)))
        pairs.sort(key=lambda x: (-x[1], x[0].encode()))
        for part, found in (("term", terms), ("pair", pairs)):
            out |= {(lang, source, part, item, value, i) for i, (item, value) in enumerate(found, 1)}
    return out


def result(df, **more):
    rows = [tuple(r) for r in divergence.divergence(df, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_the_plain_rule(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):  # a third of all rows in one source; terms of very uneven frequency
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(90):02d}"
        rows.append((" ".join(f"Te{'abcdefghij'[int(rng.paretovariate(0.7)) % 10]}{'é' * rng.randrange(3)}" + ",1 " * rng.randrange(2) for _ in range(rng.randrange(40))), rng.choice(["en", "fr"]), source))
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    # More than 64 sources in a language take several tiles; a low k cuts every band.
    assert len({r[2] for r in rows if r[1] == "en"}) > divergence.TILE
    for top in (200, 3):
        assert result(df, top=top) == plain(rows, top)


def test_small_buckets_bands_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "BUFFER", 5)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 7)
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("ab") * rng.randrange(1, 12) for _ in range(30)), "en", f"s{i % 5}") for i in range(60)]
    assert result(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4), top=4) == plain(rows, 4)


def test_hostile_and_empty_tables(spark):
    df = h.hostile(spark, ["Same text HERE", "1 2 3", "ß ẞ İ ſ"])
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    assert result(df) == plain(rows, 200)
    assert result(h.empty(spark)) == set()
    no_terms = [("1 2", None, "a"), (None, None, None), ("", "", "b")]  # no kept term: pairs of value 0
    assert result(spark.createDataFrame(no_terms, "text string, lang string, source string")) == plain(no_terms, 200)
    clash = df.withColumnsRenamed({"size": "n", "score": "term", "n_chars": "value"})
    assert result(clash) == plain(rows, 200)


def test_skyband_of_random_rows_equals_the_definition():
    rng = np.random.default_rng(1)
    for k in (1, 3, 10):
        group, n, total, at = rng.integers(0, 3, 2000), rng.integers(1, 9, 2000), rng.integers(1, 30, 2000), rng.permutation(2000)
        got = set(divergence.skyband_rows(group, n, total, at, k))
        want = {i for i in range(2000) if ((group == group[i]) & (n >= n[i]) & (total <= total[i]) & (at < at[i])).sum() < k}
        assert got == want
    none = np.empty(0, np.int64)
    assert len(divergence.skyband_rows(none, none, none, none, 3)) == 0
