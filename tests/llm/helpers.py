"""Small hostile tables and plain versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string"


def rows_of(texts, source=None):
    """Documents with two extra columns whose names clash with outputs; ids from 1 on."""
    return [(i, t, "en", source(i) if source else f"s{i % 3}", len(t or ""), 7, "x") for i, t in enumerate(texts, 1)]


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary):x}" for _ in range(n)]


def hostile(spark, extra=()):
    """Nulls in every column, empty and blank texts, ties, repeated rows, one very long text."""
    rows = rows_of([None, "", " \t\n", "a", "same text here", "same text here", "x" * 70_000, " ".join(words(30_000, 1)), "é ü 𝛼 words here", *extra])
    rows += [rows[4], (None, None, None, None, None, None, None), (None, "text without an id", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, width=5):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def component_map(ids, edges):
    """Smallest reachable id of each id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
