import hashlib
import random

import pytest
from pyspark.sql import functions as F

from postmill.llm import decontaminate, suffixes
from tests.llm.helpers import SCHEMA, empty, hostile, rows_of, words


def plain_removal(rows):
    """Per row: bytes covered by a 50-byte string that also starts in a smaller document."""
    bodies = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in bodies:
        for p in range(len(b) - 49) if i is not None else ():
            s = b[p:p + 50]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removal(docs):
    return sorted((tuple(r) for r in suffixes.repeat_digest(docs).collect()), key=str)


def passages(seed):
    r = random.Random(seed)
    shared = [" ".join(words(r.randrange(4, 60), 90 + i)) for i in range(6)] + ["é" * 60, "ab" * 80, "x" * 49, "y" * 50]
    texts = []
    for i in range(120):
        parts = [" ".join(words(r.randrange(0, 40), 10_000 * seed + i))]
        for _ in range(r.randrange(4)):
            s = r.choice(shared)
            a = r.randrange(len(s))
            parts.insert(r.randrange(len(parts) + 1), s if r.random() < 0.5 else s[a:])
        texts.append(r.choice([" ", "", "\n"]).join(parts))
    return texts + texts[:5]


@pytest.mark.parametrize("bucket", [8 << 20, 4000])
def test_repeats_as_plain_search(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    rows = rows_of(passages(3))
    random.Random(1).shuffle(rows)
    assert removal(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain_removal([r[:2] for r in rows])


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    rows = rows_of(passages(4) + [" ".join(words(900, 7))[a:] for a in (0, 1, 333)])
    assert list(suffixes.pieces([1], [0], [b"z" * 349]))[0][0].size == 349
    big = rows_of([" ".join(words(900, 7))[a:] for a in (0, 1, 333)])
    assert _local(big) == plain_removal([r[:2] for r in big])


def _local(rows):
    """The two comparisons without Spark, with the pieces of this process."""
    import numpy as np

    lost = {r[0]: set() for r in rows}
    seen = []
    for raw, edges, doc, _, at in suffixes.pieces([r[0] for r in rows], [0] * len(rows), [r[1].encode() for r in rows]):
        _, first, last, _ = suffixes.blocks(raw, edges)
        for f, l in zip(first, last):
            of = int(np.searchsorted(edges, f, "right")) - 1
            for p in range(f, l + 1):
                seen.append((raw[p:p + 50].tobytes(), int(doc[of]), int(p - edges[of] + at[of])))
    least = {}
    for s, d, _ in seen:
        least[s] = min(d, least.get(s, d))
    for s, d, p in seen:
        if least[s] < d:
            lost[d].update(range(p, p + 50))
    out = []
    for i, t, *_ in rows:
        b = t.encode()
        runs = sum(1 for k in lost[i] if k - 1 not in lost[i])
        out.append((i, len(b), len(lost[i]), runs, hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in lost[i])).hexdigest()))
    return sorted(out, key=str)


def test_repeats_hostile_rows(spark):
    long = "p" * 55
    docs = hostile(spark, [long, long + "q", long]).unionByName(spark.createDataFrame([(12, "other text under one id " + long, None, None, None, None, None)], SCHEMA))
    assert removal(docs) == plain_removal([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert removal(empty(spark)) == []


def plain_contamination(texts, items, masks=decontaminate.MASKS):
    import re

    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    span, out = len(masks[0]), []
    for t in texts:
        w, found = split(t), []
        for item, text in items:
            v = split(text)
            hits = {i - j for m in masks for i in range(len(w) - span + 1) for j in range(len(v) - span + 1) if all(w[i + o] == v[j + o] for o in range(span) if m[o] == "1")}
            n = min(len(v), decontaminate.STRETCH)
            for s in hits:
                same = [0 <= k + s < len(w) and w[k + s] == x for k, x in enumerate(v)]
                if any(100 * sum(same[k:k + n]) >= decontaminate.SIMILAR * n for k in range(len(v) - n + 1)):
                    found.append(item)
                    break
        out.append(sorted(found))
    return out


def test_contamination_as_plain_search(spark):
    r = random.Random(6)
    items = [(i, " ".join(words(r.choice([4, 9, 11, 30]), 50 + i, 60))) for i in range(12)] + [(None, "no id"), (40, None), (41, "")]
    texts = []
    for i in range(80):
        w = words(r.randrange(60), 500 + i, 60)
        for _ in range(r.randrange(3)):
            v = (items[r.randrange(12)][1]).split()
            for _ in range(r.randrange(5)):
                v[r.randrange(len(v))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = v[r.randrange(3):]
        texts.append(", ".join(w).title())
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_items int")
    got = {x["doc_id"]: x for x in decontaminate.contamination(docs, bench).collect()}
    want = plain_contamination(texts, [x for x in items if x[0] is not None])
    assert [got[i + 1]["items"] for i in range(len(texts))] == want and sum(map(bool, want)) > 20
    kept = decontaminate.decontaminated(docs, bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == [i + 1 for i, w in enumerate(want) if not w] and kept.schema == docs.schema


def test_contamination_hostile_rows(spark):
    text = " ".join(words(30, 3))
    docs = hostile(spark, [text, "before " + text, text]).unionByName(spark.createDataFrame([(None, text, None, None, None, None, None), (10, "other", None, None, None, None, None)], SCHEMA))
    bench = spark.createDataFrame([(1, text), (1, text), (2, None)], "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == docs.count() and sum(r["contaminated"] for r in got) == 4
    assert all(r["items"] == ([1] if r["contaminated"] else []) and r["n_items"] == len(r["items"]) for r in got)
    assert sum(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect()) == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_splitters_sample_copies_apart(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLE_BYTES", 1000)
    for text_hash in range(0, 40, 4):
        texts = spark.range(2000).select(F.col("id").alias("doc"), F.lit(text_hash).alias("text_hash"))
        assert 150 < suffixes.splitter_texts(texts, 8000).count() < 350


def test_whole_search_as_the_rule_without_masks(spark):
    from itertools import combinations

    items, texts = [], []
    for n in (1, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13):
        v = [f"q{n}x{k}" for k in range(n)]
        items.append((n, " ".join(v)))
        for wrong in {(), *combinations(range(n), max(0, n // 5)), *combinations(range(n), n // 5 + 1)}:
            texts.append((n, wrong, " ".join(["before", *("changed" if k in wrong else w for k, w in enumerate(v)), "after"])))
    long = [f"long{k}" for k in range(20)]
    items.append((20, " ".join(long)))
    for n_wrong in (2, 3):
        for wrong in combinations(range(13), n_wrong):
            texts.append((20, wrong, " ".join("changed" if k in wrong else w for k, w in enumerate(long[4:17]))))
    docs = spark.createDataFrame(rows_of([t for *_, t in texts]), SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x["items"] for x in decontaminate.contamination(docs, bench, whole=True).collect()}
    for i, (n, wrong, _) in enumerate(texts, 1):
        m = min(n, 13)
        assert got[i] == ([n] if 100 * (m - len(wrong)) >= 80 * m else []), (n, wrong)


@pytest.mark.parametrize("whole", [False, True])
def test_seeds_too_many_to_broadcast(spark, monkeypatch, whole):
    monkeypatch.setattr(decontaminate, "FEW_SEEDS", 0)
    item = " ".join(words(40, 9))
    long = words(20_000, 10, 4000)
    long[15_000:15_020] = item.split()[5:25]
    texts = [" ".join(long), " ".join(words(30, 11)), "before " + item + " after", None, ""]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    bench = spark.createDataFrame([(1, item), (2, item), (3, " ".join(words(40, 12))), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs, bench, whole=whole).collect()}
    assert got == {1: [1, 2], 2: [], 3: [1, 2], 4: [], 5: []}
    wide = [(s, f"s{s}") for s in (-(1 << 63), -1, 0, 1, 5 << 57, (1 << 63) - 1)]
    seeds = spark.createDataFrame(wide, "seed long, name string")
    bits = {r["slot"]: r["bits"] for r in decontaminate.marked(seeds).collect()}
    where = seeds.select(decontaminate.slot_of(F.col("seed")), decontaminate.word_of(F.col("seed")), decontaminate.bit_of(F.col("seed"))).collect()
    assert all(bits[slot][w] >> b & 1 for slot, w, b in where)


def test_words_do_not_travel_with_positions(spark, monkeypatch, capsys):
    monkeypatch.setattr(decontaminate, "FEW_SEEDS", 0)
    docs = spark.createDataFrame(rows_of(["a b c d e f g h i j k"]), SCHEMA)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    seen, settle = {}, decontaminate.settle
    monkeypatch.setattr(decontaminate, "settle", lambda df, label: (seen.update({label: df}), settle(df, label))[1])
    decontaminate.overlaps(docs, bench).collect()
    seen["hits"].explain()
    exchanges = [line for line in capsys.readouterr().out.splitlines() if "Exchange" in line]
    assert exchanges and not any("words" in line for line in exchanges)
