"""How the sources of a language differ: per pair of sources, and the terms a source has more of than its language.

All arithmetic is on integers. A group is (lang, source); a term is kept where at least ``min_docs`` documents of the
language have it. A term's share p in a group is 1 + floor(10^9 (count + 1) / (N + V)), N the group's occurrences of
kept terms, V the number of kept terms; q is the share in the language, or in another source. A term weighs
floor((p - q)^2 / q).

* Terms: a term that ``k`` others of the group dominate (at least as frequent in the group, at most as frequent in the
  language, earlier in UTF-8) cannot be among the first k, as the weight rises with p and falls with q. Every partition
  keeps the skyband of its terms (those with fewer than k dominators), skybands are merged, and what is left is
  weighed and ranked.
* Pairs: the sum over all kept terms is V times the weight of a term that both lack, plus what a count in either source
  adds while the other has none (from the source's histogram of counts), plus a correction for terms both have. Only
  the last needs terms to meet; they do in tiles of 64 x 64 sources and a bucket of terms, which give one sum per pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.tokens import LETTERS, binary, raw, words
from postmill.operators.settle import settle
from postmill.operators.skew import top_n_per_key

SCALE = 1_000_000_000
HELD = 800_000  # entries of (group, term) and (language, term) a counting task holds before it passes them on
BUFFER = 300_000  # rows a task holds before it cuts them down to their skybands
TILE = 64  # sources on one side of a tile
BUCKET_ROWS = 100_000  # rows of a term bucket, about
OUT = ("lang", "source", "part", "item", "value", "rank")


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n (occurrences), total (those of the language) and docs (documents of the language with the term).

    A row without a source stands for the term in its language; every group has a row with an empty term. Each task sums its
    documents and passes on one row per (lang, term) with its counts by source, so one exchange brings all counts of a term
    together, where they are summed per source and over sources.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[str, dict[str, Counter]] = {}
        documents: dict[str, Counter] = {}

        def rows():
            for lang_, by_source in occurrences.items():
                by_source = {None: documents[lang_], **by_source}
                for found in by_source.values():
                    found[b""] += 0
                terms = binary([t for found in by_source.values() for t in found]).dictionary_encode()
                code = terms.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(by_source), dtype=np.int32), [len(f) for f in by_source.values()])[order], pa.array(list(by_source), pa.string()))
                n = pa.array(np.fromiter((x for found in by_source.values() for x in found.values()), np.int64)[order])
                starts = np.searchsorted(code[order], np.arange(len(terms.dictionary) + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([names.cast(pa.string()), n], names=["source", "n"]))
                for start in range(0, len(found), 20_000):
                    part = found.slice(start, 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(part), pa.string()), terms.dictionary.slice(start, 20_000), part], names=["lang", "term", "found"])
            occurrences.clear()
            documents.clear()

        held = 0
        for b in batches:
            for lang_, source_, data in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                found = words(data, LETTERS)
                n, d = occurrences.setdefault(lang_, {}).setdefault(source_, Counter()), documents.setdefault(lang_, Counter())
                held -= len(n) + len(d)
                n.update(found)
                d.update(set(found))
                held += len(n) + len(d)
                if held > HELD:
                    yield from rows()
                    held = 0
        yield from rows()

    named = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), raw(F.col(text)).alias("text")
    )
    dealt = named.mapInArrow(count, "lang string, term binary, found array<struct<source: string, n: long>>").repartition("lang", "term")
    flat = dealt.select("lang", F.col("term"), F.inline("found"))
    summed = flat.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("lang", "term")
    return summed.withColumns({
        "total": F.coalesce(F.sum(F.expr("IF(source IS NOT NULL, n, 0)")).over(whole), F.lit(0)), "docs": F.coalesce(F.sum(F.expr("IF(source IS NULL, n, 0)")).over(whole), F.lit(0)),
    }).withColumn("term", F.col("term").cast("string"))


def skyband_rows(group: np.ndarray, n: np.ndarray, total: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that fewer than k others of their group dominate: n at least as high, total at most as high, ``at`` lower.

    Of rows equal in n and total only the first k can stay. Dominators come first in the order of (n falling, total, at), and it
    is enough to count those that are kept: what a dropped row dominates, its k dominators dominate as well.
    """
    order = np.lexsort((at, total, -n, group))
    g, n_, t_ = group[order], n[order], total[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (n_[1:] != n_[:-1]) | (t_[1:] != t_[:-1])
    starts = np.flatnonzero(new)
    order = order[np.arange(len(order)) - starts[np.cumsum(new) - 1] < k] if len(order) else order
    kept: list[np.ndarray] = []
    for rows_of in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(rows_of) <= k:  # too few for anyone to have k dominators
            kept.append(rows_of)
            continue
        band = rows_of[:k]
        for start in range(k, len(rows_of), 256):
            rows = rows_of[start : start + 256]
            before = ((total[band][None, :] <= total[rows][:, None]) & (at[band][None, :] < at[rows][:, None])).sum(1)
            rows, before = rows[before < k], before[before < k]
            inside = np.tril((total[rows][None, :] <= total[rows][:, None]) & (at[rows][None, :] < at[rows][:, None]), -1)
            taken = before + inside.sum(1) < k  # these stay whichever of the chunk do
            for i in np.flatnonzero(~taken):
                taken[i] = before[i] + np.count_nonzero(inside[i] & taken) < k
            band = np.concatenate([band, rows[taken]])
        kept.append(band)
    return np.concatenate(kept) if kept else order


def skyband(counted: DataFrame, k: int) -> DataFrame:
    """The k-skyband of each group's rows within each partition; rows are lang, source, term, n, total."""

    def reduced(table: pa.Table) -> pa.Table:
        code = lambda c: table.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.empty(len(table), np.int64)
        at[pc.sort_indices(table.column("term")).to_numpy()] = np.arange(len(table))  # by bytes, so in UTF-8 order
        group = code("lang") * (1 << 32) + code("source")
        return table.take(pa.array(np.sort(skyband_rows(group, table.column("n").to_numpy(), table.column("total").to_numpy(), at, k))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(map(len, held)) > BUFFER:
                held = [reduced(pa.concat_tables(held))]
                if len(held[0]) > BUFFER // 2:  # many groups: what they keep is passed on
                    yield from held[0].combine_chunks().to_batches()
                    held = []
        if held:
            yield from reduced(pa.concat_tables(held)).combine_chunks().to_batches()

    return counted.select("lang", "source", "term", "n", "total").mapInArrow(cut, "lang string, source string, term string, n long, total long")


def _share(n, size, kept) -> Column:
    """1 + floor(10^9 (n + 1) / (size + kept)), exact also beyond 64 bits; null without kept terms."""
    return F.expr(f"IF({kept} > 0, 1 + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0)) div CAST(greatest({size} + {kept}, 1) AS DECIMAL(20, 0)), NULL)")


def _weight(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _shared_terms(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: what terms that both sources have add beyond the two one-sided sums."""
    numbered = groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    numbered = settle(numbered.withColumn("tiles", F.expr(f"(count(*) OVER (PARTITION BY lang) + {TILE - 1}) div {TILE}")), "divergence-sources")
    rows = counted.join(numbered.select("lang", "source", "s", "tiles", "zero", "size", "kept"), ["lang", "source"])
    rows = rows.withColumn("p", _share("n", "size", "kept"))
    buckets = max(1, -(-counted.count() // BUCKET_ROWS))
    tile = F.expr(f"s div {TILE}")
    dealt = (
        rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
        .select(
            "lang", F.least(tile, "other").alias("u"), F.greatest(tile, "other").alias("v"), F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"),
            "term", F.col("s").cast("long").alias("s"), "p", "zero",
        )
    )

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        u, v = key[1].as_py(), key[2].as_py()
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        term = term[order]
        s, p, zero = (rows.column(c).to_numpy()[order] for c in ("s", "p", "zero"))
        first, last = np.searchsorted(term, term, "left"), np.searchsorted(term, term, "right")
        ends = np.cumsum(last - first)
        local = np.where(s // TILE == u, s % TILE, TILE + s % TILE)
        total, seen = np.zeros(4 * TILE * TILE, np.int64), np.zeros(4 * TILE * TILE, bool)
        start = 0
        while start < len(s):  # at most some 2^20 pairs at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), "right")))
            a = np.repeat(np.arange(start, stop), (last - first)[start:stop])
            b = np.arange(len(a)) - np.repeat(np.cumsum((last - first)[start:stop]) - (last - first)[start:stop], (last - first)[start:stop]) + first[a]
            meets = (a != b) & ((u == v) | (s[a] // TILE != s[b] // TILE))
            a, b = a[meets], b[meets]
            w = lambda x, y: (x - y) * (x - y) // y
            value = w(p[a], p[b]) - w(p[a], zero[b]) - w(zero[a], p[b]) + w(zero[a], zero[b])
            cell = local[a] * 2 * TILE + local[b]
            np.add.at(total, cell, value)
            seen[cell] = True
            start = stop
        cells = np.flatnonzero(seen)
        back = lambda x: np.where(x < TILE, u * TILE + x, v * TILE + x - TILE)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(cells), pa.string()), "a": pa.array(back(cells // (2 * TILE)), pa.int64()),
            "b": pa.array(back(cells % (2 * TILE)), pa.int64()), "value": pa.array(total[cells], pa.int64()),
        })

    met = dealt.groupBy("lang", "u", "v", "bucket").applyInArrow(meet, "lang string, a long, b long, value long")
    sums = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = lambda n, as_: numbered.select("lang", F.col("s").cast("long").alias(n), F.col("source").alias(as_))
    return sums.join(names("a", "source"), ["lang", "a"]).join(names("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def divergence(docs: DataFrame, top: int = 200, min_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` ranks the other sources of the language by how far they are
    from the source, part ``term`` the first ``top`` terms that the source has more of than the language.

    Null text, lang and source count as ''; a group whose texts have no terms takes part in pairs; where a language
    keeps no term, its pairs have value 0. Ties rank by UTF-8. Repeated rows count as documents of their own. A table
    without rows gives none. Other columns are not read, whatever their names.
    """
    counts = term_counts(docs, text, lang, source).filter((F.col("term") == "") | (F.col("docs") >= min_docs))
    counts = settle(counts.select("lang", "source", "term", "n", "total"), "divergence-counts")
    counted = counts.filter("source IS NOT NULL AND term <> ''")
    langs = counts.filter("source IS NULL AND term <> ''").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    sizes = counted.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.filter("source IS NOT NULL AND term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["size", "kept", "lang_size"]).withColumn("zero", _share("0", "size", "kept"))
    groups = settle(groups, "divergence-groups")

    band = skyband(counted, top)
    # The second round sees each group's bands in a few places, wherever its terms were.
    band = skyband(band.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(8))), top)
    weighed = band.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "size", "kept"), "q": _share("total", "lang_size", "kept")}).filter("p > q")
    weighed = weighed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_weight("p", "q")).alias("value"))
    terms = top_n_per_key(weighed, ["lang", "source"], [F.col("value").desc(), F.col("item")], top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"))
    base = groups.join(other, "lang").filter("source <> item").select(
        "lang", "source", "item", F.expr(f"coalesce(kept * {_weight('zero', 'zero_b')}, 0)").alias("value")
    )
    histogram = counted.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"]).withColumn("p", _share("n", "size", "kept"))
    sides = histogram.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.expr(f"terms * ({_weight('p', 'zero_b')} - {_weight('zero', 'zero_b')})")).alias("here"),
        F.sum(F.expr(f"terms * ({_weight('zero_b', 'p')} - {_weight('zero_b', 'zero')})")).alias("there"),
    )
    one_side = sides.select("lang", F.explode(F.array(
        F.struct("source", "item", F.col("here").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("there").alias("value")),
    )).alias("x")).select("lang", "x.*")
    pairs = base.unionByName(one_side).unionByName(_shared_terms(counted, groups)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return terms.unionByName(pairs.withColumns({"part": F.lit("pair"), "rank": place})).select(*OUT)


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT d, lang, source, unnest(ws) AS term FROM w),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
l AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS nl FROM k GROUP BY 1),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
g AS (SELECT x.lang, x.source, coalesce(l.v, 0) AS v, coalesce(l.nl, 0) AS nl, coalesce(s.size, 0) AS size FROM (SELECT DISTINCT lang, source FROM w) x
  LEFT JOIN l ON l.lang = x.lang LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS size FROM c GROUP BY 1, 2) s ON s.lang = x.lang AND s.source = x.source),
p AS (SELECT g.lang, g.source, k.term, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.size + g.v) AS p FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT k.lang, k.term, 1 + 1000000000 * (k.total + 1) // (l.nl + l.v) AS q FROM k JOIN l ON l.lang = k.lang),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term
  JOIN c ON c.lang = p.lang AND c.source = p.source AND c.term = p.term WHERE p.p > q.q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
