"""Near-duplicates of word shingles: one-permutation MinHash, optimal densification, banded buckets, stars.

One hash of each shingle serves all bins: its range names the bin, and a bin keeps its least value. An
empty bin takes the value of a bin that a universal hash of (bin, attempt) points to, trying on until one
is filled, which keeps the chance of agreement at the Jaccard similarity. Texts that share all bins of a
band meet in a bucket. There, members are compared with the smallest id instead of with each other. Members left over, of
buckets that still hold several components, form families by their stars; a family is compared in square blocks, out of which
come a few edges, never pairs. So no pair of a bucket is left out, and links are always confirmed on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.components import connected_components, forest
from postmill.llm.shingles import mix, shingle_sets
from postmill.operators.settle import settle

ROWS = 5  # bins per band
MISS = 1e-6  # chance that a pair at the threshold meets in no band
ATTEMPTS = 1024
BLOCK = 256  # sets on each side of a block
STRIP = 4096  # shingles of a block multiplied at once


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signature of sorted distinct 64-bit hashes (at least one)."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # ascends with the hashes
    filled, first = np.unique(at.astype(np.int64), return_index=True)
    out, known = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[filled], known[filled] = hashes[first], True
    own, empty = known.copy(), np.flatnonzero(~known)
    for attempt in range(1, ATTEMPTS):
        if not len(empty):
            break
        to = (mix(empty.astype(np.uint64) * np.uint64(ATTEMPTS) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = own[to]
        out[empty[hit]] = out[to[hit]]
        empty = empty[~hit]
    out[empty] = hashes[0]  # practically never: no filled bin in all attempts
    return out


_STEPS = np.array([0x9FB21C651E98DF25, 0xAEF17502108EF2D9, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D], np.uint64)


def digest_type(bands: int, width: int):
    """Function of a text column: (n, high, low, bands): set size, a 128-bit digest of the set, band hashes."""
    kind = pa.struct([("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("n long, high long, low long, bands array<long>")
    def digest(texts: pa.Array) -> pa.Array:
        out = []
        for s in shingle_sets(texts.to_pylist(), width):
            if not len(s):
                out.append({"n": 0, "high": 0, "low": 0, "bands": []})
                continue
            rows = signature(s, bands * ROWS).reshape(bands, ROWS)
            keys = mix((rows * _STEPS).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
            high, low = mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64), mix(s ^ np.uint64(0x9E6C63D0876A9A35)).sum(dtype=np.uint64)
            out.append({"n": len(s), "high": int(high.view(np.int64)), "low": int(low.view(np.int64)), "bands": keys.view(np.int64).tolist()})
        return pa.array(out, kind)

    return digest


def set_function(width: int):
    @F.arrow_udf("array<long>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([s.view(np.int64) for s in shingle_sets(texts.to_pylist(), width)], pa.list_(pa.int64()))

    return hashed


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Full sets (id, hashes) of some documents, written once; repeated rows of an id count once."""
    texts = docs.join(ids.select("id").distinct().hint("merge"), F.col("doc_id") == F.col("id"), "left_semi")
    sets = texts.select(F.col("doc_id").alias("id"), set_function(width)(F.col("text")).alias("hashes"))
    # Different texts under one id stay apart.
    return settle(sets.withColumn("_set", F.xxhash64("hashes")).dropDuplicates(["id", "_set"]).drop("_set"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("_a")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return (
        pairs.join(left, "a").join(right, "b").withColumn("_both", both)
        .filter(100 * F.col("_both") >= percent * (F.size("_a") + F.size("_b") - F.col("_both"))).select("a", "b").distinct()
    )


def compare_block(kind, percent: int):
    """Function of the sets in one block: edges (a, b) of a spanning forest of the similar pairs.

    Intersections of all pairs are one product of indicator matrices over the shingles that occur twice, a strip
    of them at a time.
    """
    def compare(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        own, ids, n = t.column("own").to_numpy(), t.column("id").to_pylist(), t.column("n").to_numpy()
        lists = t.column("hashes").combine_chunks()
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy())
        _, token, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        twice = count[token] > 1
        row, token = row[twice], np.unique(token[twice], return_inverse=True)[1]
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        both = np.zeros((len(a), len(b)), np.float32)
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        for start in range(0, int(token[-1]) + 1 if len(token) else 0, STRIP):
            lo, hi = np.searchsorted(token, [start, start + STRIP])
            seen = np.zeros((len(ids), STRIP), np.float32)
            seen[row[lo:hi], token[lo:hi] - start] = 1
            both += seen[a] @ seen[b].T
        linked = (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)) & (both > 0) & (a[:, None] != b[None, :])
        edges = forest(linked, a, b)
        return pa.table({"a": pa.array([ids[x] for x, _ in edges], kind), "b": pa.array([ids[y] for _, y in edges], kind)})

    return compare


def links(reps: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Components (id, component) of distinct sets: ``reps`` has id, n and bands."""
    members = reps.select("id", "n", F.explode("bands").alias("bucket"))
    size = members.groupBy("bucket").agg(F.count("*").alias("k"), F.min_by(F.struct("id", "n"), "id").alias("c")).filter("k > 1")
    centres = size.select("bucket", F.col("c.id").alias("b"), F.col("c.n").alias("m"))
    # Every member beside the smallest id of its bucket: a star.
    stars = settle(members.join(centres, "bucket").filter(F.col("id") != F.col("b")), "stars")
    near = stars.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select(F.col("id").alias("a"), "b").distinct()
    pairs = settle(near, "pairs")
    confirmed = settle(_confirm(pairs, _sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), width), percent), "links")
    found = settle(connected_components(confirmed), "components")
    # Left are members whose bucket also has members of other components, centres aside.
    of = stars.join(found, "id", "left").select("id", "n", "bucket", F.coalesce("component", "id").alias("component"))
    several = of.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("id").alias("root")).filter("x <> y")
    left = settle(of.join(several.select("bucket", "root"), "bucket").select("id", "n", "root").distinct(), "left")
    if left.isEmpty():
        return found
    family = connected_components(left.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    rows = settle(left.select("id", "n").distinct().join(family.withColumnRenamed("component", "family"), "id"), "families")
    blocks = rows.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int"))
    full = placed.join(_sets(docs, rows, width), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = full.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", F.size("hashes").cast("bigint").alias("n"), "hashes")
    kind = dict(docs.dtypes)["doc_id"]
    arrow = pa.string() if kind == "string" else pa.int64()
    more = tiles.groupBy("family", "i", "j").applyInArrow(compare_block(arrow, percent), f"a {'string' if kind == 'string' else 'bigint'}, b {'string' if kind == 'string' else 'bigint'}")
    more = settle(more.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).distinct(), "links")
    return found if more.isEmpty() else settle(connected_components(confirmed.unionByName(more)), "components")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with ``100 * intersection >= percent * union`` of their distinct shingles are linked;
    component_id is the smallest id reachable, kept says that the document is it. Null and empty texts have
    no shingles and link with nothing, and so do rows without an id (kept, component null). Equal texts have one
    component, also under one repeated id. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    digest = digest_type(bands_for(percent), width)(F.col("text"))
    rows = settle(docs.select("doc_id", digest.alias("d")).select("doc_id", "d.*"), "minhash")
    linkable = rows.filter("n > 0 AND doc_id IS NOT NULL")
    reps = linkable.groupBy("n", "high", "low").agg(F.min("doc_id").alias("id"))
    reps = settle(reps, "reps")
    # Bands of each distinct set, from the row that stands for it.
    banded = linkable.join(reps.select(F.col("id").alias("doc_id"), "n", "high", "low"), ["doc_id", "n", "high", "low"]).select(F.col("doc_id").alias("id"), "n", "bands").distinct()
    found = links(banded, docs, percent, width)
    named = reps.join(found, "id", "left").select("n", "high", "low", F.coalesce("component", "id").alias("_component"))
    out = rows.drop("bands").join(named, ["n", "high", "low"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id WHERE r.c < e.y),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
