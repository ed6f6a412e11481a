"""Embedding near-duplicates: spherical k-means cells, a sieve of short sketches, blocked cosine products inside cells, one kept per group.

Equal vectors count as one with a weight. A vector's home is the cell of its nearest centre. It also
visits every cell whose bounding plane lies within half the longest chord of a link, sqrt((1 - cosine) / 2). The two
of a linked pair are no farther apart than that chord, so at least one of them visits the other's cell, whatever the
number of dimensions and however the vectors are spread: no link is missed.

Vectors that point in all directions visit nearly all cells, so visits are sieved before a vector is copied. A sketch is
the vector's part along the directions in which the centres differ most, and the length of the rest: products of two
sketches are never below the cosine. Rounded to a byte a number they lose at most ``ROUNDED``. Sketches meet in tiles of two regions of
the cells; a vector goes on to a cell only if a sketch at home there is near enough, and most go nowhere.

Each cell compares those at home with all that are there, in square blocks that are tasks of their own, so a cell of any size is split.
Out of a block come link counts and the edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

import functools
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.components import connected_components, forest
from postmill.operators.settle import settle

MOST_CELLS = 4096
PER_CELL = 32  # sampled vectors per centre: some MOST_CELLS * PER_CELL vectors are fitted at most
ROUNDS = 12
SLACK = 1e-7  # more than rounding takes off the distance of two centres
BLOCK = 4096  # vectors on each side of a block
STRIP = 512  # rows multiplied at once
SKETCH = 32  # numbers of a sketch, one byte each
ROUNDED = 2.05 * math.sqrt(SKETCH) / 254  # two sketches, half a step off in every number
REGIONS = 12  # a sketch is copied once per region
PER_REGION = 16_384, 2_000_000  # vectors: tables below REGIONS times the first have fewer regions, above the second more
HELD = 8192  # sketches a task holds before it hands them on


def unit(arrays: pa.ListArray) -> np.ndarray:
    """Rows of one dimension, in double precision, of length 1."""
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(arrays), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Strips of vectors of one dimension each."""
    for b in batches:
        sizes = pc.list_value_length(b.column("embedding"))
        for d in pc.unique(sizes).to_pylist():
            part = b.filter(pc.equal(sizes, d))
            for s in range(0, part.num_rows, STRIP):
                yield d, part.slice(s, STRIP)


SUMS = "size int, cell int, sums array<double>"


def _sums(held: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(held), STRIP):
        keys = list(held)[at:at + STRIP]
        lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(held[k]) for k in keys])].astype(np.int32), pa.array(np.concatenate([held[k] for k in keys])))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), lists], names=["size", "cell", "sums"])


def moved(sample: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Centres after a round: a task sums its vectors by their nearest centre, sums of one centre are put together."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for d, part in _by_size(batches):
            x = unit(part.column("embedding"))
            home = (x @ centres[d].T).argmax(1)
            for c in np.unique(home):
                held[d, int(c)] = held.get((d, int(c)), 0) + x[home == c].sum(0)
        yield from _sums(held)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            sums = b.column("sums")
            for i, k in enumerate(zip(b.column("size").to_pylist(), b.column("cell").to_pylist())):
                held[k] = held.get(k, 0) + sums[i].values.to_numpy()
        yield from _sums(held)

    out = {d: c.copy() for d, c in centres.items()}
    # Only one row per centre comes to the driver; a centre without vectors keeps its place.
    got = sample.mapInArrow(nearest, SUMS).repartition("size", "cell").mapInArrow(together, SUMS).toArrow()
    lists = got.column("sums").combine_chunks()
    for i, (d, c) in enumerate(zip(got.column("size").to_pylist(), got.column("cell").to_pylist())):
        total = lists[i].values.to_numpy()
        length = np.linalg.norm(total)
        if length > 1e-12:
            out[d][c] = total / length
    return out


def _fit(vectors: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centres by dimension with their shares of the vectors, by rounds of Lloyd on Spark over a bounded sample; the first of it in hash order are the first centres."""
    cells = min(MOST_CELLS, max(1, math.ceil(math.sqrt(n) / 2)))
    h = F.xxhash64("embedding")
    sample = settle(vectors.filter(F.pmod(h, F.lit(n)) < cells * PER_CELL).select("embedding", h.alias("h"), F.size("embedding").alias("size")), "sample")
    keys = sample.select("size", "h").toPandas().sort_values("h")
    first = {d: set(g["h"].head(max(1, cells * len(g) // len(keys))).tolist()) for d, g in keys.groupby("size")}
    chosen = pa.array(sorted(set().union(*first.values())), pa.int64())

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.is_in(b.column("h"), value_set=chosen))

    rows = sample.mapInArrow(starts, sample.schema).orderBy("h").toArrow()
    centres = {d: unit(rows.filter(pc.equal(rows.column("size"), d)).column("embedding").combine_chunks()) for d in first}
    for _ in range(ROUNDS):
        centres = moved(sample, centres)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in _by_size(batches):
            cells, counts = np.unique((unit(part.column("embedding")) @ centres[d].T).argmax(1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), d), pa.int32()), pa.array(cells, pa.int32()), pa.array(counts, pa.int64())], names=["size", "cell", "n"])

    held = {d: np.zeros(len(c)) for d, c in centres.items()}
    for d, c, k in sample.mapInArrow(homes, "size int, cell int, n long").groupBy("size", "cell").agg(F.sum("n")).collect():
        held[d][c] = k
    return {d: (c, held[d] / held[d].sum()) for d, c in centres.items()}


class Cells:
    """Cells of one dimension: centres, the directions of sketches, and regions of about equal numbers of vectors."""

    def __init__(self, d: int, fitted: tuple[np.ndarray, np.ndarray] | None, regions: int):
        self.centres = fitted[0] if fitted else None
        self.regions = regions
        self.ends = np.r_[0, np.minimum(np.cumsum(fitted[1]), 1)] if fitted else np.array([0.0, 1.0])
        axes = np.linalg.svd(self.centres, full_matrices=False)[2] if fitted else np.eye(min(d, SKETCH), d)
        self.axes = axes[:SKETCH - 1]
        first, last = self._region(self.ends[:-1]), self._region(self.ends[1:])
        self.span = [(int(at.min()), int(at.max()) + 1) if len(at) else (0, 0) for at in (np.flatnonzero((first <= r) & (last >= r)) for r in range(regions))]

    def _region(self, at: np.ndarray) -> np.ndarray:
        return np.minimum((at * self.regions).astype(np.int64), self.regions - 1)

    def region(self, home: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Cells lie side by side on a line, a vector at a scattered place of its cell's stretch; so large cells have several regions."""
        scattered = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / 2.0**53
        return self._region(np.minimum(self.ends[home] + scattered * (self.ends[home + 1] - self.ends[home]), self.ends[home + 1]))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        part = x @ self.axes.T
        rest = np.sqrt(np.maximum(0, 1 - (part * part).sum(1)))
        out = np.zeros((len(x), SKETCH), np.int8)
        out[:, :part.shape[1]] = np.rint(part * 127)
        out[:, -1] = np.rint(rest * 127)
        return out


def met(x: np.ndarray, visits: np.ndarray, span: tuple[int, int], y: np.ndarray, home: np.ndarray, least: float, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By cell of ``span``: rows of ``x`` that visit it and rows of ``y`` at home there whose sketches are near; with ``same``, x and y are one table."""
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(span[0], span[1] + 1))
    place_of = np.full(len(x), -1)
    for c in range(*span):
        there = order[cuts[c - span[0]]:cuts[c - span[0] + 1]]
        byte, bit = divmod(c - span[0], 8)
        who = np.flatnonzero(visits[:, byte] >> (7 - bit) & 1) if len(there) else there
        if not len(who):
            continue
        near_x, near_y = np.zeros(len(who), bool), np.zeros(len(there), bool)
        for t in range(0, len(there), BLOCK):
            others = there[t:t + BLOCK]
            b = np.ascontiguousarray(y[others].T)
            if same:
                place_of[:] = -1
                place_of[others] = np.arange(len(others))
            for s in range(0, len(who), STRIP):
                rows = who[s:s + STRIP]
                dots = x[rows] @ b
                if same:
                    itself = np.flatnonzero(place_of[rows] >= 0)
                    dots[itself, place_of[rows[itself]]] = -np.inf
                if dots.max() >= least:
                    near = dots >= least
                    near_x[s:s + STRIP] |= near.any(1)
                    near_y[t:t + BLOCK] |= near.any(0)
        if near_x.any():
            yield c, who[near_x], there[near_y]


TILES = "size int, i int, j int, side int, keys binary, homes binary, sketches binary, visits binary"


def sieved(distinct: DataFrame, cells: dict[int, Cells], regions: int, reach: float, cosine: float) -> DataFrame:
    """(key, size, home, cell): the cells a vector visits, its own included, where a sketch of another one is near; no link is lost."""
    least = (cosine - ROUNDED) * 127 * 127
    alone = functools.partial(Cells, fitted=None, regions=regions)  # a dimension too rare for the sample is one cell

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int, int], list[tuple[bytes, ...]]] = {}

        def hand_on() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int32()) for c in zip(*held)]
            blobs = [[b"".join(p) for p in zip(*parts)] for parts in held.values()]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.binary()) for c in zip(*blobs)]], names=["size", "i", "j", "side", "keys", "homes", "sketches", "visits"])

        rows = 0
        for d, part in _by_size(batches):
            own = cells.get(d) or alone(d)
            x = unit(part.column("embedding"))
            home, visits = place(x, own.centres, reach)
            key = part.column("key").to_numpy()
            sketch, region = own.sketch(x), own.region(home, key)
            packed = [np.packbits(visits[:, lo:hi], axis=1) for lo, hi in own.span]
            for r in np.unique(region):
                at = np.flatnonzero(region == r)
                common = key[at].tobytes(), home[at].astype(np.int32).tobytes(), sketch[at].tobytes()
                for other in range(regions):
                    tile = (d, int(min(r, other)), int(max(r, other)), int(r > other))
                    held.setdefault(tile, []).append((*common, packed[other][at].tobytes()))
            rows += len(key)
            if rows >= HELD:
                yield hand_on()
                held.clear()
                rows = 0
        if held:
            yield hand_on()

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        d, i, j = (k.as_py() for k in key)
        own = cells.get(d) or alone(d)

        def side(k: int, span: tuple[int, int]) -> tuple[np.ndarray, ...]:
            part = t.filter(pc.equal(t.column("side"), k))
            keys, homes, sketches, visits = (b"".join(part.column(c).to_pylist()) for c in ("keys", "homes", "sketches", "visits"))
            # Products of 32 bytes are below 2^24: single precision adds them without rounding.
            x = np.frombuffer(sketches, np.int8).reshape(-1, SKETCH).astype(np.float32)
            return np.frombuffer(keys, np.int64), np.frombuffer(homes, np.int32), x, np.frombuffer(visits, np.uint8).reshape(len(x), -(-(span[1] - span[0]) // 8))

        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], span: tuple[int, int], same: bool) -> None:
            for c, who, there in met(a[2], a[3], span, b[2], b[1], least, same):
                out.extend((s[0][at], s[1][at], np.full(len(at), c)) for s, at in ((a, who), (b, there)))

        left = side(0, own.span[j])
        if i == j:
            add(left, left, own.span[i], True)
        else:
            right = side(1, own.span[i])
            add(left, right, own.span[j], False)
            add(right, left, own.span[i], False)
        keys, homes, at = (np.concatenate(c) if out else np.zeros(0) for c in (zip(*out) if out else ((), (), ())))
        return pa.table({"key": pa.array(keys, pa.int64()), "size": pa.array(np.full(len(keys), d), pa.int32()), "home": pa.array(homes, pa.int32()), "cell": pa.array(at, pa.int32())})

    # A fixed number of partitions: tiles are small but long to compare, and would be put together by their size.
    tiles = distinct.select("key", "embedding").mapInArrow(sketched, TILES).repartition(2 * regions * (regions + 1), "size", "i", "j")
    return tiles.groupBy("size", "i", "j").applyInArrow(compare, "key long, size int, home int, cell int")


def place(x: np.ndarray, centres: np.ndarray | None, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and a matrix of the cells it visits."""
    if centres is None:
        return np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
    dots = x @ centres.T
    home = dots.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T))
    return home, dots.max(1, keepdims=True) - dots <= reach * apart + SLACK


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, per_region: tuple[int, int] = PER_REGION) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least ``cosine`` are linked, whatever their labels. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do rows without an id (component null,
    kept) and vectors of different lengths. Repeated rows are vectors of their own; different vectors under one id
    have their links and component in common. An empty table gives an empty result. Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    equal = rows.filter(good).groupBy("embedding").agg(F.min("vec_id").cast("bigint").alias("id"), F.count("*").alias("copies"))
    # Different vectors may have one id, so each has a key of its own.
    distinct = settle(equal.withColumn("key", F.monotonically_increasing_id()), "vectors")
    n = distinct.count()
    regions = max(1, min(REGIONS, math.ceil(n / per_region[0])), math.ceil(n / per_region[1]))
    cells = {d: Cells(d, fitted, regions) for d, fitted in (_fit(distinct, n) if n else {}).items()}
    reach = math.sqrt(max(0.0, (1 - cosine) / 2))
    visits = sieved(distinct, cells, regions, reach, cosine).groupBy("key").agg(F.first("size").alias("size"), F.first("home").alias("home"), F.collect_set("cell").alias("visits"))
    placed = settle(distinct.join(visits, "key").drop("key"), "placed")
    there = placed.withColumn("cell", F.explode("visits"))
    # One row per cell: its number of blocks, from the number of its vectors.
    blocks = settle(there.groupBy("size", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "cells")
    there = there.join(blocks, ["size", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    columns = ["size", "cell", "side", "i", "j", "id", "copies", "home", "visits", "embedding"]
    left = there.filter("home = cell").withColumns({"side": F.lit(0), "i": F.col("own"), "j": F.explode(every)}).select(columns)
    right = there.withColumns({"side": F.lit(1), "i": F.explode(every), "j": F.col("own")}).select(columns)

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        cell = key[1].as_py()
        side = t.column("side").to_numpy()
        t = t.combine_chunks()
        a, b = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        out: list[tuple[int, int | None, int]] = []
        if a.num_rows and b.num_rows:
            ids, others = a.column("id").to_numpy(), b.column("id").to_numpy()
            x, y = unit(a.column("embedding").combine_chunks()), unit(b.column("embedding").combine_chunks())
            homes, weight, own = b.column("home").to_numpy(), b.column("copies").to_numpy(), a.column("copies").to_numpy()
            goes = np.zeros((len(ids), max(homes.max(), cell) + 1), bool)
            lists = a.column("visits").combine_chunks()
            at, to = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
            ok = to < goes.shape[1]
            goes[at[ok], to[ok]] = True
            linked = np.empty((len(ids), len(others)), bool)
            for s in range(0, len(ids), STRIP):
                linked[s:s + STRIP] = x[s:s + STRIP] @ y.T >= cosine
            linked &= ids[:, None] != others[None, :]
            mine = linked @ weight
            # A visitor counts this link at its own home, unless the other one does not go there.
            theirs = own @ (linked & ~goes[:, homes]) if (homes != cell).any() else np.zeros(len(others), np.int64)
            out += [(int(i), None, int(c)) for i, c in zip(ids, mine) if c]
            out += [(int(i), None, int(c)) for i, c in zip(others, theirs) if c]
            out += [(i, r, 0) for i, r in forest(linked, ids, others)]
        cols = list(zip(*out)) if out else [(), (), ()]
        return pa.table({"id": pa.array(cols[0], pa.int64()), "root": pa.array(cols[1], pa.int64()), "links": pa.array(cols[2], pa.int64())})

    found = left.unionByName(right).groupBy("size", "cell", "i", "j").applyInArrow(compare, "id long, root long, links long")
    found = settle(found, "vector-links")
    counts = found.filter("root IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("root IS NOT NULL"), "id", "root")
    named = distinct.join(counts, "id", "left").join(parts, "id", "left")
    named = named.select(F.col("embedding").alias("_e"), F.coalesce("component", "id").alias("_component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    joined = rows.withColumn("_good", good).join(named, F.col("_good") & (F.col("embedding") == F.col("_e")), "left")
    component = F.coalesce(F.col("_component"), F.col("vec_id").cast("bigint"))
    return joined.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id WHERE r.c < e.y),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1), k AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT t.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.c AS component_id, t.vec_id = m.c AS kept FROM embeddings t JOIN m ON m.id = t.vec_id LEFT JOIN k ON k.x = t.vec_id
"""
