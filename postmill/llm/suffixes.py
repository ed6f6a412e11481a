"""Removal of long repeats by a distributed, sampled suffix array.

A repeat is a string of 50 bytes that starts in two documents. Suffixes are sampled by content: of each 50-byte
window, the 30 bytes at one place (its anchor) are chosen by the window's bytes alone, so equal windows
have equal anchors at equal places. Windows that follow each other mostly share an anchor; together they form a block, and
one suffix per block is sorted instead of about 17.

1. Suffixes go to buckets by their leading token (8 bytes); splitters come from a sample. Each bucket sorts
   its suffixes by multikey quicksort over (anchor, block, document). Where a whole block repeats, all but the
   document with the smallest id lose it.
2. Blocks that share an anchor but differ (at the edges of a repeat) are compared window by window: their
   windows are sorted in the same way, by leading token and 50 bytes.
3. What a document loses is brought to its text, and the rest of the text is put together.

A bucket boundary never parts equal suffixes: where splitters are equal, the anchor decides among the buckets
between them. Equal suffixes of one batch of texts are settled before the exchange, so a passage that a third of all
documents hold reaches its bucket once per batch. Sorted columns travel packed, thousands of suffixes to a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shingles import mix, spans
from postmill.operators.settle import settle

LENGTH = 50  # bytes of a repeat
GRAM = 30  # bytes of an anchor
PLACES = LENGTH - GRAM + 1
# Modulo sampling: the least of the small grams of a window chooses the anchor, at its place modulo PLACES.
SMALL = 4 + (GRAM - 4) % PLACES
PIECE = 1 << 20  # bytes worked on at once
BUCKET_BYTES = 8 << 20  # text per bucket
SAMPLE_BYTES = 4 << 20  # text from which splitters are taken
_PLACE_BITS = np.uint64(23)  # pieces are shorter than 8 MB
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

SUFFIX = [("gram", "u4"), ("block", "u8"), ("doc", "i8"), ("text", "i4"), ("at", "i4"), ("more", "u2"), ("lost", "u1")]
RANGE = [("doc", "i8"), ("text", "i4"), ("at", "i4"), ("more", "i4")]


def pack(columns: dict[str, np.ndarray], layout) -> bytes:
    return b"".join(np.ascontiguousarray(columns[name].astype(kind)).tobytes() for name, kind in layout)


def unpack(blobs: list[bytes], layout) -> dict[str, np.ndarray]:
    width = sum(np.dtype(k).itemsize for _, k in layout)
    parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, kind)] for name, kind in layout}
    for b in blobs:
        n, at = len(b) // width, 0
        for name, kind in layout:
            parts[name].append(np.frombuffer(b, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(p) for name, p in parts.items()}


def by_part(part: np.ndarray, columns: dict[str, np.ndarray], layout, kind: int) -> list[tuple[int, int, bytes]]:
    """One packed row per part: (part, kind, data)."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(order) else []
    return [(int(part[i[0]]), kind, pack({k: v[i] for k, v in columns.items()}, layout)) for i in np.split(order, cut[1:])] if len(order) else []


def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "data"]
    )


PACKED = "part int, kind int, data binary"


def multikey_sort(*keys: np.ndarray) -> np.ndarray:
    """Order by the first key, then, only where it ties, by the next one, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    for i, key in enumerate(keys[1:], 1):
        same = np.ones(max(0, len(order) - 1), bool)
        for k in keys[:i]:
            same &= k[order[1:]] == k[order[:-1]]
        tied = np.r_[same, False] | np.r_[False, same] if len(order) else np.zeros(0, bool)
        if not tied.any():
            break
        run = np.cumsum(np.r_[True, ~same])[tied]
        sub = order[tied]
        order[tied] = sub[np.lexsort((key[sub], run))]
    return order


def tokens(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, first byte highest; zeros follow the end."""
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    out = np.empty(len(raw), np.uint64)
    for o in range(8):
        n = len(out[o::8])
        out[o::8] = np.frombuffer(padded, ">u8", n, o)
    return out


def blocks(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of texts laid end to end (text i is raw[edges[i]:edges[i + 1]]).

    Returns anchors, first and last windows of the blocks, and the tokens of all places.
    """
    token = tokens(raw)
    n = len(raw) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, token
    small = len(raw) - SMALL + 1
    h = mix(token[:small] * _ODD[0] ^ raw[SMALL - 1:].astype(np.uint64) * _ODD[1])
    low = ((h >> _PLACE_BITS) << _PLACE_BITS) | np.arange(small, dtype=np.uint64)
    width, reach = 1, LENGTH - SMALL + 1
    while width * 2 <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if reach > width:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width:])
    place = np.arange(n)
    anchor = place + ((low & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64) - place) % PLACES
    inside = np.ones(n + LENGTH, np.int8)
    for e in edges[1:-1]:
        inside[max(0, e - LENGTH + 1):e] = 0
    place = np.flatnonzero(inside[:n])
    if not len(place):
        return none, none, none, token
    anchor = anchor[place]
    start = np.r_[True, (np.diff(anchor) != 0) | (np.diff(place) != 1)]
    return anchor[start], place[start], place[np.r_[start[1:], True]], token


def pieces(ids: list[int | None], texts: list[int], bodies: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts laid end to end up to PIECE bytes: raw, edges, and of each part its document, text and offset.

    Longer texts are cut into pieces that overlap by one window less a byte, so that each window is in one piece.
    """
    group, size = [], 0
    for doc, text, body in zip(ids, texts, bodies):
        if doc is None or len(body) < LENGTH:
            continue
        for at in range(0, max(1, len(body) - LENGTH + 1), PIECE):
            part = body[at:at + PIECE + LENGTH - 1]
            if group and size + len(part) > PIECE:
                yield _laid(group)
                group, size = [], 0
            group.append((doc, text, at, part))
            size += len(part)
    if group:
        yield _laid(group)


def _laid(group):
    doc, text, at, parts = zip(*group)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    return raw, np.cumsum([0, *map(len, parts)]), np.array(doc, np.int64), np.array(text, np.int64), np.array(at, np.int64)


def bucket_of(token: np.ndarray, tie: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    low, high = np.searchsorted(splitters, token, "left"), np.searchsorted(splitters, token, "right")
    return low + (tie.astype(np.uint64) % (high - low + 1).astype(np.uint64)).astype(np.int64)


def home_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """Part that holds a document's text; the same in ``_with_texts``."""
    return doc % parts


def _first_of(run: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Smallest document of each run, for every row; ``run`` marks where runs begin."""
    start = np.flatnonzero(run)
    return np.repeat(np.minimum.reduceat(doc, start), np.diff(np.r_[start, len(doc)])) if len(doc) else doc


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """Rows whose keys are those of a row of a smaller document."""
    order = multikey_sort(*keys, doc)
    begin = np.ones(len(order), bool)
    if len(order):
        begin[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    out = np.zeros(len(doc), bool)
    out[order] = doc[order] > _first_of(begin, doc[order])
    return out


def _suffixes(splitters: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, edges, doc, text, at in pieces(b.column("doc").to_pylist(), b.column("text_hash").to_pylist(), b.column("body").to_pylist()):
                anchor, first, last, token = blocks(raw, edges)
                if not len(anchor):
                    continue
                of = np.searchsorted(edges, first, "right") - 1
                c = {"gram": spans(raw, anchor, anchor + GRAM), "block": spans(raw, first, last + LENGTH), "doc": doc[of], "text": text[of], "at": first - edges[of] + at[of], "more": last - first}
                c["lost"] = _later((c["block"],), c["doc"])
                part = np.where(c["lost"], home_of(c["doc"], parts), bucket_of(token[anchor], c["gram"], splitters))
                yield packed(by_part(part, c, SUFFIX, 0))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Packed rows of each bucket that this task holds."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
            held.setdefault(part, []).append(data)
    for part in sorted(held):
        yield held.pop(part)


def _compare_blocks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_bucket(batches):
            c = unpack(blobs, SUFFIX)
            lost = c["lost"] > 0
            live = np.flatnonzero(~lost)
            order = live[multikey_sort(c["gram"][live], c["block"][live], c["doc"][live])]
            gram, block, doc = c["gram"][order], c["block"][order], c["doc"][order]
            new_gram = np.ones(len(order), bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_block = new_gram.copy()
            new_block[1:] |= block[1:] != block[:-1]
            later = doc > _first_of(new_block, doc)
            lost[order[later]] = True
            # Blocks that differ from another of the same anchor, where more than one document has it.
            start = np.flatnonzero(new_gram)
            size = np.diff(np.r_[start, len(order)])
            if len(start):
                many = (np.add.reduceat(new_block.astype(np.int64), start) > 1) & (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start))
                unsure = order[np.repeat(many, size) & ~later]
            else:
                unsure = order
            for kind, rows, more in ((0, np.flatnonzero(lost), LENGTH), (1, unsure, 0)):
                r = {k: c[k][rows] for k in ("doc", "text", "at")} | {"more": c["more"][rows].astype(np.int64) + more}
                yield packed(by_part(home_of(r["doc"], parts), r, RANGE, kind))

    return run


def _texts_with(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """Hand each batch of texts to ``use`` with the ranges of this task's documents; ranges come first."""
    blobs: list[bytes] = []
    ranges = None
    for b in batches:
        known = b.column("data").is_valid().to_numpy(zero_copy_only=False)
        blobs += [x for x in b.column("data").to_pylist() if x is not None]
        if known.all():
            continue
        if ranges is None:
            ranges = unpack(blobs, RANGE)
            order = np.lexsort((ranges["at"], ranges["text"], ranges["doc"]))
            ranges = {k: v[order] for k, v in ranges.items()}
            blobs = []
        yield from use(b.filter(pa.array(~known)), ranges)


def _of_document(ranges: dict[str, np.ndarray], doc: int | None, text: int) -> tuple[np.ndarray, np.ndarray]:
    if doc is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.searchsorted(ranges["doc"], doc, "left"), np.searchsorted(ranges["doc"], doc, "right")
    a, b = a + np.searchsorted(ranges["text"][a:b], text, "left"), a + np.searchsorted(ranges["text"][a:b], text, "right")
    return ranges["at"][a:b].astype(np.int64), ranges["more"][a:b].astype(np.int64)


def _windows(splitters: np.ndarray, parts: int):
    def use(b: pa.RecordBatch, ranges) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, np.ndarray]] = []
        size = 0
        for doc, text, body in zip(b.column("doc").to_pylist(), b.column("text_hash").to_pylist(), b.column("body").to_pylist()):
            at, more = _of_document(ranges, doc, text)
            if not len(at):
                continue
            n = more + 1
            held.append((doc, text, body, np.unique(np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()))))
            size += len(body)
            if size > PIECE:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def flush(held) -> pa.RecordBatch:
        docs, texts, bodies, places = zip(*held)
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        edges, n = np.cumsum([0, *map(len, bodies)]), [len(p) for p in places]
        at = np.concatenate(places)
        where = at + np.repeat(edges[:-1], n)
        window = spans(raw, where, where + LENGTH)
        c = {"gram": window >> np.uint64(32), "block": window, "doc": np.repeat(np.array(docs, np.int64), n), "text": np.repeat(np.array(texts, np.int64), n), "at": at, "more": np.zeros(len(at), np.int64)}
        c["lost"] = _later((window,), c["doc"])
        part = np.where(c["lost"], home_of(c["doc"], parts), bucket_of(tokens(raw)[where], window, splitters))
        return packed(by_part(part, c, SUFFIX, 0))

    return lambda batches: _texts_with(batches, use)


def _compare_windows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_bucket(batches):
            c = unpack(blobs, SUFFIX)
            lost = c["lost"] > 0
            live = np.flatnonzero(~lost)
            lost[live] = _later((c["gram"][live], c["block"][live]), c["doc"][live])
            r = {k: c[k][lost] for k in ("doc", "text", "at")}
            # Windows that follow each other are one range.
            order = np.lexsort((r["at"], r["text"], r["doc"]))
            r = {k: v[order] for k, v in r.items()}
            if not len(order):
                continue
            begin = np.ones(len(order), bool)
            begin[1:] = (np.diff(r["doc"]) != 0) | (np.diff(r["text"]) != 0) | (np.diff(r["at"]) > LENGTH)
            ends = r["at"][np.r_[begin[1:], True]]
            r = {k: v[begin] for k, v in r.items()}
            r["more"] = ends - r["at"] + LENGTH
            yield packed(by_part(home_of(r["doc"], parts), r, RANGE, 0))

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def use(b: pa.RecordBatch, ranges) -> Iterator[pa.RecordBatch]:
        starts, ends, kept = [], [], []
        for doc, text, body in zip(b.column("doc").to_pylist(), b.column("text_hash").to_pylist(), b.column("body").to_pylist()):
            at, more = _of_document(ranges, doc, text)
            if not len(at):
                starts.append([]), ends.append([]), kept.append(body)
                continue
            step = np.zeros(len(body) + 1, np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + more, -1)
            gone = np.cumsum(step[:-1]) > 0
            edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
            starts.append(np.flatnonzero(edge == 1)), ends.append(np.flatnonzero(edge == -1))
            kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary())], names=["doc_id", "starts", "ends", "kept"])

    return _texts_with(batches, use)


def _with_texts(ranges: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Ranges and texts in the parts of their documents, ranges first."""
    home = F.coalesce(F.pmod("doc", F.lit(parts)), F.pmod("text_hash", F.lit(parts))).cast("int")
    a = ranges.select("part", F.lit(0).alias("turn"), "data", F.lit(None).cast("bigint").alias("doc"), F.lit(None).cast("int").alias("text_hash"), F.lit(None).cast("binary").alias("body"))
    b = texts.select(home.alias("part"), F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("data"), "doc", "text_hash", "body")
    return a.unionByName(b).repartitionById(parts, F.col("part")).sortWithinPartitions("turn").drop("part", "turn")


def splitter_texts(texts: DataFrame, size: int) -> DataFrame:
    """Some SAMPLE_BYTES of ``size`` bytes of texts; copies under other ids are chosen apart."""
    return texts.filter(F.pmod(F.xxhash64("doc", "text_hash"), F.lit(max(1, size // SAMPLE_BYTES))) == 0)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, starts and ends of the maximal removed runs (bytes, end exclusive), kept (bytes).

    Each byte is removed that is covered by a 50-byte string which also starts in a document with a smaller id, both
    judged on the input. Null and empty texts have no bytes. Rows without an id neither lose anything nor take
    anything from others; nor do rows of one id from each other. An empty table gives an empty result. Other columns are ignored.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.xxhash64(F.col(text)).bitwiseAND(0x7FFFFFFF).cast("int").alias("text_hash"), body.alias("body"))
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-size // BUCKET_BYTES))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, edges, *_ in pieces(b.column("doc").to_pylist(), b.column("text_hash").to_pylist(), b.column("body").to_pylist()):
                anchor, _, _, token = blocks(raw, edges)
                yield pa.RecordBatch.from_arrays([pa.array(token[anchor][::8].view(np.int64))], names=["token"])

    # Some 4 MB of text, whatever the input's size, of which every eighth suffix is taken.
    some = splitter_texts(texts, size).mapInArrow(sampled, "token long").toPandas()["token"].to_numpy(np.int64).view(np.uint64)
    splitters = np.sort(some)[np.linspace(0, len(some) - 1, parts + 1).astype(np.int64)[1:-1]] if len(some) else np.zeros(0, np.uint64)

    first = texts.mapInArrow(_suffixes(splitters, parts), PACKED).repartitionById(parts, F.col("part")).mapInArrow(_compare_blocks(parts), PACKED)
    first = settle(first, "blocks")
    unsure = first.filter("kind = 1")
    second = _with_texts(unsure, texts, parts).mapInArrow(_windows(splitters, parts), PACKED)
    second = settle(second.repartitionById(parts, F.col("part")).mapInArrow(_compare_windows(parts), PACKED), "windows")
    gone = first.filter("kind = 0").unionByName(second)
    kept = _with_texts(gone, texts, parts).mapInArrow(_keep, "doc_id long, starts array<long>, ends array<long>, kept binary")
    return kept.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def repeat_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    out = remove_repeats(docs).withColumn("n_removed", removed)
    return out.select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("bigint").alias("n_bytes"), "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, p, hex(array_slice(x, p + 1, p + 1)) AS byte, CASE WHEN p + 50 <= octet_length(x) THEN md5(array_slice(x, p + 1, p + 50)) END AS s
  FROM (SELECT doc_id, x, unnest(range(octet_length(x))) AS p FROM b)),
f AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY 1),
c AS (SELECT w.doc_id, p, byte, coalesce(max((f.first < w.doc_id)::INT) OVER (PARTITION BY w.doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM w LEFT JOIN f USING (s)),
g AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS begins FROM c),
a AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY 1)
SELECT b.doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN a USING (doc_id)
"""
