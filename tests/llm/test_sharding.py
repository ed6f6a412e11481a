import zlib
from collections import defaultdict

from postmill.llm import sharding
from tests.llm.helpers import SCHEMA, empty, hostile, rows_of, words


def check(docs, shards, part_rows):
    rows = sharding.shard_by_bytes(docs, shards, part_rows=part_rows).collect()
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, max((r["size"] for r in rows), default=0)


def test_shards_are_even_and_gapless(spark):
    texts = [" ".join(words(1 + i % 200, i)) for i in range(3000)] + ["a copy of a text"] * 1500
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    for part_rows in (50, 50_000):
        sizes, largest = check(docs, 24, part_rows)
        assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_hostile_rows(spark):
    check(hostile(spark), 24, 50_000)
    check(hostile(spark), 1, 3)
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


def test_reruns_agree(spark):
    docs = spark.createDataFrame(rows_of([f"text {i % 40}" for i in range(300)]), SCHEMA)
    a, b = (set(sharding.shard_by_bytes(d, 5).collect()) for d in (docs, docs.repartition(9)))
    assert a == b
