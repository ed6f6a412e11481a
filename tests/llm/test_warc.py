import base64
import gzip
import hashlib
import io
import random
import uuid

import pytest
from pyspark.sql import functions as F

from postmill.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, refers_to int"
ROWS = [
    (5, "http://a/5", "<p>one</p>", "x", 1), (2, "http://a/2", "<p>one</p>", "x", 1), (9, None, "<p>one</p>", None, None), (3, "http://b/3\r\nX-Bad: 1", "", None, None),
    (4, "http://b/4", None, None, None), (7, "http://c/7", "é𝛼\r\n\r\nWARC/1.1\r\n" * 9000, None, None), (7, "http://c/7", "é𝛼\r\n\r\nWARC/1.1\r\n" * 9000, None, None),
    (None, "http://d", "<p>one</p>", None, None), (None, None, None, None, None), (8, "http://c/8", "other", None, None),
]


@pytest.fixture
def path(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, path, least):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((tuple(r) for r in warc.round_trip(pages, path, least).collect()), key=str)
    groups = {}
    for i, _, html, *_ in ROWS:
        if i is not None and len((html or "").encode()) >= least:
            groups[html or ""] = min(i, groups.get(html or "", i))
    want = []
    for i, _, html, *_ in ROWS:
        first = groups.get(html or "")
        again = first is not None and i != first
        n = len((html or "").encode())
        want.append((i, n, sha(html), "revisit" if again else "response", first if again else None, None if again else True))
    assert got == sorted(want, key=str)


def test_payloads_and_predicates(spark, path):
    warc.write_warc(spark.createDataFrame(ROWS, SCHEMA), path)
    all_ = warc.read_warc(spark, path)
    assert {r["payload"].decode() for r in all_.filter("record_type = 'response'").collect()} == {r[2] or "" for r in ROWS}
    some = all_.filter(F.col("target_uri").startswith("http://c/") & (F.col("page_id").isin("7", "8")))
    assert sorted(r["page_id"] for r in some.collect()) == ["7", "7", "8"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] or "isin" not in plan
    assert all_.filter("payload_digest = 'none'").count() == 0
    assert warc.read_warc(spark, path, payload=False).filter("payload IS NOT NULL").count() == 0


def test_plain_file_is_skipped_by_seek(tmp_path):
    records = [warc.record(str(i), f"http://x/{i}", b"y" * 3_000_000, None, False, "2024-01-01T00:00:00Z") for i in range(3)]
    data = warc.Members(io.BytesIO(b"".join(records)), False)
    for _ in records:
        head = warc._parse(data.until(warc.END))
        data.skip(int(head["content-length"]) + len(warc.END))
    assert data.until(warc.END) is None


def payloads(sizes, seed=3):
    rng = random.Random(seed)
    return [rng.randbytes(n) if i % 2 else b"line of text\r\n\r\n" * (n // 16) for i, n in enumerate(sizes)]


def test_unwanted_blocks_of_gzip_files_are_not_inflated():
    blocks = payloads([2_000_000, 3_000_000, 0, 40, 900, 5000, 1_500_000] * 3)
    records = [warc.record(str(i), f"http://x/{i}", b, None, False, "2024-01-01T00:00:00Z") for i, b in enumerate(blocks)]
    whole = b"".join(map(warc.member, records))
    assert gzip.decompress(whole) == b"".join(records)  # still plain gzip to others
    for wanted in ({0, 5, 20}, set(), {1}, set(range(len(blocks)))):
        data, seen = warc.Members(io.BytesIO(whole), True), 0
        for i, block in enumerate(blocks):
            head = warc._parse(data.until(warc.END))
            n = int(head["content-length"])
            assert head["x-page-id"] == str(i)
            if i in wanted:
                assert data.take(n).partition(warc.END)[2] == block
                data.skip(len(warc.END))
                seen += n
            else:
                data.skip(n + len(warc.END))
        assert data.until(warc.END) is None
        assert seen <= data.inflated <= seen + 2 * warc.HEAD_STEP * len(blocks)


def test_gzip_members_of_other_writers_are_read():
    blocks = payloads([70_000, 1_200_000, 0, 300])
    records = [warc.record(str(i), None, b, None, False, "2024-01-01T00:00:00Z") for i, b in enumerate(blocks)]
    # One member per record, two records in one member, and members with and without lengths mixed.
    for whole in (b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:2])) + warc.member(b"".join(records[2:])), warc.member(records[0]) + gzip.compress(b"".join(records[1:]))):
        for wanted in (set(), {1, 3}, {0, 2}):
            data = warc.Members(io.BytesIO(whole), True)
            for i, block in enumerate(blocks):
                n = int(warc._parse(data.until(warc.END))["content-length"])
                if i in wanted:
                    assert data.take(n).partition(warc.END)[2] == block
                    data.skip(len(warc.END))
                else:
                    data.skip(n + len(warc.END))
            assert data.until(warc.END) is None


def test_a_cut_file_is_an_error():
    whole = warc.member(warc.record("1", None, payloads([0, 50_000])[1], None, False, "2024-01-01T00:00:00Z"))
    data = warc.Members(io.BytesIO(whole[:9000]), True)
    n = int(warc._parse(data.until(warc.END))["content-length"])
    with pytest.raises(ValueError):
        data.take(n)


def test_nothing_written_nothing_read(spark, path):
    warc.write_warc(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_warc(spark, path).count() == 0
    assert warc.read_warc(spark, path + "-none").count() == 0
