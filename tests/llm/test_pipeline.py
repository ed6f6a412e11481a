import pytest

import corpus_pipeline
from postmill.llm import queries
from tests.check import compare, connect
from tests.llm.helpers import component_map, shingle_set, words
from tests.llm.test_passages import plain_contamination

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, name):
    ok, message = compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLE.get(name), SF)
    assert ok, message


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, before, docs.collect()))
    for name, before, after in seen:
        ids = {r["doc_id"] for r in after}
        if name == "near_dedup":
            sets = {r["doc_id"]: shingle_set(r["text"]) for r in before}
            edges = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert ids == set(component_map(sets, edges).values())
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = plain_contamination([r["text"] for r in before], items)
            assert ids == {r["doc_id"] for r, found in zip(before, held) if not found}
        elif name == "mixing":
            assert len(after) > len(before)
        elif name == "sharding":
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before) and {r["shard"] for r in after} <= set(range(24))


def test_document_stages_keep_columns_with_clashing_names(spark):
    """Columns named like the operators' own, hostile rows, and an empty table through the stages that keep documents."""
    from tests.llm import helpers as h

    names = {"size": "_id", "score": "_removed", "n_chars": "_hash"}
    docs = h.hostile(spark, [" ".join(words(60, 5)), " ".join(words(60, 5))]).withColumnsRenamed(names)
    for stage in (corpus_pipeline.one_of_each, corpus_pipeline.no_test_items):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = [str(r["text"])[:50] for r in out.collect()]
        for text in ("a", "same text here", "text without an id", "None"):
            assert text in kept, (stage.__name__, text)
        assert stage(spark, h.empty(spark).withColumnsRenamed(names), SF).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_dedup_of_ids_with_several_texts(spark, kind):
    a, b, c, d = (" ".join(words(60, 700 + i)) for i in range(4))
    near = lambda t: t + " more"
    rows = [(9, a), (9, b), (3, b), (12, near(a)), (20, c), (20, near(d)), (-5, d), (30, None), (30, c), (None, a), (9, a)]
    want = [(9, a), (9, a), (3, b), (20, c), (-5, d), (30, None), (None, a)]
    as_kind = lambda rows: [(i if kind == "long" or i is None else f"{i + 100:04}", t) for i, t in rows]
    docs = spark.createDataFrame(as_kind(rows), f"doc_id {kind}, text string")
    got = [tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted(as_kind(want), key=str)
