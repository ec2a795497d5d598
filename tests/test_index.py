"""The stored index: hits as without one, segments written only where something changed, blocks left out by their bounds."""

import glob

import pytest
from pyspark.sql import functions as F

from tidewell.operators import search
from tidewell.operators.index import Stored, StoredIndex

WORDS = ("red", "fox", "the", "blue", "owl", "river", "stone", "very", "old")


def corpus(spark, n=400):
    rows = [(i, " ".join(WORDS[(i * k + k * k) % len(WORDS)] for k in range(1, 4 + i % 13)) + (" gem gem" if i % 97 == 5 else "")) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, content string")


def asked(spark):
    return spark.createDataFrame([(1, "old red gem"), (2, "red red the"), (3, "fox owl"), (4, "nothing known"), (5, "")], "query_id int, query string")


def hits(df):
    return sorted(tuple(r) for r in df.collect())


def test_hits_equal_those_without_an_index(spark, tmp_path):
    docs = corpus(spark)
    index = StoredIndex(spark, str(tmp_path / "i"), 4, 8)
    assert not index.ready() and hits(index.search(asked(spark))) == []
    assert index.update(docs) == [0, 1, 2, 3] and index.ready()
    for settings in ({}, {"k1": 0.9, "b": 0.2, "epsilon": 0.5}):
        assert hits(index.search(asked(spark), 5, **settings)) == hits(search.bm25(docs, asked(spark), 5, **settings))


def test_blocks_below_the_floor_are_not_read(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"), 4, 16)
    index.update(corpus(spark))
    query = asked(spark).filter("query_id = 1")
    judged = index.kept_blocks(query, 3)[0].collect()
    assert 0 < sum(r.kept for r in judged) < len(judged)
    assert hits(index.search(query, 3)) == hits(search.bm25(corpus(spark), query, 3))


def test_updates_write_touched_segments_only(spark, tmp_path):
    docs, path = corpus(spark), str(tmp_path / "i")
    index = StoredIndex(spark, path, 8, 2)
    index.update(docs)
    assert index.update(docs) == []
    new = docs.filter("doc_id <> 7").withColumn("content", F.when(F.col("doc_id") == 9, F.lit("gem of the river")).otherwise(F.col("content")))
    touched = {r[0] for r in docs.filter("doc_id IN (7, 9)").select(index._segment(F.col("doc_id"))).collect()}
    assert {(r.doc_id, r.change) for r in index.changes(new).collect()} == {(7, "gone"), (9, "changed")}
    assert set(index.update(new)) == touched
    assert len(glob.glob(f"{path}/blocks/version=2/segment=*")) == len(touched)
    assert hits(index.search(asked(spark))) == hits(search.bm25(new, asked(spark)))
    index.update(docs.limit(0))
    assert not index.ready() and hits(index.search(asked(spark))) == []


def test_an_update_without_a_manifest_does_not_count(spark, tmp_path, monkeypatch):
    docs, index = corpus(spark), StoredIndex(spark, str(tmp_path / "i"), 4, 2)
    index.update(docs)
    before = hits(index.search(asked(spark)))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(index, "_publish", fail)
        with pytest.raises(OSError):
            index.update(docs.filter("doc_id % 2 = 0"))
    assert hits(index.search(asked(spark))) == before
    assert index.update(docs.filter("doc_id % 2 = 0")) == [0, 1, 2, 3]
    assert hits(index.search(asked(spark))) == hits(search.bm25(docs.filter("doc_id % 2 = 0"), asked(spark)))


def test_ids_and_shape_are_checked(spark, tmp_path):
    docs, path = corpus(spark, 20), str(tmp_path / "i")
    for bad in (docs.unionByName(docs.limit(1)), docs.unionByName(spark.createDataFrame([(None, "x")], docs.schema))):
        with pytest.raises(ValueError):
            StoredIndex(spark, path, 4, 2).update(bad)
    StoredIndex(spark, path, 4, 2).update(docs)
    with pytest.raises(ValueError):
        StoredIndex(spark, path, 8, 2).ready()


def test_first_search_builds_and_later_ones_read_no_text(spark, tmp_path):
    docs, path = corpus(spark, 60), str(tmp_path / "i")
    assert hits(Stored(docs, path, segments=4, blocks=2).search(asked(spark))) == hits(search.bm25(docs, asked(spark)))
    unread = docs.withColumn("content", F.raise_error(F.lit("read")).cast("string"))
    assert hits(Stored(unread, path, segments=4, blocks=2).search(asked(spark))) == hits(search.bm25(docs, asked(spark)))


def test_segments_grow_with_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidewell.operators.index.SEGMENT_CHARS", 500)
    docs, path = corpus(spark), str(tmp_path / "i")
    chars = docs.agg(F.sum(F.length("content"))).first()[0]
    index = StoredIndex(spark, path, blocks=2)
    assert len(index.update(docs)) == index.segments == -(-chars // 500) > 16
    again = StoredIndex(spark, path, blocks=2)
    assert hits(again.search(asked(spark))) == hits(search.bm25(docs, asked(spark))) and again.segments == index.segments
    assert again.update(docs) == []
