from pyspark.sql import functions as F

from tidewell.sources import sinks


def test_manifest_verifies(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "é")], "path string, content string")
    listed = sinks.manifest(files)
    assert sinks.verify(listed, files).count() == 0
    other = spark.createDataFrame([("a", "y"), ("c", "z")], "path string, content string")
    assert {tuple(r) for r in sinks.verify(listed, other).collect()} == {("a", "changed"), ("b", "missing"), ("c", "extra")}
    assert {r.path for r in sinks.changed_only(other, files).collect()} == {"a", "c"}


def test_next_records(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "node_id long, ord int")
    heads = spark.createDataFrame([(1, 7)], "node_id long, seq long")
    got = {(r.node_id, r.ord): (r.node_seq, r.parents) for r in sinks.next_records(rows, heads).collect()}
    assert got == {(1, 1): (8, {1: 7}), (1, 2): (9, {1: 7}), (2, 1): (1, {1: 7})}


def test_rejects_and_upsert(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, None)], "id int, v string")
    good, bad = sinks.split_rejects(rows, F.when(F.col("v").isNull(), "empty"))
    assert [r.id for r in good.collect()] == [1] and [r.reason for r in bad.collect()] == ["empty"]
    new = spark.createDataFrame([(1, "new"), (3, "x")], "id int, v string")
    assert {tuple(r) for r in sinks.upsert(rows, new, "id").collect()} == {(1, "new"), (2, None), (3, "x")}
    assert sinks.newest_ids(rows.withColumn("ord", F.col("id")), 1).collect()[0].id == 2
