import json

from tidewell.streaming import ingest


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = json.dumps({"role": "user", "content": "x", "timestamp": "1"})
    (tmp_path / "in/a.jsonl").write_text(f"{row}\n{row}\nbad")
    run = lambda: ingest.ingest_messages(ingest.transcript_stream(spark, str(tmp_path / "in")), "hermes", str(tmp_path / "out"), str(tmp_path / "cp"))
    run().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "in/b.jsonl").write_text(row)
    run().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_sync_is_idempotent(spark, tmp_path):
    schema = "record_id string, node_seq long, verified boolean"
    source = str(tmp_path / "in")

    def deliver(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.sync_records(stream, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "no")).awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("record_id").collect())

    assert deliver(("b", 2, True), ("b", 2, True), ("z", 9, False)) == ["b"]
    assert deliver(("a", 1, True), ("b", 2, True)) == ["a", "b"]
