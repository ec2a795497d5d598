"""Files, folders and streams that the table queries cannot show."""

import hashlib
import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as fx
from tidewell.operators import artifacts, exchange, search, trees
from tidewell.sources import settings, sinks
from tidewell.sources import transcripts as t
from tidewell.streaming import ingest


def test_codex_documents_of_every_shape(spark, tmp_path):
    said = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    (tmp_path / "list.json").write_text(json.dumps(said, indent=2))
    (tmp_path / "items.json").write_text(json.dumps({"items": said}, indent=2))
    (tmp_path / "one.json").write_text(json.dumps(said[0], indent=2))
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(x) for x in said) + "\nbroken\n")
    (tmp_path / "empty.json").write_text("")
    got = t.read_all(spark, {"codex": str(tmp_path)})
    found = {}
    for r in got.orderBy("path", "line_no").collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append(r.content)
    assert found == {"list.json": ["a", "b"], "items.json": ["a", "b"], "one.json": ["a"], "lines.jsonl": ["a", "b"]}


def test_grok_text_of_an_untyped_content(spark):
    rows = [{"method": "session/update", "params": {"update": {"sessionUpdate": "agent_message_chunk", "content": {"n": 3, "note": " said "}}}}]
    lines = spark.createDataFrame([("p", i + 1, json.dumps(r)) for i, r in enumerate(rows)], "path string, line_no int, line string")
    assert [r.content for r in t.grok(lines).collect()] == ["said"]


def test_memory_files(spark, tmp_path):
    for name, body in {"proj/memory/MEMORY.md": "x", "proj/memory/note.md": "y", "proj/memory/blank.md": " \n", "proj/memory/a.txt": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    files = t.read_files(spark, str(tmp_path / "proj/memory"))
    assert {(r.project, r.stem, r.is_index) for r in artifacts.memory_files(files).collect()} == {("proj", "MEMORY", True), ("proj", "note", False)}


def test_parts_of_many_texts_are_not_held_at_once():
    """A batch of 24 million characters, which take four bytes each in Python as one is wide."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(240)), pa.array(["# \U0001f534\n" + "line of text\n" * 7692] * 239 + [None])], names=["doc", "text"])
    tracemalloc.start()
    rows, text = [0] * 240, hashlib.sha256()
    for out in artifacts._cut(iter([batch]), 1500):
        for i in out.column("doc").to_pylist():
            rows[i] += 1
        text.update("".join(x.split("(continued)\n\n")[-1] for x in out.column("text").to_pylist()).encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and min(rows[:239]) == max(rows[:239]) > 60 and rows[239] == 1
    assert text.hexdigest() == hashlib.sha256("".join(x or "" for x in batch.column(1).to_pylist()).encode()).hexdigest()


def test_byte_chunks(spark):
    texts = ["", "short", "# Title\n" + "line é\n" * 400, "日本" * 500, "# H\nx" + "y" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = artifacts.byte_chunks(docs, 200).orderBy("doc", "part").collect()
    for i, text in enumerate(texts):
        parts = [r.text for r in got if r.doc == i]
        assert all(len(p.encode()) <= 200 for p in parts)
        head = text.split("\n")[0] + " (continued)\n\n" if text.startswith("#") else ""
        assert parts[0] + "".join(p[len(head) :] for p in parts[1:]) == text and all(p.startswith(head) for p in parts[1:])


def test_snapshot_that_is_not_there(spark):
    shots = spark.createDataFrame([("a", 1), ("b", 2)], "snapshot_id string, created_at int")
    assert exchange.selected_snapshot(shots, "latest").first().snapshot_id == "b" and exchange.selected_snapshot(shots, "a").first().created_at == 1
    with pytest.raises(Exception, match="no snapshot c"):
        exchange.selected_snapshot(shots, "c").collect()


def test_restore_stops_at_the_first_problem(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    spoilt = spark.createDataFrame([("a", "1"), ("b", "!")], "path string, content string")
    assert {r.step for r in exchange.restore_plan(sinks.manifest(files), spoilt, files).collect()} == {"abort"}


def test_postings_are_read_by_term(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox")], "doc_id long, content string")
    sinks.write_postings(search.postings(docs), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    got = {(r.doc_id, r.term, r.tf) for r in sinks.postings_of(stored, ["red", "fox"]).collect()}
    assert got == {(1, "red", 2), (1, "fox", 1), (2, "fox", 1)}
    with pytest.raises(ValueError):
        search.backend("other", docs)


def test_rates_and_calls(spark, tmp_path):
    (tmp_path / "r.toml").write_text('[models."m-1"]\ninput = 1\noutput = 2.5\n')
    rates = settings.read_rates(spark, tmp_path / "r.toml", "file")
    assert [tuple(r) for r in sinks.sorted_rates(rates, rates.limit(0)).collect()] == [("m-1", 1.0, 2.5, "file")]
    calls = spark.createDataFrame([(1, "2026-01-01 10:00:00"), (2, "2026-01-02 10:00:00")], "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        sinks.append_calls(calls, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).groupBy("day").count().count() == 2


def test_a_batch_that_is_tried_again_writes_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps({"role": "user", "content": "x"}))
    for k in range(2):  # a new checkpoint gives the batch its old number again
        lines = ingest.transcript_stream(spark, str(tmp_path / "in"))
        ingest.ingest_messages(lines, "hermes", str(tmp_path / "out"), str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_a_rejected_record_is_listed_once(spark, tmp_path):
    schema = "record_id string, node_seq long, verified boolean"
    for _ in range(2):
        spark.createDataFrame([("z", 9, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.sync_records(stream, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "no")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "no")).count() == 1


def test_sessions_windows_and_notes(spark, tmp_path):
    rows = spark.createDataFrame([("p", str(i)) for i in range(6)] + [("q", "1")], "path string, timestamp string")
    assert {(r.path, r.messages, r.last, r.status) for r in ingest.session_state(rows).collect()} == {("p", 6, "5", "ready"), ("q", 1, "1", "waiting")}
    calls = spark.createDataFrame([("ok", "2026-01-01 10:05:00", "a", 1.0, 2), ("error", "2026-01-01 10:06:00", "a", 5.0, 2)], "status string, ts string, operation string, usd double, tokens long")
    got = ingest.usage_windows(calls.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert [(r.operation, r.usd, r.tokens) for r in got] == [("a", 1.0, 2)]
    notes = ingest.compress_batches(spark.createDataFrame([("p", "long text")], "path string, text string"), lambda system, text: f"{system}:{len(text)}", "sum up")
    assert [tuple(r) for r in notes.collect()] == [("p", "sum up:9")]


def test_null_scope_passes_and_empty_scope_is_withheld(spark):
    rows = spark.createDataFrame([(None,), ("cluster",), ("",), ("local",)], "scope string")
    assert [r[0] for r in rows.select(fx.shareable(F.col("scope"))).collect()] == [True, True, False, False]
