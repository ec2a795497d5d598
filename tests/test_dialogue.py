"""Requests with replies, and jobs, each as a stream and as a table."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewell.operators import jobs, replies

ASKED = "request_id string, peer string, asked_at timestamp"
SAID = "request_id string, sender string, replied_at timestamp, message_id string, verified boolean, ready boolean, hits int"
T0 = datetime(2026, 6, 1, 12)


def _at(seconds):
    return T0 + timedelta(seconds=seconds)


REQUESTS = [("a", "p", _at(0)), ("a", "p", _at(0)), ("b", "p", _at(5)), ("c", "p", _at(5)), ("d", "p", _at(7)), ("e", "q", _at(10)), ("f", "p", _at(59)), ("g", None, _at(1)), ("h", "p", None), ("k", "p", _at(2))]
REPLIES = [
    ("a", "p", _at(9), "m2", True, True, 3), ("a", "p", _at(9), "m1", True, True, 0), ("a", "p", _at(4), "m0", False, True, 3), ("a", "x", _at(4), "m9", True, True, 3),
    ("b", "p", _at(65), "m3", True, True, 1), ("b", "p", _at(66), "m4", True, True, 1), ("c", "p", _at(66), "m5", True, True, 1), ("d", "p", _at(6), "m6", True, True, 1),
    ("e", "q", _at(10), "m7", True, False, 2), ("f", "p", _at(119), "m8", True, True, 2), ("f", "p", _at(119), "m8", True, True, 2), (None, "p", _at(3), "n1", True, True, 1), ("k", "p", _at(3), "n2", None, True, 1),
]
WANT = {("a", "EMPTY", "m1"), ("b", "OK", "m3"), ("c", "TIMEOUT", None), ("d", "TIMEOUT", None), ("e", "UNAVAILABLE", "m7"), ("f", "OK", "m8"), ("g", "TIMEOUT", None), ("k", "TIMEOUT", None)}


def _rows(df):
    rows = [(r.request_id, r.status, r.message_id) for r in df.collect() if r.request_id != "end"]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_first_valid_reply_in_time(spark):
    asked, said = spark.createDataFrame(REQUESTS, ASKED), spark.createDataFrame(REPLIES, SAID)
    assert _rows(replies.outcomes(asked, said, 60)) == WANT
    waiting = replies.outcomes(asked, said.filter("false"), 60, F.lit(_at(66)))
    assert {r.request_id for r in waiting.collect()} == {"a", "b", "c", "g", "k"}
    assert replies.outcomes(asked.filter("false"), said, 60).count() == 0


def test_stream_of_replies_equals_batch(spark, tmp_path):
    asked_at, said_at = str(tmp_path / "asked"), str(tmp_path / "said")

    def deliver(requests, answers):
        spark.createDataFrame(requests, ASKED).coalesce(1).write.mode("append").parquet(asked_at)
        spark.createDataFrame(answers, SAID).coalesce(1).write.mode("append").parquet(said_at)
        found = replies.outcome_stream(spark.readStream.schema(ASKED).parquet(asked_at), spark.readStream.schema(SAID).parquet(said_at), 60, "10 minutes")
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    # Replies before their requests, requests in two deliveries, one replay; nothing leaves before its time is up.
    deliver(REQUESTS[5:], REPLIES[:6])
    assert spark.read.schema("request_id string, status string, message_id string").parquet(str(tmp_path / "out")).count() == 0
    deliver(REQUESTS[:5], [*REPLIES[6:], REPLIES[0]])
    for minutes in (60, 120):
        deliver([("end", "p", T0 + timedelta(minutes=minutes))], [("end", "z", T0 + timedelta(minutes=minutes), "z", True, True, 0)])
    assert _rows(spark.read.parquet(str(tmp_path / "out"))) == WANT


POLLS = "job_id string, note string, custom_id string, at timestamp, batch_status string, output_file_id string"


def _line(job, content, code=200, **more):
    return json.dumps({"custom_id": job, "response": {"status_code": code, "body": {"choices": [{"message": {"content": content}}]}}, **more})


def test_answers_and_their_faults(spark):
    rows = [
        ("f", 1, "{broken"), ("f", 2, _line("a", "first")), ("f", 3, _line("a", "second")), ("f", 4, _line("b", "x", 500)), ("f", 5, _line("c", "x", error={"code": 1})), ("f", 6, _line("d", " \n")),
        ("f", 7, json.dumps({"custom_id": "e", "response": {"status_code": 200}})), ("f", 8, _line("g", 7)), ("f", 9, json.dumps({"custom_id": "h", "error": None, "response": {"body": {"choices": []}}})),
        ("f", 10, _line("i", "no code", None)), ("f", 11, "[1]"), ("f", 12, ""), ("f", 13, None), ("g", 1, _line("a", "other file")),
    ]
    got = {(r.output_file_id, r.custom_id): (r.fault, r.text) for r in jobs.answers(spark.createDataFrame(rows, "output_file_id string, line_no int, line string")).collect()}
    assert got[("f", "a")] == (None, "first") and got[("g", "a")] == (None, "other file") and got[("f", "i")] == (None, "no code")
    assert {k[1]: v[0] for k, v in got.items() if v[0]} == {"b": "request failed: HTTP 500", "c": 'request failed: {"code":1}', "d": "no text", "e": "no body", "g": "no text", "h": "no text"}


def test_stream_of_jobs_equals_batch(spark, tmp_path):
    inputs = lambda extra: spark.createDataFrame([("n", "reflections", "r"), ("n", "observations", "o" + extra), ("m", "reflections", None)], "note string, kind string, text string")
    sent = jobs.sent(spark.createDataFrame([("a", "n", _at(0)), ("a", "n", _at(9)), ("b", "n", _at(0)), ("c", "m", _at(0)), ("d", "k", _at(0)), ("e", "n", _at(0)), ("w", "n", _at(0))], "job_id string, note string, at timestamp"), inputs(""))
    lines = spark.createDataFrame([("f", i, _line(j, f"text {j}")) for i, j in enumerate("abcde")], "output_file_id string, line_no int, line string")
    early = jobs.polled(spark.createDataFrame([("a", "n", "a", _at(20), "completed", "f"), ("b", "n", "b", _at(20), "in_progress", None), ("e", "n", "e", _at(20), "expired", None), ("zz", "n", "a", _at(20), "completed", "f")], POLLS), lines, inputs(""))
    late = jobs.polled(spark.createDataFrame([("a", "n", "a", _at(30), "failed", None), ("b", "n", "b", _at(30), "completed", "f"), ("c", "m", "c", _at(30), "completed", "f"), ("d", "k", "d", _at(30), "completed", None), ("e", "n", "e", _at(30), "completed", "f"), ("w", "n", "w", _at(30), None, None)], POLLS), lines, inputs("!"))
    off = jobs.cancelled(spark.createDataFrame([("c", _at(40)), ("w", _at(50))], "job_id string, at timestamp"))
    want = {
        "a": ("applied", None, "text a", [], None), "b": ("drifted", None, "text b", ["observations"], "b.result.md"), "c": ("applied", None, "text c", [], None),
        "d": ("failed", "no output file", None, [], None), "e": ("expired", "batch expired", None, [], None), "w": ("cancelled", None, None, [], None),
    }
    shown = lambda df: {r.job_id: (r.status, r.error, r.text, r.moved, r.artifact) for r in df.collect()}
    batch = jobs.states(sent.unionByName(early).unionByName(late).unionByName(off))
    assert shown(batch) == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert jobs.stored_states(spark, out).count() == 0
    # Later events first, everything twice.
    for part in (late, off, sent, early, sent, late):
        part.coalesce(1).write.mode("append").parquet(source)
        jobs.write_states(spark.readStream.schema(part.schema).parquet(source), out, str(tmp_path / "cp")).awaitTermination()
    assert shown(jobs.stored_states(spark, out)) == want


def test_job_without_events(spark):
    none = spark.createDataFrame([], "job_id string, at timestamp, kind string, to string, error string, text string, digests struct<reflections: string, observations: string, auto_memory: string>")
    assert jobs.states(none).count() == 0
