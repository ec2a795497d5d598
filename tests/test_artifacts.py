from tidewell.operators import artifacts


def test_memory_documents(spark):
    files = spark.createDataFrame(
        [("p", "a_b", "---\nname: N: x\n# no\ndescription: D\nkey\n---\nbody"), ("p", "MEMORY", "no front"), ("p", "open", "---\nname: z"), ("p", "blank", " \n")],
        "project string, stem string, content string",
    )
    got = {r.doc_id: r for r in artifacts.memory_documents(files).collect()}
    assert set(got) == {"amem:p/a_b", "amem:p/MEMORY", "amem:p/open"}
    assert got["amem:p/a_b"].content == "### p: N: x\n\nD\n\nbody"
    assert got["amem:p/a_b"].metadata == {"name": "N: x", "description": "D", "project": "p", "is_index": "false"}
    assert got["amem:p/MEMORY"].heading == "### p: Memory" and got["amem:p/open"].content.endswith("---\nname: z")


def test_index_documents(spark):
    notes = spark.createDataFrame([("d", "# O\n## 2026-01-01\nx\n## Other\ny\n## 2026-01-01\nz")], "doc string, text string")
    files = spark.createDataFrame([("p", "s", "t")], "project string, stem string, content string")
    got = sorted((r.doc_id, r.content) for r in artifacts.index_documents(notes, notes, files).collect())
    assert [i for i, _ in got] == ["amem:p/s", "obs:2026-01-01", "obs:2026-01-01", "ref:2026-01-01", "ref:2026-01-01", "ref:other"]
    assert got[1][1] == "## 2026-01-01\nx"


def test_scan(spark):
    files = spark.createDataFrame([("a", "-----BEGIN PRIVATE KEY-----"), ("b", "fine é")], "path string, content string")
    assert [tuple(r) for r in artifacts.secret_findings(files).collect()] == [("a", "private_key")]
    assert tuple(artifacts.scan_report(files).collect()[0]) == (2, 34, 1, False)
    assert tuple(artifacts.scan_report(files.limit(0)).collect()[0]) == (0, 0, 0, True)


def test_job_transitions(spark):
    jobs = spark.createDataFrame([("1", "completed", {"a": "h"}), ("2", "completed", {"a": "old"}), ("3", "pending", {"a": "h"})], "job_id string, status string, hashes map<string,string>")
    now = spark.createDataFrame([("a", "h")], "name string, hash string")
    assert {r.job_id: r.next_status for r in artifacts.job_transitions(jobs, now).collect()} == {"1": "applied", "2": "drifted", "3": "pending"}


def test_rendered_log(spark):
    rows = spark.createDataFrame([("2026-01-01", 2, "n / a", "two", "r2"), ("2026-01-01", 1, "n / a", " ", "r1")], "date string, position int, label string, body string, record_id string")
    text = artifacts.rendered_log(rows).collect()[0].text
    assert text.startswith("## 2026-01-01\n\n### From n / a\n\n\n<!-- record: r1 -->") and text.endswith("two\n\n<!-- record: r2 -->")
