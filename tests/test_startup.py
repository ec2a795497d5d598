"""Start-up steps: sections cut within their row, chunks packed once, texts read once a side."""

import re

from pyspark.sql import functions as F

from tidewell.functions.text import strip
from tidewell.operators import sections, startup
from tidewell.plans import registry

TEXTS = ["", "x", "## A", "## A\n", "\n## A\n\n## B\r\nb\r", "p\n##  A b \t\n- x\n### C\n##x\n## A b \nq\n\n", "## a b\n##  \n", "a ## B\n##\n## \n## C"]


def _plain(text):
    lines = re.split("\r\n|\r|\n", text)
    rows, at = [], 0
    for n, line in enumerate(lines, 1):
        hit = re.search(r"\A##[ \t\x0b\f]+([^ \t\x0b\f][^\n\x85  ]*?)[ \t\x0b\f]*[\x85  ]?\Z", line)
        if hit:
            at += 1
            rows.append([at, hit.group(1), n, []])
        else:
            if not rows:
                rows.append([0, None, n, []])
            rows[-1][3].append(line)
    return [(o, h, n, "\n".join(b)) for o, h, n, b in rows]


def test_sections_equal_a_plain_version(spark):
    found = sections.sections(spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc int, text string"))
    got = {}
    for r in found.orderBy("doc", "ord").collect():
        got.setdefault(r.doc, []).append((r.ord, r.heading, r.first_line, r.body))
    assert got == {i: _plain(t) for i, t in enumerate(TEXTS)}


def test_unread_windows_are_not_planned(spark):
    found = sections.sections(spark.createDataFrame([(1, "## A")], "doc int, text string"))
    plan = found.select("doc", "heading", "body")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_chunks_of_one_handle_are_packed_each_once(spark):
    rows = [("d", "active", "A", "h", 2, 3, "one"), ("d", "active", "B", "h", 1, 3, "two"), ("d", "active", "C", "i", 0, 9, "long")]
    packed = startup.packed(spark.createDataFrame(rows, "doc string, source string, heading string, handle string, priority int, size int, body string"), 6, ["doc"], ("body",))
    assert [tuple(r) for r in startup.payload_text(packed, ["doc"]).collect()] == [("d", "one\n\ntwo", "i")]


def test_start_up_reads_each_side_once(spark):
    for name, most in (("startup_payload", 3), ("startup_quality", 4)):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most, name


def test_strip_takes_blanks_of_all_kinds(spark):
    texts = ["", " \n", "a", "   a b　\n", "a\x1f\x85", None, " a  "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()
    assert [r[0] for r in got] == ["", "", "a", "a b", "a", None, "a"]
