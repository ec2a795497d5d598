"""Sharing filter, patches, routing, pruning and packing on own fixtures."""

from pyspark.sql import functions as F

from tidewell.operators import sections, trees

LOCAL, CLUSTER, EMPTY = "<!--om: scope=local-->", "<!--om: scope=cluster-->", "<!--om: scope=-->"


def test_sharing_filter():
    text = "\n".join(
        ["# T", "## A", f"- gone {LOCAL}", "  tail of it", f"  - own {CLUSTER}", "  - with it", "- stays", f"- typo {EMPTY}", "lazy", "", "prose",
         "## B", f"- gone {LOCAL}", "## C", "### D", "- x"]
    )
    kept = trees.shareable_text(text)
    assert kept == "\n".join(["# T", "## A", f"  - own {CLUSTER}", "- stays", "", "prose", "## C", "### D", "- x"])
    assert trees.shareable_text(None) is None and trees.shareable_text("") == ""


def notes(spark):
    text = "intro\n## A\none\n### S\n## B\ntwo\n## A\nthree"
    return spark.createDataFrame([("d", text)], "doc string, text string"), text


def test_sections_round_trip(spark):
    docs, text = notes(spark)
    found = sections.sections(docs)
    assert [r.handle for r in found.orderBy("ord").collect()] == [None, "a", "b", "a-2"]
    assert trees.reassembled(found).collect()[0].text == text


def test_prune(spark):
    text = "## A\n- old <!--om: kind=snapshot last_seen=2026-01-01T00:00:00Z-->\n- new <!--om: kind=snapshot last_seen=2026-02-01-->\n- bad <!--om: kind=snapshot last_seen=x-->"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    got = trees.pruned(docs, F.lit("2026-02-03").cast("timestamp"), action="drop").orderBy("line_no").collect()
    assert [r.action for r in got] == ["drop", "keep", "keep"]


def test_packing(spark):
    text = "## 2026-01-01\n" + "a\n" * 10 + "## 2026-01-02\n" + "b" * 50
    found = trees.packed_pieces(text, 30)
    assert "".join(found) == text and max(map(len, found)) <= 30
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc string, text string")
    assert trees.chunked(docs, 30).filter("doc = 'd'").count() == len(found)
    assert trees.chunked(docs, 30).filter("doc = 'e'").count() == 0
