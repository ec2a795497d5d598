"""Notes after pruning, and times of ISO texts."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewell.functions.text import iso_moment
from tidewell.operators import pruning
from tidewell.plans import registry

OLD, NEW = "<!--om: kind=snapshot last_seen=2026-01-01T00:00:00Z -->", "<!--om: kind=snapshot last_seen=2026-05-30 -->"
NOTE = f"# N\n- top {OLD}\n\n## A {OLD}\n- old {OLD}  \n- new {NEW}\n- task <!--om: kind=task last_seen=2020-01-01-->\n- none <!--om: kind=snapshot-->\n\n## STALE snapshots\n- kept {OLD}\n\n\n"


def _pruned(spark, action, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    found = pruning.pruned_notes(rows, F.lit("2026-06-01 00:00:00+00:00").cast("timestamp"), 14, action).orderBy("doc").collect()
    return [(r.text, r.pruned, r.annotated, r.stale_sectioned) for r in found]


def test_each_action(spark):
    rest = f"- new {NEW}\n- task <!--om: kind=task last_seen=2020-01-01-->\n- none <!--om: kind=snapshot-->\n\n## STALE snapshots\n- kept {OLD}\n"
    head = f"\n## A {OLD}\n"
    assert _pruned(spark, "drop", NOTE) == [(f"# N\n{head}{rest}", 2, 0, 0)]
    assert _pruned(spark, "stale-section", NOTE) == [(f"# N\n{head}{rest}\n## Stale snapshots\n\n- top {OLD}\n- old {OLD}\n", 0, 0, 2)]
    once = f"# N\n- top {OLD} <!-- stale=true -->\n{head}- old {OLD} <!-- stale=true -->\n{rest}"
    assert _pruned(spark, "annotate", NOTE, once) == [(once, 0, 2, 0), (once, 0, 2, 0)]
    with pytest.raises(ValueError):
        _pruned(spark, "burn", NOTE)


def test_notes_with_nothing_to_keep(spark):
    assert _pruned(spark, "stale-section", None, "", "a\r\nb\r", f"\n- x {OLD}") == [("\n", 0, 0, 0), ("\n", 0, 0, 0), ("a\nb\n", 0, 0, 0), (f"\n## Stale snapshots\n\n- x {OLD}\n", 0, 0, 1)]
    assert _pruned(spark, "drop", f"- x {OLD}") == [("\n", 1, 0, 0)]


def test_moments(spark):
    texts = ["2026-01-02", "2026-01-02T03:04", "2026-01-02 03:04:05.5", "2026-01-02T03:04:05+02:00", "2026-01-02T03:04:05-0130", "2026-01-02T03:04:05Z", "soon", "2026-13-01", "", None, "2026-01-02x"]
    got = [None if r.t is None else datetime.fromtimestamp(r.t, timezone.utc).strftime("%d %H:%M:%S.%f")[:13] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(iso_moment(F.col("x")).cast("double").alias("t")).collect()]
    assert got == ["02 00:00:00.0", "02 03:04:00.0", "02 03:04:05.5", "02 01:04:05.0", "02 04:34:05.0", "02 03:04:05.0", None, None, None, None, None]


def test_all_ways_read_a_note_once(spark):
    plan = registry.QUERIES["pruned_notes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
