"""Scalar expressions on odd inputs, and operators that need rows the tables lack."""

from pyspark.sql import functions as F

from tidewell.functions import clocks, text
from tidewell.operators import changes, messages, records, search, sections, startup, usage
from tidewell.sources import settings


def one(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").orderBy("i")
    return [r[0] for r in rows.select(make(F.col("c"))).collect()]


def test_text(spark):
    assert one(spark, text.strip, "\t a \n", "", None) == ["a", "", None]
    assert one(spark, text.slug, "A  b!", "!!") == ["a-b", "section"]
    assert one(spark, text.search_tokens, "The Café, is_ok and x", "of") == [["café", "is_ok", "x"], []]
    assert one(spark, text.comparable, "**Bold**  ‘x’ — y.", "bold 'x' - y") == ["bold 'x' - y"] * 2
    assert one(spark, text.number, "$1_000.5", "1,2", "x", "") == [1000.5, 12.0, None, None]
    assert one(spark, lambda c: text.entry_kind(c, F.lit("")), "Never do", "PR #1", "decided", "x") == ["policy", "snapshot", "decision", "evergreen"]
    assert one(spark, text.bullet_key, "- \U0001f534 **A**  b (as of 2026-01-01 — verify) <!--om: id=1-->", "* a B") == ["a b", "a b"]


def test_metadata(spark):
    line = "- x <!--om: scope=local id=1 zz=9 id=2 bad =x-->"
    got = one(spark, text.metadata, line, "- x", "- <!--om:-->")
    assert got == [{"scope": "local", "id": "2", "zz": "9"}, {}, {}]
    assert one(spark, lambda c: text.metadata_comment(text.metadata(c)), line) == ["<!--om: id=2 scope=local zz=9-->"]
    assert one(spark, text.shareable, None, "cluster", "", "local") == [True, True, False, False]


def test_clocks(spark):
    stamps = ["2026-01-01T00:00:00.000001Z-000003-n1", "2026-01-01T00:00:00.000001Z-000007-n2", "junk"]
    parsed = one(spark, clocks.hlc, *stamps)
    assert (parsed[0].counter, parsed[0].node, parsed[2].wall) == (3, "n1", None)
    assert one(spark, lambda c: clocks.hlc_text(clocks.hlc(c)), stamps[0]) == [stamps[0]]
    df = spark.createDataFrame([(stamps[0], stamps[1])], "a string, b string")
    merge = clocks.hlc_merge(clocks.hlc(F.col("a")), clocks.hlc(F.col("b")), F.lit("2025-01-01").cast("timestamp"), F.lit("n1"))
    assert df.select(merge.alias("m")).collect()[0].m.counter == 8
    maps = spark.createDataFrame([({"a": 1}, {"b": 1}), ({"a": 2}, {"a": 1}), ({}, {}), ({"a": 1}, {"a": 1, "b": 3})], "x map<string,long>, y map<string,long>")
    order = [r[0] for r in maps.select(clocks.frontier_order(F.col("x"), F.col("y"))).collect()]
    assert order == ["incomparable", "covers", "equal", "covered_by"]


def test_search_falls_back_to_overlap(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, content string")
    hits = search.bm25(docs, spark.createDataFrame([(1, "alpha"), (2, "the of")], "query_id int, query string")).collect()
    assert [(h.query_id, h.doc_id, h.score) for h in hits] == [(1, 1, 1.0)]
    assert search.recall_status(docs.limit(0), F.lit(True)).collect()[0].status == "EMPTY"


def test_prices(spark):
    rates = spark.createDataFrame([("m", 1.0, 2.0), ("m-big", 3.0, 4.0)], "key string, input double, output double")
    models = spark.createDataFrame([("m-big",), ("m-big-20260101",), ("m-bigger",), ("mx",), ("z",)], "model string")
    assert {r.model: r.key for r in usage.price_lookup(models, rates).collect()} == {"m-big": "m-big", "m-big-20260101": "m-big", "m-bigger": "m-big", "mx": "m", "z": None}
    merged = settings.merge_rates(rates.withColumn("origin", F.lit("builtin")), rates.filter("key = 'm'").withColumns({"input": F.lit(9.0), "origin": F.lit("override")}))
    assert {r.key: (r.input, r.origin) for r in merged.collect()} == {"m": (9.0, "override"), "m-big": (3.0, "builtin")}
    found = settings.budgets(spark, {"global_day_usd": "$1_0", "chat_month_tokens": "0", "chat_day_tokens": "5", "chat_day_tokens_mode": "soft"}, ("chat",))
    assert {r.key: (r.limit, r.mode) for r in found.collect()} == {"global_day_usd": (10.0, "hard"), "chat_day_tokens": (5.0, "soft")}


def test_windows_of_an_empty_ledger(spark):
    calls = spark.createDataFrame([], "id long, ts timestamp, session_id long, operation string, usd double, tokens long, status string")
    assert usage.window_totals(calls).collect() == [(0.0, 0)]
    assert usage.usage_summary(calls).collect()[0].calls == 0


def test_conflicts_and_divergences(spark):
    shape = "record_id string, section string, kind string, actionability string, text string, entry_id string, id_explicit boolean, reviewable boolean"
    prior = spark.createDataFrame([("r1", "A", "policy", "high", "never x", "e1", True, True), ("r1", "B", "mode", "high", "fast", "h1", False, True)], shape)
    new = spark.createDataFrame([("r2", "A", "policy", "high", "always x", "e1", True, True), ("r2", "B", "mode", "high", "Slow.", "h2", False, True)], shape)
    assert sorted((r.signal, r.after) for r in changes.divergences(prior, new).collect()) == [("id", "always x"), ("slot", "Slow.")]
    assert changes.conflicts(prior.union(new)).count() == 2
    assert changes.divergences(prior, prior).count() == 0


def test_sections_and_entries(spark):
    text_ = "# N\n## 2026-01-02\n- a <!--om: scope=local node=n1-->\n## 2026-01-02\n- b\n## Other\n- c <!--om: kind=task-->\n-  "
    docs = spark.createDataFrame([("d", text_)], "doc string, text string")
    found = sections.sections(docs)
    assert [r.handle for r in found.orderBy("ord").collect()] == [None, "2026-01-02", "2026-01-02-2", "other"]
    assert sections.latest_section(found).collect()[0].body.startswith("- a")
    assert sections.since(found, "2026-02-01").count() == 0 and sections.since(found, "2026-01-01").count() == 4
    rows = sections.entries(docs).orderBy("line_no").collect()
    assert [(r.text, r.section, r.kind) for r in rows] == [("a", "2026-01-02", "evergreen"), ("b", "2026-01-02", "evergreen"), ("c", "Other", "task")]
    assert [r.text for r in sections.for_host(sections.entries(docs), "n2").orderBy("line_no").collect()] == ["b", "c"]
    assert sections.provenance(sections.entries(docs), ["doc"]).collect()[0][1:] == ("local", "n1", None)
    assert [r.next_line for r in sections.end_lines(found).orderBy("ord").collect()] == [2, 4, 6, None]


def test_packing_skips_what_does_not_fit(spark):
    chunks = spark.createDataFrame([("h1", 3, 8), ("h2", 2, 5), ("h3", 1, 2)], "handle string, priority int, size int").withColumns({"source": F.lit("s"), "heading": F.lit("h")})
    assert {r.handle: r.taken for r in startup.pack(chunks, 10).collect()} == {"h1": True, "h2": False, "h3": True}


def test_first_sightings_keep_parents(spark):
    lines = [(1, 1, "- a"), (1, 2, "- b"), (1, 3, "  - child"), (2, 1, "- A"), (2, 2, "- b"), (2, 3, "text")]
    df = spark.createDataFrame([(*x, False) for x in lines], "chunk_rank int, line_no int, line string, exempt boolean")
    assert sorted((r.chunk_rank, r.line_no) for r in startup.first_sightings(df).collect()) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)]


def test_priority_bullets(spark):
    lines = ["- ! keep", "  more", "other", "  not", "- ! two"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, line_no int, line string")
    assert [r.line_no for r in startup.priority_bullets(df, ("- !",)).orderBy("line_no").collect()] == [0, 1, 4]


def test_record_views(spark):
    shots = spark.createDataFrame([("a", {"n": 5}, "h1"), ("b", {"n": 2, "m": 3}, "h2")], "record_id string, frontier map<string,long>, hlc string")
    assert records.choose_snapshot(shots).collect()[0].record_id == "b"
    seen = spark.createDataFrame([("m1",)], "message_id string")
    inbox = spark.createDataFrame([("m1", "1"), ("m2", "1")], "message_id string, timestamp string")
    assert [r.message_id for r in records.unseen(inbox, seen).collect()] == ["m2"]


def test_checkpoints_due(spark):
    rows = [("a", 5, 5, True, None), ("b", 6, 5, False, "2026-01-01 00:00:00"), ("c", 6, 5, True, "2026-01-01 00:00:00"), ("d", 6, 5, False, None)]
    df = spark.createDataFrame(rows, "path string, message_count int, seen_count int, forced boolean, last_observed string").withColumn("last_observed", F.col("last_observed").cast("timestamp"))
    due = messages.checkpoint_due(df, F.lit("2026-01-01 00:05:00").cast("timestamp"), 600)
    assert {r.path: r.due for r in due.collect()} == {"a": False, "b": False, "c": True, "d": True}


def test_a_search_shuffles_asked_words_and_reads_the_texts_of_hits_only(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "the beta gamma"), (3, "delta"), (4, None)], "doc_id long, content string")
    words = spark.createDataFrame([("beta",), ("beta",), ("none",)], "term string")
    assert sorted(tuple(r) for r in search.postings(docs, only=words).collect()) == [(1, 3, "beta", 2), (2, 2, "beta", 1)]
    hits = spark.createDataFrame([(1, 1, 3), (1, 2, 9)], "query_id int, rank int, doc_id long")
    content = F.when(F.col("doc_id") == 3, F.col("content")).otherwise(F.raise_error(F.lit("read")).cast("string"))
    got = search.hit_payload(hits, docs.withColumn("content", content)).orderBy("rank").collect()
    assert [(r.doc_id, r.content) for r in got] == [(3, "delta"), (9, None)]
    scored = spark.createDataFrame([(1, 5, 0.5, 1.0), (1, 6, -1.0, 9.0), (2, 7, 0.0, 2.0), (2, 8, -3.0, 2.0), (2, 9, 0.0, 3.0)], "query_id int, doc_id long, score double, overlap double")
    assert sorted(tuple(r) for r in search.ranked(scored, 2).collect()) == [(1, 1, 5, 0.5), (2, 1, 9, 3.0), (2, 2, 7, 2.0)]


def test_divergences_read_each_entry_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    shape = "section string, kind string, text string, entry_id string, id_explicit boolean, reviewable boolean"
    prior = spark.createDataFrame([("A", "policy", "never x", "e1", True, True), ("B", "mode", "fast", "h1", False, True), ("C", "mode", "one", "h3", False, True)], shape)
    new = spark.createDataFrame([("A", "policy", "always x", "e1", True, True), ("A", "policy", "Never x.", "e1", True, True), ("B", "mode", "slow", "h2", False, True), ("C", "task", "two", "h4", False, False)], shape)
    found = changes.divergences(prior.withColumn("text", seen("text")), new.withColumn("text", seen("text")))
    assert sorted((r.signal, r.section, r.after) for r in found.collect()) == [("id", "A", "always x"), ("section", "C", "two"), ("slot", "B", "slow")]
    assert read.value == 7
