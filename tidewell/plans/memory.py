"""Note and start-up queries: a note with fixed sections made of every document, read back by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as fx
from tidewell.operators import context, patches, pruning, sections, startup, trees

from .documents import GROWTH_SQL, _growth
from .relations import docs

NOW = "2026-06-01 00:00:00"
SHORT = 700


def _flat():
    return F.concat(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), "[ \\t\\n\\x0b\\f\\r]+", " ")), F.lit(" end"))


def _day():
    return F.concat(F.lit("2026-05-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))


def _notes(spark, sf_dir):
    """One reflections note (doc, text) per document."""
    n, flat = F.col("doc_id").cast("string"), _flat()
    prefs = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## Preferences & Opinions\n- **Preferences:**\n  - tea "), n, F.lit("\n  - coffee\n- **Other:** x\n\n"))).otherwise("")
    text = F.concat(
        F.lit("# Notes\n\n*Last updated: "), _day(), F.lit(" 08:00 UTC*\n*Last reflected: "), _day(), F.lit("*\n\n## Core Identity\n- **Name:** N"), n,
        F.lit("\n- **Role/occupation:** r\n- "), flat, F.lit("\n\n"), prefs, F.lit("## Active Projects\n### P"), (F.col("doc_id") % 7).cast("string"), F.lit("\n- "), flat,
        F.lit(" <!--om: kind=task-->\n### Q\n- q\n\n## Key Facts & Context\n- \U0001f534 hot "), n, F.lit("\n  - below\n- cold\n\n## Recent Themes\n- theme"),
    )
    return docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), text.alias("text"))


def _observed(spark, sf_dir):
    """One observations note (doc, text) per document."""
    text = F.concat(F.lit("# Observations\n\n## "), _day(), F.lit("\n### Current Context\n- ctx "), _flat(), F.lit("\n### Other\n- o\n\n## 2026-04-01\n- old"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), text.alias("text"))


def _found(spark, sf_dir):
    return sections.sections(_notes(spark, sf_dir)).filter("ord > 0")


def _seen(spark, sf_dir):
    return sections.sections(_observed(spark, sf_dir)).filter("ord > 0")


def _profiles(spark, sf_dir):
    return context.profiles(_found(spark, sf_dir))


def _actives(spark, sf_dir):
    return context.actives(_found(spark, sf_dir), _seen(spark, sf_dir))


def _chunks(spark, sf_dir):
    return context.startup_chunks(_profiles(spark, sf_dir), _actives(spark, sf_dir))


def _sized(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.withColumn("size", F.length("body")).withColumn("priority", startup.priority(F.col("source"), F.col("heading"), F.col("body"), ["tea"]))


def _handles(spark, sf_dir):
    asked = F.array(F.concat(F.lit("startup:active:active-projects:p"), (F.col("doc_id") % 7).cast("string")), F.lit("startup:profile:nothing"))
    wanted = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.explode(asked).alias("handle"))
    return context.expanded(_chunks(spark, sf_dir), wanted).select("doc", "handle", "known", F.md5("body").alias("body_md5"))


def _payload(spark, sf_dir):
    packed = startup.packed(_sized(spark, sf_dir), SHORT, ["doc"], ("body",))
    return startup.payload_text(packed, ["doc"]).select("doc", F.md5("text").alias("text_md5"), "overflow")


def _bullet_rows(spark, sf_dir):
    """Bullets (doc, line) of the note's sections, with one that stands in two of them."""
    f = _found(spark, sf_dir)
    each = f.select("doc", F.explode(F.split("body", "\n")).alias("line")).filter("line LIKE '- %'")
    return each


def _repeats(spark, sf_dir):
    keyed = startup.keyed_bullets(_bullet_rows(spark, sf_dir)).select("doc", "key")
    return keyed.groupBy("doc", "key").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0").select("doc", "n")


def _quality(spark, sf_dir):
    return context.quality_report(startup.packed(_sized(spark, sf_dir), SHORT, ["doc"]), _repeats(spark, sf_dir), SHORT)


def _latest(spark, sf_dir):
    return context.date_span(_seen(spark, sf_dir)).select("doc", F.date_add("last", F.when(F.col("doc") % 2 == 0, 3).otherwise(0)).alias("latest"))


def _changed(spark, sf_dir):
    scan = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "never ran").when(F.col("doc_id") % 4 == 2, "2026-05-15T08:00:00Z").otherwise("2026-05-20T09:00:00+00:00")
    return context.memory_changed(_notes(spark, sf_dir), docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), scan.alias("last_scan")))


def _restamped(spark, sf_dir):
    """The new version of every note has other themes in odd documents; the prior one carries stamps."""
    f = _found(spark, sf_dir).filter("heading IN ('Recent Themes', 'Active Projects')")
    prior = f.withColumn("body", F.concat(F.lit("<!--om-section: last_reflected=2026-01-01 derived_from_obs_window=a..b-->\n"), "body"))
    new = f.withColumn("body", F.when((F.col("heading") == "Recent Themes") & (F.col("doc") % 2 == 1), F.lit("- other")).otherwise(F.col("body")))
    done = context.restamped(new, prior, "2026-06-01", "2026-05-01", "2026-05-31")
    return done.select("doc", "heading", "changed", F.substring("body", 1, 90).alias("start"))


def _memory_files(spark, sf_dir):
    return docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).cast("long").cast("string").alias("project"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), "content")


def _pruned(spark, sf_dir):
    """Entries (doc, line_no, kind, last_seen): four to a note of ten documents."""
    d = docs(spark, sf_dir)
    n = F.col("doc_id")
    rows = d.select(
        F.floor(n / 10).cast("long").alias("doc"), (n % 10).cast("int").alias("line_no"), F.when(n % 3 == 0, "snapshot").otherwise("task").alias("kind"),
        F.when(n % 4 > 0, F.timestamp_seconds(F.lit(1780272000) - n % 30 * 86400)).alias("last_seen"), F.concat(F.lit("- "), n.cast("string")).alias("line"),
    )
    moved = context.stale_moved(rows, F.lit(NOW).cast("timestamp"), 14).select(F.lit("stale-section").alias("action"), "doc", "line", "position")
    for action in ("drop", "annotate"):
        moved = moved.unionByName(context.stale_moved(rows, F.lit(NOW).cast("timestamp"), 14, action).select(F.lit(action).alias("action"), "doc", "line", "position"))
    return moved


def _pruned_notes(spark, sf_dir):
    """A note per document, whose text is a snapshot seen in May, pruned in each of the three ways."""
    mark = F.when(F.col("doc_id") % 5 == 0, " <!-- stale=true -->").otherwise("")
    text = F.concat(
        F.lit("## Facts\n- "), _flat(), F.lit(" <!--om: kind=snapshot last_seen="), _day(), F.when(F.col("doc_id") % 2 == 0, "T10:00:00+02:00").otherwise(""), F.lit(" -->"), mark,
        F.lit("\n- task <!--om: kind=task last_seen=2020-01-01-->\n- odd <!--om: kind=snapshot last_seen=soon-->\n\n## Stale Snapshots\n- z <!--om: kind=snapshot last_seen=2020-01-01-->\n\n"),
    )
    notes = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), text.alias("text"))
    found = pruning.pruned_each_way(notes, F.lit("2026-06-01 09:00:00+00:00").cast("timestamp"), 14)
    return found.withColumn("text", F.md5("text"))


def _stamps(spark, sf_dir):
    """Notes without a title, with both lines, with one of them and with none."""
    n = F.col("doc_id") % 4
    text = F.when(n == 0, F.lit("plain\ntext")).when(n == 1, "# T\n*Last updated: never*\n\n*Last reflected: 2026-01-01*\nx").when(n == 2, "# T\n\n*Last updated: a*\nx").otherwise("# T\nx")
    day = F.col("doc_id").cast("string")
    done = fx.stamped(text, F.concat(F.lit("u"), day), F.concat(F.lit("r"), day))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), done.alias("text"))


def _freshness(spark, sf_dir):
    """Statements about versions, seen at several times, one kind of which does not age."""
    d = docs(spark, sf_dir)
    n = F.col("doc_id")
    rows = d.select(
        "doc_id", F.concat(F.lit("- tool"), (n % 50).cast("string"), F.lit(" version is v1.2 <!--om: kind=task-->")).alias("line"),
        F.when(n % 6 == 0, "preference").otherwise("task").alias("kind"), F.timestamp_seconds(F.lit(1780272000) - n % 40 * 86400).alias("last_seen"),
    )
    seen = startup.freshness(rows)
    met = rows.withColumn("key", fx.bullet_key(F.col("line"))).join(seen.withColumnRenamed("last_seen", "seen"), "key", "left")
    return met.select("doc_id", fx.noted_freshness(F.col("line"), F.col("seen"), F.lit(NOW).cast("timestamp"), 4).alias("line"))


def _scalars(spark, sf_dir):
    n = F.col("doc_id")
    kind = F.get(F.array(*[F.lit(k) for k in ("identity", "snapshot", "task", "mode", "other")]), (n % 5).cast("int"))
    fields = F.create_map(F.lit("z"), n.cast("string"), F.lit("a"), F.concat(F.lit('q"'), n.cast("string"), F.lit("é")))
    raw = F.get(F.array(F.lit("15m"), F.lit(" 2H "), F.lit("7d"), F.lit("90"), F.lit("x9"), F.lit("")), (n % 6).cast("int"))
    ident = F.when(n % 2 == 0, F.concat(F.lit("sha256:"), F.sha2(n.cast("string"), 256))).otherwise(F.concat(F.lit("sha256:"), F.sha2(n.cast("string"), 256), F.lit("\n")))
    doc = F.concat(F.lit("obs:é"), n.cast("string"))
    tokens = F.when(n % 3 == 0, None).otherwise(n)
    return docs(spark, sf_dir).select(
        "doc_id", F.to_json(F.array_sort(F.map_values(fx.default_fields(kind)))).alias("defaults"), fx.canonical_json(fields).alias("canonical"), fx.duration_seconds(raw).alias("seconds"),
        fx.is_id(ident, "sha256:").alias("is_id"), fx.id_of_hex_name(F.concat(fx.hex_name(doc), F.lit(".md"))).alias("id_back"),
        fx.id_of_hex_name(F.rtrim(F.translate(F.base64(F.encode(doc, "UTF-8")), "+/", "-_"), F.lit("="))).alias("id_from_base64"),
        fx.total_tokens(tokens, F.when(n % 2 == 0, n), F.when(n % 5 == 0, F.lit(7).cast("long"))).alias("tokens"),
        fx.typed_metadata(F.when(n % 2 == 0, n.cast("string")).otherwise("x1")).alias("typed"),
        F.array_join(fx.name_tokens(F.concat(F.lit("worked on Om-Relay and src/app.py, v"), n.cast("string"))), ",").alias("names"),
        fx.shown_bytes(n * 977).alias("shown_bytes"), fx.shown_usd(F.when(n % 4 > 0, n / 1000)).alias("shown_usd"),
        F.md5(fx.head_within(F.coalesce("content", F.lit("")), 300, " …")).alias("head_md5"), F.md5(fx.tail_within(F.coalesce("content", F.lit("")), 300)).alias("tail_md5"),
        fx.has_visible_content(F.when(n % 2 == 0, F.lit("# h\n <!-- c -->\n")).otherwise("# h\n x")).alias("visible"),
        fx.metadata_comment(fx.metadata(F.concat(F.lit("- x <!--om: zeta=1 kind=task id="), n.cast("string"), F.lit(" kind=mode junk-->")))).alias("comment"),
    )


def _shared(spark, sf_dir):
    """Notes whose entries may or may not leave the host, by their scope."""
    n = F.col("doc_id")
    scope = F.when(n % 3 == 0, "cluster").when(n % 3 == 1, "local").otherwise("")
    text = F.concat(F.lit("## A\n- open "), _flat(), F.lit("\n- own <!--om: scope="), scope, F.lit("-->\n  - below\n  - free <!--om: scope=cluster-->\n## B\n- gone <!--om: scope=local-->\n\n## C\n- last"))
    return trees.for_sharing(docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), text.alias("text"))).select("doc", F.md5("text").alias("text_md5"))


def _hosted(spark, sf_dir):
    n = F.col("doc_id")
    rows = docs(spark, sf_dir).select("doc_id", F.when(n % 2 == 0, "local").when(n % 5 == 0, "cluster").alias("scope"), F.when(n % 3 == 0, "h1").when(n % 3 == 1, "h2").alias("node"), F.when(n % 7 > 0, "inferred").otherwise("").alias("source_type"))
    return rows


def _chunked(spark, sf_dir):
    return trees.chunked(docs(spark, sf_dir), 500, "doc_id", "content").groupBy("doc").agg(F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).cast("long").alias("chars"), F.count(F.lit(1)).alias("pieces"))


def _replies(spark, sf_dir):
    """A reply to every note, of nine kinds in turn: four that fit their note, four that do not, and one whose text has a line like a handle's."""
    n = F.col("doc_id") % 9
    own = F.substring(_flat(), 1, 40)
    block = lambda handle, body, *more: F.concat(F.lit(f"SECTION_HANDLE: {handle}\n"), *[F.lit(x + "\n") for x in more], F.lit("UPDATED_MARKDOWN:\n"), *body, F.lit("\n"))
    themes = block("ref:recent-themes", [F.lit("## Recent Themes\n- about "), own])
    area = [F.lit("## New Area\n- "), own]
    reply = (
        F.when(n == 0, themes)
        .when(n == 1, F.concat(block("ref:active-projects:q", [F.lit("### Q\n- "), own]), F.lit("\n"), themes))
        .when(n == 2, block("ref:new-area", area, "NEW_AFTER: ref:core-identity"))
        .when(n == 3, block("ref:new-area", area, "NEW_AFTER:"))
        .when(n == 4, F.concat(themes, F.lit("\nSECTION_HANDLE: ref:active-projects:q\n### Q\n- "), own))
        .when(n == 5, F.concat(themes, block("ref:nothing", [F.lit("## Nothing\n- x")])))
        .when(n == 6, block("ref:new-area", [F.lit("## Key Facts & Context\n- "), own], "NEW_AFTER:"))
        .when(n == 7, F.concat(F.lit("Sure:\n"), themes))
        .otherwise(block("ref:core-identity", [F.lit("## Core Identity\n- "), own]))
    )
    return docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), reply.alias("reply"))


def _patch(spark, sf_dir):
    """Every note with its reply's patches, of which those of the identity are not on offer."""
    notes = _notes(spark, sf_dir)
    offered = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit("ref:recent-themes"), F.lit("ref:active-projects:q"))).alias("handle"))
    done = patches.applied(notes, _replies(spark, sf_dir), offered)
    return done.select("doc", "error", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


def _rebuilt(spark, sf_dir):
    """Every note taken apart and put together again, byte for byte."""
    notes = _notes(spark, sf_dir)
    none = notes.limit(0).select("doc", F.col("text").alias("reply"))
    return patches.applied(notes, none).select("doc", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


QUERIES = {
    "note_profiles": lambda spark, sf_dir: _profiles(spark, sf_dir).select("doc", F.md5("text").alias("text_md5")),
    "note_actives": lambda spark, sf_dir: _actives(spark, sf_dir).select("doc", F.md5("text").alias("text_md5")),
    "startup_chunks": lambda spark, sf_dir: _chunks(spark, sf_dir).select("doc", "source", "heading", "handle", F.md5("body").alias("body_md5")),
    "startup_handles": _handles,
    "startup_payload": _payload,
    "startup_quality": _quality,
    "identity_basics": lambda spark, sf_dir: context.identity_basics(_found(spark, sf_dir)),
    "nested_preferences": lambda spark, sf_dir: context.nested_bullets(_found(spark, sf_dir), "Preferences & Opinions", "Preferences"),
    "catch_up_needed": lambda spark, sf_dir: context.catch_up_needed(_notes(spark, sf_dir).filter("doc % 5 > 0"), _latest(spark, sf_dir), F.lit("2026-05-20 00:00:00").cast("timestamp")),
    "memory_changed": _changed,
    "date_spans": lambda spark, sf_dir: context.date_span(_seen(spark, sf_dir), "2026-04-15"),
    "latest_stamps": lambda spark, sf_dir: context.latest_stamp(_observed(spark, sf_dir)).select("doc", F.date_format("seen", "yyyy-MM-dd").alias("seen")),
    "restamped_sections": _restamped,
    "fold_budgets": lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", context.fold_budgets(F.coalesce("content", F.lit("")), F.lit("memory")).alias("b")).select("doc_id", "b.context", "b.chunk"),
    "memory_context": lambda spark, sf_dir: context.memory_context(_memory_files(spark, sf_dir)).select("project", F.md5("text").alias("text_md5")),
    "file_status": lambda spark, sf_dir: context.file_status(_memory_files(spark, sf_dir).filter("content IS NOT NULL")),
    "growth_lines": lambda spark, sf_dir: context.growth_lines(_growth(spark, sf_dir), fx.shown_bytes(F.col("bytes"))).select("doc", "line"),
    "growth_checks": lambda spark, sf_dir: context.growth_checks(_growth(spark, sf_dir), 30_000, 20),
    "note_coldest": lambda spark, sf_dir: sections.coldest(_growth(spark, sf_dir), 10, "doc").select("doc", "age_days"),
    "pruned_entries": _pruned,
    "pruned_notes": _pruned_notes,
    "stamped_notes": _stamps,
    "freshness_notes": _freshness,
    "more_scalars": _scalars,
    "shared_notes": _shared,
    "host_entries": lambda spark, sf_dir: sections.for_host(_hosted(spark, sf_dir), "h1").select("doc_id"),
    "entry_provenance": lambda spark, sf_dir: sections.provenance(_hosted(spark, sf_dir).withColumn("grp", F.floor(F.col("doc_id") / 3).cast("long")), ["grp"]),
    "section_ends": lambda spark, sf_dir: sections.end_lines(_found(spark, sf_dir)).select("doc", "handle", "first_line", "next_line"),
    "notes_since": lambda spark, sf_dir: sections.since(_seen(spark, sf_dir), "2026-05-10").select("doc", "heading"),
    "chunked_texts": _chunked,
    "patched_notes": _patch,
    "rebuilt_notes": _rebuilt,
    "repeated_bullets": lambda spark, sf_dir: startup.repeated_bullets(_bullet_rows(spark, sf_dir)),
}

FLAT = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ') || ' end'"
DAY = "'2026-05-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')"
PARTS_SQL = f"""parts AS (
  SELECT doc_id AS doc, {FLAT} AS flat, {DAY} AS day, chr(10) AS nl, doc_id % 3 = 0 AS has_prefs, 'P' || (doc_id % 7) AS project FROM documents),
made AS (
  SELECT *, '## Core Identity' || nl || '- **Name:** N' || doc || nl || '- **Role/occupation:** r' || nl || '- ' || flat AS core,
         '## Preferences & Opinions' || nl || '- **Preferences:**' || nl || '  - tea ' || doc || nl || '  - coffee' || nl || '- **Other:** x' AS prefs,
         '## Key Facts & Context' || nl || '- 🔴 hot ' || doc || nl || '  - below' AS facts FROM parts),
profile AS (
  SELECT doc, '# Startup Profile' || nl || nl || '<!-- Auto-maintained from reflections.md. -->' || nl || nl || core || CASE WHEN has_prefs THEN nl || nl || prefs ELSE '' END || nl || nl || facts AS text FROM made),
active AS (
  SELECT doc, '# Active Context' || nl || nl || '<!-- Auto-maintained from reflections.md and observations.md. -->' || nl || nl || '## Active Projects' || nl || '### ' || project || nl || '- ' || flat
    || ' <!--om: kind=task-->' || nl || '### Q' || nl || '- q' || nl || nl || '## Recent Themes' || nl || '- theme' || nl || nl
    || '## Current Session Snapshot' || nl || nl || '### ' || day || nl || nl || '- ctx ' || flat AS text FROM made),
chunk AS (
  SELECT doc, 'profile' AS source, 'Core Identity' AS heading, 'startup:profile:core-identity' AS handle, core AS body FROM made
  UNION ALL SELECT doc, 'profile', 'Preferences & Opinions', 'startup:profile:preferences-opinions', prefs FROM made WHERE has_prefs
  UNION ALL SELECT doc, 'profile', 'Key Facts & Context', 'startup:profile:key-facts-context', facts FROM made
  UNION ALL SELECT doc, 'active', 'Active Projects / ' || project, 'startup:active:active-projects:' || lower(project), '## Active Projects / ' || project || nl || '- ' || flat FROM made
  UNION ALL SELECT doc, 'active', 'Active Projects / Q', 'startup:active:active-projects:q', '## Active Projects / Q' || nl || '- q' FROM made
  UNION ALL SELECT doc, 'active', 'Recent Themes', 'startup:active:recent-themes', '## Recent Themes' || nl || '- theme' FROM made
  UNION ALL SELECT doc, 'active', 'Current Session Snapshot / ' || day, 'startup:active:current-session-snapshot:' || day,
    '## Current Session Snapshot / ' || day || nl || nl || '- ctx ' || flat FROM made)"""
NOTE_SQL = """note AS (
  SELECT doc, nl, head, head || nl || nl || CASE WHEN has_prefs THEN prefs || nl || nl ELSE '' END || '## Active Projects' || nl || '### ' || project || nl || '- ' || flat || ' <!--om: kind=task-->' || nl
    || '### Q' || nl || '- q' || nl || nl || facts || nl || '- cold' || nl || nl || '## Recent Themes' || nl || '- theme' AS text
  FROM (SELECT *, '# Notes' || nl || nl || '*Last updated: ' || day || ' 08:00 UTC*' || nl || '*Last reflected: ' || day || '*' || nl || nl || core AS head FROM made))"""
PACK_SQL = f"""{PARTS_SQL}, sized AS (
  SELECT *, length(body) AS size, CASE WHEN heading = 'Core Identity' THEN 8 WHEN heading LIKE 'Preferences%' THEN 10 WHEN heading LIKE 'Current Session%' THEN 9
    WHEN heading LIKE 'Active Projects%' THEN 8 WHEN source = 'profile' THEN 7 ELSE 4 END + CASE WHEN contains(lower(heading || ' ' || body), 'tea') THEN 6 ELSE 0 END AS priority FROM chunk),
item AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY -priority, source, heading, handle, size) AS n FROM sized),
fold AS (
  SELECT DISTINCT doc, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, '' AS handle, false AS taken FROM item
  UNION ALL SELECT i.doc, i.n, CAST(CASE WHEN f.used + i.size <= {SHORT} THEN f.used + i.size ELSE f.used END AS BIGINT), i.handle, f.used + i.size <= {SHORT}
  FROM fold f JOIN item i ON i.doc = f.doc AND i.n = f.n + 1),
packed AS (SELECT i.*, f.taken FROM item i JOIN fold f USING (doc, n))"""
SHOWN_BYTES = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.1f KB', {0} / 1024.0::DOUBLE) ELSE printf('%.1f MB', {0} / 1048576.0::DOUBLE) END"

ORACLE_SQL = {
    "note_profiles": f"WITH {PARTS_SQL} SELECT doc, md5(text) AS text_md5 FROM profile",
    "note_actives": f"WITH {PARTS_SQL} SELECT doc, md5(text) AS text_md5 FROM active",
    "startup_chunks": f"WITH {PARTS_SQL} SELECT doc, source, heading, handle, md5(body) AS body_md5 FROM chunk",
    "startup_handles": f"""WITH {PARTS_SQL} SELECT doc, handle, true AS known, md5(body) AS body_md5 FROM chunk WHERE handle LIKE 'startup:active:active-projects:p%'
UNION ALL SELECT doc, 'startup:profile:nothing', false, NULL FROM made""",
    "startup_payload": f"""WITH RECURSIVE {PACK_SQL}, ordered AS (
  SELECT *, CASE source WHEN 'profile' THEN 0 ELSE 1 END AS a, CASE WHEN heading = 'Core Identity' THEN 1 WHEN heading LIKE 'Preferences%' THEN 2 WHEN source = 'profile' THEN 4
    WHEN heading LIKE 'Current Session%' THEN 0 WHEN heading LIKE 'Active Projects%' THEN 1 ELSE 4 END AS b FROM packed)
SELECT doc, md5(coalesce(string_agg(body, chr(10) || chr(10) ORDER BY a, b, heading, handle) FILTER (WHERE taken), '')) AS text_md5,
       coalesce(string_agg(handle, ',' ORDER BY handle) FILTER (WHERE NOT taken), '') AS overflow FROM ordered GROUP BY doc""",
    "startup_quality": f"""WITH RECURSIVE {PACK_SQL}
SELECT doc, CAST(coalesce(sum(size) FILTER (WHERE taken), 0) AS BIGINT) AS used, count(*) FILTER (WHERE taken) AS included, count(*) FILTER (WHERE NOT taken) AS overflow,
       CAST(any_value(same) AS BIGINT) AS duplicates, round(coalesce(sum(size) FILTER (WHERE taken), 0) / {SHORT}, 4) AS share
FROM packed JOIN (SELECT doc AS d, 1 AS same FROM made) ON doc = d GROUP BY doc""",
    "identity_basics": "SELECT doc_id AS doc, '- **Name:** N' || doc_id || chr(10) || '- **Role/occupation:** r' AS basics FROM documents",
    "nested_preferences": """SELECT doc_id AS doc, 0 AS at, '- tea ' || doc_id AS line FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 1, '- coffee' FROM documents WHERE doc_id % 3 = 0""",
    "catch_up_needed": """SELECT doc_id AS doc, doc_id % 5 = 0 OR (doc_id % 2 = 0 AND make_timestamp(2026, 5, doc_id % 28 + 1, 8, 0, 0) < TIMESTAMP '2026-05-19') AS needed FROM documents""",
    "memory_changed": """SELECT doc_id AS doc, CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN doc_id % 28 + 1 < 15 ELSE doc_id % 28 + 1 <= 20 END AS changed FROM documents""",
    "date_spans": "SELECT doc_id AS doc, make_date(2026, 5, doc_id % 28 + 1) AS first, make_date(2026, 5, doc_id % 28 + 1) AS last FROM documents",
    "latest_stamps": f"SELECT doc_id AS doc, {DAY} AS seen FROM documents",
    "restamped_sections": f"""WITH {PARTS_SQL}, mark AS (SELECT 'derived_from_obs_window=' AS w)
SELECT doc, 'Recent Themes' AS heading, doc % 2 = 1 AS changed,
       substr(CASE WHEN doc % 2 = 1 THEN '<!--om-section: last_reflected=2026-06-01 ' || w || '2026-05-01..2026-05-31-->' || nl || '- other'
                   ELSE '<!--om-section: last_reflected=2026-01-01 ' || w || 'a..b-->' || nl || '- theme' END, 1, 90) AS start FROM parts, mark
UNION ALL SELECT doc, 'Active Projects', false, substr('<!--om-section: last_reflected=2026-01-01 ' || w || 'a..b-->' || nl || '### ' || project || nl || '- ' || flat || ' <!--om', 1, 90) FROM parts, mark""",
    "fold_budgets": "SELECT doc_id, least(48000, greatest(157500 - 94500 - 2000 - length(coalesce(text, '')) - 6, 0)) AS context, CAST(94500 AS BIGINT) AS chunk FROM documents",
    "memory_context": """WITH f AS (SELECT CAST(doc_id // 10 AS VARCHAR) AS project, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS c FROM documents)
SELECT project, md5('## ' || project || chr(10) || chr(10) || string_agg('### ' || path || chr(10) || CASE WHEN length(c) > 500 THEN regexp_replace(substr(c, 1, 500), '\\s+$', '') || ' …' ELSE c END,
  chr(10) || chr(10) ORDER BY path)) AS text_md5 FROM f WHERE c <> '' GROUP BY project""",
    "file_status": """SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS lines, length(text) AS chars
FROM documents WHERE text IS NOT NULL""",
    "growth_lines": f"""WITH {GROWTH_SQL}, s AS (SELECT *, round(bytes / sum(bytes) OVER (), 4) AS share FROM sums)
SELECT doc, doc || '  ' || {SHOWN_BYTES.format("bytes")} || '  ' || printf('%.1f', floor(share * 1000 + 0.5) / 10) || '%  ' || bullets || ' bullets' AS line FROM s""",
    "growth_checks": f"""WITH {GROWTH_SQL} SELECT doc, CASE WHEN bytes > 30000 OR age_days > 20 THEN 'WARN' ELSE 'OK' END AS level,
concat_ws(',', CASE WHEN bytes > 30000 THEN 'size' END, CASE WHEN age_days > 20 THEN 'age' END) AS reason FROM sums""",
    "note_coldest": f"WITH {GROWTH_SQL} SELECT doc, age_days FROM sums ORDER BY age_days DESC, doc LIMIT 10",
    "pruned_entries": """WITH e AS (SELECT doc_id // 10 AS doc, doc_id % 10 AS line_no, doc_id AS n, doc_id % 3 = 0 AND doc_id % 4 > 0 AND doc_id % 30 >= 14 AS stale FROM documents)
SELECT 'stale-section' AS action, doc, '- ' || n AS line, CAST(row_number() OVER (PARTITION BY doc ORDER BY stale, line_no) AS INTEGER) AS position FROM e
UNION ALL SELECT 'drop', doc, '- ' || n, row_number() OVER (PARTITION BY doc ORDER BY line_no) FROM e WHERE NOT stale
UNION ALL SELECT 'annotate', doc, '- ' || n || CASE WHEN stale THEN ' <!-- stale=true -->' ELSE '' END, row_number() OVER (PARTITION BY doc ORDER BY line_no) FROM e""",
    "pruned_notes": f"""WITH p AS (SELECT doc_id AS doc, chr(10) AS nl, '- ' || {FLAT} || ' <!--om: kind=snapshot last_seen=' || {DAY} || CASE WHEN doc_id % 2 = 0 THEN 'T10:00:00+02:00' ELSE '' END || ' -->' || CASE WHEN doc_id % 5 = 0 THEN ' <!-- stale=true -->' ELSE '' END AS line,
  doc_id % 28 + 1 <= 18 AS stale FROM documents),
q AS (SELECT *, '- task <!--om: kind=task last_seen=2020-01-01-->' || nl || '- odd <!--om: kind=snapshot last_seen=soon-->' || nl || nl || '## Stale Snapshots' || nl || '- z <!--om: kind=snapshot last_seen=2020-01-01-->' AS rest, '## Facts' || nl AS head FROM p),
a AS (SELECT doc, 'stale-section' AS action, CASE WHEN stale THEN head || rest || nl || nl || '## Stale snapshots' || nl || nl || line ELSE head || line || nl || rest END AS t, stale FROM q
  UNION ALL SELECT doc, 'drop', CASE WHEN stale THEN head || rest ELSE head || line || nl || rest END, stale FROM q
  UNION ALL SELECT doc, 'annotate', head || line || CASE WHEN stale AND doc % 5 <> 0 THEN ' <!-- stale=true -->' ELSE '' END || nl || rest, stale FROM q)
SELECT doc, action, md5(t || chr(10)) AS text, CAST(stale AND action = 'drop' AS BIGINT) AS pruned, CAST(stale AND action = 'annotate' AS BIGINT) AS annotated, CAST(stale AND action = 'stale-section' AS BIGINT) AS stale_sectioned FROM a""",
    "stamped_notes": """WITH s AS (SELECT doc_id AS doc, '*Last updated: u' || doc_id || '*' AS u, '*Last reflected: r' || doc_id || '*' AS r, chr(10) AS nl FROM documents)
SELECT doc, CASE doc % 4 WHEN 0 THEN 'plain' || nl || 'text' WHEN 1 THEN '# T' || nl || u || nl || nl || r || nl || 'x'
  WHEN 2 THEN '# T' || nl || nl || u || nl || r || nl || 'x' ELSE '# T' || nl || nl || u || nl || r || nl || 'x' END AS text FROM s""",
    "freshness_notes": """WITH s AS (SELECT doc_id, doc_id % 50 AS k, doc_id % 6 = 0 AS lasting, doc_id % 40 AS age FROM documents),
seen AS (SELECT k, min(age) AS age FROM s WHERE NOT lasting GROUP BY k)
SELECT doc_id, '- tool' || s.k || ' version is v1.2' || CASE WHEN seen.age >= 4 THEN ' (as of ' || strftime(DATE '2026-06-01' - CAST(seen.age AS INTEGER), '%Y-%m-%d') || ' — verify)' ELSE ' ' END
  || '<!--om: kind=task-->' AS line FROM s LEFT JOIN seen USING (k)""",
    "more_scalars": f"""SELECT doc_id,
  '["' || array_to_string(list_sort(['inferred', 'medium', CASE WHEN doc_id % 5 = 0 THEN 'personal' ELSE 'normal' END, CASE WHEN doc_id % 5 IN (0, 3) THEN 'high' WHEN doc_id % 5 = 1 THEN 'low' ELSE 'medium' END, '1']), '","') || '"]' AS defaults,
  '{{"a":"q\\"' || doc_id || 'é","z":"' || doc_id || '"}}' AS canonical,
  CAST([900, 7200, 604800, 90, NULL, NULL][doc_id % 6 + 1] AS BIGINT) AS seconds, doc_id % 2 = 0 AS is_id, 'obs:é' || doc_id AS id_back, 'obs:é' || doc_id AS id_from_base64,
  CASE WHEN doc_id % 5 = 0 THEN 7 WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN NULL ELSE CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END + CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END END AS tokens,
  CASE WHEN doc_id % 2 = 0 THEN doc_id END AS typed,
  array_to_string(list_sort(list_distinct(list_filter(['and', 'app', 'om-relay', 'relay', 'src', 'src-app-py', 'worked', 'v' || doc_id], lambda x: length(x) >= 3))), ',') AS names,
  {SHOWN_BYTES.format("(doc_id * 977)")} AS shown_bytes,
  CASE WHEN doc_id % 4 = 0 THEN '—' WHEN doc_id < 10 THEN printf('$%.4f', doc_id / 1000.0::DOUBLE) ELSE '$' || format('{{:,.2f}}', doc_id / 1000.0::DOUBLE) END AS shown_usd,
  md5(CASE WHEN length(coalesce(text, '')) > 300 THEN regexp_replace(substr(text, 1, 300), '\\s+$', '') || ' …' ELSE coalesce(text, '') END) AS head_md5,
  md5(CASE WHEN length(coalesce(text, '')) <= 300 THEN coalesce(text, '') WHEN contains(right(text, 300), chr(10)) THEN substr(right(text, 300), position(chr(10) IN right(text, 300)) + 1) ELSE right(text, 300) END) AS tail_md5,
  doc_id % 2 = 1 AS visible, '<!--om: id=' || doc_id || ' kind=mode zeta=1-->' AS comment FROM documents""",
    "shared_notes": f"""WITH s AS (SELECT doc_id, doc_id % 3 = 0 AS open, chr(10) AS nl, {FLAT} AS flat FROM documents)
SELECT doc_id AS doc, md5('## A' || nl || '- open ' || flat || CASE WHEN open THEN nl || '- own <!--om: scope=cluster-->' || nl || '  - below' ELSE '' END
  || nl || '  - free <!--om: scope=cluster-->' || nl || nl || '## C' || nl || '- last') AS text_md5 FROM s""",
    "host_entries": "SELECT doc_id FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 <> 0)",
    "entry_provenance": """WITH e AS (SELECT doc_id // 3 AS grp, CASE WHEN doc_id % 2 = 0 THEN 'local' WHEN doc_id % 5 = 0 THEN 'cluster' END AS scope,
  CASE doc_id % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' END AS node, CASE WHEN doc_id % 7 > 0 THEN 'inferred' END AS kind FROM documents)
SELECT grp, CASE WHEN bool_or(scope = 'local') THEN 'local' WHEN bool_or(scope = 'cluster') THEN 'cluster' END AS scope,
       CASE WHEN count(DISTINCT node) = 1 THEN max(node) END AS owner, CASE WHEN count(DISTINCT kind) = 1 THEN max(kind) END AS source_type FROM e GROUP BY grp""",
    "section_ends": """WITH p AS (SELECT doc_id AS doc, CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 0 END AS more, doc_id % 3 = 0 AS prefs FROM documents)
SELECT doc, 'core-identity' AS handle, 6 AS first_line, 11 AS next_line FROM p
UNION ALL SELECT doc, 'preferences-opinions', 11, 17 FROM p WHERE prefs
UNION ALL SELECT doc, 'active-projects', 11 + more, 17 + more FROM p
UNION ALL SELECT doc, 'key-facts-context', 17 + more, 22 + more FROM p
UNION ALL SELECT doc, 'recent-themes', 22 + more, NULL FROM p""",
    "notes_since": f"SELECT doc_id AS doc, {DAY} AS heading FROM documents WHERE doc_id % 28 + 1 >= 10",
    "patched_notes": f"""WITH {PARTS_SQL}, {NOTE_SQL}, own AS (SELECT note.*, substr(flat, 1, 40) AS said, rtrim(substr(flat, 1, 40)) AS last_said FROM note JOIN parts USING (doc)),
done AS (SELECT doc, CASE doc % 9 WHEN 4 THEN NULL WHEN 5 THEN 'unknown handle' WHEN 6 THEN 'heading exists' WHEN 7 THEN 'text before the first block' WHEN 8 THEN 'handle not offered' END AS error,
  CASE doc % 9
    WHEN 0 THEN left(text, length(text) - 24) || '## Recent Themes' || nl || '- about ' || last_said || nl || nl
    WHEN 1 THEN replace(left(text, length(text) - 24), '### Q' || nl || '- q' || nl || nl || '## Key', '### Q' || nl || '- ' || said || nl || '## Key') || '## Recent Themes' || nl || '- about ' || last_said || nl || nl
    WHEN 2 THEN head || nl || nl || '## New Area' || nl || '- ' || last_said || nl || nl || substr(text, length(head) + 3)
    WHEN 3 THEN text || nl || nl || '## New Area' || nl || '- ' || last_said || nl || nl
    WHEN 4 THEN left(text, length(text) - 24) || '## Recent Themes' || nl || '- about ' || said || nl || nl || 'SECTION_HANDLE: ref:active-projects:q' || nl || '### Q' || nl || '- ' || last_said || nl || nl
    ELSE text END AS text FROM own)
SELECT doc, error, md5(text) AS text_md5, length(text) AS chars FROM done""",
    "rebuilt_notes": f"WITH {PARTS_SQL}, {NOTE_SQL} SELECT doc, md5(text) AS text_md5, length(text) AS chars FROM note",
    "repeated_bullets": f"""WITH {PARTS_SQL}, said AS (
  SELECT lower(regexp_replace(regexp_replace(regexp_replace(flat, '[🔴🟡🟢⚪\\x{{FE0F}}🔵🟠*`]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS key FROM parts),
every AS (
  SELECT key FROM said UNION ALL SELECT key FROM said
  UNION ALL SELECT unnest(['name: n' || doc, 'role/occupation: r', 'q', 'hot ' || doc, 'cold', 'theme']) FROM parts
  UNION ALL SELECT unnest(['preferences:', 'other: x']) FROM parts WHERE has_prefs)
SELECT key, count(*) - 1 AS n FROM every GROUP BY key HAVING count(*) > 1""",
    "chunked_texts": None,
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
