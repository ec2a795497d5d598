"""Message, section and start-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import messages as msg
from tidewell.operators import sections, startup

from .relations import CHUNKS_SQL, MESSAGES_SQL, chunks, docs, messages

NOW = "2026-06-01 00:00:00"


def _cursor_uuid(spark, sf_dir):
    m = messages(spark, sf_dir)
    number = F.substring("path", 2, 20).cast("long")
    uuid = F.when(number % 3 == 0, None).when(number % 3 == 1, F.concat_ws("-", number.cast("string"), F.lit("1"))).otherwise("missing")
    cursors = m.select("path").distinct().withColumn("uuid", uuid)
    return msg.after_uuid(m, cursors).select("path", "line_no", "role")


def _cursor_count(spark, sf_dir):
    m = messages(spark, sf_dir)
    cursors = m.select("path").distinct().withColumn("seen", F.substring("path", 2, 20).cast("long") % 9).filter("seen <> 4")
    return msg.after_count(m, cursors).select("path", "line_no", F.col("msg_index").cast("long").alias("msg_index"))


def _notes(spark, sf_dir):
    """A note per thousand ids of a source and language: one dated section per document, its lines as bullets."""
    d = docs(spark, sf_dir)
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 180).cast("int")), "yyyy-MM-dd")
    body = F.concat(F.lit("## "), day, F.lit("\n- "), F.replace(F.coalesce("content", F.lit("")), F.lit("\n"), F.lit("\n- ")))
    name = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 1000).cast("long").cast("string"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", body.alias("b")))), lambda x: x["b"])
    return d.groupBy(name.alias("doc")).agg(F.concat(F.lit("# Notes\n"), F.array_join(ordered, "\n")).alias("text"))


NOTES_SQL = """part AS (
  SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || (doc_id // 1000) AS doc,
         CAST(DATE '2026-01-01' + CAST(doc_id % 180 AS INTEGER) AS DATE) AS date,
         '- ' || replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(10) || '- ') AS body
  FROM documents),
named AS (
  SELECT *, strftime(date, '%Y-%m-%d') AS slug, row_number() OVER (PARTITION BY doc, date ORDER BY doc_id) AS nth,
         row_number() OVER (PARTITION BY doc ORDER BY doc_id) AS ord FROM part)"""


def _note_sections(spark, sf_dir):
    return sections.sections(_notes(spark, sf_dir)).filter("ord > 0")


def _growth(spark, sf_dir):
    found = _note_sections(spark, sf_dir).withColumn("seen", F.col("date").cast("timestamp"))
    return sections.growth(found, ["doc"], F.lit(NOW).cast("timestamp"))


def _bullets(spark, sf_dir):
    """Lines of documents as bullets of chunks in order of id."""
    d = docs(spark, sf_dir)
    lines = d.select((F.col("doc_id")).alias("chunk_rank"), F.posexplode(F.split("content", "\n")).alias("at", "raw"))
    return lines.select(
        "chunk_rank", (F.col("at") + 1).alias("line_no"), F.concat(F.lit("- "), F.trim(F.regexp_replace("raw", "[*`]|\\s+", " "))).alias("line"),
        (F.col("chunk_rank") % 10 == 0).alias("exempt"),
    )


def _priorities(spark, sf_dir):
    c = chunks(spark, sf_dir)
    level = startup.priority(F.col("source"), F.col("heading"), F.col("body"), ["whsting", "eringer"])
    return c.withColumn("priority", level)


def _profile_all(spark, sf_dir):
    """All lines of the documents, in order of id and place."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    lines = lines.select("line", F.struct("doc_id", (F.col("at") + 1).cast("long").alias("pos")).alias("line_no"))
    return startup.profile_lines(lines, ["the ", "ing", "und"]).select("line", "line_no.doc_id", "line_no.pos", "score")


QUERIES = {
    "messages_after_uuid": _cursor_uuid,
    "messages_after_count": _cursor_count,
    "gated_paths": lambda spark, sf_dir: msg.gated(messages(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("n")),
    "message_batches": lambda spark, sf_dir: msg.batches(messages(spark, sf_dir), 3).groupBy("path", "batch").agg(F.count(F.lit(1)).alias("n")),
    "newest_turns": lambda spark, sf_dir: msg.newest_turns(messages(spark, sf_dir), 2).select("path", "line_no"),
    "latest_timestamps": lambda spark, sf_dir: msg.latest_timestamp(messages(spark, sf_dir)),
    "transcript_text": lambda spark, sf_dir: msg.transcript(messages(spark, sf_dir)).select("path", F.md5("text").alias("text_md5")),
    "note_sections": lambda spark, sf_dir: _note_sections(spark, sf_dir).select("doc", F.col("ord").cast("long").alias("ord"), "date", "handle", F.md5("body").alias("body_md5")),
    "note_retention": lambda spark, sf_dir: sections.retained(_note_sections(spark, sf_dir), "2026-05-01").groupBy("doc").agg(F.count(F.lit(1)).alias("n")),
    "note_latest": lambda spark, sf_dir: sections.latest_section(_note_sections(spark, sf_dir)).select("doc", "heading", F.md5("body").alias("body_md5")),
    "note_growth": _growth,
    "note_fattest": lambda spark, sf_dir: sections.fattest(_growth(spark, sf_dir), 10, "doc").select("doc", "bytes"),
    "chunk_priorities": lambda spark, sf_dir: _priorities(spark, sf_dir).select("handle", "priority"),
    "packed_chunks": lambda spark, sf_dir: startup.pack(_priorities(spark, sf_dir), 20000, ["payload"]).filter("taken").select("payload", "handle"),
    "first_sightings": lambda spark, sf_dir: startup.first_sightings(_bullets(spark, sf_dir)).select("chunk_rank", "line_no"),
    "profile_lines": _profile_all,
    "profile_all_lines": _profile_all,
}

PRIORITY_SQL = f"""{CHUNKS_SQL}, ranked AS (
  SELECT *, CASE heading WHEN 'Working Profile' THEN 14 WHEN 'Core Identity' THEN 8 WHEN 'Preferences' THEN 10 WHEN 'Active Projects' THEN 8
    ELSE CASE WHEN source = 'profile' THEN 7 ELSE 4 END END
    + CASE WHEN regexp_matches(lower(heading || ' ' || body), 'whsting|eringer') THEN 6 ELSE 0 END AS priority FROM chunks)"""
GROWTH_SQL = f"""{NOTES_SQL}, sums AS (
  SELECT doc, CAST(sum(strlen(body)) AS BIGINT) AS bytes, CAST(sum(len(string_split(regexp_replace(body, '\\n$', ''), chr(10)))) AS BIGINT) AS n_lines,
         CAST(sum(len(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '^\\s*[-*]\\s+')))) AS BIGINT) AS bullets,
         CAST(greatest(date_diff('day', max(date), DATE '2026-06-01'), 0) AS BIGINT) AS age_days
  FROM named GROUP BY doc)"""

ORACLE_SQL = {
    "messages_after_uuid": f"""WITH {MESSAGES_SQL}, numbered AS (SELECT *, CAST(substr(path, 2) AS BIGINT) AS number FROM messages)
SELECT path, line_no, role FROM numbered WHERE number % 3 = 0 OR (number % 3 = 1 AND line_no > 2 AND path IN (SELECT path FROM messages WHERE line_no = 2))""",
    "messages_after_count": f"""WITH {MESSAGES_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS msg_index, count(*) OVER (PARTITION BY path) AS n,
         CAST(substr(path, 2) AS BIGINT) % 9 AS seen FROM messages)
SELECT path, line_no, msg_index FROM numbered WHERE msg_index > CASE WHEN seen = 4 OR seen > n THEN 0 ELSE seen END""",
    "gated_paths": f"WITH {MESSAGES_SQL} SELECT path, count(*) AS n FROM messages GROUP BY path HAVING count(*) >= 5",
    "message_batches": f"""WITH {MESSAGES_SQL}, numbered AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY line_no) - 1) // 3 AS batch FROM messages)
SELECT path, batch, count(*) AS n FROM numbered GROUP BY ALL""",
    "newest_turns": f"WITH {MESSAGES_SQL} SELECT path, line_no FROM messages QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) <= 2",
    "latest_timestamps": f"WITH {MESSAGES_SQL} SELECT path, max(nullif(timestamp, '')) AS latest FROM messages GROUP BY path",
    "transcript_text": f"""WITH {MESSAGES_SQL}
SELECT path, md5(string_agg('[' || CASE WHEN timestamp = '' THEN '??:??' ELSE substr(timestamp, 1, 19) END || '] ' ||
  CASE WHEN role = 'user' THEN 'USER' ELSE 'ASSISTANT' END || ' [log]: ' || content, chr(10) || chr(10) ORDER BY line_no)) AS text_md5
FROM messages GROUP BY path""",
    "note_sections": f"""WITH {NOTES_SQL}
SELECT doc, ord, date, CASE WHEN nth = 1 THEN slug ELSE slug || '-' || nth END AS handle, md5(body) AS body_md5 FROM named""",
    "note_retention": f"WITH {NOTES_SQL} SELECT doc, count(*) AS n FROM named WHERE date >= DATE '2026-05-01' GROUP BY doc",
    "note_latest": f"""WITH {NOTES_SQL} SELECT doc, slug AS heading, md5(body) AS body_md5 FROM named
QUALIFY row_number() OVER (PARTITION BY doc ORDER BY date DESC, ord) = 1""",
    "note_growth": f"""WITH {GROWTH_SQL}
SELECT doc, bytes, n_lines, bullets, round(bytes / sum(bytes) OVER (), 4) AS share, age_days FROM sums""",
    "note_fattest": f"WITH {GROWTH_SQL} SELECT doc, bytes FROM sums ORDER BY bytes DESC, doc LIMIT 10",
    "chunk_priorities": f"WITH {PRIORITY_SQL} SELECT handle, CAST(priority AS INTEGER) AS priority FROM ranked",
    "packed_chunks": f"""WITH RECURSIVE {PRIORITY_SQL}, item AS (
  SELECT *, row_number() OVER (PARTITION BY payload ORDER BY -priority, source, heading, handle, size) AS n FROM ranked),
fold AS (
  SELECT payload, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, '' AS handle, false AS taken FROM item GROUP BY payload
  UNION ALL
  SELECT i.payload, i.n, CAST(CASE WHEN f.used + i.size <= 20000 THEN f.used + i.size ELSE f.used END AS BIGINT), i.handle, f.used + i.size <= 20000
  FROM fold f JOIN item i ON i.payload = f.payload AND i.n = f.n + 1)
SELECT payload, handle FROM fold WHERE taken""",
    "profile_all_lines": """WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM split),
once AS (SELECT ls[pos] AS line, doc_id, pos FROM numbered QUALIFY row_number() OVER (PARTITION BY ls[pos] ORDER BY doc_id, pos) = 1)
SELECT line, doc_id, pos, CAST(4 * (contains(lower(line), 'the ')::INT + contains(lower(line), 'ing')::INT + contains(lower(line), 'und')::INT)
  + contains(line, '🔴')::INT AS INTEGER) AS score
FROM once ORDER BY score DESC, doc_id, pos LIMIT 16""",
}
ORACLE_SQL["profile_lines"] = ORACLE_SQL["profile_all_lines"]
ORACLE_SQL["first_sightings"] = """WITH ls AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, i AS line_no, trim(regexp_replace(ls[i], '[*`]|\\s+', ' ', 'g')) AS body FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ls)),
line AS (SELECT *, '- ' || body AS line, doc_id % 10 = 0 AS exempt FROM raw),
keyed AS (
  SELECT *, CASE WHEN NOT exempt THEN nullif(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    trim(regexp_replace(regexp_replace(line, '(?s)<!--om:.*$', ''), '(?i)\\s*\\(as of [^)]*verify\\)', '', 'g')), '^[-*]\\s+', ''),
    '[🔴🟡🟢⚪\\x{FE0F}🔵🟠*`]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))), '') END AS key FROM line)
SELECT doc_id AS chunk_rank, CAST(line_no AS INTEGER) AS line_no FROM keyed
QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY doc_id, line_no) = 1"""
