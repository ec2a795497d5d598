"""Queries of requests with their replies, of jobs with their answers, and of notes with what is said about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import jobs, replies, routing

from .relations import docs, table


def _outcomes(spark, sf_dir):
    """Every click asks the user's peer; views and purchases of the user within half a day are replies, some forged, unverified or empty."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    n, peer = F.col("event_id"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))
    requests = e.filter("event_type = 'click'").select(F.col("user_id").alias("request_id"), peer.alias("peer"), F.col("at").alias("asked_at"))
    said = e.filter("event_type IN ('view', 'purchase')").select(
        F.col("user_id").alias("request_id"), F.when(n % 10 == 0, "px").otherwise(peer).alias("sender"), F.col("at").alias("replied_at"), F.concat(F.lit("m"), n.cast("string")).alias("message_id"),
        (n % 17 > 0).alias("verified"), (n % 5 > 0).alias("ready"), (n % 3).alias("hits"),
    )
    found = replies.outcomes(requests, said, 43200, F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return found.select("request_id", "peer", F.date_format("asked_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("asked_at"), "status", "message_id")


def _states(spark, sf_dir):
    """A job per document, its text as all three inputs and as the answer; every ninth document's observations move before the polls."""
    d, n = docs(spark, sf_dir), F.col("doc_id")
    at = lambda h: F.lit(f"2026-06-01 0{h}:00:00").cast("timestamp").alias("at")
    name = lambda c: F.concat(F.lit(c), n.cast("string"))
    kinds = F.explode(F.array(*[F.lit(k) for k in jobs.INPUTS]))
    before = d.select(n.alias("note"), kinds.alias("kind"), F.col("content").alias("text"))
    moved = (F.col("kind") == "observations") & (F.col("note") % 9 == 0)
    after = before.withColumn("text", F.when(moved, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    sent = jobs.sent(d.filter(n % 13 > 0).select(name("j").alias("job_id"), n.alias("note"), at(1)), before)
    state = F.get(F.array(*[F.lit(s) for s in ("completed", "failed", "in_progress", "expired", "completed")]), (n % 5).cast("int"))
    poll = lambda h, status, file: d.select(name("j").alias("job_id"), n.alias("note"), name("x").alias("custom_id"), at(h), status.alias("batch_status"), file.alias("output_file_id"))
    polls = poll(3, state, F.when(n % 6 > 0, name("f"))).unionByName(poll(4, F.lit("completed"), name("f")))
    body = F.struct(F.array(F.struct(F.struct(F.col("content").alias("content")).alias("message"))).alias("choices"))
    line = F.to_json(F.struct(name("x").alias("custom_id"), F.struct(F.when(n % 10 == 3, 500).otherwise(200).alias("status_code"), body.alias("body")).alias("response")))
    lines = d.filter(n % 8 > 0).select(name("f").alias("output_file_id"), F.lit(1).alias("line_no"), line.alias("line"))
    off = jobs.cancelled(d.filter(n % 11 == 0).select(name("j").alias("job_id"), at(2)))
    found = jobs.states(sent.unionByName(jobs.polled(polls, lines, after)).unionByName(off))
    return found.select("job_id", "status", "error", F.md5("text").alias("text_md5"), F.array_join("moved", ",").alias("moved"), "artifact")


def _routable(spark, sf_dir):
    """A note per document, some of whose headings are words of the document, and the document's text as a chunk."""
    d, n = docs(spark, sf_dir), F.col("doc_id")
    words = F.regexp_extract_all("content", F.lit("[A-Za-z]{4,}"), 0)
    word = lambda i, every, other: F.coalesce(F.when(n % every == 0, F.get(words, i)), F.concat(F.lit(other), n.cast("string")))
    first, second = word(0, 3, "proj"), word(1, 4, "topic")
    text = F.concat(
        F.lit("# Notes\n\n## Core Identity\n- one\n\n## Active Projects\n### "), first, F.lit("-hub\n- a\n### Zz "), F.reverse(first), F.lit("\n- b\n\n## "), second, F.lit("\n- c\n\n## Recent Themes\n- t\n")
    )
    chunks = d.select(n.alias("doc"), F.lit(0).alias("chunk_id"), n.alias("fold"), F.col("content").alias("text"))
    return chunks, d.select(n.alias("doc"), text.alias("text"))


def _routes(spark, sf_dir):
    found = routing.routed(*_routable(spark, sf_dir))
    joined = [F.array_join(c, ",").alias(c) for c in ("sections", "subsections")]
    return found.select("doc", *joined, F.size("unmatched").cast("long").alias("n_unmatched"), F.md5(F.array_join("unmatched", ",")).alias("unmatched_md5"), "rotation")


def _contexts(spark, sf_dir):
    chunks, notes = _routable(spark, sf_dir)
    return routing.contexts(routing.routed(chunks, notes), notes).select("doc", "text")


QUERIES = {"reply_outcomes": _outcomes, "job_states": _states, "routed_chunks": _routes, "targeted_context": _contexts}

ROUTES_SQL = r"""d AS (SELECT doc_id AS n, text, regexp_extract_all(text, '[A-Za-z]{4,}') AS w, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_./-]*') AS names FROM documents),
t AS (SELECT n, coalesce(CASE WHEN n % 3 = 0 THEN w[1] END, 'proj' || n) AS p, coalesce(CASE WHEN n % 4 = 0 THEN w[2] END, 'topic' || n) AS q, regexp_matches(lower(coalesce(text, '')), 'today|working|wip|in progress|current|now|pr |release|commit|deploy|branch') AS cur,
  list_filter(list_distinct(list_transform(list_concat(names, flatten(list_transform(names, lambda x: string_split_regex(x, '[/.-]')))), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-'))), lambda x: length(x) >= 3) AS tokens FROM d),
k AS (SELECT *, [lower(p), 'hub', lower(p) || '-hub'] AS k1, [reverse(lower(p)), 'zz-' || reverse(lower(p))] AS k2, lower(q) AS ks FROM t),
h AS (SELECT *, list_has_any(tokens, k1) AS s1, list_has_any(tokens, k2) AS s2, list_contains(tokens, 'active-projects') AS s3, list_contains(tokens, ks) AS s4, list_contains(tokens, 'recent-themes') OR cur AS s5,
  list_sort(list_filter(tokens, lambda x: NOT list_contains(list_concat(k1, k2, ['active-projects', 'recent-themes', ks]), x))) AS unmatched FROM k),
r AS (SELECT *, NOT (s1 OR s2 OR s3 OR s4 OR s5) AS rotation FROM h),
f AS (SELECT *, s1 OR (rotation AND n % 2 = 0) AS b1, s2 OR (rotation AND n % 2 = 1) AS b2 FROM r)"""

ORACLE_SQL = {
    "reply_outcomes": """WITH q AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'click' AND ts IS NOT NULL),
r AS (SELECT user_id, ts, 'm' || event_id AS message_id, CASE WHEN event_id % 5 = 0 THEN 'UNAVAILABLE' WHEN event_id % 3 > 0 THEN 'OK' ELSE 'EMPTY' END AS status
  FROM events WHERE event_type IN ('view', 'purchase') AND event_id % 17 > 0 AND event_id % 10 > 0),
m AS (SELECT q.user_id, q.ts, message_id, status FROM q LEFT JOIN r ON r.user_id = q.user_id AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 12 HOUR
  QUALIFY row_number() OVER (PARTITION BY q.user_id, q.ts ORDER BY r.ts NULLS LAST, message_id) = 1)
SELECT user_id AS request_id, 'p' || (user_id % 4) AS peer, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS asked_at, coalesce(status, 'TIMEOUT') AS status, message_id
FROM m WHERE status IS NOT NULL OR ts + INTERVAL 12 HOUR < TIMESTAMP '2024-01-30 00:00:00'""",
    "routed_chunks": f"""WITH {ROUTES_SQL} SELECT n AS doc, concat_ws(',', 'ref:core-identity', CASE WHEN s3 THEN 'ref:active-projects' END, CASE WHEN s4 THEN 'ref:' || ks END, CASE WHEN s5 THEN 'ref:recent-themes' END) AS sections,
  concat_ws(',', CASE WHEN b1 THEN 'ref:active-projects:' || k1[3] END, CASE WHEN b2 THEN 'ref:active-projects:' || k2[2] END) AS subsections, len(unmatched) AS n_unmatched, md5(array_to_string(unmatched, ',')) AS unmatched_md5, rotation FROM f""",
    "targeted_context": f"""WITH {ROUTES_SQL}, x AS (SELECT *, chr(10) AS nl FROM f)
SELECT n AS doc, concat_ws(nl || nl, '## Core Identity' || nl || '- one', CASE WHEN s3 THEN '## Active Projects' || nl || '### ' || p || '-hub' || nl || '- a' || nl || '### Zz ' || reverse(p) || nl || '- b' END,
  CASE WHEN s4 THEN '## ' || q || nl || '- c' END, CASE WHEN s5 THEN '## Recent Themes' || nl || '- t' END, CASE WHEN b1 THEN '## Active Projects' || nl || nl || '### ' || p || '-hub' || nl || '- a' END,
  CASE WHEN b2 THEN '## Active Projects' || nl || nl || '### Zz ' || reverse(p) || nl || '- b' END) AS text FROM x""",
    "job_states": """WITH d AS (SELECT doc_id AS n, text, coalesce(text, '') AS t, CASE WHEN doc_id % 9 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS later FROM documents WHERE doc_id % 13 > 0),
e AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'cancelled' WHEN n % 5 = 1 THEN 'failed' WHEN n % 5 = 3 THEN 'expired' END AS ended, CASE WHEN n % 6 = 0 AND n % 5 <> 2 THEN 'no output file' WHEN n % 8 = 0 THEN 'no answer'
  WHEN n % 10 = 3 THEN 'request failed: HTTP 500' WHEN trim(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN 'no text' END AS fault FROM d),
s AS (SELECT *, CASE WHEN ended IS NOT NULL THEN ended WHEN fault IS NOT NULL THEN 'failed' WHEN sha256(t) <> sha256(later) THEN 'drifted' ELSE 'applied' END AS status FROM e)
SELECT 'j' || n AS job_id, status, CASE WHEN n % 11 = 0 THEN NULL WHEN ended IS NOT NULL THEN 'batch ' || ended ELSE fault END AS error, CASE WHEN status IN ('applied', 'drifted') THEN md5(text) END AS text_md5,
  CASE WHEN status = 'drifted' THEN 'observations' ELSE '' END AS moved, CASE WHEN status = 'drifted' THEN 'j' || n || '.result.md' END AS artifact FROM s""",
}
