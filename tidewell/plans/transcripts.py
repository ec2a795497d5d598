"""Transcript queries: the readers over JSON lines made from ``conversations``, cursors and file lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import messages as msg
from tidewell.sources import transcripts as t

from .relations import MESSAGES_SQL, docs, messages, table

NOW = "2026-06-01 00:00:00"
ROOTS = [("claude", "/home/a/projects"), ("codex", "/home/a/codex/sessions"), ("kimi", "/home/a/kimi/events.jsonl"), ("hermes", "/home/a")]


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), (F.col("turn") + 1).alias("line_no"), "role", "text",
        F.concat(F.lit("T"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("at"),
    )


def _lines(spark, sf_dir, entry):
    return _turns(spark, sf_dir).select("path", "line_no", F.to_json(entry).alias("line"))


def _block(kind, **fields):
    """A content block; all blocks of a list have the same fields, of which JSON leaves out the null ones."""
    names = ("text", "name", "input", "output", "content")
    shape = {"input": "struct<command:string>"}
    return F.struct(F.lit(kind).alias("type"), *[fields.get(n, F.lit(None).cast(shape.get(n, "string"))).alias(n) for n in names])


def _claude_lines(spark, sf_dir):
    """Odd lines are a list of a text, a tool call and an image; every seventh is meta; system lines are no messages."""
    odd = F.col("line_no") % 2 == 1
    call = _block("tool_use", name=F.lit("Bash"), input=F.struct(F.lit("ls -l").alias("command")))
    listed = F.to_json(F.array(_block("text", text=F.col("text")), call, _block("image")))
    content = F.when(odd, listed).otherwise(F.get(F.split(F.to_json(F.struct(F.col("text").alias("x"))), '^\\{"x":|\\}$'), 1))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.concat(
        F.lit('{"type":'), quoted(F.col("role")), F.lit(',"uuid":'), quoted(F.concat_ws("-", "path", "line_no")), F.lit(',"timestamp":'), quoted(F.col("at")),
        F.when(F.col("line_no") % 7 == 0, ',"isMeta":true').otherwise(""), F.lit(',"message":{"role":'), quoted(F.col("role")), F.lit(',"content":'), content, F.lit("}}"),
    )
    return _turns(spark, sf_dir).select("path", "line_no", line.alias("line"))


def _claude(spark, sf_dir):
    return t.claude(_claude_lines(spark, sf_dir)).select("path", "line_no", "role", F.md5("content").alias("content_md5"), "timestamp", "uuid")


def _counts(spark, sf_dir):
    lines = _claude_lines(spark, sf_dir)
    return t.transcript_counts(lines, t.claude(lines))


def _codex_lines(spark, sf_dir):
    """Three shapes by line: a message at the top, one in ``payload``, two in ``items``."""
    entry = F.struct("role", F.col("text").alias("content"))
    shape = F.col("line_no") % 3
    call = F.struct(F.lit("assistant").alias("role"), F.array(_block("function_call", name=F.lit("grep")), _block("tool_result", output=F.lit("ok"))).alias("content"))
    plain = F.to_json(F.struct("role", F.col("text").alias("content"), F.col("at").alias("timestamp")))
    inner = F.struct(F.lit("message").alias("type"), "role", F.array(_block("output_text", text=F.col("text"))).alias("content"))
    wrapped = F.to_json(F.struct(F.lit("response_item").alias("type"), F.col("at").alias("timestamp"), inner.alias("payload")))
    items = F.concat(F.lit('{"items":['), F.to_json(entry), F.lit(","), F.to_json(call), F.lit("]}"))
    line = F.when(shape == 0, plain).when(shape == 1, wrapped).otherwise(items)
    return _turns(spark, sf_dir).select("path", "line_no", line.alias("line"))


def _codex(spark, sf_dir):
    return t.codex(_codex_lines(spark, sf_dir)).select("path", "line_no", "item", "role", F.md5("content").alias("content_md5"), "timestamp")


def _codex_documents(spark, sf_dir):
    """The same conversations, each as one pretty JSON document: a list for odd ones, ``items`` for others."""
    entry = F.struct("line_no", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("j"))
    whole = _turns(spark, sf_dir).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["j"]), ",\n  ").alias("inner"))
    odd = F.substring("path", 2, 20).cast("long") % 2 == 1
    value = F.when(odd, F.concat(F.lit("[\n  "), "inner", F.lit("\n]\n"))).otherwise(F.concat(F.lit('{\n "items": [\n  '), "inner", F.lit("\n ]\n}\n")))
    files = whole.select("path", F.lit(None).cast("timestamp").alias("modified"), value.alias("value"))
    return t.codex(t.json_lines(files)).select("path", "line_no", "role", F.md5("content").alias("content_md5"))


def _migrated(spark, sf_dir):
    found = t.codex(_codex_lines(spark, sf_dir))
    cursors = found.select("path").distinct().withColumn("seen", F.substring("path", 2, 20).cast("long") % 13)
    return msg.migrated_cursors(found, cursors)


def _hermes(spark, sf_dir):
    """Assistant lines call a tool; every fifth of these says nothing else and ends the turn."""
    stub = (F.col("role") == "assistant") & (F.col("line_no") % 5 == 0)
    call = F.struct(F.struct(F.lit("terminal").alias("name"), F.lit('{"command": "make"}').alias("arguments")).alias("function"))
    entry = F.struct(
        "role", F.when(~stub, F.col("text")).alias("content"), F.col("at").alias("timestamp"), F.when(stub, "tool_calls").alias("finish_reason"),
        F.when(F.col("role") == "assistant", F.array(call)).alias("tool_calls"),
    )
    return t.hermes(_lines(spark, sf_dir, entry)).select("path", "line_no", "role", F.md5("content").alias("content_md5"), "timestamp")


def _grok_messages(spark, sf_dir):
    """Users' chunks as text, assistants' with tool markup, system lines as tool calls."""
    user = F.col("role") == "user"
    text = F.when(user, F.col("text")).otherwise(F.concat(F.lit("a <tool_call>x\ny</tool_call>  b "), F.col("line_no").cast("string")))
    kind = F.when(user, "user_message_chunk").when(F.col("role") == "assistant", "agent_message_chunk").otherwise("tool_call")
    content = F.when(F.col("role") != "system", F.struct(F.lit("text").alias("type"), text.alias("text")))
    update = F.struct(kind.alias("sessionUpdate"), content.alias("content"), F.when(F.col("role") == "system", "grep").alias("name"))
    entry = F.struct(F.lit("session/update").alias("method"), F.col("at").alias("timestamp"), F.struct(update.alias("update")).alias("params"))
    return t.grok(_lines(spark, sf_dir, entry))


def _grok_resumed(spark, sf_dir):
    found = _grok_messages(spark, sf_dir)
    number = F.substring("path", 2, 20).cast("long") % 4
    stamp = F.when(number > 0, F.concat(F.lit("T"), F.lpad((number * 2).cast("string"), 4, "0")))
    return msg.after_timestamp(found, found.select("path").distinct().withColumn("timestamp", stamp)).select("path", "line_no")


def _opencode(spark, sf_dir):
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.upper("role"))
    message = F.struct(role.alias("role"), F.col("text").alias("text"), F.col("at").alias("time"))
    kind = F.when(F.col("line_no") % 6 == 0, "session.idle").otherwise("message.updated")
    entry = F.struct(kind.alias("type"), F.struct(kind.alias("type"), message.alias("message")).alias("event"))
    return t.opencode(_lines(spark, sf_dir, entry)).select("path", "line_no", "role", F.md5("content").alias("content_md5"), "timestamp")


def _kimi_messages(spark, sf_dir):
    name = F.when(F.col("role") == "user", "UserPromptSubmit").when(F.col("role") == "assistant", "SubagentStop").otherwise("StopFailure")
    entry = F.struct(
        name.alias("hook_event_name"), F.when(F.col("role") == "user", F.col("text")).alias("prompt"), F.when(F.col("role") == "assistant", F.col("text")).alias("response"),
        F.lit("bot").alias("agent_name"), F.lit("boom").alias("error_type"), F.col("at").alias("om_captured_at"),
    )
    return t.kimi(_lines(spark, sf_dir, entry))


def _kimi_after(spark, sf_dir):
    found = _kimi_messages(spark, sf_dir)
    cursors = found.select("path").distinct().withColumn("line", F.substring("path", 2, 20).cast("long") % 5).filter("line > 1")
    return msg.after_lines(found, cursors).select("path", "line_no")


def _files(spark, sf_dir):
    """Documents as transcript files, a third of them under no known folder."""
    n = F.col("doc_id")
    folder = F.get(F.array(*[F.lit(x) for x in ("/home/a/projects/", "/home/a/codex/sessions/", "/home/b/", "/home/a/other/")]), (n % 4).cast("int"))
    path = F.when(n == 6, "/home/a/kimi/events.jsonl").otherwise(F.concat(folder, n.cast("string"), F.lit(".jsonl")))
    modified = F.timestamp_seconds(F.lit(1780272000) - (n * 7919) % 400_000)
    return docs(spark, sf_dir).select(path.alias("path"), modified.alias("modified"))


def _listed(df):
    return df.select("path", F.unix_seconds("modified").alias("stamp"))


def _prompts(spark, sf_dir):
    m = messages(spark, sf_dir)
    found = m.filter("line_no <= 2 AND role = 'user'").select("path", F.col("line_no").alias("rank"), F.substring("content", 1, 80).alias("text"))
    return msg.prompt_turns(m, found, 3, "EMPTY").select("path", F.md5("prompt").alias("prompt_md5"))


QUERIES = {
    "claude_messages": _claude,
    "claude_counts": _counts,
    "codex_messages": _codex,
    "codex_documents": _codex_documents,
    "codex_cursors": _migrated,
    "hermes_messages": _hermes,
    "grok_messages": lambda spark, sf_dir: _grok_messages(spark, sf_dir).select("path", "line_no", "role", F.md5("content").alias("content_md5"), "timestamp"),
    "grok_resumed": _grok_resumed,
    "opencode_messages": _opencode,
    "kimi_messages": lambda spark, sf_dir: _kimi_messages(spark, sf_dir).select("path", "line_no", "role", F.md5("content").alias("content_md5"), "timestamp"),
    "kimi_line_range": lambda spark, sf_dir: msg.within_lines(_kimi_messages(spark, sf_dir), 1, 4).select("path", "line_no"),
    "kimi_after_lines": _kimi_after,
    "recent_files": lambda spark, sf_dir: _listed(t.recent_files(_files(spark, sf_dir), F.lit(NOW).cast("timestamp"))),
    "newest_files": lambda spark, sf_dir: _listed(t.newest_files(_files(spark, sf_dir))),
    "unread_files": lambda spark, sf_dir: _listed(t.unread_files(_files(spark, sf_dir), _files(spark, sf_dir).filter(F.unix_seconds("modified") % 3 == 0))),
    "routed_files": lambda spark, sf_dir: t.routed(_files(spark, sf_dir), ROOTS).select("path", "reader"),
    "advanced_cursors": lambda spark, sf_dir: msg.advanced(
        messages(spark, sf_dir), messages(spark, sf_dir).select("path").distinct().withColumn("seen", F.length("path").cast("long")).filter("path LIKE '%1'")
    ),
    "reply_prompts": _prompts,
    "checkpoints_due": lambda spark, sf_dir: msg.checkpoint_due(
        messages(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("message_count")).select(
            "path", "message_count", (F.length("path") * 2).alias("seen_count"), (F.substring("path", 2, 20).cast("long") % 5 == 0).alias("forced"),
            F.when(F.substring("path", 2, 20).cast("long") % 3 > 0, F.lit("2026-05-31 23:00:00").cast("timestamp")).alias("last_observed"),
        ), F.lit(NOW).cast("timestamp"), 7200,
    ).select("path", "due"),
}

TURNS_SQL = """turns AS (
  SELECT 'c' || conv_id AS path, conv_id, turn + 1 AS line_no, role, text, 'T' || lpad(CAST(turn AS VARCHAR), 4, '0') AS stamp FROM conversations)"""
CLAUDE_SQL = f"""{TURNS_SQL}, claude AS (
  SELECT *, path || '-' || line_no AS uuid, CASE WHEN line_no % 2 = 1 THEN text || chr(10) || '[Bash: ls -l]' || chr(10) || '[1 image(s) shared]' ELSE text END AS content
  FROM turns WHERE role IN ('user', 'assistant') AND line_no % 7 <> 0)"""
CODEX_SQL = f"""{TURNS_SQL}, codex AS (
  SELECT path, conv_id, line_no, 0 AS item, role, text AS content, CASE WHEN line_no % 3 = 2 THEN '' ELSE stamp END AS timestamp FROM turns WHERE role IN ('user', 'assistant')
  UNION ALL SELECT path, conv_id, line_no, 1, 'assistant', '[Tool: grep]' || chr(10) || '[result: ok]', '' FROM turns WHERE line_no % 3 = 2)"""
GROK_SQL = f"""{TURNS_SQL}, grok AS (
  SELECT *, CASE role WHEN 'user' THEN text WHEN 'assistant' THEN 'a b ' || line_no || ' [tool call details omitted for observation]' ELSE '[Grok tool call: grep]' END AS content FROM turns)"""
KIMI_SQL = f"""{TURNS_SQL}, kimi AS (
  SELECT *, CASE role WHEN 'user' THEN text WHEN 'assistant' THEN '[bot subagent response] ' || text ELSE 'Kimi turn failed: boom' END AS content FROM turns)"""
FILES_SQL = """files AS (
  SELECT CASE WHEN doc_id = 6 THEN '/home/a/kimi/events.jsonl'
         ELSE ['/home/a/projects/', '/home/a/codex/sessions/', '/home/b/', '/home/a/other/'][doc_id % 4 + 1] || doc_id || '.jsonl' END AS path,
         1780272000 - (doc_id * 7919) % 400000 AS stamp FROM documents)"""

ORACLE_SQL = {
    "claude_messages": f"WITH {CLAUDE_SQL} SELECT path, line_no, role, md5(content) AS content_md5, stamp AS timestamp, uuid FROM claude",
    "claude_counts": f"""WITH {CLAUDE_SQL}, raw AS (SELECT path, count(*) AS lines FROM turns GROUP BY path)
SELECT path, lines, coalesce(n, 0) AS messages, last_uuid FROM raw
LEFT JOIN (SELECT path, count(*) AS n, max_by(uuid, line_no) AS last_uuid FROM claude GROUP BY path) USING (path)""",
    "codex_messages": f"WITH {CODEX_SQL} SELECT path, line_no, CAST(item AS INTEGER) AS item, role, md5(content) AS content_md5, timestamp FROM codex",
    "codex_documents": f"""WITH {TURNS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM turns)
SELECT path, CAST(n AS INTEGER) AS line_no, role, md5(text) AS content_md5 FROM placed WHERE role IN ('user', 'assistant')""",
    "codex_cursors": f"""WITH {CODEX_SQL}, sums AS (
  SELECT path, conv_id % 13 AS seen, count(*) AS n, count(*) FILTER (WHERE line_no <= conv_id % 13) AS until FROM codex GROUP BY path, conv_id)
SELECT path, CASE WHEN seen > n THEN until ELSE seen END AS seen FROM sums""",
    "hermes_messages": f"""WITH {TURNS_SQL}
SELECT path, line_no, role, md5(text || CASE WHEN role = 'assistant' THEN chr(10) || '[terminal: make]' ELSE '' END) AS content_md5, stamp AS timestamp
FROM turns WHERE role = 'user' OR (role = 'assistant' AND line_no % 5 <> 0)""",
    "grok_messages": f"WITH {GROK_SQL} SELECT path, line_no, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, md5(content) AS content_md5, stamp AS timestamp FROM grok",
    "grok_resumed": f"""WITH {GROK_SQL}, met AS (SELECT *, bool_or(line_no = conv_id % 4 * 2 + 1) OVER (PARTITION BY path) AS found FROM grok)
SELECT path, line_no FROM met WHERE conv_id % 4 = 0 OR (found AND line_no > conv_id % 4 * 2 + 1)""",
    "opencode_messages": f"WITH {TURNS_SQL} SELECT path, line_no, role, md5(text) AS content_md5, stamp AS timestamp FROM turns WHERE line_no % 6 <> 0",
    "kimi_messages": f"WITH {KIMI_SQL} SELECT path, line_no, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, md5(content) AS content_md5, stamp AS timestamp FROM kimi",
    "kimi_line_range": f"WITH {KIMI_SQL} SELECT path, line_no FROM kimi WHERE line_no BETWEEN 2 AND 4",
    "kimi_after_lines": f"WITH {KIMI_SQL} SELECT path, line_no FROM kimi WHERE line_no > CASE WHEN conv_id % 5 > 1 THEN conv_id % 5 ELSE 0 END",
    "recent_files": f"WITH {FILES_SQL} SELECT path, stamp FROM files WHERE stamp > 1780272000 - 86400",
    "newest_files": f"WITH {FILES_SQL} SELECT path, stamp FROM files ORDER BY stamp DESC, path LIMIT 50",
    "unread_files": f"WITH {FILES_SQL} SELECT path, stamp FROM files WHERE stamp % 3 <> 0",
    "routed_files": f"""WITH {FILES_SQL}
SELECT path, CASE WHEN path LIKE '/home/a/projects/%' THEN 'claude' WHEN path LIKE '/home/a/codex/%' THEN 'codex' WHEN path LIKE '%events.jsonl' THEN 'kimi'
            WHEN path LIKE '/home/a/%' THEN 'hermes' END AS reader FROM files""",
    "advanced_cursors": f"""WITH {MESSAGES_SQL}
SELECT path, CAST(CASE WHEN path LIKE '%1' THEN length(path) ELSE 0 END + CASE WHEN count(*) >= 5 THEN count(*) ELSE 0 END AS BIGINT) AS seen
FROM messages GROUP BY path HAVING path LIKE '%1' OR count(*) >= 5""",
    "reply_prompts": f"""WITH {MESSAGES_SQL}, last AS (
  SELECT path, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || content, chr(10) ORDER BY line_no) AS history FROM (
    SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) <= 3) GROUP BY path),
known AS (SELECT path, string_agg('[' || line_no || '] ' || substr(content, 1, 80), chr(10) ORDER BY line_no) AS memory FROM messages WHERE line_no <= 2 AND role = 'user' GROUP BY path)
SELECT path, md5('Memories:' || chr(10) || coalesce(memory, '(no memories: EMPTY)') || chr(10) || chr(10) || 'Conversation:' || chr(10) || history) AS prompt_md5
FROM last LEFT JOIN known USING (path)""",
    "checkpoints_due": f"""WITH {MESSAGES_SQL}, s AS (SELECT path, count(*) AS n, CAST(substr(path, 2) AS BIGINT) AS c FROM messages GROUP BY path)
SELECT path, n > length(path) * 2 AND (c % 5 = 0 OR c % 3 = 0) AS due FROM s""",
}
