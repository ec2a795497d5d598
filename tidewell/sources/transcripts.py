"""Agent transcripts to normalised messages.

Each reader takes lines (path, line_no, line) and gives (path, line_no, role, content, timestamp,
source) and what its cursor needs. Lines are JSON of varying shape, so they are read as VARIANT;
blank and malformed lines, and lines of another shape, give no message. Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import strip

COLUMNS = ("path", "line_no", "role", "content", "timestamp", "source")


def read_files(spark: SparkSession, paths: str | list[str], modified_after: str | None = None) -> DataFrame:
    """(path, modified, value) of text files; each file is one transcript."""
    reader = spark.read.option("modifiedAfter", modified_after) if modified_after else spark.read
    return reader.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value"
    )


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, line, modified) of whole files (path, modified, value)."""
    split = files.select("path", "modified", F.split("value", "\r\n|\n|\r").alias("_all"))
    each = split.select("path", "modified", F.posexplode("_all").alias("_at", "line"))
    return each.select("path", (F.col("_at") + 1).alias("line_no"), "line", "modified")


def json_lines(files: DataFrame) -> DataFrame:
    """As ``file_lines``, but a file that is one JSON document gives an entry per line: those of an array, or of its ``items``, else itself.

    A file whose first line is an object by itself is read by lines, as the parser stops after the first value.
    """
    v, lines = F.col("_v"), F.filter(F.split("value", "\r\n|\n|\r"), lambda x: F.trim(x) != "")
    by_line = _is(F.try_parse_json(F.get(lines, 0)), "OBJECT")
    whole = F.when(_is(v, "ARRAY"), _items(v, "$")).when(_is(_get(v, "$.items", "variant"), "ARRAY"), _items(v, "$.items")).when(_is(v, "OBJECT"), F.array(v))
    entries = F.when(~by_line, whole)
    parsed = files.withColumn("_v", F.try_parse_json("value"))
    texts = F.coalesce(F.transform(entries, lambda x: F.to_json(x)), F.split("value", "\r\n|\n|\r"))
    each = parsed.select("path", "modified", texts.alias("_all")).select("path", "modified", F.posexplode("_all").alias("_at", "line"))
    return each.select("path", (F.col("_at") + 1).alias("line_no"), "line", "modified")


def read_lines(spark: SparkSession, paths: str | list[str], modified_after: str | None = None) -> DataFrame:
    """(path, line_no from 1, line, modified) of text files."""
    return file_lines(read_files(spark, paths, modified_after))


def recent_files(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Files (path, modified) changed less than ``hours`` before ``now``, newest first."""
    return files.filter(F.col("modified").cast("double") > now.cast("double") - hours * 3600).orderBy(F.desc("modified"), "path")


def newest_files(files: DataFrame, most: int = 50) -> DataFrame:
    return files.orderBy(F.desc("modified"), "path").limit(most)


def unread_files(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files without a cursor (path), oldest first: what a backfill reads."""
    return files.join(cursors.select("path"), "path", "left_anti").orderBy("modified", "path")


def routed(files: DataFrame, roots: list[tuple[str, str]]) -> DataFrame:
    """Adds ``reader``: that of the first (reader, folder or file) of ``roots`` that a path lies under or is; null if none."""
    hit = F.lit(None).cast("string")
    for reader, root in reversed(roots):
        under = F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")) | (F.col("path") == root)
        hit = F.when(under, reader).otherwise(hit)
    return files.withColumn("reader", hit)


def transcript_counts(lines: DataFrame, messages: DataFrame) -> DataFrame:
    """(path, lines, messages, last_uuid): counted without keeping texts; ``messages`` are the reader's, with uuid."""
    raw = lines.groupBy("path").agg(F.count_if(F.trim("line") != "").alias("lines"))
    said = messages.groupBy("path").agg(F.count(F.lit(1)).alias("messages"), F.max_by("uuid", "line_no").alias("last_uuid"))
    return raw.join(said, "path", "left").na.fill({"messages": 0})


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """The string at a path, null if something else is there."""
    inner = _get(v, path, "variant")
    return F.when(_is(inner, "STRING"), _get(v, path))


def _items(v: Column, path: str) -> Column:
    """The array at a path as array<variant>, empty if something else is there."""
    inner = _get(v, path, "variant")
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.when(_is(inner, "ARRAY"), _get(v, path, "array<variant>")), empty)


def _or(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _joined(parts: Column) -> Column:
    return strip(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n"))


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.try_parse_json("line")).filter(_is(F.col("v"), "OBJECT"))


def _messages(rows: DataFrame, source: str, *extra: str) -> DataFrame:
    kept = rows.filter(F.coalesce("content", F.lit("")) != "")
    return kept.withColumn("source", F.lit(source)).withColumn("timestamp", F.coalesce("timestamp", F.lit(""))).select(*COLUMNS, *extra)


#: The input field that sums up a call of each tool.
TOOL_FIELDS = {
    "Read": "file_path", "Write": "file_path", "Edit": "file_path", "Glob": "pattern", "Grep": "pattern",
    "WebSearch": "query", "WebFetch": "url", "Task": "description",
}


def _claude_block(b: Column) -> Column:
    kind, tool = _get(b, "$.type"), F.coalesce(_get(b, "$.name"), F.lit("unknown"))
    note = F.when(tool == "Bash", _or(_text(b, "$.input.description"), F.substring(_text(b, "$.input.command"), 1, 100)))
    for name, field in TOOL_FIELDS.items():
        note = note.when(tool == name, F.coalesce(_get(b, f"$.input.{field}"), F.lit("?")))
    known = tool.isin("Bash", *TOOL_FIELDS)
    call = F.when(known, F.concat(F.lit("["), tool, F.lit(": "), F.coalesce(note, F.lit("")), F.lit("]"))).otherwise(F.concat(F.lit("["), tool, F.lit("]")))
    return F.when(_is(b, "STRING"), _get(b, "$")).when(kind == "text", _get(b, "$.text")).when(kind == "tool_use", call)


def _claude_images(b: Column) -> Column:
    inner = F.filter(_items(b, "$.content"), lambda s: _get(s, "$.type") == "image")
    kind = _get(b, "$.type")
    return F.when(kind == "image", 1).when(kind == "tool_result", F.size(inner)).otherwise(0)


def claude(lines: DataFrame, cursors: DataFrame | None = None, source: str = "claude") -> DataFrame:
    """User and assistant lines that are not meta. ``cursors`` (path, uuid): only lines after the one with that id."""
    rows = _parsed(lines).filter(_get(F.col("v"), "$.type").isin("user", "assistant"))
    rows = rows.withColumn("uuid", _get(F.col("v"), "$.uuid"))
    if cursors is not None:
        from tidewell.operators.messages import after_uuid

        rows = after_uuid(rows, cursors)
    v = F.col("v")
    blocks = _items(v, "$.message.content")
    images = F.aggregate(F.transform(blocks, _claude_images), F.lit(0), lambda a, x: a + x)
    shared = F.when(images > 0, F.concat(F.lit("["), images.cast("string"), F.lit(" image(s) shared]")))
    listed = _joined(F.concat(F.transform(blocks, _claude_block), F.array(shared)))
    rows = rows.filter(~F.coalesce(_get(v, "$.isMeta", "boolean"), F.lit(False)))
    rows = rows.withColumn("content", F.coalesce(strip(_text(v, "$.message.content")), listed))
    rows = rows.withColumn("timestamp", _or(_get(v, "$.timestamp"), _get(v, "$._audit_timestamp")))
    return _messages(rows.withColumn("role", F.coalesce(_get(v, "$.message.role"), F.lit(""))), source, "uuid")


def _codex_content(entry: Column) -> Column:
    def parts(b: Column) -> Column:
        kind = _get(b, "$.type")
        name = F.coalesce(_get(b, "$.name"), _get(b, "$.function.name"), F.lit("?"))
        result = F.coalesce(_text(b, "$.output"), _text(b, "$.content"))
        tool = F.when(kind.isin("tool_use", "function_call"), F.concat(F.lit("[Tool: "), name, F.lit("]"))).when(
            (kind == "tool_result") & (F.length(result) < 300), F.concat(F.lit("[result: "), F.substring(result, 1, 200), F.lit("]"))
        )
        return F.when(_is(b, "STRING"), F.array(_get(b, "$"))).otherwise(F.array(_text(b, "$.text"), tool))

    return F.coalesce(strip(_text(entry, "$.content")), _joined(F.flatten(F.transform(_items(entry, "$.content"), parts))))


def codex(lines: DataFrame) -> DataFrame:
    """Messages at the top level, in ``payload`` or in ``message``; a line may wrap several in ``items``. Whole documents come by ``json_lines``."""
    v = F.col("v")
    rows = _parsed(lines)
    wrapped = _get(v, "$.type").isNull() & (F.size(_items(v, "$.items")) > 0)
    one = F.when(wrapped, _items(v, "$.items")).otherwise(F.array(v))
    rows = rows.select("path", "line_no", F.posexplode(one).alias("item", "v"))
    spoken = ("user", "assistant")
    places = [
        (_get(v, "$.role").isin(*spoken), v),
        ((_get(v, "$.payload.type") == "message") & _get(v, "$.payload.role").isin(*spoken), _get(v, "$.payload", "variant")),
        (_get(v, "$.message.role").isin(*spoken), _get(v, "$.message", "variant")),
    ]
    entry = F.coalesce(*[F.when(c, e) for c, e in places])
    rows = rows.withColumn("e", entry).filter(F.col("e").isNotNull())
    rows = rows.withColumn("role", _get(F.col("e"), "$.role")).withColumn("content", _codex_content(F.col("e")))
    rows = rows.withColumn("timestamp", F.coalesce(_get(v, "$.timestamp"), _get(v, "$.created_at")))
    return _messages(rows, "codex", "item")


def _hermes_call(c: Column) -> Column:
    name = F.coalesce(_get(c, "$.function.name"), F.lit("unknown"))
    raw = _get(c, "$.function.arguments", "variant")
    args = F.when(_is(raw, "STRING"), F.try_parse_json(_get(c, "$.function.arguments"))).otherwise(raw)
    get = lambda k: F.coalesce(_get(args, f"$.{k}"), F.lit("?"))
    path = F.coalesce(_get(args, "$.path"), _get(args, "$.file_path"), F.lit("?"))
    wrap = lambda label, text: F.concat(F.lit("["), label, F.lit(": "), text, F.lit("]"))
    plain = F.concat(F.lit("["), name, F.lit("]"))
    command, action = _or(_get(args, "$.command")), _or(_get(args, "$.action"))
    return (
        F.when(name == "terminal", F.coalesce(wrap(name, F.substring(command, 1, 100)), plain))
        .when(name.isin("file_read", "read_file"), wrap(F.lit("read"), path))
        .when(name.isin("file_write", "write_file", "file_edit"), wrap(name, path))
        .when(name == "web_search", wrap(name, get("query")))
        .when(name == "web_fetch", wrap(name, F.substring(get("url"), 1, 80)))
        .when(name.isin("recall", "session_search"), wrap(F.lit("recall"), get("query")))
        .when(name == "delegate", wrap(name, F.substring(get("task"), 1, 80)))
        .when(name == "skill", wrap(name, get("name")))
        .when(name == "cron", F.coalesce(wrap(name, action), plain))
        .otherwise(plain)
    )


def hermes(lines: DataFrame) -> DataFrame:
    """User text; assistant prose with one line per tool call. Calls alone that end the turn give nothing."""
    v = F.col("v")
    rows = _parsed(lines).withColumn("role", _get(v, "$.role")).filter(F.col("role").isin("user", "assistant"))
    prose = F.transform(
        _items(v, "$.content"), lambda b: F.when(_is(b, "STRING"), strip(_get(b, "$"))).when(_get(b, "$.type") == "text", strip(_get(b, "$.text")))
    )
    parts = F.concat(F.array(strip(_text(v, "$.content"))), prose, F.transform(_items(v, "$.tool_calls"), _hermes_call))
    said = F.exists(parts, lambda p: F.coalesce(p, F.lit("")).rlike("^[^\\[]"))
    stub = ~said & F.coalesce(_get(v, "$.finish_reason") == "tool_calls", F.lit(False))
    content = F.when(F.col("role") == "user", strip(_text(v, "$.content"))).when(~stub, _joined(parts))
    return _messages(rows.withColumn("content", content).withColumn("timestamp", _get(v, "$.timestamp")), "hermes")


def grok(lines: DataFrame) -> DataFrame:
    """Session updates: text without tool-call markup, tool calls by name, thoughts and other text fields.

    Content without a text type gives its first text field, by name.
    """
    v = F.col("v")
    rows = _parsed(lines).filter(_get(v, "$.method") == "session/update").withColumn("u", _get(v, "$.params.update", "variant"))
    u, kind = F.col("u"), F.coalesce(_get(F.col("u"), "$.sessionUpdate"), F.lit(""))
    text = F.when(_get(u, "$.content.type") == "text", _text(u, "$.content.text"))
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)<tool_call>.*?(?:</tool_call>|$)", ""), "\\s+", " ")
    cleaned = F.when(F.contains(text, F.lit("<tool_call>")), F.concat(strip(bare), F.lit(" [tool call details omitted for observation]"))).otherwise(text)
    listed = _joined(F.transform(_items(u, "$.content"), lambda b: F.coalesce(F.when(_is(b, "STRING"), _get(b, "$")), _get(b, "$.text"))))
    fields = F.map_values(_get(u, "$.content", "map<string,variant>"))
    other = F.get(F.filter(F.transform(F.when(_is(_get(u, "$.content", "variant"), "OBJECT"), fields), lambda x: F.when(_is(x, "STRING"), strip(_get(x, "$")))), lambda x: x != ""), 0)
    call = F.concat(F.lit("[Grok tool call: "), F.coalesce(_or(_get(u, "$.name")), _get(u, "$.tool.name"), F.lit("unknown_tool")), F.lit("]"))
    loose = _or(strip(_text(u, "$.text")), strip(_text(u, "$.delta")))
    thought = F.concat(F.lit("[thought] "), F.substring(loose, 1, 500))
    content = _or(
        strip(cleaned), F.when(_get(u, "$.content.type") == "text", None).otherwise(other), strip(_text(u, "$.content")), listed, F.when(F.contains(kind, F.lit("tool_call")), call),
        F.when(F.contains(kind, F.lit("thought")), thought), loose, strip(_text(u, "$.message")), strip(_get(u, "$.message.text")),
    )
    role = F.when(F.contains(kind, F.lit("user_message")), "user").otherwise("assistant")
    return _messages(rows.withColumn("content", content).withColumn("role", role).withColumn("timestamp", _get(v, "$.timestamp")), "grok")


def _role(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin("user", "assistant", "system"), low).when(low.isin("agent", "ai", "model"), "assistant")


def _loose_text(v: Column, at: str) -> Column:
    """Text in any of the usual fields of an object."""

    def field(name: str) -> Column:
        parts = F.transform(
            _items(v, f"{at}.{name}"),
            lambda b: F.coalesce(
                F.when(_is(b, "STRING"), _get(b, "$")),
                F.when(_get(b, "$.type").isin("text", "input_text", "output_text"), _text(b, "$.text")),
                _text(b, "$.content"),
            ),
        )
        return _or(strip(_text(v, f"{at}.{name}")), _joined(parts), strip(_text(v, f"{at}.{name}.text")), strip(_text(v, f"{at}.{name}.content")))

    return _or(*[field(n) for n in ("text", "content", "message", "parts")])


def opencode(lines: DataFrame) -> DataFrame:
    """Events of messages or parts of them; roles by their aliases."""
    v = F.col("v")
    rows = _parsed(lines)
    event = F.when(_is(_get(v, "$.event", "variant"), "OBJECT"), _get(v, "$.event", "variant")).otherwise(v)
    rows = rows.withColumn("e", event)
    e = F.col("e")
    kind = F.coalesce(_or(_get(e, "$.type"), _get(v, "$.type")), F.lit(""))
    rows = rows.filter((kind == "") | kind.rlike("message|part"))
    rows = rows.withColumn("c", F.when(_is(_get(e, "$.message", "variant"), "OBJECT"), _get(e, "$.message", "variant")).otherwise(e))
    c = F.col("c")
    own = _loose_text(c, "$")
    rows = rows.withColumn("content", F.coalesce(own, _loose_text(e, "$.part")))
    role = _role(_or(_get(c, "$.role"), _get(c, "$.author"), _get(c, "$.speaker")))
    rows = rows.withColumn("role", F.coalesce(role, F.when(own.isNull(), _role(_get(e, "$.part.role"))))).filter("role IS NOT NULL")
    times = [_get(c, f"$.{k}") for k in ("time", "timestamp", "created")] + [_get(e, "$.time"), _get(e, "$.timestamp"), _get(v, "$.received_at")]
    return _messages(rows.withColumn("timestamp", _or(*times)), "opencode")


def kimi(lines: DataFrame, now: Column | None = None) -> DataFrame:
    """Four kinds of hook events; the cursor is the physical line."""
    v = F.col("v")
    rows = _parsed(lines).withColumn("name", _or(_get(v, "$.hook_event_name"), _get(v, "$.event")))
    field = lambda *names: _or(*[strip(_or(*[_get(v, f"$.{n}") for n in names]))])
    agent = F.coalesce(field("agent_name"), F.lit("subagent"))
    name, prompt = F.col("name"), field("prompt")
    content = (
        F.when(name == "UserPromptSubmit", prompt)
        .when(name == "SubagentStart", F.concat(F.lit("["), agent, F.lit(" subagent prompt] "), prompt))
        .when(name == "SubagentStop", F.concat(F.lit("["), agent, F.lit(" subagent response] "), field("response")))
        .when(name == "StopFailure", F.concat(F.lit("Kimi turn failed: "), field("error_message", "error_type")))
    )
    role = F.when(name.isin("UserPromptSubmit", "SubagentStart"), "user").otherwise("assistant")
    stamp = F.coalesce(_or(_get(v, "$.om_captured_at")), (now if now is not None else F.current_timestamp()).cast("string"))
    return _messages(rows.withColumn("content", content).withColumn("role", role).withColumn("timestamp", stamp), "kimi")


READERS: dict[str, Callable[..., DataFrame]] = {
    "claude": claude,
    "cowork": lambda lines, cursors=None: claude(lines, cursors, "cowork"),
    "codex": codex,
    "hermes": hermes,
    "grok": grok,
    "opencode": opencode,
    "kimi": kimi,
}


def read_all(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    """Messages of every source, one read per source: ``places`` maps a reader's name to its paths."""
    out = None
    for name, paths in places.items():
        files = read_files(spark, paths)
        found = READERS[name](json_lines(files) if name == "codex" else file_lines(files)).select(*COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out
