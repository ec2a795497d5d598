"""Memory files, index documents, secret scans, provenance, job states."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import strip
from tidewell.operators.sections import sections

#: Characters of the parts that a task of ``byte_chunks`` holds as Python strings.
TOGETHER = 1 << 20

#: What the searchable document of a memory file may take from its front matter.
FRONT_KEYS = ("name", "type", "description")

#: Patterns of material that must not leave a host in plain text.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{16,}",
    "api_key": r"\bsk-[A-Za-z0-9_-]{16,}",
}


def front_matter(content: Column) -> Column:
    """struct<fields, body>: the ``key: value`` lines between a leading ``---`` and the next one; else no fields and all as body."""
    closed = content.rlike("(?s)^---.*?---")
    head = F.when(closed, F.regexp_extract(content, "(?s)^---(.*?)---", 1)).otherwise("")
    body = F.when(closed, strip(F.regexp_replace(content, "(?s)^---.*?---", ""))).otherwise(content)
    kept = F.filter(F.transform(F.split(head, "\n"), strip), lambda x: F.contains(x, F.lit(":")) & ~F.startswith(x, F.lit("#")))
    pairs = F.transform(
        kept,
        lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("value")),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.struct(F.map_from_entries(last).alias("fields"), body.alias("body"))


def memory_documents(files: DataFrame) -> DataFrame:
    """Searchable documents of memory files (project, stem, content); blank files are left out."""
    rows = files.filter(F.coalesce(strip(F.col("content")), F.lit("")) != "").withColumn("m", front_matter(F.col("content")))
    field = lambda k: F.nullif(F.try_element_at(F.col("m.fields"), F.lit(k)), F.lit(""))
    name = F.coalesce(field("name"), F.initcap(F.translate("stem", "_-", "  ")))
    rows = rows.withColumn("heading", F.concat(F.lit("### "), "project", F.lit(": "), name))
    body = F.when(F.col("m.body") == "", F.col("content")).otherwise(F.col("m.body"))
    meta = F.map_filter("m.fields", lambda k, v: k.isin(*FRONT_KEYS))
    return rows.select(
        F.concat(F.lit("amem:"), "project", F.lit("/"), "stem").alias("doc_id"),
        F.lit("auto_memory").alias("source"),
        "heading",
        F.concat_ws("\n\n", "heading", field("description"), body).alias("content"),
        F.map_concat(meta, F.create_map(F.lit("project"), F.col("project"), F.lit("is_index"), (F.col("stem") == "MEMORY").cast("string"))).alias("metadata"),
        F.sha2("content", 256).alias("content_hash"),
    )


def note_documents(notes: DataFrame, source: str, prefix: str, dated: bool) -> DataFrame:
    """Searchable documents of the second-level sections of notes (doc, text), by date or by slug."""
    found = sections(notes).filter("heading IS NOT NULL")
    found = found.filter("date IS NOT NULL") if dated else found
    key = F.date_format("date", "yyyy-MM-dd") if dated else F.col("slug")
    return found.select(
        F.concat(F.lit(f"{prefix}:"), key).alias("doc_id"),
        F.lit(source).alias("source"),
        F.concat(F.lit("## "), "heading").alias("heading"),
        strip(F.concat(F.lit("## "), "heading", F.lit("\n"), "body")).alias("content"),
    )


def index_documents(observations: DataFrame, reflections: DataFrame, memory_files: DataFrame) -> DataFrame:
    """The bag of documents of all three sources."""
    columns = ["doc_id", "source", "heading", "content"]
    out = note_documents(observations, "observations", "obs", True).unionByName(note_documents(reflections, "reflections", "ref", False))
    return out.unionByName(memory_documents(memory_files).select(columns))


def secret_findings(files: DataFrame) -> DataFrame:
    """(path, pattern) of files (path, content) that hold a secret."""
    hits = F.array(*[F.when(F.col("content").rlike(p), F.lit(name)) for name, p in SECRETS.items()])
    return files.select("path", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("pattern"))


def scan_report(files: DataFrame) -> DataFrame:
    """One row: files, bytes, findings, and whether all is well."""
    n = F.size(F.filter(F.array(*[F.col("content").rlike(p) for p in SECRETS.values()]), lambda h: h))
    sums = files.agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("byte_count"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("findings")
    )
    return sums.withColumn("ok", F.col("findings") == 0)


def provenance_of(records: DataFrame, query: str) -> DataFrame:
    """Records of this id, or whose payload holds the words in any case."""
    return records.filter((F.col("record_id") == query) | F.contains(F.lower("payload"), F.lit(query.lower())))


def rendered_log(positioned: DataFrame) -> DataFrame:
    """(date, text): a day's records (date, position, label, body, record_id) under one heading, in order."""
    block = F.concat(F.lit("### From "), "label", F.lit("\n\n"), F.when(strip(F.col("body")) == "", "").otherwise(F.concat(strip(F.col("body")), F.lit("\n"))), F.lit("\n<!-- record: "), "record_id", F.lit(" -->"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))), lambda x: x["b"])
    return positioned.groupBy("date").agg(F.concat(F.lit("## "), F.first("date"), F.lit("\n\n"), F.array_join(ordered, "\n\n")).alias("text"))


def job_transitions(jobs: DataFrame, current: DataFrame) -> DataFrame:
    """Adds ``next_status``: a completed job applies if no input hash moved since it was sent, else it has drifted; others stay.

    ``jobs`` (job_id, status, hashes map<string,string>), ``current`` (name, hash).
    """
    now = current.agg(F.map_from_entries(F.collect_list(F.struct("name", "hash"))).alias("_now"))  # one row of a few inputs
    met = jobs.join(F.broadcast(now))
    same = F.forall(F.map_entries("hashes"), lambda e: F.coalesce(F.try_element_at(F.col("_now"), e["key"]) == e["value"], F.lit(False)))
    return met.withColumn("next_status", F.when(F.col("status") == "completed", F.when(same, "applied").otherwise("drifted")).otherwise(F.col("status"))).drop("_now")


def memory_files(files: DataFrame) -> DataFrame:
    """(project, stem, path, content, is_index, hash) of Markdown files (path, value), named by the folder above ``memory``; blank ones are left out."""
    kept = files.filter(F.col("path").rlike(r"\.md$") & (F.coalesce(strip(F.col("value")), F.lit("")) != ""))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    project = F.regexp_extract("path", r"([^/]+)/(?:memory/)?[^/]+$", 1)
    return kept.select(project.alias("project"), stem.alias("stem"), "path", F.col("value").alias("content"), (stem == "MEMORY").alias("is_index"), F.sha2("value", 256).alias("hash"))


def byte_chunks(docs: DataFrame, most: int, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, part, text): texts in parts of ``most`` bytes of UTF-8 at most, cut at line ends, else between characters. From the second part on, the heading of the text comes first."""
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    return source.mapInArrow(lambda batches: _cut(batches, most), f"doc {source.schema['doc'].dataType.simpleString()}, part long, text string")


def _cut(batches, most: int):
    """Record batches of the parts of (doc, text), of about ``TOGETHER`` characters or one longer text: no more of a batch becomes Python strings at once."""
    for batch in batches:
        ids, n, parts, size = [], [], [], 0
        for k in range(batch.num_rows):
            found = _parts(batch.column(1)[k].as_py() or "", most)
            ids += [batch.column(0)[k].as_py()] * len(found)
            n += range(len(found))
            parts += found
            size += sum(map(len, found))
            if size >= TOGETHER or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(n, pa.int64()), pa.array(parts, pa.string())], names=["doc", "part", "text"])
                ids, n, parts, size = [], [], [], 0


def _parts(text: str, most: int) -> list[str]:
    if len(text.encode()) <= most:
        return [text]
    first = re.match(r"#{1,6} [^\n]*", text)
    head = f"{first.group()} (continued)\n\n" if first and 2 * len(first.group().encode()) < most else ""
    room, out, now = most - len(head.encode()), [], b""
    for line in text.splitlines(keepends=True):
        raw = line.encode()
        while raw:
            free = room - len(now)
            if len(raw) <= free:
                now, raw = now + raw, b""
            elif now and len(raw) <= room:
                out.append(now)
                now = b""
            else:
                cut = free
                while cut > 0 and raw[cut] & 0xC0 == 0x80:  # not inside a character
                    cut -= 1
                if cut == 0 and not now:
                    raise ValueError("a part cannot hold one character")
                out.append(now + raw[:cut])
                now, raw = b"", raw[cut:]
    texts = [x.decode() for x in [*out, now] if x]
    return [texts[0], *(head + t for t in texts[1:])]


def export_bundle(profile: DataFrame, active: DataFrame, observations: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """(role, doc, part, name, text, bytes, sha256): the files of an export, cut to ``most`` bytes, with what its manifest lists."""
    sides = [("profile", profile), ("active", active), *([("observations", observations)] if observations is not None else [])]
    out = None
    for role, docs in sides:
        one = byte_chunks(docs, most).withColumn("role", F.lit(role))
        out = one if out is None else out.unionByName(one)
    name = F.concat_ws("-", "role", F.col("doc").cast("string"), F.lpad((F.col("part") + 1).cast("string"), 2, "0"))
    return out.select("role", "doc", "part", F.concat(name, F.lit(".md")).alias("name"), "text", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
